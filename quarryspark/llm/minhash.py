"""Near-duplicates by ProbMinHash, banding and exact verification (operator 1).

Shingles of five words weigh 1 + ln(count). Each sends arrivals of a Poisson process of its weight to random registers;
a register keeps the shingle that arrives first, and a text is done as soon as no later arrival can be first anywhere.
Two texts agree in a register with the probability Jaccard similarity of their weighted shingles, which for weights of 1
is the plain Jaccard similarity of their sets. 25 bands of 5 registers make buckets, and texts with repeated shingles get
the 25 of unit weights besides (without repeats both are the same): a pair at a plain 0.8 shares none of those with odds of
5e-5, however often one of the two repeats a line.

Texts with equal word sequences are one class before that. In a bucket every class is held against the bucket's hub, the
class that shares buckets with most others and so stands in the middle of its copies, and the shingle sets of such a pair are
compared in full (Jaccard 0.8 or more). Buckets that still span components take as next hub the one among the rest, for
some rounds, each in proportion to the bucket. What is open then are pairs of a bucket that fall into different components:
their classes are searched with the exact prefix filter, in the order of rarity over those classes, and an exact bound from
parity bitmaps in the join itself, so boilerplate and texts just below the threshold do not make pairs and no link within a
bucket is lost; a pair comes out at the first shingle that both prefixes share. No group is gathered in one task: buckets
are aggregated and joined, components come from distributed star contraction over the labels that a round's links join.

Defined results: words are runs of non-white-space bytes, A-Z lower-cased; texts of 1 to 4 words have one shingle; null,
empty and blank texts are never duplicates; a group's class id is its smallest doc_id; rows are known by their content, so
rows that repeat an id and a text are one document, while an id's other texts and rows without an id are documents of their
own (a group that has no id at all has null as its class id); of a group the text with the smallest id stays, the smaller
content key among equals; n_links counts the links verified for a row's text, which are those that hold its group together,
not all there are; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, distinct, mix, row_of, runs, shingles, text_bytes, text_key, without, words

WORDS, BANDS, ROWS, THRESHOLD = 5, 25, 5, 0.8
#: Rounds of hubs before the prefix filter.
HUBS = 2


def signatures(h: np.ndarray, weight: np.ndarray, at: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash of rows of distinct hashes with weights: the hash that arrives first in each register (0: no hash at all)."""
    n = len(at) - 1
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    some = np.diff(at) > 0
    row, time, turn = row_of(at), np.zeros(len(h)), 0
    while len(h):
        turn += 1
        a = mix(h ^ np.uint64(turn * 0xD6E8FEB86659FD93 % (1 << 64)))
        b = mix(a ^ np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(((a >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        to = row * registers + ((b >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, to, time)
        won = first[to] == time
        winner[to[won]] = h[won]
        last = np.where(some, first.reshape(n, registers).max(1), -1)
        on = time < last[row]
        h, weight, row, time = h[on], weight[on], row[on], time[on]
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key a band."""
    key = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, j::rows][:, :bands])
    return key


def bands(h: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct band keys, and the rows' offsets among them: those of weights 1 + ln(count), and where a shingle repeats those of unit weights too."""
    keys = band_keys(signatures(h, 1 + np.log(count), at, BANDS * ROWS))
    row = row_of(at)
    again = np.unique(row[count > 1])
    on = np.isin(row, again)
    unit = band_keys(signatures(h[on], np.ones(on.sum()), np.concatenate([[0], np.cumsum(np.diff(at)[again])]), BANDS * ROWS))
    both, new = np.concatenate([keys, np.zeros_like(keys)], 1), np.zeros(keys.shape, bool)
    both[again, BANDS:] = unit
    new[again] = unit != keys[again]
    valid = np.concatenate([np.ones(keys.shape, bool), new], 1)
    return both[valid], np.concatenate([[0], np.cumsum(valid.sum(1))])


def _prepare(batches):
    """Content key and band keys of every row."""
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        for a, b in runs(off, 1 << 20):
            part, to = data[off[a] : off[b]], off[a : b + 1] - off[a]
            hs, at = words(part, to, lower=True, hashes=2)
            n = np.diff(at)
            content = np.zeros((2, b - a), np.uint64)
            for i in (0, 1):  # the whole word sequence, as a polynomial over its words
                place = np.arange(len(hs[i]), dtype=np.uint64) - np.repeat(at[:-1], n).astype(np.uint64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hs[i] + place * np.uint64(0xC2B2AE3D27D4EB4F)))])
                content[i] = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))
            _, one, back = np.unique(content[0] ^ (content[1] << np.uint64(1)), return_index=True, return_inverse=True)
            g, to = _take(*shingles(part, to, WORDS), one)
            g, count, to = distinct(g, to)
            keys, ends = bands(g, count, to)
            keys, ends = _take(keys, ends, back)
            flat = pa.array(keys.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "text_key")), pa.array(content[0].astype(np.int64)), pa.array(content[1].astype(np.int64)), pa.array(n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)],
                ["doc_id", "text_key", "c0", "c1", "n_words", "bands"],
            )


def _take(h: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)[rows]
    to = np.concatenate([[0], np.cumsum(n)])
    return h[np.repeat(at[rows] - to[:-1], n) + np.arange(to[-1])], to


def _verify(batches):
    """The pairs whose shingle sets have a Jaccard similarity of THRESHOLD or more."""
    for batch in batches:
        sets = []
        for c in ("text_a", "text_b"):
            data, off = text_bytes(batch.column(c))
            sets.append([x for a, b in runs(off, 1 << 20) for x in _sets(data[off[a] : off[b]], off[a : b + 1] - off[a])])
        keep = []
        for i, (x, y) in enumerate(zip(*sets)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and both / (len(x) + len(y) - both) >= THRESHOLD:
                keep.append(i)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in _LINK], _LINK)


def _sets(data, off):
    g, _, to = distinct(*shingles(data, off, WORDS))
    return [g[to[i] : to[i + 1]] for i in range(len(to) - 1)]


def _explode(batches):
    """A row for each distinct shingle of a class."""
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        for a, b in runs(off, 1 << 20):
            g, _, to = distinct(*shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], WORDS))
            row = row_of(to)
            ids = batch.column("rep").slice(a, b - a).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(to)[row]), pa.array(g.astype(np.int64))], ["rep", "n", "g"])


#: Words of 64 bits in a parity map, and a prefix's first shingles that a row has along to tell whether a pair came out before.
MAP, EARLIER = 16, 32


def _parity(batches):
    """A map of 1024 bits for each class: which buckets get an odd number of its distinct shingles."""
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        for a, b in runs(off, 1 << 20):
            g, _, to = distinct(*shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], WORDS))
            bit = (mix(g.copy()) >> np.uint64(54)).astype(np.int64)
            odd = (np.bincount(row_of(to) * MAP * 64 + bit, minlength=(b - a) * MAP * 64) & 1).astype(np.uint8)
            longs = np.packbits(odd, bitorder="little").view("<i8").reshape(b - a, MAP)
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a), *(pa.array(longs[:, i].copy()) for i in range(MAP))], ["rep", *(f"m{i}" for i in range(MAP))])


#: Two vertices and the labels of their components.
_LINK = ["a", "b", "la", "lb"]


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, la, lb) with both texts compared. texts: rep, text."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select(*_LINK, "text_a", "text_b").mapInArrow(_verify, ", ".join(f"{c} bigint" for c in _LINK))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, c): every vertex of edges (a, b) with the smallest vertex of its component, by large-star and small-star steps."""
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        turn += 1
        # Large star: neighbours above a vertex go to the smallest vertex it knows.
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a vertex and its neighbours below it go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = scratch.save(small, f"{name}-{turn}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(f"{name}-{turn - 1}")
        if now == state:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
        state = now


class _Groups:
    """Components so far (v, c), taken further by the links of each round. Vertices that are in none stand for themselves."""

    def __init__(self, scratch: Scratch, texts: DataFrame):
        self.scratch, self.texts, self.comp, self.rounds = scratch, texts, None, []

    def labelled(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components, with their labels."""
        if self.comp is None:
            return pairs.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))
        for v in "ab":
            pairs = pairs.join(self.comp.select(F.col("v").alias(v), F.col("c").alias(f"l{v}")), v, "left").withColumn(f"l{v}", F.coalesce(f"l{v}", v))
        return pairs.where("la <> lb").select(*_LINK)

    def take(self, pairs: DataFrame) -> None:
        """Verifies pairs (a, b) and joins the components that links go between."""
        k, save = len(self.rounds), self.scratch.save
        found = save(links(self.labelled(pairs), self.texts), f"links-{k}")
        self.rounds.append(found)
        if self.comp is not None and not found.limit(1).count():
            return
        new = save(components(found.select(F.col("la").alias("a"), F.col("lb").alias("b")), self.scratch, f"cc-{k}"), f"new-{k}")
        if self.comp is None:
            self.comp = new
            return
        moved = self.comp.join(new.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
        self.comp = save(moved.unionByName(new.join(self.comp.select("v"), "v", "left_anti")), f"comp-{k}")

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with a column rep: the component c of each."""
        return rows.join(self.comp.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))

    def links(self) -> DataFrame:
        """(rep, n_links)."""
        ends = [r.select(F.col(v).alias("rep")) for r in self.rounds for v in "ab"]
        out = ends[0]
        for e in ends[1:]:
            out = out.unionByName(e)
        return out.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))

    def drop(self) -> None:
        for k in range(len(self.rounds)):
            self.scratch.drop(f"links-{k}", f"new-{k}", f"comp-{k}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, n_links."""
    return _judged(docs).drop("text_key")


def _judged(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key"))
    rows = scratch.save(docs.mapInArrow(_prepare, "doc_id bigint, text_key bigint, c0 bigint, c1 bigint, n_words bigint, bands array<bigint>"), "rows")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one")
    # Vertices are the rows of this table; its numbers are fixed once it is written.
    classes = rows.where("n_words > 0").groupBy("c0", "c1").agg(one, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    # Buckets of several classes.
    keys = classes.select("rep", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.save(keys.join(sizes, "key"), "shared")
    middle = shared.groupBy("rep").agg(F.sum("n").alias("middle"))
    members = scratch.save(shared.join(middle, "rep").select("key", "rep", "middle"), "members")
    scratch.drop("shared")
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("one.doc_id").alias("of"), F.col("one.text_key").alias("text_key"))
    texts = docs.withColumnRenamed("text_key", "mine").join(wanted, F.expr("doc_id <=> of and mine = text_key")).groupBy("rep").agg(F.first("text").alias("text"))
    groups = _Groups(scratch, scratch.save(texts, "texts"))

    # The hub that shares most buckets with a class, then its other hubs where they are still in other components.
    first = _hubs(members)
    spokes = scratch.save(members.join(first, "key").where("rep <> hub").groupBy("rep", "hub").count(), "spokes")
    nearest = spokes.groupBy("rep").agg(F.max(F.struct("count", "hub")).alias("x")).select(F.col("rep").alias("a"), F.col("x.hub").alias("b"))
    groups.take(nearest)
    groups.take(spokes.select(F.col("rep").alias("a"), F.col("hub").alias("b")).join(nearest, ["a", "b"], "left_anti"))

    # Buckets that span components: the rest's own hubs, then the exact prefix filter.
    for k in range(HUBS):
        rest = scratch.save(_split(groups.of(members)), f"rest-{k}")
        if k == HUBS - 1:
            break
        hubs = rest.groupBy("key").agg(F.max_by("c", F.struct("middle", "rep")).alias("top"))
        hubs = _hubs(rest.join(hubs, "key").where("c <> top"))
        groups.take(rest.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    open_ = scratch.save(rest.select("rep", "c").distinct(), "open")
    groups.take(_prefix_pairs(groups.texts.join(open_, "rep"), scratch))

    group = groups.of(classes.drop("bands"))
    lead = group.groupBy("c").agg(F.min(F.struct("one.none", "one.doc_id", "c0", "c1")).alias("lead"), F.sum("n").alias("class_size"))
    group = group.join(lead, "c").join(groups.links(), "rep", "left")
    group = scratch.save(group.select("c0", "c1", F.col("lead.doc_id").alias("class_id"), "class_size", F.expr("c0 = lead.c0 and c1 = lead.c1").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "groups")
    out = rows.where("n_words > 0").join(group, ["c0", "c1"]).select("doc_id", "text_key", "class_id", "class_size", F.expr("first and doc_id <=> class_id").alias("kept"), "n_links")
    alone = rows.where("n_words = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_links"))
    out = scratch.save(out.unionByName(alone), "out")
    groups.drop()
    scratch.drop("rows", "classes", "members", "texts", "spokes", "open", "shingles", "prefix", "groups", *(f"rest-{k}" for k in range(HUBS)))
    return out


def _hubs(members: DataFrame) -> DataFrame:
    """(key, hub): in each bucket the class that shares buckets with most others."""
    return members.groupBy("key").agg(F.max_by("rep", F.struct("middle", "rep")).alias("hub"))


def _split(members: DataFrame) -> DataFrame:
    """The rows (key, rep, middle, c) of buckets that span components."""
    split = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return members.join(split, "key").select("key", "rep", "middle", "c")


def _prefix_pairs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of classes in different components that can reach the threshold: they share one of their rarest shingles. rows: rep, text, c."""
    tokens = scratch.save(rows.select("rep", "text").mapInArrow(_explode, "rep bigint, n bigint, g bigint"), "shingles")
    often = tokens.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(often, "g").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("xs"))
    # A class's prefix: all but ceil(0.8 n) - 1 of its shingles, rarest first; those that no other class has come first and lead nowhere.
    left = F.floor((1 - THRESHOLD) * F.col("n") + 1e-9) + 1 - (F.col("n") - F.size("xs"))
    prefix = shared.withColumn("left", left.cast("int")).where("left > 0").select("rep", "n", F.slice(F.transform("xs", lambda x: x["g"]), F.lit(1), F.greatest(F.lit(0), F.col("left"))).alias("gs"))
    prefix = prefix.select("rep", "n", F.posexplode("gs").alias("i", "g"), F.slice("gs", 1, EARLIER).alias("gs"))
    prefix = prefix.select("rep", "n", "g", F.slice("gs", F.lit(1), F.least("i", F.lit(EARLIER))).alias("e")).join(rows.select("rep", "c"), "rep")
    several = prefix.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g")
    maps = rows.select("rep", "text").mapInArrow(_parity, "rep bigint" + "".join(f", m{i} bigint" for i in range(MAP)))
    prefix = scratch.save(prefix.join(several, "g").join(maps, "rep"), "prefix")
    a, b = (prefix.select("g", F.col("rep").alias(x), *(F.col(y).alias(f"{y}{x}") for y in "nce"), *(F.col(f"m{i}").alias(f"{x}{i}") for i in range(MAP))) for x in "ab")
    # Bits in which two maps differ are at most the shingles that one of the two has alone, and at 0.8 those are at most a ninth of both sizes.
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(MAP)), F.lit(0))
    close = (differ <= (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col("na") + F.col("nb")) + 1e-9) & (F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb") - 1e-9)
    return a.join(b, (a["g"] == b["g"]) & (F.col("ca") < F.col("cb")) & close & ~F.arrays_overlap("ea", "eb")).select("a", "b").distinct()


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, that of the smallest id; all columns stay."""
    return without(docs, _judged(docs).where("not kept"))
