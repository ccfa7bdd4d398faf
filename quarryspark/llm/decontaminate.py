"""Benchmark decontamination by size-partitioned MinHash containment search (operator 5).

Items are partitioned by size into classes of 2^c to 2^(c+1)-1 shingles. For a class, every document is read as segments
of 2^(c+2) shingles that overlap by half, so any item of the class that a document holds lies in one segment, and the
sizes of the two sets differ by a bounded factor: a containment of 0.8 is then a Jaccard similarity of 0.19 or more for
every document length. One register of 48 that agrees makes a candidate (a miss has odds under 0.81^48 = 4e-5; 1e-6 for
a verbatim passage). Minima are taken once over blocks of 16 shingles and put together for the larger classes. Items of
under 16 shingles keep all their shingles instead of minima. Candidates are verified: the share of the item's distinct
shingles that the whole document holds. An item whose 0.8 lie scattered over many segments is a candidate as well: each
segment adds the odds of its own share, and even one shingle a segment leaves a miss under 5e-4 (tests measure it).

Documents are never shuffled: distinct item texts go out to the tasks in blocks of a bounded number and size, each in a pass
over the documents; a block's size is checked before it is broadcast.

Defined results: words are runs of non-white-space bytes, A-Z lower-cased; an item of 1 to 4 words is contained where its
words follow one another; null and empty items or documents match nothing; items and rows that repeat, have no id, or share
an id with another text are each reported; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, grams, inside, mix, row_of, runs, text_bytes, words

WORDS, REGISTERS, BLOCK, THRESHOLD = 5, 48, 16, 0.8
#: Items that go out to the tasks at a time; more are searched for in further passes over the documents.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 32 << 20
_SIEVE = 1 << 18
_SCHEMA = "doc_id bigint, item_id bigint, containment double, n_shared bigint, n_item bigint"
_FOUND = _SCHEMA.replace("item_id bigint", "item string")
_MULTIPLY = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64))


class Items:
    """One block of item texts, prepared for the search."""

    def __init__(self, texts: list[str | None]):
        data, off = text_bytes(pa.array(texts, pa.large_string()))
        (h,), at = words(data, off, lower=True)
        n = np.diff(at)
        g, to = _shingles(h, at, WORDS)
        #: Under WORDS words: by their number, the hash of all of them.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, WORDS):
            rows = np.flatnonzero(n == k)
            if len(rows):
                hs = np.array([grams(h[at[r] : at[r + 1]], k)[0] for r in rows], np.uint64)
                order = np.argsort(hs, kind="stable")
                self.short[k] = (hs[order], rows[order])
        self.sets, _, self.set_at = distinct(g, to)
        size = np.diff(self.set_at)
        #: Class 0: all shingles of the items of under BLOCK. Class c: the minima of each register.
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        small = np.flatnonzero((np.diff(to) < BLOCK) & (size > 0))
        if len(small):
            row = np.repeat(small, size[small])
            self.classes[0] = [_index(np.concatenate([self.sets[self.set_at[r] : self.set_at[r + 1]] for r in small]), row)]
        of_class = np.where(np.diff(to) >= BLOCK, np.log2(np.maximum(np.diff(to), 1)).astype(int), 0)
        for c in sorted({*of_class[of_class > 0].tolist()}):
            rows = np.flatnonzero(of_class == c)
            minima = [[(x * m + a).min() for m, a in zip(_MULTIPLY, _ADD)] for r in rows for x in [self.sets[self.set_at[r] : self.set_at[r + 1]]]]
            self.classes[c] = [_index(np.array(col, np.uint64), rows) for col in zip(*minima)]

    def find(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(document row, item row, shared, of) of every hit in documents given as word hashes."""
        out = []
        for k, (hs, rows) in self.short.items():
            keep, to = inside(at, k)
            row = row_of(to)
            x = grams(h, k)[keep] if len(h) >= k else np.zeros(0, np.uint64)
            found = np.unique(_match(x, row, hs, rows), axis=0)
            out.append(np.column_stack([found, np.ones((len(found), 2), np.int64)]))
        g, to = _shingles(h, at, WORDS)
        if not len(g) or not self.classes:
            return np.concatenate([np.zeros((0, 4), np.int64), *out])
        pairs = [np.zeros((0, 2), np.int64)]
        if 0 in self.classes:
            pairs.append(_match(g, row_of(to), *self.classes[0][0]))
        large = [c for c in self.classes if c]
        if large:
            n = np.diff(to)
            blocks = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
            first = np.repeat(to[:-1], np.diff(blocks)) + BLOCK * (np.arange(blocks[-1]) - np.repeat(blocks[:-1], np.diff(blocks)))
            segments = {c: _segments(blocks, 1 << (c - 2), 1 << (c - 3)) for c in large}
            for k in range(REGISTERS):
                low = np.append(np.minimum.reduceat(g * _MULTIPLY[k] + _ADD[k], first), np.uint64(0))
                for c, (row, bounds) in segments.items():
                    pairs.append(_match(np.minimum.reduceat(low, bounds)[::2], row, *self.classes[c][k]))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        at_row = -1
        for r, i in pairs:
            if r != at_row:
                at_row, have = r, np.unique(g[to[r] : to[r + 1]])
            want = self.sets[self.set_at[i] : self.set_at[i + 1]]
            p = np.minimum(np.searchsorted(have, want), len(have) - 1)
            shared = int((have[p] == want).sum())
            if shared / len(want) >= THRESHOLD:
                out.append(np.array([[r, i, shared, len(want)]], np.int64))
        return np.concatenate([np.zeros((0, 4), np.int64), *out])


def _shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep, to = inside(at, k)
    return (grams(h, k)[keep] if len(h) >= k else np.zeros(0, np.uint64)), to


def _index(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    return values[order], np.asarray(rows)[order]


def _segments(blocks: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Document rows, and interleaved first and last-plus-one blocks, of the segments of each document."""
    n = np.diff(blocks)
    count = np.where(n > 0, np.maximum(1, -(-(n - (length - stride)) // stride)), 0)
    row = np.repeat(np.arange(len(n)), count)
    first = blocks[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    return row, np.column_stack([first, np.minimum(first + length, blocks[row + 1])]).ravel()


def _match(x: np.ndarray, row: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(row, rows[j]) wherever x equals values[j]; a table of low bits passes over most of x."""
    sieve = np.zeros(_SIEVE, bool)
    sieve[values & np.uint64(_SIEVE - 1)] = True
    may = np.flatnonzero(sieve[x & np.uint64(_SIEVE - 1)])
    x, row = x[may], row[may]
    a, b = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
    n = b - a
    j = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(np.column_stack([np.repeat(row, n), rows[j]]), axis=0) if len(j) else np.zeros((0, 2), np.int64)


def _blocks(items: DataFrame, most: int, most_bytes: int):
    """Broadcast blocks of distinct texts, none with over twice the bounds but one that has a single text."""
    spark = items.sparkSession
    texts = items.where("text is not null").select("text").distinct()
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-n // most), -(-(size or 0) // most_bytes))
    while True:
        part = F.pmod(F.xxhash64("text", F.lit("block")), F.lit(passes))
        sizes = texts.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()  # a row a pass
        if all(r["n"] <= 1 or r["n"] <= 2 * most and r["b"] <= 2 * most_bytes for r in sizes):
            break
        passes *= 2
    for r in sorted(sizes, key=lambda r: r["p"]):
        found = [x["text"] for x in texts.where(part == r["p"]).collect()]
        yield spark.sparkContext.broadcast((Items(found), found))


def contained(docs: DataFrame, items: DataFrame, items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """(doc_id, item_id, containment, n_shared, n_item) for every item of which a document holds 0.8 or more."""
    docs, items = docs.select(F.col("doc_id").cast("long"), "text"), items.select(F.col("item_id").cast("long"), "text")
    out = None
    for block in _blocks(items, items_per_pass, bytes_per_pass):
        found = docs.mapInArrow(_searcher(block), _FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    return out.join(items.withColumnRenamed("text", "item"), "item").select("doc_id", "item_id", "containment", "n_shared", "n_item")


def _hits(items: Items, texts):
    """For ranges of rows: first row, and (row in the range, item, shared, of) of every hit."""
    data, off = text_bytes(texts)
    for a, b in runs(off, 1 << 21):
        (h,), at = words(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True)
        yield a, items.find(h, at)


def _searcher(block):
    def search(batches):
        items, texts = block.value
        for batch in batches:
            for a, hits in _hits(items, batch.column("text")):
                if len(hits):
                    r, i, shared, of = hits.T
                    found = pa.array([texts[x] for x in i.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r + a)), found, pa.array(shared / of), pa.array(shared), pa.array(of)], ["doc_id", "item", "containment", "n_shared", "n_item"])

    return search


def drop_contaminated(docs: DataFrame, items: DataFrame, items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay. Each row's own text decides, so nothing is shuffled, and passes share one scan."""
    for block in _blocks(items, items_per_pass, bytes_per_pass):
        docs = docs.where(_clean(block)("text"))
    return docs


def _clean(block):
    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items, _ = block.value
        for some in texts:
            keep = np.ones(len(some), bool)
            for a, hits in _hits(items, some):
                keep[hits[:, 0] + a] = False
            yield pa.array(keep)

    return clean


#: Exact containment for every pair that shares a shingle. Items and documents of under five words are one shingle; such an item is also looked for inside longer documents.
SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from benchmark),
gi as (select item_id, least(len(w), 5) k, unnest(list_distinct([array_to_string(w[x : x + least(len(w), 5) - 1], ' ') for x in range(1, len(w) - least(len(w), 5) + 2)])) g from i where len(w) > 0),
ks as (select distinct k from gi),
gd as (select doc_id, k, unnest(list_distinct([array_to_string(w[x : x + k - 1], ' ') for x in range(1, len(w) - k + 2)])) g from d, ks where len(w) >= k),
n as (select item_id, count(*) n_item from gi group by 1)
select doc_id, item_id, count(*)::double / n_item as containment, count(*) as n_shared, n_item
from gd join gi using (k, g) join n using (item_id) group by doc_id, item_id, n_item having count(*)::double / n_item >= 0.8
"""
