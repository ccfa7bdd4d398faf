"""Hand-offs between jobs and the byte kernels that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where it is unset a temporary one (local masters) or one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="quarryspark-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quarryspark"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Parquet hand-offs of one operator call. They survive lost executors, cut lineage, and can be dropped early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, start: str = "q") -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, start
    while name in taken:
        name += "_"
    return name


def text_key(text="text"):
    """With doc_id it tells a row's text from others of the same id; rows that agree in both are one document."""
    from pyspark.sql import functions as F

    return F.xxhash64(text)


def without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """docs without the rows of out (doc_id, text_key), all columns as they were. Null ids are equal to one another."""
    from pyspark.sql import functions as F

    key, i = fresh(docs), fresh(docs, "i")
    out = out.select(F.col("doc_id").alias(i), F.col("text_key").alias(key)).distinct()
    mine = docs.withColumn(key, text_key())
    on = mine["doc_id"].cast("long").eqNullSafe(out[i]) & (mine[key] == out[key])
    return mine.join(out, on, "left_anti").select(*(f"`{c}`" for c in docs.columns))


#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(CHUNK * 2, n)
        out = []
        for b in (int(_BASES[base]), pow(int(_BASES[base]), -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and each row's bounds in them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_string_view(column.type) or not len(column):
        column = column.cast(pa.large_string())
    large = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _cuts(data: np.ndarray, off: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end at a row's end or before a separator, so no word is cut."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + CHUNK, n)
        if b < n:
            ends = int(off[np.searchsorted(off, b, "left")])
            at = b
            while at < ends and not space[data[at]]:
                step = np.flatnonzero(space[data[at : min(at + 4096, ends)]])
                at = at + int(step[0]) if len(step) else min(at + 4096, ends)
                if len(step):
                    break
            b = at
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, hashes: int = 1, bounds: bool = False, space: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()):
    """Hashes of the words of every row: runs of bytes that aren't in space, so [^\\x20\\x09-\\x0D]+ by default.

    Returns (hash arrays, offsets of each row's words[, starts, ends in bytes]). A word's hash is a polynomial over
    its bytes modulo 2^64, taken from prefix sums, then mixed; two arrays come from different bases. prefixes: further arrays, with the hash of each word's
    first so many bytes, and 0 for words that have no more.
    """
    hs: list[list[np.ndarray]] = [[] for _ in range(hashes + len(prefixes))]
    starts, ends = [], []
    for a, b in _cuts(data, off, space):
        seg = data[a:b]
        if lower:
            seg = LOWER[seg]
        solid = ~space[seg]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = off[np.searchsorted(off, a, "left") : np.searchsorted(off, b, "left")] - a
        edge = edge[(edge >= 0) & (edge < b - a)]
        first[edge[solid[edge]]] = True
        edge = edge[edge > 0]
        last[edge[solid[edge - 1]] - 1] = True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        wide = seg.astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(seg) + 1, np.uint64)
        for i in range(hashes):
            p, q = _powers(i, len(seg) + 1)
            np.cumsum(wide * p[: len(seg)], out=total[1:])
            hs[i].append(mix((total[e] - total[s]) * q[s]))
        for i, most in enumerate(prefixes):
            long = e - s > most
            hs[hashes + i].append(np.where(long, mix((total[np.minimum(e, s + most)] - total[s]) * q[s] + np.uint64(most)), np.uint64(0)))
        starts.append(s + a)
        ends.append(e + a)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    at = np.searchsorted(s, off, "left")
    out = [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hs]
    return (out, at, s, np.concatenate(ends) if ends else s) if bounds else (out, at)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at each start that has k words after it, across rows; callers drop those that cross rows."""
    base, out, width, span, step = np.uint64(0xA24BAED4963EE407), None, 0, h, 1
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    power = int(base)
    while True:  # k in binary: blocks of 1, 2, 4, ... words, put together by a polynomial
        if k & step:
            if out is None:
                out, width = span[: n - step + 1], step
            else:
                m = n - width - step + 1
                out, width = out[:m] * np.uint64(power) + span[width : width + m], width + step
        if width == k:
            break
        m = n - 2 * step + 1
        span = span[:m] * np.uint64(power) + span[step : step + m]
        step, power = step * 2, power * power % (1 << 64)
    return mix(out.copy() + np.uint64(k))


def inside(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which starts have their k words in one row, and the offsets of each row's among those that do."""
    n = np.maximum(np.diff(at) - k + 1, 0)
    keep = np.zeros(max(0, int(at[-1]) - k + 1), bool)
    ends = np.minimum(at[:-1] + n, len(keep))
    delta = np.zeros(len(keep) + 1, np.int32)
    some = n > 0
    np.add.at(delta, at[:-1][some], 1)
    np.add.at(delta, ends[some], -1)
    keep = np.cumsum(delta[:-1]) > 0
    return keep, np.concatenate([[0], np.cumsum(n)])


def shingles(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles (with repeats), words lower-cased A-Z; a row of 1 to k-1 words has one shingle of all of them, an empty row none."""
    (h,), at = words(data, off, lower=True)
    keep, to = inside(at, k)
    g = grams(h, k)[keep] if len(h) >= k else np.zeros(0, np.uint64)
    n = np.diff(at)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return g, to
    whole = np.empty(len(short), np.uint64)
    for i, r in enumerate(short):
        x = h[at[r] : at[r + 1]]
        whole[i] = grams(x, len(x))[0]
    return np.insert(g, to[short], whole), to + np.concatenate([[0], np.cumsum((n > 0) & (n < k))])


def row_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted, with their counts, and the rows' offsets among them."""
    row = row_of(off)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(off) - 1))])


def held(doc_id, modulus: int, remainder: int):
    """Whether crc32(doc_id as text) mod modulus is remainder."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder


#: Bytes of text that a training sample has at most, and classes of labels.
SAMPLE_BYTES, CLASSES = 64 << 20, 256


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int, cut: bool = False, sample_bytes: int = SAMPLE_BYTES, classes: int = CLASSES):
    """A bounded training sample as pandas: doc_id, text, y.

    labels: doc_id, y. Of each y (the `classes` most frequent ones) the per_class rows that come first by a hash of the id,
    as far as sample_bytes, shared evenly among the classes, reach; texts over most_bytes are left out, or with cut go in
    with their first most_bytes characters. Where an id repeats with several texts one of them is taken. Two scans: the
    first gives ids and sizes of little more than per_class rows a class, the second the chosen texts.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and y is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "y")
    counts = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(classes).collect()
    none = pd.DataFrame({"doc_id": [], "text": [], "y": []})
    if not counts:
        return none
    want = per_class + 6 * per_class**0.5 + 16  # hashes below a bound: so many are expected, and per_class are found but for odds of 1e-8
    bound = F.create_map(*(x for r in counts for x in (F.lit(r["y"]), F.lit(min((1 << 63) - 1, int(want / r["n"] * 2.0**63))))))
    order = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1))
    first = labels.withColumn("h", order).where(F.col("h") <= F.element_at(bound, F.col("y"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumn("k", text_key())
    sizes = texts.join(F.broadcast(first), "doc_id").groupBy("doc_id", "y", "h").agg(F.min(F.struct("k", F.octet_length("text").alias("n"))).alias("x")).select("doc_id", "y", "h", "x.k", "x.n")
    chosen, used, each = [], {}, sample_bytes // len(counts)
    for r in sorted(sizes.collect(), key=lambda r: (r["h"], r["doc_id"])):
        n, (rows, size) = min(r["n"], most_bytes) if cut else r["n"], used.get(r["y"], (0, 0))
        if n <= most_bytes and rows < per_class and (size + n <= each or not rows):
            used[r["y"]] = rows + 1, size + n
            chosen.append((r["doc_id"], r["k"], r["y"]))
    if not chosen:
        return none
    kind = labels.schema["y"].dataType.simpleString()
    rows = spark.createDataFrame(chosen, f"doc_id bigint, k bigint, y {kind}")
    text = F.substring("text", 1, most_bytes) if cut else F.col("text")
    found = texts.join(F.broadcast(rows), ["doc_id", "k"]).select("doc_id", "y", text.alias("text")).toPandas()
    return found.drop_duplicates(["doc_id", "y"]).sort_values(["doc_id", "y"]).reset_index(drop=True)


def apart(y: np.ndarray, every: int = 4) -> np.ndarray:
    """Which training rows are kept back to fit a curve or a threshold: every fourth of each class, and none where a class would have none."""
    out = np.zeros(len(y), bool)
    for c in np.unique(y):
        out[np.flatnonzero(y == c)[every - 1 :: every]] = True
    return out if all(out[y == c].any() for c in np.unique(y)) else np.zeros(len(y), bool)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
