"""Exact deduplication by a stateful stream (operator 7). DataFrame and streaming operators only.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Every row has a content locator: its file and
its place there (documents that aren't a plain scan of Parquet are written down first). Digests with ids and locators arrive
in a folder, in one or several parts; a stream takes each part as a micro-batch and keeps, in RocksDB and without expiry, one
state row per digest: the largest document id with its locator, the locator of the text that came first, and a count. In the
micro-batch itself every hit (a row whose digest another row had before it) is compared in full with the text at the state's
locator. Rows whose digest agrees but whose bytes differ are grouped by their bytes.

Defined results: null and empty texts are one group; null ids sort below all others; of rows that repeat an id and a text the
one whose locator comes last stays, as one row of each group does; rows of one id with different texts are told apart by
their locators; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: Digest rows for each partition of the state: a store takes some MB of disk whatever it holds.
ROWS_PER_STORE = 500_000
#: Hits of one text that share a copy of it in the byte check.
HITS_PER_COPY = 512


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; a text of ASCII alone takes the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _plain(docs: DataFrame) -> bool:
    """Whether every row is one of a file's: nothing but projections and filters over a single scan."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation")


def located(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names are returned: a hash of each row's file, and the row's number in it."""
    at, row = fresh(docs, "at"), fresh(docs, "row")
    place = lambda d: d.withColumns({at: F.xxhash64(d.metadataColumn("_metadata").getField("file_path")), row: d.metadataColumn("_metadata").getField("row_index")})
    try:
        if _plain(docs):
            return place(docs), at, row
    except AnalysisException:  # files of a kind that doesn't number its rows
        pass
    return place(scratch.save(docs, "source")), at, row


def keepers(stream: DataFrame) -> DataFrame:
    """The stateful operator: for each digest the keeper so far, the text that came first, and a count."""
    return stream.groupBy("digest").agg(F.max(F.struct("doc_id", "at", "row")).alias("last"), F.min(F.struct("part", "at", "row")).alias("first"), F.count(F.lit(1)).alias("n"))


class _Arrivals:
    """The folder that the stream reads, its state, and the check of each micro-batch."""

    def __init__(self, docs: DataFrame, scratch: Scratch, digest, parts: int):
        self.spark, self.scratch, self.digest, self.parts = docs.sparkSession, scratch, digest, parts
        self.docs, at, row = located(docs, scratch)
        self.texts = self.docs.select("doc_id", F.col(at).alias("at"), F.col(row).alias("row"), normalised(F.col("text")).alias("body"))
        part = F.pmod(F.xxhash64("at", "row"), F.lit(parts)).cast("int")
        more = [] if digest is sha else [sha(F.col("body")).alias("text_sha256")]
        self.rows = scratch.save(self.texts.select("doc_id", "at", "row", part.alias("part"), digest(F.col("body")).alias("digest"), *more), "digests")
        self.n = self.rows.count()

    def run(self) -> None:
        """Lets the parts arrive one after the other. self.state: the state of all; self.odd: rows whose bytes are not those that came first."""
        stores = max(12, -(-self.n // ROWS_PER_STORE))
        settings = {**_ROCKS, "spark.sql.streaming.internal.stateStore.partitions": str(stores)}
        before = {k: self.spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            for self.part in range(self.parts):
                if self.parts > 1:
                    self.rows.where(F.col("part") == self.part).write.mode("append").parquet(self.scratch.path("arrived"))
                stream = self.spark.readStream.schema(self.rows.schema).parquet(self.scratch.path("arrived" if self.parts > 1 else "digests"))
                run = keepers(stream).writeStream.outputMode("update").foreachBatch(self.check).trigger(availableNow=True).option("checkpointLocation", self.scratch.path("stream")).start()
                run.awaitTermination()
            self.state = self.read(f"state-{self.parts - 1}")
            if self.parts > 1:
                found = self.spark.read.format("statestore").load(self.scratch.path("stream"))
                names = found.schema["value"].dataType.fieldNames()
                found = found.select(F.col("key.digest").alias("digest"), *(F.col(f"value.`{k}`").alias(x) for k, x in zip(names, ("last", "first", "n"))))
                self.state = self.scratch.save(found, "state")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        self.odd = reduce(DataFrame.unionByName, [self.read(f"odd-{p}") for p in range(self.parts)])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.scratch.path(name))

    def check(self, changed: DataFrame, _: int) -> None:
        """The micro-batch: its state rows are written down, then its hits are compared with the bytes at the locators that those hold."""
        changed.write.mode("overwrite").parquet(self.scratch.path(f"state-{self.part}"))
        copies = F.floor((F.col("n") - 1) / HITS_PER_COPY).cast("int").alias("last_copy")
        groups = self.read(f"state-{self.part}").where("n > 1").select("digest", F.col("first.at").alias("first_at"), F.col("first.row").alias("first_row"), copies)
        hits = self.rows.where(F.col("part") == self.part).join(groups, "digest").where("at <> first_at or row <> first_row")
        hits = hits.select("at", "row", "digest", F.lit(True).alias("hit"), F.pmod(F.xxhash64("at", "row"), F.col("last_copy") + 1).cast("int").alias("copy"))
        firsts = groups.select(F.col("first_at").alias("at"), F.col("first_row").alias("row"), "digest", F.lit(False).alias("hit"), F.col("last_copy").alias("copy"))
        bodies = self.texts.join(hits.unionByName(firsts), ["at", "row"])
        bodies.write.mode("overwrite").parquet(self.scratch.path(f"bodies-{self.part}"))
        bodies = self.read(f"bodies-{self.part}")
        kept = bodies.where("not hit").select("digest", F.explode(F.sequence(F.lit(0), "copy")).alias("copy"), F.col("body").alias("first_body"))
        odd = bodies.where("hit").join(kept, ["digest", "copy"]).where("body <> first_body")
        odd.select("digest", "at", "row", "body").write.mode("overwrite").parquet(self.scratch.path(f"odd-{self.part}"))
        self.scratch.drop(f"bodies-{self.part}")


_OUT = "doc_id", "at", "row", "last", "n", "text_sha256"


def _judged(docs: DataFrame, scratch: Scratch, parts: int, digest) -> tuple[DataFrame, _Arrivals]:
    """Every row with its locator, its group's keeper and size."""
    come = _Arrivals(docs, scratch, digest, parts)
    rows = come.rows if "text_sha256" in come.rows.columns else come.rows.withColumn("text_sha256", F.col("digest"))
    if not come.n:
        return rows.select("doc_id", "at", "row", F.struct("doc_id", "at", "row").alias("last"), F.lit(0).cast("long").alias("n"), "text_sha256"), come
    come.run()
    state, odd = come.state.select("digest", "last", "n"), come.odd
    if odd.limit(1).count():
        # Digests that stand for several texts: their rows are grouped by their bytes; those of the text that came first have none here.
        split = odd.select("digest").distinct()
        theirs = rows.join(split, "digest", "left_semi").join(odd.drop("digest"), ["at", "row"], "left")
        groups = theirs.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "at", "row")).alias("last"), F.count(F.lit(1)).alias("n")).select(F.col("digest").alias("d"), F.col("body").alias("b"), "last", "n")
        theirs = theirs.join(groups, F.expr("digest = d and body <=> b")).select(*_OUT)
        out = rows.join(split, "digest", "left_anti").join(state, "digest").select(*_OUT).unionByName(theirs)
    else:
        out = rows.join(state, "digest").select(*_OUT)
    out = scratch.save(out, "out")
    scratch.drop("digests", "arrived", "stream", "state", *(f"{x}-{p}" for x in ("state", "odd") for p in range(parts)))
    return out, come


def exact_dedup(docs: DataFrame, parts: int = 1, digest=sha) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    parts: how many micro-batches the documents arrive in. digest: another digest, for tests of the byte check.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    out, _ = _judged(docs.select("doc_id", "text"), scratch, parts, digest)
    scratch.drop("source")
    return out.select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), _stays().alias("kept"), "text_sha256")


def _stays() -> Column:
    return (F.col("at") == F.col("last.at")) & (F.col("row") == F.col("last.row"))


def drop_exact(docs: DataFrame, parts: int = 1) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay. Rows are told apart by their locators."""
    out, come = _judged(docs, Scratch(docs.sparkSession, "exact"), parts, sha)
    rows = come.docs
    at, row = rows.columns[-2:]
    gone = out.where(~_stays()).select(F.col("at").alias(at), F.col("row").alias(row))
    return rows.join(gone, [at, row], "left_anti").select(*(f"`{c}`" for c in docs.columns))


#: One row of each group stays; where an id repeats with its text, any of its rows.
SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, row_number() over (partition by body order by doc_id desc nulls last) = 1 as kept, sha256(body) as text_sha256
from t window g as (partition by body)
"""
