"""Table upkeep: upserts, chunk replacement, aliases, the crawl queue, politeness, limiter, expiry. Every state is a table; a change is a new table."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(table: DataFrame, changes: DataFrame, key: str, order: list) -> DataFrame:
    """Latest change of each key wins over the table; other rows stay."""
    latest = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return table.join(latest.select(key), key, "left_anti").select(table.columns).unionByName(latest.select(table.columns))


def replace_chunks(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks of the changed urls: ids that are gone go, others are replaced; a vector stays only while the content hash does. Columns: id, url, content_hash, vector."""
    old = table.select("id", F.col("content_hash").alias("old_hash"), F.col("vector").alias("old_vector"))
    new = changes.drop("vector").join(old, "id", "left").withColumn("vector", F.when(F.expr("content_hash <=> old_hash"), F.col("old_vector"))).drop("old_hash", "old_vector")
    rest = table.join(changes.select("url").distinct(), "url", "left_anti")
    return rest.select(table.columns).unionByName(new.select(table.columns))


def delete_cascade(docs: DataFrame, chunks: DataFrame, aliases: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and aliases without those of the urls in gone."""
    return docs.join(gone, "url", "left_anti"), chunks.join(gone, "url", "left_anti"), aliases.join(gone.select(F.col("url").alias("to_url")), "to_url", "left_anti")


def resolve_aliases(urls: DataFrame, aliases: DataFrame, hops: int = 5) -> DataFrame:
    """(url, target): follows from_url -> to_url up to hops times, and stops where a url was seen before."""
    edge = aliases.where("from_url <> to_url")
    out = urls.select("url", F.col("url").alias("target"), F.array("url").alias("seen"))
    for _ in range(hops):
        out = out.join(edge.select(F.col("from_url").alias("target"), F.col("to_url").alias("_to")), "target", "left")
        on = F.col("_to").isNotNull() & ~F.array_contains("seen", F.col("_to"))
        out = out.select("url", F.when(on, F.col("_to")).otherwise(F.col("target")).alias("target"), F.when(on, F.concat("seen", F.array("_to"))).otherwise(F.col("seen")).alias("seen"))
    return out.select("url", "target")


def prune_aliases(aliases: DataFrame, docs: DataFrame) -> DataFrame:
    """Aliases whose target is a known document."""
    return aliases.join(docs.select(F.col("url").alias("to_url")).distinct(), "to_url", "left_semi")


def enqueue(queue: DataFrame, found: DataFrame) -> DataFrame:
    """queue: url, depth, priority, status. Known urls take the smaller depth and the larger priority; finished ones wait again."""
    new = found.where(F.col("url").rlike("(?i)^https?://[^/?#]")).groupBy("url").agg(F.min("depth").alias("_d"), F.max("priority").alias("_p"))
    out = queue.join(new, "url", "full")
    again = F.col("_d").isNotNull() & F.col("status").isin("done", "error")
    return out.select("url", F.least("depth", "_d").alias("depth"), F.greatest("priority", "_p").alias("priority"), F.when(again | F.col("status").isNull(), "pending").otherwise(F.col("status")).alias("status"))


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The next n waiting urls: priority, then first found. One writer takes a batch; it is marked active in the next table."""
    return queue.where("status = 'pending'").orderBy(F.desc("priority"), "discovered_at", "url").limit(n).select("url", "priority", F.lit("active").alias("status"), (F.col("attempts") + 1).alias("attempts"))


def polite_schedule(rows: DataFrame, default_ms: int = 1000) -> DataFrame:
    """rows: host, url, order, crawl_delay_ms: when each url of a host may be fetched, in ms from the start."""
    delay = F.greatest(F.lit(default_ms).cast("long"), F.coalesce("crawl_delay_ms", F.lit(0)).cast("long"))
    return rows.select("host", "url", ((F.row_number().over(Window.partitionBy("host").orderBy("order", "url")) - 1) * delay).cast("long").alias("at_ms"))


def millis(ts: Column) -> Column:
    """Milliseconds since 1970, rounded half up."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000).cast("long")


#: Windows that a segment of a key's time is long: a busy key's requests are dealt out by segments.
SEGMENT = 64


def rate_limit(rows: DataFrame, limit: int, window_ms: int, segment: int = SEGMENT) -> DataFrame:
    """rows: key, t_ms, id: (key, id, allowed, used) under windows that begin at a key's first request and end after window_ms.

    A window's start depends on the one before it, so no SQL frame can hold it. Time is cut into segments of `segment` windows;
    a segment tells, for every start it may inherit, which start and count it hands on. That is a step function with few steps,
    as chains that begin at different requests soon meet. One row a segment is then walked along a key, and the segments'
    requests are numbered in parallel. Tasks read sorted requests as a stream and hold one segment of one key.
    """
    span = segment * window_ms
    rows = rows.select("key", "t_ms", "id").withColumns({"k": F.xxhash64("key"), "seg": F.floor(F.col("t_ms") / span).cast("long")})
    dealt = rows.repartition("k", "seg").sortWithinPartitions("k", "seg", "t_ms", "id")
    steps = dealt.select("k", "seg", "t_ms").mapInArrow(_segments(_steps(window_ms), _as_steps), "k bigint, seg bigint, n bigint, ups array<bigint>, starts array<bigint>, used array<bigint>")
    walked = steps.repartition("k").sortWithinPartitions("k", "seg").mapInArrow(_walk(window_ms), "k bigint, seg bigint, start bigint, before bigint")
    # By a hash of both: by the join's own columns it would be left out as done already, and lost when the join becomes a broadcast at run time.
    both = rows.join(walked, ["k", "seg"]).withColumn("start", F.coalesce("start", F.lit(_NONE))).repartition(F.xxhash64("k", "seg")).sortWithinPartitions("k", "seg", "t_ms", "id")
    kind = rows.schema["key"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    return both.select("k", "seg", "t_ms", "key", "id", "start", "before").mapInArrow(_segments(_numbered(window_ms), _as_numbers(limit)), f"key {kind[0]}, id {kind[1]}, allowed boolean, used int")


#: Stands for no start.
_NONE = -(1 << 63)


def _segments(each, finish):
    """finish(rows, [each(columns, a, b) of every segment]) over batches that are sorted by k and seg; a segment may span batches. columns: numbers by name; a, b: the segment's rows."""

    def whole(table: pa.Table, upto: int, cuts: list[int], columns: dict) -> pa.RecordBatch:
        return finish(table.slice(0, upto), [each(columns, a, b) for a, b in zip(cuts, cuts[1:])])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            columns = {c: table.column(c).to_numpy() for c in ("k", "seg", "t_ms", "start", "before") if c in table.column_names}
            k, seg = columns["k"], columns["seg"]
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (seg[1:] != seg[:-1])) + 1).tolist()]
            if len(cuts) > 1:
                yield whole(table, cuts[-1], cuts, columns)
            held = table.slice(cuts[-1])
        if held is not None:
            yield whole(held, held.num_rows, [0, held.num_rows], {c: held.column(c).to_numpy() for c in ("k", "seg", "t_ms", "start", "before") if c in held.column_names})

    return run


def _steps(window: int):
    """For a start s before the segment: the first of ups that is s + window or later tells the last start in it and its requests; none: the start goes on."""

    def each(columns: dict, a: int, b: int) -> tuple:
        t = columns["t_ms"][a:b]
        n, after, last = b - a, np.searchsorted(t, t + window), np.arange(b - a)
        while (more := after[last] < n).any():
            last = np.where(more, after[last].clip(max=n - 1), last)
        first = np.unique(np.searchsorted(t, t[: np.searchsorted(t, t[0] + window) + 1]))
        ends = last[first]
        keep = np.append(ends[1:] != ends[:-1], True)
        ups, ends = t[first][keep], ends[keep]
        return int(columns["k"][a]), int(columns["seg"][a]), n, ups.tolist(), t[ends].tolist(), (n - ends).tolist()

    return each


def _as_steps(_, found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], ["k", "seg", "n", "ups", "starts", "used"])


def _walk(window: int):
    """The start and the number of its requests that each segment of a key inherits, key after key in order."""

    def run(batches):
        key = start = None
        used = 0
        for batch in batches:
            out = []
            for k, seg, n, ups, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("k", "seg", "n", "ups", "starts", "used"))):
                if k != key:
                    key, start, used = k, None, 0
                out.append((k, seg, start, used))
                i = 0 if start is None else bisect_left(ups, start + window)
                start, used = (starts[i], counts[i]) if i < len(ups) else (start, used + n)
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k", "seg", "start", "before"])

    return run


def _numbered(window: int):
    """The place of each request in its window."""

    def each(columns: dict, a: int, b: int) -> np.ndarray:
        t, start, used = columns["t_ms"][a:b], int(columns["start"][a]), int(columns["before"][a])
        out, at = np.empty(b - a, np.int64), 0
        while at < b - a:
            end = int(np.searchsorted(t, start + window)) if start != _NONE else 0
            if end <= at:  # the next request begins a window
                start, used, end = int(t[at]), 0, int(np.searchsorted(t, t[at] + window))
            out[at:end] = np.arange(used + 1, used + 1 + end - at)
            used, at = used + end - at, end
        return out

    return each


def _as_numbers(limit: int):
    def finish(table: pa.Table, found: list[np.ndarray]) -> pa.RecordBatch:
        used = np.concatenate(found)
        key, id_ = (pa.concat_arrays(table.column(c).chunks) for c in ("key", "id"))
        return pa.RecordBatch.from_arrays([key, id_, pa.array(used <= limit), pa.array(used, pa.int32())], ["key", "id", "allowed", "used"])

    return finish


def limiter_state(taken: DataFrame, limit: int, window_ms: int, now_ms: int) -> DataFrame:
    """What a look at the limiter shows without using anything up. taken: key, start_ms, used. An elapsed window is shown as it stands until a request replaces it."""
    left = F.greatest(F.lit(0), F.col("start_ms") + window_ms - now_ms)
    return taken.select("key", (F.col("used") < limit).alias("allowed"), F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"), F.greatest(F.lit(1), F.ceil(left / 1000)).cast("long").alias("reset_seconds"))


def evicted(taken: DataFrame, most: int, order: list) -> DataFrame:
    """The state without the keys that were first to come, once there are over `most`: limiter windows, or a cache's entries."""
    return taken.orderBy(*(F.desc(c) for c in order)).limit(most)


def live(cache: DataFrame, now: Column, order: list) -> DataFrame:
    """The latest value of each key, if it hasn't expired."""
    return cache.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where((F.col("_r") == 1) & (F.col("expires_at") >= now)).drop("_r")


def pack_sentences(target: int = 220, most: int = 400):
    """A function of arrays of sentences, one for each section of a document: their chunks. One is closed before it would pass `most` tokens and once it has `target`.

    The fold runs over token counts alone, in linear time; chunks are new offsets over the same strings.
    """

    def ends(tokens: list[int]) -> list[int]:
        found, total, open_ = [], 0, False
        for i, n in enumerate(tokens):
            if open_ and total + n > most:
                found.append(i)
                total = 0
            total, open_ = total + n, True
            if total >= target:
                found.append(i + 1)
                total, open_ = 0, False
        return found + [len(tokens)] if open_ else found

    @F.arrow_udf("array<array<array<string>>>")
    def pack(documents: pa.Array) -> pa.Array:
        sections = documents.flatten()
        strings = sections.flatten()
        tokens = ((pc.utf8_length(strings).to_numpy(zero_copy_only=False) + 3) // 4).tolist()
        cuts, chunks, of_document, at = [0], [0], [0], 0
        for n in pc.list_value_length(sections).to_pylist():
            found = ends(tokens[at : at + (n or 0)])
            cuts += [at + e for e in found]
            chunks.append(chunks[-1] + len(found))
            at += n or 0
        for n in pc.list_value_length(documents).to_pylist():
            of_document.append(of_document[-1] + (n or 0))
        inner = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), strings.cast(pa.string()))
        return pa.ListArray.from_arrays(pa.array(of_document, pa.int32()), pa.ListArray.from_arrays(pa.array(chunks, pa.int32()), inner))

    return pack


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue with the status and error of what was worked off. done: url, status, error, each url once."""
    new = done.select("url", F.col("status").alias("_s"), F.col("error").alias("_e"))
    out = queue.drop("error").join(new, "url", "left")
    return out.withColumn("status", F.coalesce("_s", "status")).withColumnRenamed("_e", "error").drop("_s")


def host_cap(rows: DataFrame, order: list, most: int = 500) -> DataFrame:
    """Marks what a host has beyond `most` pages as skipped. rows: host, url."""
    return rows.withColumn("skipped", F.row_number().over(Window.partitionBy("host").orderBy(*order)) > most)


def admit(requests: DataFrame, keys: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """requests: key, t_ms, id: (id, status) with 401 for unknown keys, 429 beyond the limit, else 200. A refused key uses up nothing."""
    known = requests.join(keys.select("key").distinct(), "key", "left_semi")
    status = F.when(F.col("allowed"), 200).otherwise(429)
    out = rate_limit(known, limit, window_ms).select("id", status.alias("status"))
    return out.unionByName(requests.join(keys.select("key").distinct(), "key", "left_anti").select("id", F.lit(401).alias("status")))


def latest_trace(traces: DataFrame, trace_id: str) -> DataFrame:
    """The last one saved under an id. traces: trace_id, saved_at, body."""
    return traces.where(F.col("trace_id") == trace_id).orderBy(F.desc("saved_at")).limit(1)


def get(table: DataFrame, keys: DataFrame, key: str = "url") -> DataFrame:
    """The rows of a batch of keys; keys that the table doesn't have give none."""
    return table.join(keys.select(key).distinct(), key, "left_semi").select(table.columns)


def chunks_of(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """The chunks of some urls in their order."""
    return get(chunks, urls).orderBy("url", "ord")


def set_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with new vectors (id, vector) where there are any."""
    return chunks.join(vectors.select("id", F.col("vector").alias("_v")), "id", "left").withColumn("vector", F.coalesce("_v", "vector")).select(chunks.columns)


def vector_counts(chunks: DataFrame) -> DataFrame:
    """chunks, vectors, has_vectors."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count("vector").alias("vectors")).withColumn("has_vectors", F.col("vectors") > 0)


def embed_missing(chunks: DataFrame, embedder, most: int = 2000) -> DataFrame:
    """chunks with vectors for the first `most` (by id) that have none. embedder: gives (id, vector) for (id, text), the text being heading path and text."""
    missing = chunks.where("vector is null").orderBy("id").limit(most)
    return set_vectors(chunks, embedder(missing.select("id", F.concat(F.concat_ws(" > ", "heading_path"), F.lit("\n"), F.col("text")).alias("text"))))


def touched(docs: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """docs after these urls came back unchanged: fetched now, stale."""
    hit = urls.select("url", F.lit(True).alias("_t")).distinct()
    out = docs.join(hit, "url", "left")
    return out.withColumns({"fetched_at": F.when(F.col("_t"), now).otherwise(F.col("fetched_at")), "stale": F.when(F.col("_t"), 1).otherwise(F.col("stale"))}).select(docs.columns)


def fresh_enough(docs: DataFrame) -> DataFrame:
    """docs without stale ones whose status isn't ok."""
    return docs.where((F.coalesce("stale", F.lit(0)) == 0) | (F.coalesce("status", F.lit("")) == "ok"))


def upsert_aliases(aliases: DataFrame, seen: DataFrame) -> DataFrame:
    """Redirects by from_url, the latest wins; one to itself is none. Columns: from_url, to_url, seen_at."""
    return upsert(aliases, seen.where("from_url <> to_url"), "from_url", [F.desc("seen_at"), F.desc("to_url")])


def capped(content: Column, most: int) -> Column:
    """The first `most` bytes of a body."""
    return F.substring(content, 1, most)


def save_trace(spark_rows: DataFrame, path: str) -> None:
    """Appends traces (trace_id, saved_at, body); the latest of an id counts."""
    spark_rows.select("trace_id", "saved_at", "body").write.mode("append").parquet(path)
