"""The crawl: a queue worked off in rounds, each a step over tables, that are written down and read again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markdown as M
from .functions import urls as U
from .operators import store as S
from .operators.index import shared_dir
from .sources import html, robots

# Priorities of a seed, of a sitemap's urls and of links, and links that a round may add for each place in it.
SEED, LISTED, LINKED, LINKS_PER_PLACE, SHORTEST = 1.0, 0.5, 0.3, 20, 200
_QUEUE = "url string, depth int, priority double, status string, discovered_at bigint, attempts int, error string"
_DOCS = "url string, title string, markdown string, lang string, published string"
_OUTCOMES = "url string, status string, reason string, round int"


@dataclass(frozen=True)
class State:
    queue: DataFrame
    docs: DataFrame
    outcomes: DataFrame


def start(spark: SparkSession) -> State:
    empty = lambda kind: spark.createDataFrame([], kind)
    return State(empty(_QUEUE), empty(_DOCS), empty(_OUTCOMES))


def seeded(state: State, seed: str, sitemaps: DataFrame | None = None) -> tuple[State, str | None]:
    """The queue with a seed and the urls that its host's sitemaps (root, loc) list in its folder; and that folder."""
    spark = state.queue.sparkSession
    one = spark.createDataFrame([(seed,)], "url string").select("url", F.lit(0).alias("depth"), F.lit(SEED).alias("priority"), U.scope(F.col("url")).alias("folder"))
    folder = one.first()["folder"]
    found = one.drop("folder")
    if sitemaps is not None:
        listed = sitemaps.where(U.in_scope(F.col("loc"), F.lit(seed), F.lit(folder).cast("string")))
        found = found.unionByName(listed.select(F.col("loc").alias("url"), F.lit(1).alias("depth"), F.lit(LISTED).alias("priority")))
    return replace(state, queue=_enqueued(state.queue, found, 0)), folder


def _enqueued(queue: DataFrame, found: DataFrame, now: int) -> DataFrame:
    new = S.enqueue(queue.select("url", "depth", "priority", "status"), found)
    old = queue.select("url", "discovered_at", "attempts", "error")
    return new.join(old, "url", "left").select("url", F.col("depth").cast("int"), F.col("priority").cast("double"), "status", F.coalesce("discovered_at", F.lit(now)).cast("long").alias("discovered_at"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "error")


def judged(fetched: DataFrame) -> DataFrame:
    """fetched: url, status, content_type, html: what came of each page, and its text where it is to be indexed."""
    ok, kind = F.col("status") == 200, F.col("content_type").rlike("(?i)html|xml")
    pages = html.extract(fetched.withColumn("page_id", F.xxhash64("url"))).select("page_id", "title", "text", "lang", "published")
    rows = fetched.withColumn("page_id", F.xxhash64("url")).join(pages, "page_id")
    reason = F.when(F.col("status") == 304, "not modified").when(~ok, F.concat(F.lit("status "), F.col("status").cast("string"))).when(~kind, "not a page").when(F.length("text") < SHORTEST, "too little text")
    status = F.when(F.col("status") == 304, "unchanged").when(reason.isNull(), "indexed").when(F.col("status") >= 400, "error").otherwise("skipped")
    return rows.select("url", status.alias("status"), reason.alias("reason"), "title", F.col("text").alias("markdown"), "lang", "published")


def drain(state: State, fetch: Callable[[DataFrame], DataFrame], files: DataFrame | None = None, folder: str | None = None, budget: int | None = None, places: int = 4, agent: str = "quarrybot/1.0", follow: bool = True, on_round: Callable[[int, DataFrame], None] | None = None) -> State:
    """Works the queue off. fetch: gives (url, status, content_type, html) for urls; files: robots bodies by host.

    A round claims as many urls as there are places and the budget leaves, marks what robots rules refuse as skipped, fetches
    the rest, takes pages in, and adds links of new pages that lie in the folder of the round's first and aren't known. Its
    tables are written to the shared folder, so a round never reaches back over another.
    """
    spark = state.queue.sparkSession
    root = f"{shared_dir(spark)}/crawl-{spark.sparkContext.applicationId}-{id(state):x}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    done, turn = state.outcomes.count(), 0
    while True:
        left = places if budget is None else min(places, budget - done)
        turn += 1
        batch = kept(S.claim(state.queue, max(0, left)).select("url"), f"batch-{turn}") if left > 0 else None
        n = batch.count() if batch is not None else 0
        if not n:
            return state
        allowed = batch
        if files is not None:
            at = batch.select("url", U.host(F.col("url")).alias("host"), U.target(F.col("url")).alias("path"))
            rules = robots.allowed(at.select("host", "path").distinct(), files, agent)
            allowed = at.join(rules.where("allow"), ["host", "path"]).select("url")
        seen = kept(judged(fetch(allowed)), f"seen-{turn}")
        refused = batch.join(seen.select("url"), "url", "left_anti").select("url", F.lit("skipped").alias("status"), F.lit("refused by robots").alias("reason"))
        results = seen.select("url", "status", "reason").unionByName(refused).withColumn("round", F.lit(turn))
        docs = S.upsert(state.docs, seen.where("status = 'indexed'").select("url", "title", "markdown", "lang", "published"), "url", ["url"])
        queue = S.complete(state.queue, results.select("url", F.when(F.col("status") == "error", "error").otherwise("done").alias("status"), F.col("reason").alias("error")))
        docs, outcomes = kept(docs, f"docs-{turn}"), kept(state.outcomes.unionByName(results), f"outcomes-{turn}")
        new = seen.where("status = 'indexed'")
        first = new.select("url").orderBy("url").first() if follow else None
        if first:
            links = new.select(F.explode(M.internal_links(F.col("markdown"))).alias("url")).limit(LINKS_PER_PLACE * places)
            links = links.join(docs.select("url"), "url", "left_anti").where(U.in_scope(F.col("url"), F.lit(first["url"]), F.lit(folder).cast("string")))
            queue = _enqueued(queue, links.select("url", F.lit(1).alias("depth"), F.lit(LINKED).alias("priority")), turn)
        state = State(kept(queue.select(*(x.split()[0] for x in _QUEUE.split(", "))), f"queue-{turn}"), docs, outcomes)
        done += n
        if on_round is not None:
            on_round(turn, results)
