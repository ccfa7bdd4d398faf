"""Aggregates that tell how well retrieval, the gate and answers do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

THRESHOLDS = (1, 3, 5)
#: Share of the required substance that an answer must carry.
SUBSTANCE = 0.6


def rank_moves(rows: DataFrame) -> DataFrame:
    """rows: item_id, before, after (ranks of the right document, null where it isn't there): hits at each threshold, moved up, moved down, dropped."""
    hits = [F.count_if(F.col("after") <= k).alias(f"at_{k}") for k in THRESHOLDS]
    return rows.agg(
        F.count(F.lit(1)).alias("items"), *hits, F.count_if(F.col("after") < F.col("before")).alias("moved_up"), F.count_if(F.col("after") > F.col("before")).alias("moved_down"),
        F.count_if(F.col("before").isNotNull() & F.col("after").isNull()).alias("dropped"),
    )


def spread_of_passes(rows: DataFrame, *columns: str) -> DataFrame:
    """Least and greatest value of each column over repeated passes."""
    return rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def reasons(rows: DataFrame, most: int = 8) -> DataFrame:
    """rows: status, reason. (reason, n): the most frequent reasons, ties in their own order."""
    return rows.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def funnel(rows: DataFrame) -> DataFrame:
    """rows: item_id, fused, kept, gated, results. Means a query, and the spread of what is returned."""
    mean = lambda c: T.round_half_up(F.avg(c)).alias(f"mean_{c}")
    return rows.agg(F.count(F.lit(1)).alias("queries"), *map(mean, ("fused", "kept", "gated", "results")), F.min("results").alias("least"), F.max("results").alias("most"))


def score_board(rows: DataFrame) -> DataFrame:
    """rows: expect ('refuse' or another), answered, substance. How many that should be declined were, and of the others how many were answered and carried what they had to."""
    refuse = F.col("expect") == "refuse"
    return rows.agg(
        F.count_if(refuse).alias("should_decline"), F.count_if(refuse & ~F.col("answered")).alias("declined"), F.count_if(~refuse).alias("should_answer"),
        F.count_if(~refuse & F.col("answered")).alias("answered"), F.count_if(~refuse & (F.col("substance") >= SUBSTANCE)).alias("carried"),
    )


def usage(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of tokens and requests; the cost is null only where no call had one."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy(*by).agg(total("input_tokens"), total("output_tokens"), total("requests"), F.sum("cost_usd").alias("cost_usd"))


def locate(queries: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """(item_id, doc_id, shared, rank): the k texts that share most content terms with a query."""
    asked = queries.select("item_id", F.explode(T.content_terms(F.col("text"))).alias("term"))
    have = docs.select("doc_id", F.explode(T.content_terms(F.col("text"))).alias("term"))
    shared = have.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return shared.withColumn("rank", place).where(F.col("rank") <= k)


def may_state(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, n): how many texts share a content term with a fact and so are worth judging."""
    asked = facts.select("item_id", F.explode(T.content_terms(F.col("text"))).alias("term"))
    have = docs.select("doc_id", F.explode(T.content_terms(F.col("text"))).alias("term"))
    n = have.join(asked, "term").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return facts.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


def guard(labels: DataFrame, docs: DataFrame, fits: Column) -> None:
    """Refuses to measure where a labelled page is missing. labels: label; fits: whether a document is that label's page."""
    missing = [r["label"] for r in labels.join(docs, fits, "left_anti").limit(20).collect()]
    if missing:
        raise LookupError(f"labelled pages that the corpus doesn't have: {', '.join(map(str, missing))}")
