"""Answers put together from evidence, each claim with its source and its support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import judge as J

SPANS, SHORTEST, QUOTE, SUPPORTED, SOURCES = 8, 30, 300, 0.7, 5


def spans(s: Column) -> Column:
    """The first sentences that are long enough to quote."""
    return F.slice(F.filter(T.sentences(s), lambda x: F.length(x) >= SHORTEST), 1, SPANS)


def best_span(q: Column, s: Column) -> Column:
    """(overlap, at, span) of the sentence of s with most of the distinct words q; the first of equals, null without sentences."""
    return F.array_max(F.transform(spans(s), lambda x, i: F.struct(F.size(F.array_intersect(q, T.content_words(x))).alias("overlap"), (-i).alias("at"), x.alias("span"))))


def quote(best: Column, s: Column) -> Column:
    """A span that shares a word, else the beginning of the text."""
    return T.truncate(F.when(best["overlap"] > 0, best["span"]).otherwise(s), QUOTE)


def support(claim: Column, s: Column) -> Column:
    return T.round_half_up(0.12 + 0.85 * J.affinity(T.content_words(claim), T.content_words(s), s))


def claims(page: DataFrame, queries: DataFrame, docs: DataFrame, sources: int = SOURCES) -> DataFrame:
    """(item_id, position, doc_id, claim, overlap, support, kept): one claim from each of the first included rows of a page."""
    rows = page.where((F.col("route") == "include") & (F.col("position") <= sources)).select("item_id", "position", "doc_id")
    rows = rows.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("item_id", F.array_distinct(T.content_words(F.col("text"))).alias("q")), "item_id")
    rows = rows.withColumn("best", best_span(F.col("q"), F.col("text"))).withColumn("claim", quote(F.col("best"), F.col("text")))
    rows = rows.withColumn("support", support(F.col("claim"), F.col("text")))
    return rows.select("item_id", "position", "doc_id", "claim", F.coalesce("best.overlap", F.lit(0)).alias("overlap"), "support", (F.col("support") >= SUPPORTED).alias("kept"))


def write(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, answer, n_claims, n_dropped): supported claims that share a word with the query, in order, with their positions; null if none is left."""
    on = F.col("kept") & (F.col("overlap") > 0)
    said = F.when(on, F.struct("position", F.concat("claim", F.lit(" ["), "position", F.lit("]")).alias("s")))
    rows = found.groupBy("item_id").agg(F.sort_array(F.collect_list(said)).alias("xs"), F.count_if(~on).alias("n_dropped"))  # a page's sources at most
    rows = queries.select("item_id").join(rows, "item_id", "left")
    answer = F.when(F.size("xs") > 0, F.concat_ws(" ", F.transform("xs", lambda x: x["s"])))
    return rows.select("item_id", answer.alias("answer"), F.coalesce(F.size("xs"), F.lit(0)).cast("long").alias("n_claims"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def shaped(page: DataFrame, docs: DataFrame, raw: int | None = 6000) -> DataFrame:
    """What a search returns for each row: content of up to 1500 characters, raw content of up to `raw`, score and route."""
    rows = page.join(docs.select("doc_id", "text"), "doc_id")
    more = [] if raw is None else [T.truncate(F.col("text"), raw).alias("raw_content")]
    return rows.select("item_id", "position", "doc_id", T.truncate(F.col("text"), 1500).alias("content"), *more, F.col("composite").alias("score"), F.when(F.col("route") == "exclude", "excluded").otherwise(F.col("route")).alias("route"))


def verified(claims: DataFrame, evidence: DataFrame, least: float = SUPPORTED) -> DataFrame:
    """claims: item_id, n, claim, sources (ids, the first counts); evidence: item_id, doc_id, text. Adds support, quote, kept: a claim whose source isn't among the evidence has none."""
    rows = claims.withColumn("doc_id", F.get("sources", F.lit(0))).join(evidence.select("item_id", "doc_id", F.col("text").alias("source")), ["item_id", "doc_id"], "left")
    best = best_span(F.array_distinct(T.content_words(F.col("claim"))), F.col("source"))
    rows = rows.withColumn("best", best).withColumn("support", F.when(F.col("source").isNull(), 0.0).otherwise(support(F.col("claim"), F.col("source"))))
    found = F.when(F.col("source").isNull(), "").otherwise(quote(F.col("best"), F.col("source")))
    return rows.select("item_id", "n", "claim", "doc_id", "support", found.alias("quote"), (F.col("source").isNotNull() & (F.col("support") >= least)).alias("kept"))


def surviving(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """The evidence that claims which were kept rest on."""
    return evidence.join(found.where("kept").select("item_id", "doc_id").distinct(), ["item_id", "doc_id"], "left_semi")


def repaired(written: DataFrame, found: DataFrame, evidence: DataFrame, writer=None) -> DataFrame:
    """(item_id, answer, n_kept, n_dropped, rewritten). written: item_id, answer.

    Where claims were dropped and some were kept, writer (item_id, doc_id, text of the surviving evidence, to item_id, answer)
    writes once more; where it doesn't, the answer says how many claims were left out.
    """
    n = found.groupBy("item_id").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"))
    rows = written.select("item_id", "answer").join(n, "item_id", "left").fillna({"n_kept": 0, "n_dropped": 0})
    again = F.lit(None).cast("string")
    if writer is not None:
        broken = rows.where("n_dropped > 0 and n_kept > 0").select("item_id")
        rows = rows.join(writer(surviving(found, evidence).join(broken, "item_id", "left_semi")).select("item_id", F.col("answer").alias("_again")), "item_id", "left")
        again = F.col("_again")
    note = F.concat("answer", F.lit("\n\n("), F.col("n_dropped").cast("string"), F.lit(" of its claims had no support in their source and were left out.)"))
    answer = F.when(F.col("n_dropped") == 0, F.col("answer")).otherwise(F.coalesce(again, note))
    return rows.select("item_id", answer.alias("answer"), "n_kept", "n_dropped", ((F.col("n_dropped") > 0) & again.isNotNull()).alias("rewritten"))


def citations(found: DataFrame) -> DataFrame:
    """(item_id, n, doc_id, quote, support, confidence, verified) of the claims that were kept; one without a quote is not verified."""
    return found.where("kept").select("item_id", "n", "doc_id", "quote", "support", F.lit(1.0).alias("confidence"), (F.length("quote") > 0).alias("verified"))
