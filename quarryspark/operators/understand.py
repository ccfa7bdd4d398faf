"""What a query asks for: levels and flags from the local formulas, then depth, pool and number of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import judge as J

# Numbers of levels, strategies, depths and their pools, thresholds.
COMPLEXITY, HORIZON = 3, 4
STRATEGIES = ("none", "keyword_variants", "sub_questions", "decomposition")
POOLS = {"fast": 24, "basic": 60, "advanced": 110}
DEPTHS = tuple(POOLS)
AMBIGUOUS, WIDER, SECOND_ROUND, FRESH = 0.6, 1.4, 0.55, 2.5
#: Base of each judgement where a query stands alone: no text to match, no host, a short text's quality.
BASES = {"complexity": 0.2, "time_horizon": 0.15, "ambiguity": 0.4, "exact_phrase": 0.15, "strategy": 0.15, "multi_round": 0.4, "synthesis": 0.55, "constraint": 0.2}


def weights(n: int, peak: Column) -> list[Column]:
    """Weights of n levels that fall off with the square of the distance from peak (0 to 1)."""
    out = []
    for i in range(n):
        near = 1 - F.abs(F.lit(i / (n - 1)) - peak)
        out.append(F.greatest(F.lit(0.02), near * near))
    return out


def spread(n: int, peak: Column) -> Column:
    """The weights as probabilities."""
    w = weights(n, peak)
    return F.array(*(x / sum(w[1:], w[0]) for x in w))


def expected_level(n: int, peak: Column) -> Column:
    w = weights(n, peak)
    return T.round_half_up(sum((x * float(i) for i, x in enumerate(w)), F.lit(0.0)) / sum(w[1:], w[0]))


def entropy_confidence(p: Column) -> Column:
    """1 less the entropy of probabilities over its maximum; 1 for a single one."""
    h = F.aggregate(p, F.lit(0.0), lambda t, x: t - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return F.when(F.size(p) <= 1, 1.0).otherwise(T.clamp01(1 - h / F.log(F.size(p))))


def judged(name: str) -> Column:
    return T.round_half_up(T.clamp01(F.lit(BASES[name]) + J.jitter(F.col("item_id"), F.lit(name))))


def understand(queries: DataFrame, depth: str = "basic", auto: bool = False, pool: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """queries: item_id, text. Adds complexity, horizon, ambiguity, strategy, exact_phrase, constrained, depth, pool and rounds.

    depth: what the caller asks for; the stronger of it and the plan's is taken, with auto the plan's. pool and max_rounds
    override the plan.
    """
    rows = queries
    for name in BASES:
        rows = rows.withColumn(name, judged(name))
    strategy = spread(len(STRATEGIES), F.col("strategy"))
    best = F.array_position(strategy, F.array_max(strategy))
    level = F.floor(F.col("level") + 0.5).cast("int")
    asked = 0 if auto else DEPTHS.index(depth)
    at = F.greatest(level, F.lit(asked))
    rows = rows.withColumn("level", expected_level(COMPLEXITY, F.col("complexity"))).withColumn("fresh", expected_level(HORIZON, F.col("time_horizon")))
    rows = rows.withColumn("strategy", F.element_at(F.array(*map(F.lit, STRATEGIES)), best.cast("int"))).withColumn("depth", F.element_at(F.array(*map(F.lit, DEPTHS)), at + 1))
    size = F.lit(pool) if pool is not None else F.element_at(F.array(*map(F.lit, POOLS.values())), at + 1)
    again = F.when((F.col("multi_round") > SECOND_ROUND) | (F.col("strategy") == "decomposition") | (F.col("fresh") >= FRESH), 2).otherwise(1)
    return rows.select(
        *queries.columns, level.alias("complexity"), F.floor(F.col("fresh") + 0.5).cast("int").alias("horizon"), "ambiguity", "strategy",
        ((F.col("exact_phrase") > 0.5) | (F.size(T.quoted(F.coalesce("text", F.lit("")))) > 0)).alias("exact_phrase"), (F.col("constraint") > 0.5).alias("constrained"), "depth",
        F.floor(size * F.when(F.col("ambiguity") > AMBIGUOUS, WIDER).otherwise(1.0) + 0.5).cast("int").alias("pool"), (F.lit(max_rounds) if max_rounds is not None else again).alias("rounds"),
    )
