"""Signals, rerank, gate and domain cap over (item_id, doc_id) candidates, with transparent local formulas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Thresholds and weights of both policies, phrases and patterns.
RECENCY_SHARE = (0.0, 0.25, 1.0, 1.0)
DENSE_ONLY, DECISIVE, DECISIVE_ABOVE, HEDGE_BELOW = 0.08, 0.8, 0.2, 0.8
#: Evidence and conflicts that sufficiency is judged on, and characters of each.
EVIDENCE, EVIDENCE_CHARS, CONFLICTS, CONFLICT_CHARS = 8, 1200, 3, 600


@dataclass(frozen=True)
class Policy:
    """Thresholds and weights for an engine whose probabilities are calibrated, or not."""

    keep_above: float
    weights: dict
    constraint_penalty: float
    injection_max: float
    advertisement_max: float
    contradict_min: float
    relevant_min: float
    evidence_min: float
    min_sufficiency: float
    min_top: float
    min_accepted: int
    max_per_domain: int
    min_domains: int
    support_min: float


CALIBRATED = Policy(
    keep_above=0.34, weights={"relevance": 0.5, "authority": 0.14, "quality": 0.12, "directness": 0.08, "recency": 0.1, "constraint": 0.06}, constraint_penalty=0.08,
    injection_max=0.7, advertisement_max=0.85, contradict_min=0.75, relevant_min=0.35, evidence_min=0.45,
    min_sufficiency=0.55, min_top=0.34, min_accepted=2, max_per_domain=3, min_domains=1, support_min=0.6,
)
UNCALIBRATED = Policy(
    keep_above=0.4, weights={"relevance": 0.56, "authority": 0.1, "quality": 0.1, "directness": 0.06, "recency": 0.08, "constraint": 0.1}, constraint_penalty=0.25,
    injection_max=0.5, advertisement_max=0.7, contradict_min=0.7, relevant_min=0.45, evidence_min=0.55,
    min_sufficiency=0.65, min_top=0.4, min_accepted=2, max_per_domain=2, min_domains=2, support_min=0.7,
)


def policy(calibrated: bool) -> Policy:
    return CALIBRATED if calibrated else UNCALIBRATED


INJECTION = (
    "ignore all previous", "ignore previous instructions", "disregard the above", "you are now a", "you are now an", "system prompt", "reveal the system", "reply only with",
    "respond only with", "new instructions", "assistant:", "as an ai", "do not mention this",
)
ADVERTISEMENT = ("buy now", "sign up", "limited time", "subscribe", "promo code", "discount", "get started today")
AUTHORITATIVE = r"(?i)(^|\.)(docs?\.|developer\.|learn\.|support\.|help\.|wiki\.|reference\.)|(^|\.)(wikipedia\.org|arxiv\.org|nist\.gov|who\.int|ieee\.org|acm\.org)$|(^|\.)(gov|edu|mil)(\.|$)"
LOW_QUALITY = r"(?i)(^|\.)(forum|blogspot|medium|substack|quora|wikipedia\.org/wiki/Talk|reddit)\b|content-farm|seo-"
PUBLIC_SUFFIX = r"(?i)\.(gov|edu|mil|int|org)(\.[a-z]{2})?$"
DETAIL, FILLER = r"\d|[A-Z][a-z]+\.[A-Za-z]", r"(?i)\b(delve|leverage|in today|in the realm|it's important to note)\b"
UNSAFE = r"(?i)\b(how to make (a )?(bomb|explosive|meth)|child (porn|abuse)|bestiality|self.?harm methods)\b"


def coverage(q: Column, d: Column) -> Column:
    """Share of the query's content words (with repeats) that the document has."""
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.filter(q, lambda w: F.array_contains(d, w))) / F.size(q))


def affinity(q: Column, d: Column, doc_text: Column) -> Column:
    density = coverage(q, d) * F.least(F.lit(1.0), F.lit(220.0) / F.greatest(F.lit(60), F.size(d)))
    return F.when((F.size(q) == 0) | (F.length(doc_text) < 20) | (F.size(d) == 0), 0.0).otherwise(T.clamp01(density / 0.5))


def authority(host: Column) -> Column:
    return F.when(host == "", 0.5).when(host.rlike(AUTHORITATIVE), 0.92).when(host.rlike(LOW_QUALITY), 0.15).when(host.rlike(PUBLIC_SUFFIX), 0.75).otherwise(0.5)


def quality(s: Column) -> Column:
    chars = F.length(F.regexp_replace(s, r"^\s+|\s+$", ""))
    n = F.size(F.split(s, r"\s+"))
    parts = F.size(F.filter(F.split(s, r"[.!?]\s+"), lambda x: ~x.rlike(r"^\s*$")))
    mean = n / F.greatest(F.lit(1), parts)
    bonus = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    return F.when(chars < 120, 0.2).otherwise(T.clamp01(F.lit(0.35) + bonus(chars > 400, 0.25) + bonus((mean > 12) & (mean < 45), 0.2) + bonus(s.rlike(DETAIL), 0.2) - bonus(s.rlike(FILLER), 0.3)))


def phrase_hits(s: Column, phrases: tuple[str, ...]) -> Column:
    s = T.fold(s)
    return sum((F.when(F.contains(s, F.lit(p)), 1).otherwise(0) for p in phrases), F.lit(0))


def injection(s: Column) -> Column:
    n = phrase_hits(s, INJECTION)
    return F.when(n == 0, 0.05).otherwise(T.clamp01(0.55 + 0.2 * n))


def advertisement(s: Column) -> Column:
    return T.clamp01(0.05 + 0.2 * phrase_hits(s, ADVERTISEMENT))


def jitter(*key: Column) -> Column:
    """Between -0.06 and 0.06, fixed by the key."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", *(k.cast("string") for k in key)), 256), 1, 2), 16, 10).cast("double") / 255.0 - 0.5) * 0.12


def noul(base: Column, name: str) -> Column:
    return T.round_half_up(T.clamp01(base + jitter(F.col("item_id"), F.col("doc_id"), F.lit(name))))


def signals(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """candidates with aff, cov, auth, qual, inj, adv. docs: doc_id, text, host. Words and per-document signals are made once a document."""
    wanted = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    per_doc = wanted.select("doc_id", "host", F.length("text").alias("n_text"), "text", T.content_words(F.col("text")).alias("d"), quality(F.col("text")).alias("qual"), injection(F.col("text")).alias("inj"), advertisement(F.col("text")).alias("adv"))
    per_query = queries.select("item_id", T.content_words(F.col("text")).alias("q"))
    rows = candidates.join(per_doc, "doc_id").join(per_query, "item_id")
    rows = rows.withColumn("cov", coverage(F.col("q"), F.col("d"))).withColumn("aff", affinity(F.col("q"), F.col("d"), F.col("text"))).withColumn("auth", authority(F.col("host")))
    return rows.select(*candidates.columns, "host", "aff", "cov", "auth", "qual", "inj", "adv")


def rerank(rows: DataFrame, horizon: int = 1, policy: Policy = UNCALIBRATED) -> DataFrame:
    """Adds the six signals, composite and keep. Where rows have a column unmet (a hard requirement is asked for and not met), the penalty is taken off."""
    base = {
        "relevance": 0.15 + 0.7 * F.col("aff") + 0.15 * F.col("cov"), "authority": 0.15 + 0.8 * F.col("auth"), "quality": 0.15 + 0.8 * F.col("qual"), "directness": 0.3 + 0.5 * F.col("qual"),
        "recency": 0.15 + 0.7 * F.col("aff") + 0.15 * F.col("cov"), "constraint": 0.2 + 0.7 * F.col("cov"),
    }
    for name, x in base.items():
        rows = rows.withColumn(name, noul(x, name))
    weights = policy.weights | {"recency": policy.weights["recency"] * RECENCY_SHARE[min(max(horizon, 0), 3)]}
    total = sum((F.col(name) * w for name, w in weights.items()), F.lit(0.0)) - F.when(F.coalesce(F.col("lexical"), F.lit(0.0)) == 0, DENSE_ONLY).otherwise(0.0)
    total = T.clamp01(total)
    if "unmet" in rows.columns:
        total = T.clamp01(total - F.when(F.col("unmet"), policy.constraint_penalty).otherwise(0.0))
    return rows.withColumn("composite", T.round_half_up(total)).withColumn("keep", total >= policy.keep_above)


def reasons(rows: DataFrame) -> DataFrame:
    """rows of rerank() with what speaks against or for each: weak signals, an exact phrase (column phrase), both channels."""
    weak = [F.when(F.col(c) < least, c) for c, least in (("relevance", 0.4), ("authority", 0.3), ("quality", 0.35), ("constraint", 0.4))]
    more = ([F.when(F.col("phrase"), "exact_phrase")] if "phrase" in rows.columns else []) + [F.when(F.col("channels") > 1, "both_channels")]
    return rows.withColumn("reasons", F.array_compact(F.array(*weak, *more)))


def rerank_order() -> list:
    """Best composite first, then more channels, the better fused rank, the smaller id."""
    return [F.desc("composite"), F.desc("channels"), F.desc("fused"), F.col("doc_id")]


def include_limit(rows: DataFrame, limit: int) -> DataFrame:
    """Of a query's included rows the first `limit`, and all others."""
    place = F.row_number().over(Window.partitionBy("item_id", "route").orderBy(F.desc("composite"), "doc_id"))
    return rows.withColumn("_p", place).where((F.col("route") != "include") | (F.col("_p") <= limit)).drop("_p")


def said(policy: Policy = UNCALIBRATED) -> Column:
    """The route of a row with the gate's signals; the order of the tests counts."""
    return (
        F.when(F.col("g_injection") > policy.injection_max, "exclude").when(F.col("g_advertisement") > policy.advertisement_max, "exclude").when(F.col("g_contradicts") > policy.contradict_min, "conflicting")
        .when(F.col("g_relevant") < policy.relevant_min, "exclude").when(F.col("g_evidence") < policy.evidence_min, "exclude").otherwise("include")
    )


def inconsistent(rows: DataFrame, policy: Policy = UNCALIBRATED) -> DataFrame:
    """Routed rows whose route isn't the one that their signals give."""
    return rows.where(~F.col("route").eqNullSafe(said(policy)))


def route(rows: DataFrame, policy: Policy = UNCALIBRATED) -> DataFrame:
    """Adds the gate's five signals and the route."""
    base = {
        "g_relevant": 0.15 + 0.8 * F.col("aff"), "g_evidence": 0.15 + 0.7 * F.col("aff") + 0.15 * F.col("cov"), "g_contradicts": 0.1 + 0.3 * (1 - F.col("cov")),
        "g_injection": 0.12 + 0.8 * F.col("inj"), "g_advertisement": 0.12 + 0.8 * F.col("adv"),
    }
    for name, x in base.items():
        rows = rows.withColumn(name, noul(x, name))
    return rows.withColumn("route", said(policy))


def domain_cap(rows: DataFrame, order: list, cap: int = UNCALIBRATED.max_per_domain, min_distinct: int = UNCALIBRATED.min_domains) -> DataFrame:
    """The first rows of each domain in order; cap is at least 2 where several domains are asked for."""
    cap = max(cap, 2 if min_distinct > 1 else 1)
    return rows.withColumn("in_domain", F.row_number().over(Window.partitionBy("item_id", "host").orderBy(*order))).where(F.col("in_domain") <= cap)


def verdicts(rows: DataFrame, queries: DataFrame, policy: Policy = UNCALIBRATED, enabled: bool = True, degraded: DataFrame | None = None, cancelled: DataFrame | None = None) -> DataFrame:
    """One row per query: what the evidence amounts to and why an answer is withheld, if it is.

    rows: item_id, host, composite, route, cov. degraded, cancelled: item_id of queries whose judgements failed, or that were
    called off. The first reason that holds counts: cancelled; none where withholding is off; failed judgements; no evidence;
    too little or of one source, unless sufficiency is decisive; a weak match; too little sufficiency.
    """
    order = Window.partitionBy("item_id", "route").orderBy(F.desc("composite"), "doc_id") if "doc_id" in rows.columns else Window.partitionBy("item_id", "route").orderBy(F.desc("composite"))
    rows = rows.withColumn("_p", F.row_number().over(order))
    mine, top = F.col("route") == "include", F.col("route").isin("include", "conflicting")
    got = rows.where(top).groupBy("item_id").agg(
        F.count_if(mine).alias("n"), F.countDistinct(F.when(mine, F.col("host"))).alias("domains"), F.max(F.when(mine, F.col("composite"))).alias("top"),
        F.max(F.when(mine & (F.col("_p") <= EVIDENCE), F.col("cov"))).alias("cov"),
    )
    out = queries.select("item_id").join(got, "item_id", "left").fillna({"n": 0, "domains": 0})
    for name, marks in (("degraded", degraded), ("cancelled", cancelled)):
        out = out.withColumn(name, F.lit(False)) if marks is None else out.join(marks.select("item_id", F.lit(True).alias(name)).distinct(), "item_id", "left").fillna({name: False})
    none = F.col("n") == 0
    out = out.withColumns({
        "sufficient": F.when(none, 0.0).otherwise(T.round_half_up(0.2 + 0.75 * F.col("cov"))),
        "conflicting": F.when(none, 0.0).otherwise(T.round_half_up(0.1 + 0.3 * (1 - F.col("cov")))),
    })
    decisive = F.col("sufficient") >= max(DECISIVE, policy.min_sufficiency + DECISIVE_ABOVE)
    reason = (
        F.when(none, "no_evidence").when(~decisive & (F.col("n") < policy.min_accepted), "insufficient_evidence").when(~decisive & (F.col("domains") < policy.min_domains), "single_source")
        .when(F.col("top") < policy.min_top, "weak_match").when(F.col("sufficient") < policy.min_sufficiency, "evidence_does_not_support_answer")
    )
    reason = F.when(F.col("cancelled"), "cancelled").when(F.lit(not enabled), None).when(F.col("degraded"), "decision_engine_unavailable").otherwise(reason)
    evidence = F.when(none, 0.0).otherwise(T.round_half_up(T.clamp01(0.7 * F.col("top") + 0.3 * F.least(F.lit(1.0), F.col("n") / 4))))
    return out.select("item_id", F.col("n").cast("long"), F.col("domains").cast("long"), "sufficient", "conflicting", (F.col("sufficient") < HEDGE_BELOW).alias("hedge"), evidence.alias("evidence_score"), reason.alias("reason"))
