"""The request side: validated requests, and an engine over tables of documents, vectors and queries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import urls as U
from .operators import answer as A
from .operators import decision as D
from .operators import judge as J
from .operators import retrieval as R
from .operators import understand as Q
from .operators.index import Index
from .plans import search as P
from .sources import html

DEPTHS, TOPICS, RANGES = ("fast", "basic", "advanced"), ("general", "news", "finance"), {"day": 1, "week": 7, "month": 30, "year": 365}


class RequestError(ValueError):
    """What is wrong with a request: [(field, message)]."""

    def __init__(self, errors: list[tuple[str, str]]):
        super().__init__("; ".join(f"{k}: {m}" for k, m in errors))
        self.errors = errors


@dataclass
class SearchRequest:
    query: str = ""
    search_depth: str = "basic"
    topic: str = "general"
    max_results: int = 10
    time_range: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    filter_by_published_date: bool = False
    include_domains: list[str] = field(default_factory=list)
    exclude_domains: list[str] = field(default_factory=list)
    language: str = ""
    filter_by_language: bool = False
    safe_search: bool = False
    include_answer: bool | str = False
    include_raw_content: bool | str = False
    auto_parameters: bool = False
    candidate_pool: int | None = None
    max_rounds: int | None = None
    # Accepted, without an effect on which rows come back.
    include_domains_mode: str = "restrict"
    exact_match: bool = False
    country: str = ""
    chunks_per_source: int = 1
    include_images: bool = False
    include_image_descriptions: bool = False
    include_favicon: bool = False
    include_usage: bool = False
    include_published_date: bool = False
    include_trace: bool = False
    verify_citations: bool = True

    @classmethod
    def of(cls, request: dict | SearchRequest) -> SearchRequest:
        return request if isinstance(request, SearchRequest) else cls.parse(request)

    @classmethod
    def parse(cls, body: dict) -> SearchRequest:
        """A checked request; unknown fields are errors."""
        known = {f.name for f in fields(cls)}
        errors = [(k, "unknown field") for k in body if k not in known]
        r = cls(**{k: v for k, v in body.items() if k in known})
        if not isinstance(r.query, str) or not r.query.strip():
            errors.append(("query", "must not be empty"))
        for name, among in (("search_depth", DEPTHS), ("topic", TOPICS), ("time_range", (None, *RANGES))):
            if getattr(r, name) not in among:
                errors.append((name, f"must be one of {', '.join(map(str, among))}"))
        if not isinstance(r.max_results, int) or not 0 <= r.max_results <= 50:
            errors.append(("max_results", "must be from 0 to 50"))
        for name, low, high in (("candidate_pool", 1, 500), ("max_rounds", 1, 3)):
            v = getattr(r, name)
            if v is not None and (not isinstance(v, int) or not low <= v <= high):
                errors.append((name, f"must be from {low} to {high}"))
        dates = {}
        for name in ("start_date", "end_date"):
            try:
                dates[name] = date.fromisoformat(v) if (v := getattr(r, name)) else None
            except (TypeError, ValueError):
                errors.append((name, "must be a date like 2024-01-31"))
        if dates.get("start_date") and dates.get("end_date") and dates["start_date"] > dates["end_date"]:
            errors.append(("start_date", "must not be after end_date"))
        if r.time_range and r.start_date:
            errors.append(("time_range", "can't be given along with start_date"))
        if r.filter_by_language and not r.language:
            errors.append(("filter_by_language", "needs a language"))
        if set(r.include_domains) & set(r.exclude_domains):
            errors.append(("include_domains", "shares a domain with exclude_domains"))
        if errors:
            raise RequestError(errors)
        r.include_answer = "basic" if r.include_answer is True else r.include_answer
        r.include_raw_content = "markdown" if r.include_raw_content is True else r.include_raw_content
        return r


def _http(value) -> bool:
    return isinstance(value, str) and bool(re.match(r"(?i)https?://[^/?#]", value))


#: Fields of the other requests: kind, least and most, default. urls: one or a list of so many.
_BODIES = {
    "extract": {"urls": ("urls", 1, 20, None), "include_images": ("bool", None, None, False), "extract_depth": (("basic", "advanced"), None, None, "basic"), "format": (("markdown", "text"), None, None, "markdown")},
    "crawl": {"url": ("url", None, None, None), "mode": (("page", "site", "queue"), None, None, "page"), "max_depth": ("int", 0, 6, 3), "max_pages": ("int", 1, 500, None), "force": ("bool", None, None, False)},
    "index": {"urls": ("urls", 1, 50, None), "mode": (("page", "site"), None, None, "page"), "force": ("bool", None, None, False)},
    "evaluate": {"state": ("any", None, None, None), "questions": ("questions", None, None, None), "model": ("str", None, None, "")},
}
_NEEDED = {"urls", "url", "questions", "state"}


def parse_body(kind: str, body: dict) -> dict:
    """A checked request to extract, crawl, index or evaluate, with its defaults; unknown fields are errors."""
    known = _BODIES[kind]
    errors = [(k, "unknown field") for k in body if k not in known]
    out = {}
    for name, (what, least, most, default) in known.items():
        value = body.get(name)
        if value is None:
            if name in _NEEDED and not (name == "state" and name in body):
                errors.append((name, "is needed"))
            out[name] = default
            continue
        if what == "urls":
            value = [value] if isinstance(value, str) else value
            ok = isinstance(value, list) and least <= len(value) <= most and all(map(_http, value))
            message = f"must be {least} to {most} urls"
        elif what == "url":
            ok, message = _http(value), "must be a url"
        elif what == "bool":
            ok, message = isinstance(value, bool), "must be true or false"
        elif what == "int":
            ok, message = isinstance(value, int) and not isinstance(value, bool) and least <= value <= most, f"must be from {least} to {most}"
        elif what == "questions":
            ok = isinstance(value, dict) and bool(value) and all(isinstance(q, dict) and q.get("type") in ("noul", "choice", "score") for q in value.values())
            message = "must be at least one question of a known type"
        elif isinstance(what, tuple):
            ok, message = value in what, f"must be one of {', '.join(what)}"
        else:
            ok, message = what == "any" or isinstance(value, str), "must be a text"
        if not ok:
            errors.append((name, message))
        out[name] = value
    if errors:
        raise RequestError(errors)
    return out


def redacted(response: dict) -> dict:
    """A response as it is kept, without its trace."""
    return {k: v for k, v in response.items() if k != "trace"}


def log_line(level: str, message: str, least: str = "info", **more) -> str | None:
    """A line of JSON for a log, or None below the least level."""
    levels = ("debug", "info", "warn", "error")
    return json.dumps({"level": level, "message": message, **more}, sort_keys=True, default=str) if levels.index(level) >= levels.index(least) else None


class Engine:
    """docs: doc_id, text, host, lang, published, and title where second rounds are wanted; vectors: doc_id, vector.

    embedder: gives (item_id, vector) for queries (item_id, text), in the space of vectors; without one the search is lexical.
    index: one of docs; it is built when first needed otherwise. generator: gives (item_id, variants) for (item_id, text, strategy, most).
    policy: thresholds, those of an engine that isn't calibrated by default.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, vectors: DataFrame | None = None, embedder: Callable[[DataFrame], DataFrame] | None = None, index: Index | None = None, generator: Callable[[DataFrame], DataFrame] | None = None, policy: J.Policy = J.UNCALIBRATED):
        self.spark, self.docs, self.vectors, self.embedder, self._index, self.generator, self.policy = spark, docs, vectors, embedder, index, generator, policy

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index.build(self.docs.select("doc_id", "text", *(c for c in ("title", "heading_path") if c in self.docs.columns)))
        return self._index

    def evaluate(self, body: dict, engine: D.Engine) -> D.Reply:
        """An engine's answers to questions about a state: no cache, and failures are raised."""
        body = parse_body("evaluate", body)
        questions = [D.Question(k, q["type"], str(q.get("instructions", "")), tuple(map(str, q.get("criteria") or ()))) for k, q in body["questions"].items()]
        return engine.evaluate(json.dumps(body["state"], sort_keys=True), questions)

    def variants(self, plans: DataFrame) -> DataFrame:
        """(item_id, text): each query, and where its plan widens it and there is a generator its variants. plans: item_id, text, strategy."""
        most = F.when(F.col("strategy") == "keyword_variants", 3).otherwise(4)
        if self.generator is None:
            return plans.select("item_id", "text")
        asked = plans.where("strategy <> 'none'").select("item_id", "text", "strategy", most.alias("most"))
        rows = plans.join(self.generator(asked).select("item_id", "variants"), "item_id", "left")
        return rows.select("item_id", F.explode(T.query_variants(F.col("text"), F.when(F.col("strategy") != "none", F.col("variants")), most)).alias("text"))

    def understand(self, requests: list[dict | SearchRequest]) -> DataFrame:
        """The plan of each request; item_id is its place in the list."""
        out = None
        for i, r in enumerate(map(SearchRequest.of, requests)):
            one = Q.understand(self._query(i, r), r.search_depth, r.auto_parameters, r.candidate_pool, r.max_rounds)
            out = one if out is None else out.unionByName(one)
        return out

    def search(self, requests: list[dict | SearchRequest], now: date) -> DataFrame:
        """item_id, position, doc_id, host, score, route, content[, raw_content] of every request; item_id is its place in the list."""
        out = None
        for i, r in enumerate(map(SearchRequest.of, requests)):
            page = self._page(i, r, now)
            raw = {"text": 20_000, "markdown": 6_000}.get(r.include_raw_content)
            rows = A.shaped(page, self.docs, raw).join(page.select("item_id", "doc_id", "host"), ["item_id", "doc_id"])
            rows = rows if raw else rows.withColumn("raw_content", F.lit(None).cast("string"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def answer(self, requests: list[dict | SearchRequest], now: date) -> DataFrame:
        """item_id, answer, n_claims, n_dropped, reason: an answer from the results, or why it is withheld."""
        out = None
        for i, r in enumerate(map(SearchRequest.of, requests)):
            page, query = self._page(i, r, now), self._query(i, r)
            written = A.write(A.claims(page, query, self.docs), query)
            rows = written.join(J.verdicts(page, query, self.policy).select("item_id", "reason"), "item_id")
            rows = rows.withColumn("answer", F.when(F.col("reason").isNull(), F.col("answer")))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _query(self, i: int, r: SearchRequest) -> DataFrame:
        return self.spark.createDataFrame([(i, r.query)], "item_id bigint, text string")

    def _page(self, i: int, r: SearchRequest, now: date) -> DataFrame:
        queries, plan = self._query(i, r), self.understand([r]).first()  # one row
        asked = self.variants(self.understand([r])).select(F.monotonically_increasing_id().alias("item_id"), "text")
        each = R.depth(asked.count() if self.generator else 1)
        found = R.fuse([(c, w, x.withColumn("item_id", F.lit(i).cast("long"))) for c, w, x in self._lists(asked, each)])
        lit = lambda x: None if x is None else F.lit(x).cast("date") if isinstance(x, str) else x
        since = r.start_date or (F.date_sub(F.lit(now), RANGES[r.time_range]) if r.time_range else None)
        docs = P.passes(self.docs, [*map(str, r.include_domains)], [*map(str, r.exclude_domains)], r.language if r.filter_by_language else "", lit(since), lit(r.end_date), r.filter_by_published_date, r.safe_search)
        if plan["rounds"] > 1 and "title" in self.docs.columns:
            nearest = None if self.vectors is None or self.embedder is None else lambda q: R.dense(self.embedder(q), self.vectors, R.POOL)
            more = P.second_round(queries, self.docs, found, plan["pool"], self.index, nearest).select("item_id", "doc_id", "rank")
            known = found.drop("rank")
            found = more.join(known, ["item_id", "doc_id"], "left")
            # What only the second round found came by its words.
            found = found.withColumn("lexical", F.coalesce("lexical", F.when(F.col("fused").isNull(), 1.0))).withColumn("channels", F.coalesce("channels", F.lit(1)))
        found = found.where(F.col("rank") <= plan["pool"]).join(docs.select("doc_id"), "doc_id", "left_semi")
        near = R.collapse_near(found, self.index.hashes())
        found = found.join(near.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_semi")
        return P.page(P.judged(queries, self.docs, found, self.policy), r.max_results, self.policy)

    def _lists(self, asked: DataFrame, each: int) -> list[tuple[str, float, DataFrame]]:
        """Ranked lists of both channels for queries (item_id, text)."""
        lists = [("lexical", R.LEXICAL_WEIGHT, self.index.bm25(asked, each))]
        if self.vectors is not None and self.embedder is not None:
            lists.append(("dense", R.DENSE_WEIGHT, R.dense(self.embedder(asked), self.vectors, each)))
        return lists

    def extract(self, pages: DataFrame) -> DataFrame:
        """A row per page with its status: ok, or what was wrong."""
        found = html.extract(pages)
        status = F.when(~U.is_http(F.col("url")), "bad_url").when(F.length("text") < 200, "too_short").otherwise("ok")
        return found.withColumn("status", F.coalesce(status, F.lit("bad_url")))

    def stats(self) -> DataFrame:
        return self.docs.agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("host").alias("hosts")).crossJoin(F.broadcast(self.index.stats().select("terms")))
