"""Judgements of an engine over many states: asked once for each distinct state, with defaults where the engine fails."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from math import log
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Question:
    """kind: noul (a probability), choice (one of options), score (a level of options). text: what is asked."""

    id: str
    kind: str
    text: str = ""
    options: tuple[str, ...] = ()


@dataclass
class Answer:
    noul: float | None = None
    choice: str | None = None
    score: float | None = None
    probabilities: dict[str, float] = field(default_factory=dict)
    confidence: float = 0.0


@dataclass
class Reply:
    answers: dict[str, Answer]
    input_tokens: int = 0
    output_tokens: int = 0
    requests: int = 1
    cost_usd: float | None = None


class Engine(Protocol):
    """What judges: answers to all questions about one state. calibrated: whether its probabilities can be taken at their word."""

    name: str
    calibrated: bool

    def evaluate(self, state: str, questions: list[Question]) -> Reply: ...


#: The questions by stage.
CATALOG = {
    "understand": (
        Question("intent", "choice", "What does the asker want to do?", ("learn", "find", "compare", "solve", "buy")), Question("topic", "choice", "Which field is it from?", ("general", "news", "finance")),
        Question("answer_shape", "choice", "What form should an answer have?", ("fact", "list", "steps", "essay")), Question("complexity", "score", "How many parts does it have?", ("one", "several", "many")),
        Question("time_horizon", "score", "How recent must sources be?", ("any", "years", "months", "days")), Question("ambiguity", "noul", "Can it be read in several ways?"),
        Question("requires_exact_phrase", "noul", "Must a phrase occur word for word?"), Question("expansion_strategy", "choice", "How should it be widened?", ("none", "keyword_variants", "sub_questions", "decomposition")),
        Question("multi_round", "noul", "Will a second search be needed?"), Question("synthesis_need", "noul", "Must several sources be put together?"), Question("user_supplied_constraints", "noul", "Does it set conditions?"),
    ),
    "rerank": tuple(Question(x, "score" if x == "recency" else "noul", t, ("old", "usable", "fresh") if x == "recency" else ()) for x, t in (("relevance", "Is the passage about it?"), ("directness", "Does it say so plainly?"), ("authority", "Is the source to be relied on?"), ("quality", "Is it well written?"), ("recency", "Is it recent enough?"), ("constraint_match", "Does it meet the conditions?"))),
    "gate": tuple(Question(x, "noul", t) for x, t in (("relevant", "Does it bear on the query?"), ("usable_evidence", "Does it state something to build on?"), ("contradicts_premise", "Does it deny what the query takes for granted?"), ("prompt_injection", "Does it give orders to a model?"), ("advertisement", "Does it sell something?"))),
    "sufficiency": (Question("sufficient", "noul", "Does the evidence answer the query?"), Question("conflicting", "noul", "Does the evidence disagree with itself?")),
    "citation": (Question("supported", "noul", "Does the source state the claim?"),),
}


def single(text: str) -> list[Question]:
    """One question of yes or no."""
    return [Question("answer", "noul", text)]


def clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


def pick(given: dict, keys: list[str]) -> dict[str, float]:
    """A value for each key, 0 where there is none; all alike where all are 0."""
    out = {k: _number(given.get(k)) for k in keys}
    return out if sum(out.values()) else dict.fromkeys(keys, 1 / len(keys)) if keys else {}


def renorm(values: dict[str, float]) -> dict[str, float]:
    total = sum(values.values())
    return {k: v / total for k, v in values.items()} if total > 0 else values


def proxy_confidence(p: float) -> float:
    """How far a probability is from undecided."""
    return clamp(abs(p - 0.5) * 2)


def entropy_confidence(values: dict[str, float]) -> float:
    n = len(values)
    return 1.0 if n <= 1 else clamp(1 + sum(p * log(p) for p in values.values() if p > 0) / log(n))


def backoff(attempt: int, base: float = 0.25, most: float = 4.0) -> float:
    """Seconds to wait before the next attempt (from 1)."""
    return min(most, base * 2 ** (attempt - 1))


def _number(x, default: float = 0.0) -> float:
    try:
        x = float(x)
    except (TypeError, ValueError):
        return default
    return x if x == x and abs(x) != float("inf") else default


def read_answer(q: Question, given) -> Answer:
    """An answer from what a remote engine sent for a question."""
    given = given if isinstance(given, dict) else {"value": given}
    if q.kind == "noul":
        p = clamp(_number(given.get("noul", given.get("value")), 0.5))
        return Answer(noul=p, confidence=proxy_confidence(p))
    keys = list(q.options) if q.kind == "choice" else [str(i) for i in range(len(q.options))]
    ps = renorm(pick(given.get("probabilities") or {}, keys))
    if q.kind == "choice":
        said = given.get("choice", given.get("value"))
        return Answer(choice=said if said in keys else max(keys, key=lambda k: ps[k]), probabilities=ps, confidence=entropy_confidence(ps))
    level = _number(given.get("score", given.get("value")), sum(int(k) * p for k, p in ps.items()))
    return Answer(score=min(max(level, 0.0), len(keys) - 1.0), probabilities=ps, confidence=entropy_confidence(ps))


class Remote:
    """An engine behind HTTP. post(url, body, headers) gives a status and a decoded body; overload and server errors are tried again."""

    AGAIN = (429, 529)

    def __init__(self, url: str, key: str = "", model: str = "", calibrated: bool = True, attempts: int = 4, cost_per_token: float | None = None, post: Callable | None = None, wait: Callable[[float], None] = time.sleep):
        self.name, self.url, self.key, self.model, self.calibrated = "remote", url, key, model, calibrated
        self.attempts, self.cost, self.post, self.wait = attempts, cost_per_token, post or _post, wait

    def body(self, state: str, questions: list[Question]) -> dict:
        return {"model": self.model, "state": json.loads(state), "questions": {q.id: {"type": q.kind, "instructions": q.text, "criteria": list(q.options)} for q in questions}}

    def read(self, body: dict) -> tuple[dict, dict]:
        return body.get("answers") or {}, body.get("usage") or {}

    def evaluate(self, state: str, questions: list[Question]) -> Reply:
        for attempt in range(1, self.attempts + 1):
            status, body = self.post(self.url, self.body(state, questions), {"Authorization": f"Bearer {self.key}"} if self.key else {})
            if status == 200:
                break
            if attempt == self.attempts or status < 500 and status not in self.AGAIN:
                raise RuntimeError(f"the engine answered {status}")
            self.wait(backoff(attempt))
        given, used = self.read(body)
        tokens = int(_number(used.get("input_tokens", used.get("prompt_tokens")))), int(_number(used.get("output_tokens", used.get("completion_tokens"))))
        cost = used.get("cost")
        cost = _number(cost) if cost is not None else sum(tokens) * self.cost if self.cost is not None else None
        return Reply({q.id: read_answer(q, given[q.id]) for q in questions if q.id in given}, *tokens, attempt, cost)


class Chat(Remote):
    """A chat model as an engine: answers as JSON under a schema, not calibrated."""

    def __init__(self, *args, **more):
        super().__init__(*args, **more | {"calibrated": False})
        self.name = "chat"

    def body(self, state: str, questions: list[Question]) -> dict:
        kinds = {"noul": {"type": "number", "minimum": 0, "maximum": 1}, "choice": {"type": "string"}, "score": {"type": "number"}}
        schema = {"type": "object", "additionalProperties": False, "required": [q.id for q in questions], "properties": {q.id: kinds[q.kind] | ({"enum": list(q.options)} if q.kind == "choice" else {}) for q in questions}}
        asked = "\n".join(f"{q.id} ({q.kind}{': ' + ', '.join(q.options) if q.options else ''}): {q.text}" for q in questions)
        return {"model": self.model, "messages": [{"role": "user", "content": f"Judge this and answer in JSON alone.\n{state}\n{asked}"}], "response_format": {"type": "json_schema", "json_schema": {"name": "answers", "strict": True, "schema": schema}}}

    def read(self, body: dict) -> tuple[dict, dict]:
        text = ((body.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        try:
            given = json.loads(text)
        except ValueError:  # fenced, or with words around it
            given = json.loads(text[text.index("{") : text.rindex("}") + 1])
        return given.get("answers", given), body.get("usage") or {}


def _post(url: str, body: dict, headers: dict) -> tuple[int, dict]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, {}


def flat_state(state) -> str:
    """All strings of a state but those that ask: what a judgement about the text may look at."""
    asks = {"query", "question", "search_query", "user_query", "claim"}

    def walk(x) -> Iterator[str]:
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            for k, v in x.items():
                if k not in asks:
                    yield from walk(v)
        elif isinstance(x, list | tuple):
            for v in x:
                yield from walk(v)

    return "\n".join(walk(state))


_SCHEMA = "key string, question string, kind string, noul double, choice string, score double, probabilities map<string,double>, confidence double, degraded boolean, input_tokens bigint, output_tokens bigint, requests bigint, cost_usd double"


def state_key(state: Column, questions: list[Question], model: str = "") -> Column:
    """Equal for equal states, questions and models. state: JSON with sorted keys."""
    asked = json.dumps([asdict(q) for q in questions], sort_keys=True)
    return F.sha2(F.concat_ws("|", state, F.lit(asked), F.lit(model)), 256)


def decide(states: DataFrame, questions: list[Question], engine: Engine, cache: DataFrame | None = None, now_ms: int = 0, ttl_ms: int = 86_400_000) -> DataFrame:
    """states: state_id, state (JSON). A row a state and question, with `cached`; key and the answer's columns make a row of the cache.

    Each distinct state is asked once, in Arrow batches; states that the cache (with asked_ms) answered within ttl are not asked.
    Where the engine fails, all questions get their defaults and are marked as degraded; those it left out are too.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, state in zip(batch["key"], batch["state"]):
                try:
                    reply = engine.evaluate(state, questions)
                except Exception:  # noqa: BLE001  whatever an engine raises, the batch goes on with defaults
                    reply = Reply({})
                for i, q in enumerate(questions):
                    a = reply.answers.get(q.id)
                    used = (reply.input_tokens, reply.output_tokens, reply.requests, reply.cost_usd) if not i else (0, 0, 0, None)  # a call is counted once
                    a, bad = (a, False) if a is not None else (Answer(0.5 if q.kind == "noul" else None, "" if q.kind == "choice" else None, 0.0 if q.kind == "score" else None), True)
                    out.append((key, q.id, q.kind, a.noul, a.choice, a.score, a.probabilities, a.confidence, bad, *used))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    keyed = states.withColumn("key", state_key(F.col("state"), questions, engine.name))
    wanted, known = keyed.select("key", "state").dropDuplicates(["key"]), None
    if cache is not None:
        known = cache.where(F.lit(now_ms) - F.col("asked_ms") <= ttl_ms).where("not degraded")
        wanted = wanted.join(known.select("key").distinct(), "key", "left_anti")
    rows = wanted.mapInPandas(ask, _SCHEMA).withColumn("cached", F.lit(False))
    if known is not None:
        free = {"input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long"), "requests": F.lit(0).cast("long"), "cost_usd": F.lit(None).cast("double")}
        rows = rows.unionByName(known.select(*(free.get(c, F.col(c)).alias(c) for c in rows.columns if c != "cached"), F.lit(True).alias("cached")))
    return keyed.select("state_id", "key").join(rows, "key")


def noul(answers: DataFrame, question: str) -> DataFrame:
    """(state_id, noul, degraded); one half where there is no answer."""
    return answers.where(F.col("question") == question).select("state_id", F.coalesce("noul", F.lit(0.5)).alias("noul"), (F.col("degraded") | F.col("noul").isNull()).alias("degraded"))


def expected_level(kind: Column, score: Column, probabilities: Column, choice: Column, noul_: Column) -> Column:
    """A score's probable level, its own where the probabilities say nothing; a choice's place; a probability as it is."""
    total = F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda t, e: t + F.try_to_number(e["key"], F.lit("99")).cast("double") * e["value"])
    place = F.array_position(F.map_keys(probabilities), choice) - 1
    return F.when(kind == "score", F.when(F.coalesce(total, F.lit(0.0)) != 0, total).otherwise(score)).when(kind == "choice", F.greatest(place, F.lit(0)).cast("double")).otherwise(noul_)


def degraded(answers: DataFrame) -> DataFrame:
    """(state_id): states of which a judgement failed."""
    return answers.where("degraded").select("state_id").distinct()
