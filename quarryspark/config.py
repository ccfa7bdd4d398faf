"""Settings from the environment, checked."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from .operators.decision import Chat, Remote


@dataclass(frozen=True)
class Config:
    """Names are those of the environment in lower case."""

    max_results: int = 10
    candidate_pool: int = 60
    candidates_reranked: int = 24
    fusion_rrf_k: int = 60
    embedding_dimensions: int = 512
    decision_concurrency: int = 8
    decision_provider: str = "auto"
    decision_url: str = ""
    decision_key: str = ""
    chat_url: str = ""
    chat_key: str = ""
    requests_per_minute: int = 240
    limiter_window_s: int = 60
    crawl_concurrency: int = 4
    crawl_delay_ms: int = 1000
    crawl_max_bytes: int = 3_000_000
    crawl_pages_per_host: int = 500
    crawl_user_agent: str = "quarrybot/1.0"
    hybrid: bool = True
    abstain: bool = True
    respect_robots: bool = True


_LEAST = {"limiter_window_s": 1, "fusion_rrf_k": 1, "crawl_concurrency": 1, "decision_concurrency": 1, "candidates_reranked": 1, "candidate_pool": 1, "embedding_dimensions": 1}
_YES, _NO = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def load(env: Mapping[str, str] = os.environ, prefix: str = "QUARRY_") -> Config:
    """The settings of env; a value of the wrong kind or out of its range is an error that names it."""
    found = {}
    for f in fields(Config):
        raw = env.get(prefix + f.name.upper())
        if raw is None or not raw.strip():
            continue
        raw = raw.strip()
        if f.type == "bool":
            if raw.lower() not in _YES | _NO:
                raise ValueError(f"{prefix}{f.name.upper()} must be true or false")
            found[f.name] = raw.lower() in _YES
        elif f.type == "int":
            if not raw.isdigit() or int(raw) < _LEAST.get(f.name, 0):
                raise ValueError(f"{prefix}{f.name.upper()} must be a whole number from {_LEAST.get(f.name, 0)}")
            found[f.name] = int(raw)
        else:
            found[f.name] = raw
    if found.get("decision_provider", "auto") not in ("auto", "local", "remote", "chat"):
        raise ValueError(f"{prefix}DECISION_PROVIDER must be auto, local, remote or chat")
    return Config(**found)


def engine(c: Config):
    """The engine that the settings name, None for the local formulas; auto takes the remote one where it has a key."""
    kind = c.decision_provider
    if kind == "auto":
        kind = "remote" if c.decision_key else "local"
    if kind == "local":
        return None
    url, key = (c.decision_url, c.decision_key) if kind == "remote" else (c.chat_url, c.chat_key)
    if not url or not key:
        raise ValueError(f"the {kind} engine needs a url and a key")
    return (Remote if kind == "remote" else Chat)(url, key)
