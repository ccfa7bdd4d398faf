"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path (operator 2).

Rules name a host suffix and a path prefix; the longest that fits decides. Other urls get the classifier's verdict,
trained from the labelled urls below.

Defined results: a null url, or one without "://", has an empty host and path, matches no rule and is left to the
classifier as an empty string (allow); what a rule decides has no score; repeated rows, rows without an id and several urls
of one id are each judged; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sigmoid

#: host/path and verdict.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: The labelled table: names that stand as a host's label, with and without a path.
BLOCKED = (
    "spam-farm", "link-farm", "seo-spam", "casino-win", "casino-royal", "online-casino", "slots-bonus", "poker-cash", "free-bets", "sports-bets", "bets-now", "cheap-pills",
    "pills-direct", "pharma-deal", "viagra-shop", "adult-x", "xxx-video", "adult-cams", "ads-track", "ad-server", "tracker-pixel", "click-ads", "popup-ads", "win-prize",
    "free-money", "crypto-double", "loan-fast", "warez-crack", "keygen-free", "malware-load", "phish-login", "fake-watches",
)
ALLOWED = (
    "library", "museum", "university", "school", "news-daily", "weather", "city-council", "health-service", "science-review", "journal", "archive", "wiki", "docs", "developer",
    "recipes", "garden-club", "football-club", "history-society", "travel-guide", "book-shop", "open-data", "radio", "theatre", "music-school", "photo-blog", "north-river",
    "the-herald", "the-times", "another-then", "threading", "station", "nation", "winter-sports", "addison", "advent", "padstow", "classic-cars", "better-homes", "betty-cooks", "farm-shop",
    "linked-lists", "expert-answers", "thin-lines", "theory", "therapist", "northern-lights", "tenth-hour", "ration-book", "tire-shop", "hearing-aid",
    "table", "stable", "thimble", "whistle", "width", "tenable", "notable", "able-hands", "white-hall", "watch-tower", "bethel", "estate", "ather", "withy",
)
_HOSTS = ("{}.example.com", "www.{}.example.org", "m.{}.example.net", "blog.{}.example.com")
_PATHS = ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}")
DIMENSION, ROUNDS, RIDGE = 1 << 14, 400, 1e-4


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: then up to ? or #."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def labelled(blocked=BLOCKED, allowed=ALLOWED) -> list[tuple[str, int]]:
    """The labelled urls: every name in each host form, with a path."""
    rows = []
    for y, names in ((1, blocked), (0, allowed)):
        for i, name in enumerate(names):
            for j in range(4):
                rows.append((_HOSTS[j].format(name) + _PATHS[(i + j) % 5].format(37 * (i + 1) + j), y))
    return rows


def ngrams(s: str) -> np.ndarray:
    """Buckets of the 3- to 5-grams of host and path, without digits."""
    s = "^" + "".join(c for c in s if not c.isdigit()) + "$"
    return np.unique([zlib.crc32(s[i : i + n].encode()) % DIMENSION for n in (3, 4, 5) for i in range(len(s) - n + 1)] or [0])


class Regression:
    def __init__(self, rows: list[tuple[str, int]], rounds: int = ROUNDS, ridge: float = RIDGE):
        xs, y = [ngrams(s) for s, _ in rows], np.array([y for _, y in rows], float)
        at = np.cumsum([0, *map(len, xs)])
        flat, row = np.concatenate(xs), np.repeat(np.arange(len(xs)), np.diff(at))
        scale = 1 / np.sqrt(np.diff(at))
        self.w, self.b, seen = np.zeros(DIMENSION), 0.0, np.full(DIMENSION, 1e-8)
        for _ in range(rounds):  # Adagrad over the whole table
            z = np.add.reduceat(self.w[flat], at[:-1]) * scale + self.b
            d = (sigmoid(z) - y) / len(y)
            g = np.bincount(flat, (d * scale)[row], DIMENSION) + ridge * self.w / len(y)
            seen += g**2
            self.w -= 0.3 * g / np.sqrt(seen)
            self.b -= 2.0 * d.sum()

    def __call__(self, s: str) -> float:
        if not s:
            return 0.0
        x = ngrams(s)
        return float(sigmoid(np.array([self.w[x].sum() / np.sqrt(len(x)) + self.b]))[0])


def judged(pages: DataFrame, rules=RULES, table=None) -> DataFrame:
    """page_id, host, path, rule, verdict, score: every url."""
    spark = pages.sparkSession
    known = spark.sparkContext.broadcast(Regression(labelled() if table is None else table))

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        once = {x: known.value(x) for x in s.dropna().unique()}
        return s.map(once).astype(float)

    url = F.col("url")
    host, path = host_path(url)
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):  # longer ones override
        suffix, _, prefix = rule.partition("/")
        hit = ((F.col("host") == suffix) | F.col("host").endswith("." + suffix)) & F.col("path").startswith("/" + prefix)
        fits, verdict = F.when(hit, F.lit(rule)).otherwise(fits), F.when(hit, F.lit(says)).otherwise(verdict)
    # What a rule has decided is not scored.
    rows = rows.withColumn("rule", fits).withColumn("said", verdict).withColumn("score", score(F.when(F.col("said").isNull(), F.concat("host", "path"))))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
