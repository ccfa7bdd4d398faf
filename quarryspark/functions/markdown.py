"""Markdown and date functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(s: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in steps:
        s = F.regexp_replace(s, pattern, to)
    return s


def strip_markdown(s: Column) -> Column:
    """Plain text on one line: no fences, code, images or line marks; links as their text."""
    return _chain(s, ((r"(?s)```.*?```", " "), (r"`[^`]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?Um)^[>#*\-|:\s]+", " "), (r"(?U)\s+", " "), (r"^\s+|\s+$", "")))


def cleanup_markdown(s: Column) -> Column:
    """Markdown without embedded image data, links without text, table rules and runs of empty lines."""
    return _chain(s, ((r"!\[[^\]]*\]\(data:[^)]*\)", ""), (r"(?<!!)\[\s*\]\([^)]*\)", ""), (r"(?m)^\s*\|?(\s*:?-{3,}:?\s*\|)+\s*:?-*:?\s*$\n?", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")))


def with_title(s: Column, title: Column) -> Column:
    """A level-one heading with the title in front, unless the text begins with one."""
    return F.when(s.rlike(r"^\s*#\s") | (F.coalesce(title, F.lit("")) == ""), s).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), s))


def internal_links(s: Column) -> Column:
    """Distinct targets of http links, without their fragments."""
    return F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"\]\((https?://[^)\s]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "#.*$", "")))


def normal_date(s: Column) -> Column:
    """A timestamp from an ISO date or time, year and month, year, or RFC-1123 date; null for anything else."""
    s = F.trim(s)
    other = F.regexp_replace(s, r"^[A-Za-z]{3},\s*", "")
    return F.when(s.rlike(r"^\d{4}"), F.try_to_timestamp(s)).otherwise(F.try_to_timestamp(other, F.lit("d MMM yyyy HH:mm:ss z")))
