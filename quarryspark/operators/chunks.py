"""Markdown documents into chunks under their headings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .store import pack_sentences

TARGET, MOST = 220, 400
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"\s*(```|~~~)")


def sections(markdown: str) -> Iterator[tuple[list[str], str]]:
    """(heading path, body) of each part with a body; a # in a fence is no heading."""
    path: list[tuple[int, str]] = []
    body: list[str] = []
    fence = None

    def part():
        text = "\n".join(body).strip()
        body.clear()
        return [([h for _, h in path], text)] if text else []

    for line in markdown.split("\n"):
        mark = _FENCE.match(line)
        if mark and fence in (None, mark[1]):
            fence = None if fence else mark[1]
        heading = None if fence or mark else _HEADING.match(line)
        if not heading:
            body.append(line)
            continue
        yield from part()
        level = len(heading[1])
        path = [p for p in path if p[0] < level] + [(level, heading[2])]
    yield from part()


def _tokens(s: str) -> int:
    return -(-len(s) // 4)


def grouped(parts: Iterator[tuple[list[str], str]], most: int = MOST) -> list[tuple[list[str], str]]:
    """Neighbours under one top heading put together while their bodies fit; a heading that goes into another's body stays there in bold."""
    out: list[tuple[list[str], str]] = []
    for path, body in parts:
        if out and out[-1][0][:1] == path[:1] and _tokens(out[-1][1]) + _tokens(body) <= most:
            top, text = out[-1]
            label = f"**{path[-1]}**\n\n" if path and path[-1:] != top[-1:] else ""
            out[-1] = (top[:1], f"{text}\n\n{label}{body}")
        else:
            out.append((path, body))
    return out


def _groups(most: int):
    def run(batches):
        kind = pa.list_(pa.struct([("heading", pa.list_(pa.string())), ("body", pa.string())]))
        for batch in batches:
            rows = []
            for title, text in zip(batch.column("title").to_pylist(), batch.column("markdown").to_pylist()):
                text = text or ""
                found = grouped(sections(text), most) or ([([], text)] if text.strip() else [])
                rows.append([])
                for path, body in found:
                    named = [x for x in [title or "", *path] if x]
                    rows[-1].append({"heading": [x for i, x in enumerate(named) if not i or x != named[i - 1]], "body": body})
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(rows, kind)], ["url", "groups"])

    return run


def chunk_documents(docs: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """docs: url, title, markdown: (id, url, ord, heading_path, text, tokens, lang, content_hash).

    Headings are a fold over lines, so Arrow batches find them, one pass a document; sentences are cut and packed from their
    token counts. Numbers come from the place in a document's own array, so nothing is shuffled. Tokens are those of the plain
    text, the language that of the heading path and the beginning of the section. Empty documents have no chunk.
    """
    rows = docs.select(F.col("url").cast("string"), "title", "markdown").mapInArrow(_groups(most), "url string, groups array<struct<heading:array<string>,body:string>>")
    rows = rows.withColumn("packed", pack_sentences(target, most)(F.transform("groups", lambda g: T.sentences(g["body"]))))
    rows = rows.withColumn("texts", F.transform("packed", lambda parts: F.filter(F.transform(parts, lambda x: T.plain_markdown(F.concat_ws(" ", x))), lambda x: x != "")))
    lang = lambda g: T.detect_language(F.concat(F.concat_ws(" ", g["heading"]), F.lit(" "), F.substring(g["body"], 1, 400)))
    chunks = F.flatten(F.zip_with("groups", "texts", lambda g, xs: F.transform(xs, lambda x: F.struct(g["heading"].alias("heading_path"), lang(g).alias("lang"), x.alias("text")))))
    rows = rows.select("url", F.posexplode(chunks).alias("ord", "c"))
    ident = F.concat(F.substring(F.sha1(F.col("url").cast("binary")), 1, 10), F.lit("-"), F.lower(F.conv(F.col("ord").cast("string"), 10, 36)))
    return rows.select(ident.alias("id"), "url", F.col("ord").cast("long").alias("ord"), "c.heading_path", "c.text", T.estimate_tokens(F.col("c.text")).alias("tokens"), "c.lang", F.substring(F.sha2(F.col("c.text"), 256), 1, 32).alias("content_hash"))
