"""Substring deduplication with difference-cover anchors (operator 4).

A window is 20 consecutive words of one document; a word goes if a window over it also starts earlier (smaller doc_id, or
same document and earlier start), judged on the input. {0, 1, 3, 9} is a difference cover modulo 13: for any two starts
some shift below 13 puts both on cover positions. So equal windows of 20 words share an aligned anchor of 8 words, and
only anchors at cover positions (4 of 13 starts) are hashed and asked for. Where an anchor occurs more than once, it
extends to the windows around it; those are asked for in full, by 112 bits of two hashes, and the earliest start of each
comes back.

Rows that repeat a doc_id, with the same text or another, are one document's versions: of equal windows the earlier start
stays, at equal starts each. Rows without an id come after all others, as versions of one document. Null and empty texts
have no words; documents of under 20 words keep all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grams, inside, text_bytes, words
from .exchange import BLOCK_BYTES, FAN_OUT, Blocks, Rule, read, said

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bits of an anchor that are asked for; two anchors that agree by chance only make a window be asked for in vain.
_MASK = np.uint64((1 << 64) - (1 << 16))
_COVERED = np.isin(np.arange(PERIOD), COVER)
#: Stands for a null id, after all others.
_NONE = np.iinfo(np.int64).max


def _repeats(keys: np.ndarray, values: dict) -> tuple:
    """Whether an anchor occurs in another block, or more than once in one."""
    new, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    many = count > 1
    many[back[values["many"] > 0]] = True
    return new, {"many": many.astype(np.uint8)}, back


def _earliest(keys: np.ndarray, values: dict) -> tuple:
    """Where a window starts first; windows are told apart by their keys and the other hash beside them."""
    order = np.lexsort((values["start"], values["doc"], values["low"], keys))
    k, low = keys[order], values["low"][order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (low[1:] != low[:-1])
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(new) - 1
    first = order[new]
    return keys[first], {c: values[c][first] for c in values}, back


ANCHORS = Rule({"many": "uint8"}, _repeats)
WINDOWS = Rule({"low": "uint64", "doc": "int64", "start": "int64"}, _earliest)


class _Block:
    """The words of a block's documents, in order of doc_id."""

    def __init__(self, table: pa.Table):
        self.given = table.column("doc_id")
        order = pc.sort_indices(self.given)  # nulls last
        table, self.given = table.take(order), self.given.take(order)
        self.ids = pc.fill_null(self.given, _NONE).to_numpy()
        self.data, self.off = text_bytes(table.column("text"))
        self.hs, self.at, self.begin, self.end = words(self.data, self.off, hashes=2, bounds=True)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and word positions of the anchors at cover positions."""
        keep, _ = inside(self.at, ANCHOR)
        start = np.arange(len(keep)) - np.repeat(self.at[:-1], np.diff(self.at))[: len(keep)]
        at = np.flatnonzero(keep & _COVERED[start % PERIOD])
        return grams(self.hs[0], ANCHOR)[at] & _MASK if len(at) else np.zeros(0, np.uint64), at

    def asked(self) -> tuple[np.ndarray, dict]:
        keys, count = np.unique(self.anchors()[0], return_counts=True)
        return keys, {"many": (count > 1).astype(np.uint8)}

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Positions of windows around an anchor that occurs more than once. repeated: beside the block's distinct anchors."""
        h, at = self.anchors()
        keep, _ = inside(self.at, WINDOW)
        if not len(at) or not len(keep):
            return np.zeros(0, np.int64)
        _, back = np.unique(h, return_inverse=True)
        hit = np.zeros(len(self.hs[0]) + WINDOW + 1, np.int32)
        hit[at[repeated[back] > 0]] = 1
        total = np.concatenate([[0], np.cumsum(hit)])
        p = np.arange(len(keep))
        return np.flatnonzero(keep & (total[p + PERIOD] > total[p]))

    def extended(self, repeated: np.ndarray) -> tuple:
        """Windows that may occur elsewhere: positions, which distinct one each is, and of each its two hashes and the position that starts first."""
        at = self.windows(repeated)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none
        a, b = grams(self.hs[0], WINDOW)[at], grams(self.hs[1], WINDOW)[at] >> np.uint64(16)
        doc = np.searchsorted(self.at, at, "right") - 1
        order = np.lexsort((at - self.at[doc], self.ids[doc], b, a))
        new = np.ones(len(at), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        return at, which, a[first], b[first], at[first]

    def asked_windows(self, repeated: np.ndarray) -> tuple[np.ndarray, dict]:
        _, _, a, b, first = self.extended(repeated)
        doc = np.searchsorted(self.at, first, "right") - 1
        return a, {"low": b, "doc": self.ids[doc] if len(doc) else np.zeros(0, np.int64), "start": first - self.at[doc]}

    def judged(self, repeated: np.ndarray, first_doc: np.ndarray, first_start: np.ndarray) -> pa.Table:
        """Every document with what is left of it. first_doc, first_start: beside the block's distinct windows, where each starts first of all."""
        at, which, _, _, _ = self.extended(repeated)
        gone = np.zeros(len(self.hs[0]), bool)
        if len(at):
            doc = np.searchsorted(self.at, at, "right") - 1
            hit = at[(self.ids[doc] != first_doc[which]) | (at - self.at[doc] != first_start[which])]
            cover = np.zeros(len(gone) + 1, np.int32)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
            gone = np.cumsum(cover[:-1]) > 0
        raw, shas, n = self.data.tobytes(), [], np.diff(self.at)
        lost = np.concatenate([[0], np.cumsum(gone)])
        lost = lost[self.at[1:]] - lost[self.at[:-1]]
        for i in range(len(n)):
            if not lost[i]:
                left = raw[self.off[i] : self.off[i + 1]].split()
            else:
                w = np.flatnonzero(~gone[self.at[i] : self.at[i + 1]]) + self.at[i]
                left = [raw[s:e] for s, e in zip(self.begin[w].tolist(), self.end[w].tolist())]
            shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
        return pa.table([self.given, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, fan_out: int = FAN_OUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "substrings")
    blocks = Blocks(docs.select(F.col("doc_id").cast("long"), "text"), scratch, block_bytes)
    one, _ = blocks.ask(ANCHORS, lambda table: _Block(table).asked(), None, fan_out, "anchors")
    two, _ = blocks.ask(WINDOWS, lambda table, got: _Block(table).asked_windows(said(got, ANCHORS)["many"]), one, fan_out, "windows")

    def judged(_: int, body: bytes, got: pa.Table) -> pa.Table:
        of = lambda kind, rule: said(got.filter(pc.equal(got.column("kind"), kind)), rule)
        first = of(2, WINDOWS)
        return _Block(read(body)).judged(of(1, ANCHORS)["many"], first["doc"], first["start"])

    both = one.withColumn("kind", F.lit(1)).unionByName(two.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    out = scratch.save(blocks.with_rows(both, judged, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"), "out")
    scratch.drop("blocks", *blocks.written)
    return out


#: Windows in full; for small tables.
SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, unnest(range(1, len(w) - 18)) s, w from d where len(w) >= 20),
k as (select doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) h from g),
f as (select doc_id, s, row_number() over (partition by h order by doc_id, s) r from k),
c as (select distinct doc_id, unnest(range(s, s + 20)) p from f where r > 1),
l as (select doc_id, list(p) ps from c group by 1)
select d.doc_id, len(w) as n_words, len(coalesce(ps, [])) as n_removed,
  sha256(array_to_string(case when ps is null then w else [w[i] for i in range(1, len(w) + 1) if not list_contains(ps, i)] end, ' ')) as kept_sha256
from d left join l using (doc_id)
"""
