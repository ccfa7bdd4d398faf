"""Language-model scores by cross-entropy difference (operator 8).

Two bigram models, of the target documents and of all others, are matched: same order, same additive smoothing, one
vocabulary (every word of the corpus and the start sign). p(w | v) = (c(vw) + a) / (c(v) + aV), so a document's loss is a sum
over its bigrams and one over their contexts. Counts are 64-bit and come from all documents, through blocks that ask a hash
space for each distinct word and bigram once; nothing is cut off and no table is broadcast. A document's own counts are taken
out of the model it belongs to before it is scored. score = loss under the background less loss under the target, per token.

Defined results: words are runs of non-white-space bytes, A-Z lower-cased; a document's first word follows a start sign;
null and empty texts have 0 tokens, losses and score 0; without targets the target model is uniform; repeated rows are
counted each, and every row of a target's id is a target; rows without an id are background; an empty table gives no rows;
extra columns are ignored. Words and bigrams are told apart by 52 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, row_of, text_bytes, words
from .exchange import BLOCK_BYTES, FAN_OUT, Blocks, Rule, read, said

SMOOTHING = 0.1
_MASK, _START = np.uint64((1 << 64) - (1 << 12)), np.uint64(0x5851F42D4C957F2D)


def _sums(keys: np.ndarray, values: dict) -> tuple:
    new, back = np.unique(keys, return_inverse=True)
    out = {}
    for c, x in values.items():
        out[c] = np.zeros(len(new), np.int64)
        np.add.at(out[c], back, x)
    return new, out, back


COUNTS = Rule({"target": "int64", "other": "int64"}, _sums)


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number's place among the distinct ones, which come sorted."""
    code, new = pd.factorize(x)
    order = np.argsort(new)
    place = np.empty(len(new), np.int64)
    place[order] = np.arange(len(new))
    return place[code], new[order]


class _Block:
    """A block's documents with, for every token, the places of its context word and its bigram among the block's keys."""

    def __init__(self, table: pa.Table, marks: pa.Table):
        self.ids = table.column("doc_id")
        (h,), self.at = words(*text_bytes(table.column("text")), lower=True)
        self.target = np.zeros(len(self.ids), bool)
        for pos in marks.column("pos").to_pylist():
            self.target[pos or []] = True
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.at[:-1][np.diff(self.at) > 0]] = _START
        n = self.n = len(h)
        # Every word is asked for, if only for the vocabulary; the last of a text is no context.
        code, self.keys = _codes(np.concatenate([bigram_keys(before, h), word_keys(before), word_keys(h)]))
        self.bigrams, self.contexts, self.row = code[:n], code[n : 2 * n], row_of(self.at)

    def asked(self) -> tuple[np.ndarray, dict]:
        """Distinct keys with their counts in target documents and in others. Contexts count as often as they are one."""
        code, is_target = np.concatenate([self.bigrams, self.contexts]), np.tile(self.target[self.row], 2)
        return self.keys, {c: np.bincount(code[x], minlength=len(self.keys)) for c, x in (("target", is_target), ("other", ~is_target))}

    def scored(self, counts: dict, vocabulary: int, a: float) -> pa.Table:
        n, rows = np.diff(self.at), len(self.at) - 1
        loss = np.zeros((2, rows))
        for code, add, sign in ((self.bigrams, a, -1), (self.contexts, a * vocabulary, 1)):
            pair, new = pd.factorize(self.row * len(self.keys) + code)
            own, r, k = np.bincount(pair, minlength=len(new)), new // len(self.keys), new % len(self.keys)
            for i, (c, mine) in enumerate((("target", self.target[r]), ("other", ~self.target[r]))):
                loss[i] += sign * np.bincount(r, own * np.log(counts[c][k] - own * mine + add), rows)
        loss /= np.maximum(n, 1)
        return pa.table([self.ids, pa.array(n, pa.int64()), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[1] - loss[0])], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])


def word_keys(h: np.ndarray) -> np.ndarray:
    """Words have the first quarter of the keys, bigrams the rest."""
    return (mix(h.copy()) >> np.uint64(2)) & _MASK


def bigram_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = mix(v * np.uint64(0x9E3779B97F4A7C15) + w)
    return (h >> np.uint64(2) | (h % np.uint64(3) + np.uint64(1)) << np.uint64(62)) & _MASK


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, smoothing: float = SMOOTHING, fan_out: int = FAN_OUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every document. targets: doc_id of the target documents."""
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = Blocks(docs.select(F.col("doc_id").cast("long"), "text"), scratch, block_bytes)
    # Where each block's targets are: ids meet, no texts. A block has a bounded number of places.
    places = blocks.table.select("block", F.posexplode("ids").alias("pos", "doc_id")).join(targets.select(F.col("doc_id").cast("long")).distinct(), "doc_id")
    marks = scratch.save(places.groupBy(F.col("block").alias("asker")).agg(F.collect_list("pos").alias("pos")), "marks")
    answers, sizes = blocks.ask(COUNTS, lambda table, got: _Block(table, got).asked(), marks, fan_out)
    finest = sizes.agg(F.sum(F.when(F.col("range") < F.lit(_first_quarter(blocks.n, fan_out)), F.col("n_keys")))).first()[0]
    vocabulary = max(1, int(finest or 0))

    def scored(_: int, body: bytes, got: pa.Table) -> pa.Table:
        block = _Block(read(body), got)
        return block.scored(said(got.filter(got.column("range").is_valid()), COUNTS), vocabulary, smoothing)

    out = blocks.with_rows(answers.unionByName(marks, allowMissingColumns=True), scored, "doc_id bigint, n_tokens bigint, loss_target double, loss_background double, score double")
    out = scratch.save(out, "out")
    scratch.drop("blocks", "marks", *blocks.written)
    return out


def _first_quarter(blocks: int, fan_out: int) -> int:
    """The first range of the finest kind that has no words."""
    ranges = fan_out
    while blocks > fan_out:
        blocks, ranges = -(-blocks // fan_out), ranges * fan_out
    return ranges // 4


#: The same counts and sums, rounded as the query rounds them.
SQL = r"""
with d as (select doc_id, coalesce(doc_id in (select doc_id from labels where quality = 1), false) t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') w from documents),
k as (select doc_id, t, unnest(w) w, unnest(list_concat([''], w)[1 : len(w)]) v from d),
o2 as (select doc_id, t, v, w, count(*) n from k group by all), o1 as (select doc_id, t, v, sum(n) n from o2 group by all),
c2 as (select v, w, coalesce(sum(n) filter (t), 0) a, coalesce(sum(n) filter (not t), 0) b from o2 group by all),
c1 as (select v, coalesce(sum(n) filter (t), 0) a, coalesce(sum(n) filter (not t), 0) b from o1 group by all),
s as (select 0.1e0 * (1 + count(distinct w)) av from k),
l2 as (select doc_id, sum(-o2.n * ln(a - (case when t then o2.n else 0 end) + 0.1e0)) lt, sum(-o2.n * ln(b - (case when t then 0 else o2.n end) + 0.1e0)) lb from o2 join c2 using (v, w) group by 1),
l1 as (select doc_id, sum(o1.n * ln(a - (case when t then o1.n else 0 end) + av)) lt, sum(o1.n * ln(b - (case when t then 0 else o1.n end) + av)) lb from o1 join c1 using (v), s group by 1),
r as (select d.doc_id, len(w) n, coalesce((l1.lt + l2.lt) / greatest(len(w), 1), 0e0) lt, coalesce((l1.lb + l2.lb) / greatest(len(w), 1), 0e0) lb from d left join l1 using (doc_id) left join l2 using (doc_id))
select doc_id, n::bigint as n_tokens, floor(lt * 1e6 + 0.5e0) / 1e6 as loss_target, floor(lb * 1e6 + 0.5e0) / 1e6 as loss_background, floor((lb - lt) * 1e6 + 0.5e0) / 1e6 as score from r
"""
