"""Packing into fixed windows by minimum bin slack (operator 10).

A document's ids are those of a tokenizer, then one end id. Whole windows are cut off its head; what remains, shorter
than a window, is one item. Only the counts of the remaining lengths matter to the plan, at most window-1 numbers
whatever the corpus: the largest length left opens a window, a subset-sum over a bitset finds the multiset of lengths
that fills it closest to capacity, and that pattern is used as often as its counts allow, so there are about as many
patterns as lengths. A window that no multiset fills to within `slack` ids is filled by the head of one more item, of the length
that has the most left; its tail goes back to the counts as an item of what is left of it, and may be split again. The last
items, too few for a window, share one. Items get places by their rank among
those of one length: documents by counts of file parts, tails after them in the order of their windows, so a length that a
third of all documents share is dealt out like any other. A document's rank in its part, and the whole windows before it
there, are counted while the part is tokenized, so no window function sorts a part.

Defined results: null text counts as empty (one piece with the end id); rows that repeat, share an id with another text or have
no id are packed each; an empty table gives no rows; extra columns are ignored; texts of any length are cut at whole windows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

WINDOW, SLACK = 1024, 16
_PIECES = "array<struct<start:bigint,length:bigint,crc:bigint>>"
_TOKENS = f"doc_id bigint, doc_tokens bigint, whole {_PIECES}, rest bigint, rest_start bigint, rest_crc bigint, ids binary, part int, ahead bigint, whole_ahead bigint"
_PLACED = "array<struct<start:bigint,length:bigint,crc:bigint,sequence_id:bigint,offset:bigint>>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    The same vocabulary and merges are run by tiktoken, several times faster with equal ids (tests hold both against
    each other). Texts with an added token's string, texts with a very long run of white space (whose pattern overflows
    tiktoken's stack from some 500,000 on), and files of another kind, go through tokenizers itself.
    """

    LONG = 20_000
    _BLANK = re.compile(r"\s{%d}" % LONG)

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model.get("type") == "BPE" and plain and not spec.get("normalizer") and not model.get("dropout") and not model.get("unk_token") and not model.get("byte_fallback"):
            self.fast = _tiktoken(model, self.added)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added) or len(text) >= self.LONG and self._BLANK.search(text):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_ordinary(text), "<u4")


def _tiktoken(model: dict, added: list[str]):
    """A tiktoken encoding with a BPE model's vocabulary, if ids rank the merges as both libraries then agree."""
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of the byte-level pre-tokenizer
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in signs)}
    ranks = {bytes(letter[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"][m.replace(" ", "", 1)] for m in merges]
    if ids != sorted(ids):
        return None
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def tokenized(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Lengths and checksums of every document's whole windows and its rest, and the ids of the rest."""

    def run(batches):
        from pyspark import TaskContext

        encode = Encoder(tokenizer or default_tokenizer())
        part, seen, whole = TaskContext.get().partitionId(), Counter(), 0
        piece = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))
        kinds = {"whole": piece, "ids": pa.binary(), "part": pa.int32()}
        for batch in batches:
            ids_in, texts = batch.column("doc_id"), batch.column("text")
            for a in range(0, len(batch), 500):
                out = {k: [] for k in ("doc_tokens", "whole", "rest", "rest_start", "rest_crc", "ids", "part", "ahead", "whole_ahead")}
                for t in texts.slice(a, 500):
                    x = np.append(encode(t.as_py() or ""), np.array([end_id], "<u4"))
                    cut = len(x) // window * window
                    rest = x[cut:]
                    out["doc_tokens"].append(len(x))
                    out["whole"].append([{"start": s, "length": window, "crc": _crc(x[s : s + window])} for s in range(0, cut, window)])
                    out["rest"].append(len(rest))
                    out["rest_start"].append(cut)
                    out["rest_crc"].append(_crc(rest))
                    out["ids"].append(rest.tobytes())
                    out["part"].append(part)
                    out["ahead"].append(seen[len(rest)])
                    out["whole_ahead"].append(whole)
                    seen[len(rest)] += 1
                    whole += cut // window
                cols = [pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays([ids_in.slice(a, 500), *cols], ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TOKENS)


def closest(counts: np.ndarray, capacity: int) -> Counter:
    """The multiset of available lengths whose sum is closest to capacity from below.

    Bit s of reach[i] says that the first i lengths, largest first, can sum to s; copies of a length go in as 1, 2, 4, ...
    of it. The way back takes from each length as few copies as the sums allow.
    """
    lengths = [int(n) for n in np.flatnonzero(counts)[::-1] if n <= capacity]
    mask, reach = (1 << (capacity + 1)) - 1, [1]
    for n in lengths:
        r, left, step = reach[-1], min(int(counts[n]), capacity // n), 1
        while left > 0:
            take = min(step, left)
            r |= (r << (n * take)) & mask
            left, step = left - take, step * 2
        reach.append(r)
        if r >> capacity & 1:
            break
    total, out = reach[-1].bit_length() - 1, Counter()
    for i in range(len(reach) - 1, 0, -1):
        while not reach[i - 1] >> total & 1:
            out[lengths[i - 1]] += 1
            total -= lengths[i - 1]
    return out


class Pattern(Counter):
    """Lengths that share a window, with their numbers. split: the length of one more item whose head fills the window, and the head's length."""

    split: tuple[int, int] | None = None


def plan(counts: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> list[tuple[Pattern, int]]:
    """Patterns with their numbers of windows; only the last may lack more than slack."""
    counts, patterns = counts.astype(np.int64).copy(), []
    while counts.any():
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        pattern = Pattern(closest(counts, window - top))
        counts[top] += 1
        pattern[top] += 1
        gap, need = window - sum(n * k for n, k in pattern.items()), Counter(pattern)
        left = counts.copy()
        for n, k in pattern.items():
            left[n] -= k
        if gap > slack and left.any():
            most = int(left.argmax())  # longer than the gap, as the pattern would hold it otherwise
            pattern.split, need = (most, gap), need + Counter([most])
        times = min(int(counts[n]) // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * times
        if pattern.split:
            counts[pattern.split[0] - gap] += times
        patterns.append((pattern, times))
    return patterns


def schedule(counts: np.ndarray, patterns: list[tuple[Pattern, int]]) -> tuple[dict[int, list[tuple]], int]:
    """For each length, runs of ranks in their order, and the number of windows that the plan makes.

    A run has its first rank, the items a window takes, the first window, the offset in it, how many ids of an item go
    there, and the rank that the first item's tail gets in its own length.
    """
    runs, used, made, sequence = {}, Counter(), Counter({n: int(k) for n, k in enumerate(counts)}), 0
    for pattern, times in patterns:
        at = 0
        for n, k in sorted(pattern.items(), reverse=True):
            runs.setdefault(n, []).append((used[n], k, sequence, at, n, 0))
            used[n] += k * times
            at += n * k
        if pattern.split:
            n, head = pattern.split
            runs.setdefault(n, []).append((used[n], 1, sequence, at, head, made[n - head]))
            used[n] += times
            made[n - head] += times
        sequence += times
    return runs, sequence


def places(runs: dict[int, list[tuple]], length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """The pieces of an item: start in it, length, window and offset."""
    start, out = 0, []
    while length:
        first, k, sequence, at, take, tail = runs[length][bisect_right(runs[length], rank, key=lambda x: x[0]) - 1]
        step = rank - first
        out.append((start, take, sequence + step // k, at + step % k * take))
        start, length, rank = start + take, length - take, tail + step
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, slack: int = SLACK, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "pack")
    docs = scratch.save(tokenized(docs, tokenizer, window, end_id), "tokens")
    by_part = scratch.save(docs.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("whole")).alias("whole")), "parts")
    counts = np.zeros(window, np.int64)
    for r in by_part.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).toLocalIterator():  # window - 1 rows at most
        counts[r["rest"]] = r["n"]
    runs, sequence = schedule(counts, plan(counts, window, slack))
    parted = [n for n, xs in runs.items() if any(take < n for _, _, _, _, take, _ in xs)]

    # Ranks: those of earlier parts of the same length, then the order in the part. Likewise for whole windows, each a sequence above those of the plan.
    ahead = lambda by, x: F.coalesce(F.sum(x).over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = by_part.groupBy("part").agg(F.sum("whole").alias("whole")).select("part", (F.lit(sequence) + ahead([], "whole")).alias("first_whole"))  # a row a part
    before = by_part.select("rest", "part", ahead(["rest"], "n").alias("before")).join(whole, "part")
    ranked = docs.join(before, ["rest", "part"])
    # Ids travel only with lengths of which some are split.
    ranked = ranked.select("doc_id", "doc_tokens", "whole", "rest", "rest_start", "rest_crc", (F.col("ahead") + F.col("before")).alias("rank"), (F.col("first_whole") + F.col("whole_ahead")).alias("first_whole"), F.when(F.col("rest").isin(parted), F.col("ids")).alias("ids"))

    def put(batches):
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "crc", "sequence_id", "offset")]))
        for batch in batches:
            out = []
            for n, start, crc, rank, ids, whole, first in zip(*(batch.column(c).to_pylist() for c in ("rest", "rest_start", "rest_crc", "rank", "ids", "whole", "first_whole"))):
                out.append([p | {"sequence_id": first + i, "offset": 0} for i, p in enumerate(whole)])
                for s, m, q, at in places(runs, n, rank):
                    out[-1].append({"start": start + s, "length": m, "crc": crc if m == n else zlib.crc32(ids[4 * s : 4 * (s + m)]), "sequence_id": q, "offset": at})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_tokens"), pa.array(out, kind)], ["doc_id", "doc_tokens", "placed"])

    placed = ranked.mapInArrow(put, f"doc_id bigint, doc_tokens bigint, placed {_PLACED}").select("doc_id", "doc_tokens", F.explode("placed").alias("p"))
    out = scratch.save(placed.select("doc_id", "p.start", "p.length", F.col("p.crc").alias("ids_crc32"), "doc_tokens", "p.sequence_id", "p.offset"), "out")
    scratch.drop("tokens", "parts")
    return out
