"""Blocks of documents that ask, ranges of a hash space that answer.

Operators that need to know something about every n-gram of a corpus (does it occur elsewhere, where first, how often in all)
put it as one question: each block of documents has a value for each of its distinct n-grams, values of one n-gram are merged
by an associative rule, and every block gets back what all of them come to. So the commonest n-gram is asked for once a block,
not once a document. Blocks are cut off the scan in the order of its rows and kept as a row each; nothing is shuffled for that.

A block's keys go out as `fan_out` rows, one for each range of the hash space, packed and sorted. Up to `fan_out` blocks meet
in the ranges at once. More of them meet in crews of about `fan_out` blocks first: a crew merges what its blocks ask in a range
and asks in their name, again as `fan_out` rows of finer ranges, and so on; answers come back the same way. Each level moves
every key once and writes rows in proportion to the blocks, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, runs, text_bytes

#: Text of a block, about (a longer text is a block of its own); questions and answers of a block are held by one task.
BLOCK_BYTES, FAN_OUT = 9 << 20, 256


@dataclass
class Rule:
    """What is asked. values: columns beside the keys; merge(keys, values) gives the sorted distinct keys, their merged values, and which of them each key is."""

    values: dict[str, str]
    merge: Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]]

    @property
    def columns(self) -> str:
        return "n bigint, keys binary" + "".join(f", {c} binary" for c in self.values)


class Blocks:
    """A corpus cut to blocks: block, ids, body. docs: doc_id (bigint), text."""

    def __init__(self, docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, seq = TaskContext.get().partitionId(), 0
            held, size = [], 0
            for batch in batches:
                _, off = text_bytes(batch.column("text"))
                for a, b in runs(off, block_bytes):
                    if held and size + off[b] - off[a] > block_bytes:
                        yield _block(part, seq, held)
                        held, size, seq = [], 0, seq + 1
                    held.append(batch.slice(a, b - a))
                    size += off[b] - off[a]
            if held:
                yield _block(part, seq, held)

        dealt = docs.select("doc_id", "text").mapInArrow(deal, "block bigint, ids array<bigint>, body binary")
        self.table, self.scratch = scratch.save(dealt, "blocks"), scratch
        self.n, self.written = self.table.count(), []

    def ask(self, rule: Rule, question: Callable[..., tuple[np.ndarray, dict[str, np.ndarray]]], beside: DataFrame | None = None, fan_out: int = FAN_OUT, name: str = "asked") -> tuple[DataFrame, DataFrame]:
        """Answers (asker, range, and the rule's values) for every block, and (range, n_keys) of all ranges of the finest kind.

        question(documents of a block[, its rows of beside]) gives sorted distinct keys and values. beside: has a column asker.
        """
        bits = fan_out.bit_length() - 1

        def run(block: int, body: bytes, *got: pa.Table) -> Iterator[tuple]:
            return _rows(block, *question(read(body), *got), rule, 0, bits)

        schema = f"asker bigint, range bigint, {rule.columns}"
        if beside is None:
            asked = self.table.select("block", "body").mapInArrow(lambda batches: (_batch(run(k.as_py(), x.as_py()), rule) for b in batches for k, x in zip(b.column("block"), b.column("body"))), schema)
        else:
            asked = self.with_rows(beside, lambda block, body, got: pa.Table.from_batches([_batch(run(block, body, got), rule)]), schema)
        levels = [0]
        while self.n > fan_out ** len(levels):
            levels.append(levels[-1] + bits)
        self.written += [f"{name}-{x}-{y}" for x in levels for y in ("asked", "said")]
        return _answered(asked, rule, self.n, fan_out, self.scratch, name)

    def with_rows(self, beside: DataFrame, f: Callable[[int, bytes, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f over each block and its rows of beside (which has a column asker)."""

        def run(mine: pa.Table, got: pa.Table) -> pa.Table:
            return f(mine.column("block")[0].as_py(), mine.column("body")[0].as_py(), got)

        return self.table.select("block", "body").groupBy("block").cogroup(beside.groupBy("asker")).applyInArrow(run, schema)


def _block(part: int, seq: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    ids = table.column("doc_id").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "ids", "body"])


def read(body: bytes) -> pa.Table:
    """The documents of a block: doc_id, text."""
    return pa.ipc.open_stream(pa.BufferReader(body)).read_all()


def _rows(asker: int, keys: np.ndarray, values: dict[str, np.ndarray], rule: Rule, above: int, bits: int) -> Iterator[tuple]:
    """Sorted keys as rows, a range each. above: bits of the ranges that these lie in."""
    if not len(keys):
        return
    ranges = (keys >> np.uint64(64 - above - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield asker, int(ranges[a]), int(b - a), pack(keys[a:b], True), *(pack(values[c][a:b]) for c in rule.values)


def _batch(rows: Iterator[tuple], rule: Rule) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * (4 + len(rule.values))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.binary()) for c in cols[3:])], ["asker", "range", "n", "keys", *rule.values])


def _unpacked(table: pa.Table, rule: Rule) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    end_to_end = lambda c, t, up=False: np.concatenate([unpack(x.as_py(), np.dtype(t), up) for x in table.column(c)])
    return end_to_end("keys", "uint64", True), {c: end_to_end(c, t) for c, t in rule.values.items()}


def _answered(asked: DataFrame, rule: Rule, askers: int, fan_out: int, scratch: Scratch, name: str, above: int = 0) -> tuple[DataFrame, DataFrame]:
    bits, values = fan_out.bit_length() - 1, list(rule.values)
    schema = "asker bigint, range bigint" + "".join(f", {c} binary" for c in values)

    def reply(table: pa.Table) -> pa.Table:
        keys, said, which = rule.merge(*_unpacked(table, rule))
        at = np.concatenate([[0], np.cumsum(table.column("n").to_numpy())])
        out = [pa.array([pack(said[c][which[a:b]]) for a, b in zip(at[:-1], at[1:])], pa.binary()) for c in values]
        return pa.table([table.column("asker"), table.column("range"), *out, pa.array([len(keys)] * table.num_rows, pa.int64())], ["asker", "range", *values, "n_keys"])

    if askers <= fan_out:
        found = scratch.save(asked.groupBy("range").applyInArrow(reply, f"{schema}, n_keys bigint"), f"{name}-{above}-said")
        return found.drop("n_keys"), found.groupBy("range").agg(F.max("n_keys").alias("n_keys"))

    crews, below = -(-askers // fan_out), above + bits
    asked = scratch.save(asked.withColumn("crew", F.pmod(F.xxhash64("asker", F.lit(above)), F.lit(crews))), f"{name}-{above}-asked")

    def merge(table: pa.Table) -> pa.Table:
        keys, said, _ = rule.merge(*_unpacked(table, rule))
        return pa.Table.from_batches([_batch(_rows(table.column("crew")[0].as_py(), keys, said, rule, below, bits), rule)])

    def share(table: pa.Table, said: pa.Table) -> pa.Table:
        _, _, which = rule.merge(*_unpacked(table, rule))
        said = said.sort_by("range")
        all_said = {c: np.concatenate([unpack(x.as_py(), np.dtype(rule.values[c])) for x in said.column(c)]) for c in values}
        at = np.concatenate([[0], np.cumsum(table.column("n").to_numpy())])
        out = [pa.array([pack(all_said[c][which[a:b]]) for a, b in zip(at[:-1], at[1:])], pa.binary()) for c in values]
        return pa.table([table.column("asker"), table.column("range"), *out], ["asker", "range", *values])

    merged = asked.groupBy("crew", "range").applyInArrow(merge, f"asker bigint, range bigint, {rule.columns}")
    said, sizes = _answered(merged, rule, crews, fan_out, scratch, name, below)
    back = said.withColumnRenamed("asker", "crew").withColumn("above", F.shiftright("range", bits))
    out = asked.groupBy("crew", "range").cogroup(back.groupBy("crew", "above")).applyInArrow(share, schema)
    return scratch.save(out, f"{name}-{above}-said"), sizes


def said(got: pa.Table, rule: Rule) -> dict[str, np.ndarray]:
    """A block's answers, in the order of its keys."""
    got = got.sort_by("range")
    return {c: np.concatenate([np.zeros(0, t), *(unpack(x.as_py(), np.dtype(t)) for x in got.column(c))]) for c, t in rule.values.items()}


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as zstandard over their bytes, plane by plane; ascending ones as differences."""
    import zstandard

    if ascending:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, dtype, ascending: bool = False) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
    return np.cumsum(x, dtype=x.dtype) if ascending else x
