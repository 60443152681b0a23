"""Packing of documents into token sequences by best-fit decreasing.

A document's ids end with one end id and are cut into full windows and a remainder. Best-fit decreasing only looks at
lengths, so it runs on the histogram of piece lengths (at most ``capacity`` numbers): lengths fall, and each piece goes
to the open sequence of least sufficient remaining capacity, found in a segment tree indexed by remaining capacity.
Equal sequences are handled as runs, so the plan's size depends on the capacity only, not on the documents, and it gives
exactly the packing that placing pieces one by one would give. The plan is broadcast; each piece finds its sequence
from its length and its rank among the pieces of that length. Ranks are local ranks plus offsets of its part, so no
length, however common, meets in one task.

Sequences are padded to the capacity, except those whose filling is a power of two, which need none.

Defined results: null and empty texts are a piece of the end id alone; repeated rows and null doc_ids are packed like any
other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import mapped, slices, stage
from tidewater.llm.tokenizing import encoder

CAPACITY = 2048


class CapacityTree:
    """Which remaining capacities have open sequences: a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        k = remaining + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that has an open sequence."""
        k = least + self.size
        if self.count[k]:
            return least
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


class Plan:
    """Runs of equal placements: pieces [rank, rank + n) of a length go, ``each`` to a sequence, to sequences from
    ``sequence`` on, at ``offset``."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        tree, open_ = CapacityTree(capacity), defaultdict(list)
        runs, closed, n_sequences = [], [], 0

        def keep(sequence: int, n: int, remaining: int) -> None:
            if n and remaining:
                open_[remaining].append((sequence, n))
                tree.add(remaining, n)
            elif n:
                closed.append((sequence, n, 0))

        for length in sorted(histogram, reverse=True):
            rank, left = 0, histogram[length]
            while left:
                remaining = tree.tightest(length)
                if remaining is None:
                    remaining, sequence, n = capacity, n_sequences, -(-left // (capacity // length))
                    n_sequences += n
                else:
                    sequence, n = open_[remaining].pop()
                    tree.add(remaining, -n)
                each = remaining // length
                used = min(n, -(-left // each))
                placed = min(left, used * each)
                runs.append((length, rank, sequence, each, capacity - remaining))
                full, over = divmod(placed, each)
                keep(sequence, full, remaining - each * length)
                keep(sequence + full, int(over > 0), remaining - over * length)
                keep(sequence + used, n - used, remaining)
                rank, left = rank + placed, left - placed
        ends = sorted([*closed, *((s, n, r) for r, own in open_.items() for s, n in own)])
        runs.sort()
        column = lambda k: np.array([r[k] for r in runs], np.int64)
        self.length, self.rank, self.sequence, self.each, self.offset = (column(k) for k in range(5))
        self.key = (self.length << 44) + self.rank
        self.end_sequence = np.array([e[0] for e in ends], np.int64)
        self.filled = np.array([capacity - e[2] for e in ends], np.int64)
        self.n_sequences, self.capacity = n_sequences, capacity

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, padded length of the sequence) of pieces."""
        run = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        over = rank - self.rank[run]
        sequence = self.sequence[run] + over // self.each[run]
        filled = self.filled[np.searchsorted(self.end_sequence, sequence, "right") - 1]
        padded = np.where(filled & (filled - 1) == 0, filled, self.capacity)
        return sequence, self.offset[run] + over % self.each[run] * length, padded


def pieces(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str, capacity: int, keep_ids: bool) -> DataFrame:
    """A row for each piece, with its part and its rank among the pieces of its length in that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, part = encoder(tokenizer).many, end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches, "t"):
            out: list[list] = [[] for _ in range(8)]
            for number, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    for column, x in zip(out, (number, start, length, zlib.crc32(own), total, part, seen[length], own), strict=True):
                        column.append(x)
                    seen[length] += 1
            arrays = [pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "own_rank", *["ids"] * keep_ids]
    schema = T.StructType([T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names])
    return mapped(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")), run, schema, "encoders")


def pack(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (and ids)."""
    cut = stage(pieces(docs, tokenizer, end_id, doc_id, text, capacity, keep_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows come to the driver
    plan = docs.sparkSession.sparkContext.broadcast(Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            placed = plan.value.place(number("length"), number("before") + number("own_rank"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *map(pa.array, placed)], names=[*names, "sequence_id", "offset", "padded_length"])

    schema = T.StructType([*(cut.schema[n] for n in names), *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "padded_length"))])
    return mapped(ranked, place, schema, "encoders")
