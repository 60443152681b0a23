"""Removal of word passages that occur more than once, anchored on a difference cover.

A window is ``width`` (35) consecutive words of one document; every word covered by a window whose word sequence also
starts elsewhere goes. Positions modulo 21 that lie in the perfect difference set {3, 6, 7, 12, 14} form a difference
cover: for any two positions some shift below 21 puts both on cover positions. So two equal windows share, at one such
shift, an equal anchor of 35 - 21 + 1 = 15 words that starts at a cover position of each. Steps:

1. Texts are staged in the shared folder as chunks (some megabytes, or one longer document), never shuffled. Workers
   write and read them as Arrow files: rows of megabytes in the JVM fill its heap, which it does not give back.
2. Anchors are hashed at cover positions only. Each chunk reports a hash once, with its count, so a passage common to
   a third of all rows meets as one entry for each chunk; the places of repeated hashes are written back by chunk.
   Entries travel packed: one row for a chunk and a bucket of hashes, not one for a hash. Buckets grow in number
   with the input; one of them holds about the entries of CHUNK_BYTES of text.
3. Extension: windows around a repeated anchor are hashed whole, counted and written back in the same way. 64 bits of
   one family of hashes and 32 of another tell them apart; both start from 64 bits of each word.
4. Each chunk removes the words that repeated windows cover.

Nothing is paired or capped; hashes move, texts do not: a task reads the lists of its own chunks.

Defined results: null and empty texts have no words; repeated rows count as places of their own, so a text that stands
twice loses all words within windows; documents shorter than a window are kept whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.llm.common import BATCH_BYTES, SPACED, U64, filesystem, mapped, normal_uri, rows_of, shared_path, shuffles_end, stage, utf8, window_hashes, window_starts, window_table, word_bounds, word_hashes

PERIOD, COVER = 21, (3, 6, 7, 12, 14)
WIDTH = 35
CHUNK_BYTES = 4 << 20
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
#: A hash that a chunk reports, 64 bits and 32 more (0 for anchors), and the word at which it was first met, ~word if met again.
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("p", "<i4")])


class _Words:
    """Words of a chunk's documents: bounds, hashes, and the first word of each document."""

    def __init__(self, texts: pa.Array):
        self.data, self.at = utf8(texts)
        self.start, self.end, self.first = word_bounds(self.data, self.at, SPACED)
        self.hashes = word_hashes(self.data, self.start, self.end)

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the anchors at cover positions, counted from each document's start."""
        position = window_starts(self.first, width - PERIOD + 1)
        own = position - self.first[rows_of(position, self.first)]
        position = position[_ON_COVER[own % PERIOD]]
        return position, window_table(self.hashes, width - PERIOD + 1)[position]

    def candidates(self, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a repeated anchor, as one at ``places``, at one of their first PERIOD positions: (position, two hashes)."""
        position, found = self.anchors(width)
        change = np.zeros(len(self.hashes) + 1, np.int64)
        # places are those of anchors, in order of position
        hot = position[np.isin(found, found[np.searchsorted(position, places)])]
        np.add.at(change, np.maximum(hot - PERIOD + 1, 0), 1)
        np.add.at(change, hot + 1, -1)
        near = np.cumsum(change)[:-1] > 0
        start = window_starts(self.first, width)
        start = start[near[start]]
        return start, window_hashes(self.hashes, start, width), window_hashes(self.hashes, start, width, 1)


def _chunks(batches: Iterator[pa.RecordBatch], n_columns: int) -> Iterator[list[pa.RecordBatch]]:
    """Groups of rows of about CHUNK_BYTES of text; the text is the last column."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, at = utf8(batch.column(n_columns - 1))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + max(1, CHUNK_BYTES - size), "right")) - 1)
            kept.append(batch.slice(row, end - row))
            size += int(at[end] - at[row])
            row = end
            if size >= CHUNK_BYTES:
                yield kept
                kept, size = [], 0
    if kept:
        yield kept


def _packed(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Slices ``data[at[k]:at[k + 1]]`` as binary values."""
    offsets = ((at - at[0]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at[0] : at[-1]]))])


def _reports(chunk: int, position: np.ndarray, a: np.ndarray, b: np.ndarray | None, buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's hashes, each once, as one row for each bucket that has some; a bucket is a range of hashes."""
    a, place, n = np.unique(a, return_index=True, return_counts=True)
    entries = np.zeros(len(a), _ENTRY)
    entries["a"], entries["p"] = a, np.where(n > 1, ~position[place], position[place])
    if b is not None:
        entries["b"] = b[place] >> U64(32)
    bucket, start = np.unique((a >> U64(32)) * U64(buckets) >> U64(32), return_index=True)
    at, k = np.append(start, len(a)), 0
    while k < len(bucket):
        end = max(k + 1, int(np.searchsorted(at, at[k] + BATCH_BYTES // _ENTRY.itemsize, "right")) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(end - k, chunk)), _ints(bucket[k:end]), _packed(entries, at[k : end + 1])], names=["chunk", "bucket", "entries"])
        k = end


def _met_again(rows: pa.Table) -> pa.Table:
    """Of a bucket's entries, the places of those that are reported more than once in total, by chunk."""
    chunks = rows.column("chunk").to_numpy()
    packed = pa.concat_arrays(rows.column("entries").cast(pa.large_binary()).chunks)
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, np.int64)[packed.offset : packed.offset + len(packed) + 1]
    entries = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(_ENTRY)
    at = (at - at[0]) // _ENTRY.itemsize
    order = np.lexsort((entries["b"], entries["a"]))
    a, b, place = entries["a"][order], entries["b"][order], entries["p"].copy()
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    total = np.add.reduceat(np.where(place[order] < 0, 2, 1), start)
    hot = np.zeros(len(order), bool)
    hot[order] = np.repeat(total > 1, np.diff(np.append(start, len(order))))
    place = np.where(place < 0, ~place, place)[hot]
    at = np.concatenate([[0], np.cumsum(hot)])[at]
    some = np.diff(at) > 0
    return pa.table({"chunk": pa.array(chunks[some]), "places": _packed(place, np.append(at[:-1][some], at[-1]))})


def _repeated(reports: DataFrame, path: str) -> None:
    """Writes, for each chunk, the places of the hashes it reported that are reported more than once in total.

    A place (the word at which the hash was first met in the chunk) is shorter than the hash it stands for.

    A chunk reports a hash once, so the entries of a key are at most as many as there are chunks. A task holds the entries
    of one bucket at a time: about those of CHUNK_BYTES of text.
    """
    hot = reports.groupBy("bucket").applyInArrow(_met_again, "chunk long, places binary")
    # dealt by part, so that each part has one file, however many tasks there are
    hot = hot.withColumn("part", F.shiftright("chunk", 32)).repartition("part")
    with shuffles_end(reports.sparkSession):
        hot.write.partitionBy("part").parquet(path)


class _Found:
    """Places of the repeated hashes of the chunks of one part, read from the shared folder; the last part read is kept."""

    def __init__(self, path: str):
        self.path, self.part, self.lists = path, -1, {}

    def __call__(self, chunk: int) -> np.ndarray | None:
        import pyarrow.dataset as ds

        if chunk >> 32 != self.part:
            self.part = chunk >> 32
            fs, path = filesystem(normal_uri(f"{self.path}/part={self.part}"))
            lists = defaultdict(list)
            if fs.get_file_info(path).type.name == "Directory":
                for batch in ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["chunk", "places"]).to_batches():
                    for number, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        lists[number].append(np.frombuffer(places.as_buffer(), np.int32))
            self.lists = {number: np.concatenate(places) for number, places in lists.items()}
        found = self.lists.get(chunk)
        return None if found is None else found.astype(np.int64)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """For each row, its other columns, n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256."""
    if width <= PERIOD:
        raise ValueError(f"windows must be longer than the period {PERIOD}")
    spark = docs.sparkSession
    names = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    others = [c for c in docs.columns if c != text and c not in names]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("o") if others else F.lit(None).cast("struct<x:int>").alias("o"), F.col(f"`{text}`").alias("t"))
    room = shared_path(spark, "chunks")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, size = TaskContext.get().partitionId(), 0
        fs, folder = filesystem(normal_uri(room))
        fs.create_dir(folder, recursive=True)
        name, file = f"{part}-{uuid.uuid4().hex}", None  # an attempt has a file of its own; the list names those that count
        for kept in _chunks(batches, 2):
            if file is None:
                out = fs.open_output_stream(f"{folder}/{name}")
                file = pa.ipc.new_file(out, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            for rows in pa.Table.from_batches(kept).combine_chunks().to_batches():  # one, if offsets of 32 bits suffice
                file.write_batch(rows)
                size += int(utf8(rows.column(1))[1][-1])
        if file is not None:
            file.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([size], pa.int64())], names=["part", "name", "size"])

    # Staged once: chunk numbers stay as they are, whatever is run again later.
    parts = stage(mapped(own, chunk, "part long, name string, size long"), "parts")
    with shuffles_end(spark):
        n, size = parts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(spark.sparkContext.defaultParallelism, size // CHUNK_BYTES + 1)
    staged = parts.select("part", "name").repartition(max(1, n))

    def read(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(number, rows) of the chunks of the listed parts, one at a time."""
        fs, folder = filesystem(normal_uri(room))
        for batch in batches:
            for part, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    file = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=list(columns)))
                    for k in range(file.num_record_batches):
                        yield (part << 32) + k, file.get_batch(k)

    def report_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in read(batches, 1):
            position, h = _Words(rows.column("t")).anchors(width)
            yield from _reports(number, position, h, None, buckets)

    anchors, windows = shared_path(spark, "anchors"), shared_path(spark, "windows")
    packed = "chunk long, bucket int, entries binary"
    _repeated(mapped(staged, report_anchors, packed), anchors)

    def report_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(anchors)
        for number, rows in read(batches, 1):
            if (hot := found(number)) is None:
                continue
            position, a, b = _Words(rows.column("t")).candidates(hot, width)
            yield from _reports(number, position, a, b, buckets)

    _repeated(mapped(staged, report_windows, packed), windows)

    schema = T.StructType([*own.schema["o"].dataType.fields] if others else []).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_text", T.StringType()).add("kept_sha256", T.StringType())

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(windows)
        for number, rows in read(batches, 0, 1):
            words = _Words(rows.column("t"))
            drop = np.zeros(len(words.start), bool)
            if (hot := found(number)) is not None:
                start = window_starts(words.first, width)
                table = window_table(words.hashes, width)
                start = start[np.isin(table[start], table[hot])]
                change = np.zeros(len(drop) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + width, -1)
                drop = np.cumsum(change)[:-1] > 0
            yield _kept(rows.column("o") if others else None, words, drop, names)

    return mapped(staged, remove, schema)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _kept(others: pa.StructArray | None, words: _Words, drop: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The kept words of each document joined by one space, and the counts."""
    n_words, gone = np.diff(words.first), np.concatenate([[0], np.cumsum(drop)])
    n_removed = gone[words.first[1:]] - gone[words.first[:-1]]
    row_end = words.at[1:][rows_of(np.arange(len(words.start)), words.first)]
    change = np.zeros(len(words.data) + 1, np.int8)
    change[words.start[~drop]] += 1
    np.add.at(change, (words.end + (words.end < row_end))[~drop], -1)  # a word and the byte after it, within its text
    mask = np.cumsum(change, dtype=np.int8)[:-1] > 0  # 0 or 1 everywhere
    spaced = np.where(SPACED[words.data], words.data, 32).astype(np.uint8)
    texts = [spaced[a:b][mask[a:b]].tobytes().rstrip(b" ") for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
    added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x.decode() for x in texts], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
    own = [] if others is None else [others.field(k) for k in range(others.type.num_fields)]
    kinds = [] if others is None else [others.type.field(k).name for k in range(others.type.num_fields)]
    return pa.RecordBatch.from_arrays([*own, *added], names=[*kinds, *names])
