"""Shared pieces of the training-data operators: shared folder, staged tables, vectorised words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text that one vectorised step works on (one longer document is a step of its own).
SLICE_BYTES = 2 << 20
#: Rows of a file whose marked keys are in one list.
LISTED = 1 << 16
#: Whether Spark deletes the shuffle files of an execution as soon as it ends, and not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes of a batch of rows on its way to Python, or a single row. Both Java and Python hold some copies of it, for each core.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables that workers keep from task to task, by the operators that use them.
TABLES: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, it is set to a temporary folder, on one machine only."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not (found := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidewater-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, room: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, or to ``room`` in it, and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name) if room is None else f"{room}/{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go when it is written: nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _begin(uses: str | None) -> None:
    for name, table in TABLES.items():
        if name != uses:
            table.clear()


def _give_back() -> None:
    """Memory that is free, but held by the allocators, goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, uses: str | None = None) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in lean workers, by batches of bounded size: 10,000 texts of any length are none.

    The bound holds for the session from then on, as the rows are read later, unless the session has one of its own.
    """
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows.mapInArrow(lean(run, uses), schema)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, in a worker that drops tables of other operators first and gives back free memory at the end.

    Spark keeps workers from task to task and from query to query, two for an executor of two cores, and what they hold
    counts as long as they live.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(uses)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


class _Lists:
    """Marked keys of the parts of a table, read from the shared folder; those of the parts of one batch are kept."""

    def __init__(self, path: str):
        self.path, self.lists = path, {}

    def _read(self, part: int) -> pa.Array:
        import pyarrow.dataset as ds

        fs, path = filesystem(normal_uri(f"{self.path}/part={part}"))
        if fs.get_file_info(path).type.name != "Directory":
            return pa.array([], pa.int64())
        return ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["id"]).column(0).combine_chunks()

    def __call__(self, parts: pa.Array, keys: pa.Array) -> pa.Array:
        here, parts = parts.unique().to_pylist(), parts.to_numpy(zero_copy_only=False)
        self.lists = {p: self.lists[p] if p in self.lists else self._read(p) for p in here}
        out = np.zeros(len(keys), bool)
        for p in here:
            own = np.flatnonzero(parts == p)
            out[own] = pc.is_in(keys.take(pa.array(own)), value_set=self.lists[p]).to_numpy(zero_copy_only=False)
        return pa.array(out)


def listed(docs: DataFrame, key: str, ids: DataFrame, room: str | None = None) -> tuple[DataFrame, Column, _Lists]:
    """(rows, part, lists): ``lists`` tells by part and key, in Python, whether ``key``, as long, is among the ``id`` of ``ids``.

    Rows of ``docs`` stay where they are, however long they are: only their keys move, with the part of the file that they
    are in. The keys found are written by part, and a task reads the lists of the parts of its own rows. A part only says
    where to look, so rows that share one need not differ. What is not read from files that number their rows is staged.
    """
    spark = docs.sparkSession

    def part() -> Column:
        place = docs.metadataColumn("_metadata")
        return F.xxhash64(place["file_path"], F.floor(place["row_index"] / LISTED))

    try:
        docs.select(part())
    except AnalysisException:
        docs = stage(docs, "rows", room)
    number = F.col(f"`{key}`").cast("long")
    path = shared_path(spark, "marked") if room is None else f"{room}/marked-{uuid.uuid4().hex}"
    found = docs.select(number.alias("id"), part().alias("part")).where("id is not null").join(ids.select("id"), "id", "left_semi")
    with shuffles_end(spark):
        found.hint("rebalance", "part").write.partitionBy("part").parquet(path)
    return docs, part(), _Lists(path)


def marked(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """(rows, condition): whether the column ``key``, as long, is among the ``id`` of ``ids``, as ``listed`` tells; no null is."""
    rows, part, lists = listed(docs, key, ids)

    def among(parts: pa.Array, keys: pa.Array) -> pa.Array:
        return lists(parts, keys)

    among.__annotations__ = {"parts": pa.Array, "keys": pa.Array, "return": pa.Array}
    return rows, F.arrow_udf(among, "boolean")(part, F.col(f"`{key}`").cast("long"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of staged tables that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def private(docs: DataFrame, *more: str) -> str:
    """A prefix that no column of ``docs`` and none of ``more`` begins with."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in (*docs.columns, *more)):
        prefix += "_"
    return prefix


def least_hashed(rows: DataFrame, key: Column, n: int, known: DataFrame) -> DataFrame:
    """``rows`` with a hash ``h`` of their key below a bound that some ``n`` of the rows of ``known`` stay under, and a quarter more.

    ``known`` has the rows that count, with no more columns than needed. A sort for the ``n`` least hashes then moves
    about ``n`` rows in all, not ``n`` rows of each partition.
    """
    total = known.count()
    hashed = rows.withColumn("h", F.xxhash64(key))
    return hashed if 1.25 * n >= total else hashed.where(F.col("h") < int(1.25 * n / total * 2**64) - 2**63)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def normal_uri(uri: str) -> str:
    """``file:/x`` as ``file:///x``; others as they are."""
    return "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of ``column``, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes of a word whose random numbers are looked up; those of later bytes are made when they are met.
_NEAR = 48
#: Words hashed in one step.
_HASHED = 1 << 16


def _symbols(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte at each place of a word."""
    return mix(mix(place.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1)) ^ (byte.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95))


_TABLE = _symbols(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256))


def class_table(outside: str | bytes) -> np.ndarray:
    """Which of the 256 bytes belong to words, given those that do not."""
    table = np.ones(256, bool)
    table[np.frombuffer(outside if isinstance(outside, bytes) else outside.encode(), np.uint8)] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = class_table(b" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower-cased
PLAIN = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_NORMAL = bytes(int(LOWER[b]) if PLAIN[LOWER[b]] else 32 for b in range(256))


def normalise(text: bytes) -> bytes:
    """The words of a UTF-8 text, lower-cased, each between single spaces; empty if there are none."""
    words = text.translate(_NORMAL).split(b" ")
    joined = b" ".join(filter(None, words))
    return b" " + joined + b" " if joined else b""


def word_bounds(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row offsets) of the words of each row: byte positions, and the first word of each row."""
    inside = table[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word: the sum of a random number for each of its bytes at its place, mixed with its length.

    Words differ in a number for at least one place, so unlike sums of powers no two of them agree by their structure.
    """
    out = np.zeros(len(start), U64)
    for a in range(0, len(start), _HASHED):
        own = slice(a, a + _HASHED)
        size = end[own] - start[own]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        byte = data[place + np.repeat(start[own], size)]
        number = _TABLE[np.minimum(place, _NEAR - 1) << 8 | byte]
        if size.max() > _NEAR:
            far = np.flatnonzero(place >= _NEAR)
            number[far] = _symbols(byte[far], place[far])
        out[own] = mix(np.add.reduceat(number, first) + size.astype(U64))
    return out


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Positions of the words at which a window of ``width`` words of one row starts."""
    last = np.maximum(first[1:] - width + 1, first[:-1])
    n = last - first[:-1]
    return np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of two hashes in their order."""
    own = b ^ (b >> U64(29))
    own *= U64(0xD6E8FEB86659FD93)
    own += a * U64(0x9E3779B97F4A7C15)
    own += U64(salt)
    return mix(own)


def window_table(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of words[s:s + width] for every s from 0 to len(words) - width; ``which`` chooses one of two families.

    Hashes of 1, 2, 4, ... words are made from two of half the size; those that add up to the width are joined.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    level, size, done, joined = mix(words ^ U64((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)[which])), 1, 0, None
    while True:
        if width & size:
            own = level[done : done + n]
            joined = own if joined is None else _pair(joined, own, 2 * size + 1)
            done += size
        if 2 * size > width:
            return joined
        level = _pair(level[:-size], level[size:], 2 * size)
        size *= 2


def window_hashes(words: np.ndarray, start: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of words[s:s + width] for each s of ``start``."""
    return window_table(words, width, which)[start] if len(start) else np.zeros(0, U64)


def rows_of(position: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row in which each word position lies."""
    return np.searchsorted(first, position, "right") - 1
