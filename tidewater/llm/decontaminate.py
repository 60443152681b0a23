"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of the test items.

Texts are lower-cased (A-Z) and taken as words of letters, digits and non-ASCII characters. The automaton holds every
window of ten item words (a shorter item is one window) and scans the normalised bytes of each document once; places
found are mapped back to word numbers and to code points of the original text. Documents are only mapped over, never
shuffled, so hot sources and copies do not matter.

The items are a stated query set: the driver reads them as a stream and cuts their windows into blocks of at most
``BLOCK_BYTES`` of pattern text, each broadcast and scanned in turn, so that an automaton stays bounded; the driver
holds two blocks at a time.

Defined results: null or empty texts have no words and are clean; null item texts have no windows; a null item_id is left
out of the list of items but its windows hit; repeated items count once by id; an empty item table leaves all clean.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import LOWER, PLAIN, mapped, normalise, private, remove, shared_path, slices, stage, utf8, word_bounds

WINDOW = 10
BLOCK_BYTES = 16 << 20
ADDED = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def item_windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    words = normalise((text or "").encode("utf-8", "surrogatepass")).split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))]


def pattern_blocks(items: DataFrame, item_id: str, text: str, width: int, most: int = BLOCK_BYTES) -> Iterator[dict[bytes, tuple]]:
    """Blocks of {window: item ids}, each of at most ``most`` bytes of windows."""
    block: dict[bytes, set] = {}
    size = 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        for window in item_windows(row["t"], width):
            if window not in block:
                size += len(window)
            block.setdefault(window, set()).add(row["i"])
        if size > most:
            yield {k: tuple(v) for k, v in block.items()}
            block, size = {}, 0
    if block:
        yield {k: tuple(v) for k, v in block.items()}


_BUILT: dict[str, object] = {}


def _automaton(number: str, patterns: dict[bytes, tuple]):
    """Built once for each worker and block; one is kept at a time."""
    import ahocorasick

    if number not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for window, ids in patterns.items():
            found.add_word(window.decode("latin-1"), (len(window), ids))
        found.make_automaton()
        _BUILT[number] = found
    return _BUILT[number]


def scan(normal: bytes, automaton) -> tuple[list[int], set]:
    """Runs of hit words (first, last + 1, first, ...), each inside a window, and the ids of items with occurring windows."""
    found = [(end, *value) for end, value in automaton.iter(normal.decode("latin-1"))] if normal else []
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    end, size = np.array([x[0] for x in found]), np.array([x[1] for x in found])
    change = np.zeros(len(spaces), np.int64)  # one more than words
    np.add.at(change, np.searchsorted(spaces, end - size + 1), 1)
    np.add.at(change, np.searchsorted(spaces, end), -1)
    return _runs(np.cumsum(change)[:-1] > 0), set().union(*(x[2] for x in found))


def _runs(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()


def _merged(runs: list[int]) -> list[int]:
    """Runs of several blocks as one list."""
    out: list[int] = []
    for a, b in sorted(zip(runs[::2], runs[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and hits (runs of hit words, as code points) to each row.

    One block of windows is one pass of its own. If there are more, the passes are staged one after the other, each with
    its own broadcast that goes afterwards, so a worker builds each automaton once and holds one.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(f.name for f in ADDED))
    at, kinds = docs.columns.index(text), docs.schema.fields
    p = private(docs, *(f.name for f in ADDED))
    carried = [T.StructField(f"{p}runs", T.ArrayType(T.LongType())), T.StructField(f"{p}ids", T.ArrayType(T.StringType()))]
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def found(batch: pa.RecordBatch, block, number: str) -> tuple[bytes, np.ndarray, list[bytes], list[list[int]], list[set]]:
        """The texts, and of each its runs of hit words and the items of this block and, where carried, of earlier ones."""
        data, offsets = utf8(batch.column(at))
        whole = data.tobytes()
        normal = [normalise(whole[offsets[k] : offsets[k + 1]]) for k in range(batch.num_rows)]
        both = [scan(one, _automaton(number, block.value)) for one in normal] if block is not None else [([], set()) for _ in normal]
        runs, ids = [x[0] for x in both], [{str(i) for i in x[1] if i is not None} for x in both]
        if batch.num_columns > len(kinds):
            for k, (r, i) in enumerate(zip(batch.column(len(kinds)).to_pylist(), batch.column(len(kinds) + 1).to_pylist(), strict=True)):
                if r:
                    runs[k], ids[k] = _merged(runs[k] + r), ids[k].union(i)
        return whole, offsets, normal, runs, ids

    def step(block, number: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                *_, runs, ids = found(batch, block, number)
                extra = [pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(x) for x in ids], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kinds)], *extra], names=[*batch.schema.names[: len(kinds)], *(f.name for f in carried)])

        return run

    def last(block, number: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                whole, offsets, normal, runs, ids = found(batch, block, number)
                n_hit, names = [sum(r[1::2]) - sum(r[::2]) for r in runs], [sorted(x) for x in ids]
                spans = [_spans(whole[offsets[k] : offsets[k + 1]], r) if r else [] for k, r in enumerate(runs)]
                extra = [
                    pa.array([max(0, x.count(b" ") - 1) for x in normal], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(spans, ranges),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kinds)], *extra], names=[*batch.schema.names[: len(kinds)], *(f.name for f in ADDED)])

        return run

    share = lambda b: None if b is None else spark.sparkContext.broadcast(b)
    blocks = pattern_blocks(items, item_id, item_text, width, block_bytes)
    block, room = next(blocks, None), None
    while (following := next(blocks, None)) is not None:
        sent, before, after = share(block), room, shared_path(spark, "scanned")
        docs = stage(mapped(docs, step(sent, uuid.uuid4().hex), T.StructType([*kinds, *carried])), "block", after)
        sent.destroy()
        if before:
            remove(spark, before)
        block, room = following, after
    return mapped(docs, last(share(block), uuid.uuid4().hex), T.StructType([*kinds, *ADDED]))


def _spans(raw: bytes, runs: list[int]) -> list[dict]:
    """Runs of hit words as code point ranges of the original text."""
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = word_bounds(LOWER[data], np.array([0, len(data)]), PLAIN)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": int(points[start[a]]), "end": int(points[end[b - 1]])} for a, b in zip(runs[::2], runs[1::2], strict=True)]
