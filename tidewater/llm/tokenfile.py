"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

Model: the two ids before (order 2, hashed) and the id before (order 1) each guess one id and keep a confidence; order 0
has adaptive frequencies of all ids of the block. The three predictions are mixed with weights that are learned for each
pair of confidences: an id that a guess names has that guess's weight, any other id its share of the order-0 weight. The
mixed probabilities drive a carryless 64-bit range coder with 16-bit units.

A block of up to ``BLOCK`` ids is dealt in runs of ``STEPS`` ids, one lane each. All lanes of a block share one model and
are coded in step with numpy, so the model learns from all of them after each step. Every block starts from fresh model
state and has its own header, so any block can be read alone.

Format of a file (little-endian): magic ``TWID2``; blocks; document index (doc_id i64, null flag u8, n_tokens u64 each);
JSON footer (end id, number of documents and ids, offset and ids of each block); crc32 of index and footer (u32), footer
length (u32), magic. A block: ids, crc32 of the ids as u32, distinct ids, bytes of their list, units (u32 each); the
distinct ids (zlib of their gaps as u32); units of each lane (u16 each); units (u16 each), lane by lane.

Defined results: any ids below 2**32 can be written. A damaged block is noticed by its checksum; it raises ValueError,
or, if the reader asks for it, leaves the ids of the documents that reach into it null and costs no other.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import U64, filesystem, normal_uri, shared_path, slices
from tidewater.llm.tokenizing import encoder

MAGIC = b"TWID2"
STEPS, LANES = 256, 8192
BLOCK = STEPS * LANES
#: Bytes of text that are encoded at once.
SLICE_BYTES = 8 << 20
#: Ids after which a new file begins.
FILE_IDS = 1 << 26
_HEAD = struct.Struct("<IIIII")
_TAIL = struct.Struct("<II5s")
_SLOT_BITS, _SURE = 18, 8
_MIX_BITS, _LEAST = 15, 2048  # weights add up to 2**15, of which order 0 has 2,048 at least
_ID_BITS = 22  # shares of ids within order 0 add up to 2**22; a block has 2**21 distinct ids at most
_STEP, _MOST = 4, 1 << 16
_SHORT = U64(1 << 40)  # the range is kept above: both sums of shares fit
_CAPACITY = 4 * STEPS + 8  # units of a lane at most
# What happens to a guess, by its confidence, and 8 more if it was right: the change of confidence, and whether it goes
_CHANGE = np.array([0, 0, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int32).view(np.uint32)
_GOES = np.arange(16) < 2


class _Model:
    """Predictions of the next symbol of each lane; symbols are ranks of ids among those of the block."""

    def __init__(self, symbols: int, lanes: int):
        self.frequency, self.steps = np.ones(symbols, np.int64), 0
        # (symbol + 1) << 3 | confidence; 0: no guess yet
        self.guess1, self.guess2 = np.zeros(symbols + 1, np.uint32), np.zeros(1 << _SLOT_BITS, np.uint32)
        self.won = np.ones((_SURE * _SURE * 2, 3), np.int64)
        self.before, self.before2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def _refresh(self) -> None:
        """Shares of the order-0 ids and of the three orders from the counts so far."""
        symbols, total = len(self.frequency), int(self.frequency.sum())
        below = np.zeros(symbols + 1, np.int64)
        np.cumsum(self.frequency, out=below[1:])
        # every id has a share of 1 at least; doubles hold all products, and rounding keeps their order
        self.below = (below * (((1 << _ID_BITS) - symbols) / total)).astype(np.int64) + np.arange(symbols + 1)
        self.below[-1] = 1 << _ID_BITS
        self.id_start, self.id_size = self.below.astype(U64), np.diff(self.below).astype(U64)
        full = self.won.sum(1) > _MOST
        if full.any():
            self.won[full] = (self.won[full] + 1) >> 1
        weight = self.won * ((1 << _MIX_BITS) - _LEAST) // self.won.sum(1, keepdims=True)
        weight[:, :2] += 1
        weight[:, 2] = (1 << _MIX_BITS) - weight[:, 0] - weight[:, 1]
        edge = np.cumsum(weight, 1)
        self.weight, self.start = weight.reshape(-1).astype(U64), (edge - weight).reshape(-1).astype(U64)

    def predict(self) -> None:
        if self.steps < 16 or not self.steps % 4:
            self._refresh()
        mixed = self.before * np.uint32(0x85EBCA6B) ^ self.before2 * np.uint32(0xC2B2AE35)
        mixed *= np.uint32(0x9E3779B1)
        mixed >>= np.uint32(32 - _SLOT_BITS)
        self.slot1, self.slot2 = self.before.astype(np.intp), mixed.astype(np.intp)
        self.held1, self.held2 = self.guess1.take(self.slot1), self.guess2.take(self.slot2)
        self.sure1, self.sure2 = self.held1 & np.uint32(7), self.held2 & np.uint32(7)
        self.named1, self.named2 = self.held1 >> np.uint32(3), self.held2 >> np.uint32(3)
        context = self.sure2 * np.uint32(2 * _SURE)
        context += self.sure1 * np.uint32(2)
        context += self.named1 == self.named2
        self.context = context.astype(np.intp) * 3

    def learn(self, symbol: np.ndarray, now: np.ndarray, right2: np.ndarray, right1: np.ndarray, place: np.ndarray) -> None:
        """``now``: symbol + 1 as uint32; ``right2``, ``right1``: which guesses named it; ``place``: context and order that did."""
        self.won += np.bincount(place, minlength=self.won.size).reshape(self.won.shape) * 4
        np.add.at(self.frequency, symbol, _STEP)
        fresh = now << np.uint32(3) | np.uint32(1)
        for table, slot, held, sure, right in ((self.guess1, self.slot1, self.held1, self.sure1, right1), (self.guess2, self.slot2, self.held2, self.sure2, right2)):
            case = right * np.uint32(8)
            case += sure
            held += _CHANGE.take(case)
            np.copyto(held, fresh, where=_GOES.take(case))
            table[slot] = held
        self.before2, self.before = self.before, now
        self.steps += 1

    def drop_last(self) -> None:
        """The last lane has ended."""
        self.before, self.before2 = self.before[:-1], self.before2[:-1]


class _Range:
    """Interval of each lane."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, U64), np.full(lanes, (1 << 64) - 1, U64)

    def narrow(self, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        start *= part
        self.low += start
        np.multiply(part, size, out=self.range)

    def shifts(self) -> Iterator[np.ndarray]:
        """Renormalises; yields the lanes that shift 16 bits out, before they do."""
        k, low, size = None, self.low, self.range
        while True:
            moved = ((low + size) ^ low) < U64(1 << 48)
            short = size < _SHORT
            short &= ~moved
            if short.any():
                at = np.flatnonzero(short)
                at = at if k is None else k[at]
                self.range[at] = (U64(0) - self.low[at]) & (_SHORT - U64(1))
                moved |= short
            k = np.flatnonzero(moved) if k is None else k[moved]
            if not len(k):
                return
            yield k
            low, size = self.low[k] << U64(16), self.range[k] << U64(16)
            self.low[k], self.range[k] = low, size

    def drop_last(self) -> None:
        self.low, self.range = self.low[:-1], self.range[:-1]


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and the rank of each id among them."""
    if int(ids.max()) >= 1 << 24:
        return np.unique(ids, return_inverse=True)
    known = np.zeros(int(ids.max()) + 1, bool)
    known[ids] = True
    return np.flatnonzero(known), (np.cumsum(known) - 1)[ids]


def encode_block(ids: np.ndarray) -> bytes:
    """One block of 1 to BLOCK ids below 2**32."""
    ids = np.ascontiguousarray(ids, "<u4")
    symbols, rank = _distinct(ids)
    n, lanes = len(ids), -(-len(ids) // STEPS)
    tail = n - (lanes - 1) * STEPS
    grid = np.zeros(lanes * STEPS, np.int64)
    grid[:n] = rank
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    model, coder = _Model(len(symbols), lanes), _Range(lanes)
    units, place, left = np.zeros(lanes * _CAPACITY, np.uint16), np.arange(lanes) * _CAPACITY, lanes

    def end(k: np.ndarray) -> None:
        # the first value in the interval whose lower 32 bits are zeros, which the reader adds
        last = coder.low[k] + U64((1 << 32) - 1)
        units[place[k]], units[place[k] + 1] = last >> U64(48), last >> U64(32) & U64(0xFFFF)
        place[k] += 2

    for step in range(STEPS):
        if step == tail:
            left -= 1
            end(np.array([left]))
            model.drop_last()
            coder.drop_last()
        if not left:
            break
        symbol = grid[step, :left]
        model.predict()
        now = symbol.astype(np.uint32) + np.uint32(1)
        right2, right1 = model.named2 == now, model.named1 == now
        at = model.context + np.where(right2, 0, 2 - right1)
        coder.narrow(coder.range >> U64(_MIX_BITS), model.start.take(at), model.weight.take(at))
        others = ~(right2 | right1)
        start, size = model.id_start.take(symbol), model.id_size.take(symbol)
        start *= others
        np.copyto(size, U64(1), where=~others)
        coder.narrow(coder.range >> others * U64(_ID_BITS), start, size)
        for k in coder.shifts():
            units[place[k]] = coder.low[k] >> U64(48)
            place[k] += 1
        model.learn(symbol, now, right2, right1, at)
    end(np.arange(left))
    used = (place - np.arange(lanes) * _CAPACITY).astype("<u2")
    payload = units.reshape(lanes, _CAPACITY)[np.arange(_CAPACITY) < used[:, None]].astype("<u2").tobytes()
    listed = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes(), 6)
    return _HEAD.pack(n, zlib.crc32(ids.tobytes()), len(symbols), len(listed), len(payload) // 2) + listed + used.tobytes() + payload


def decode_block(raw: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if it is damaged."""
    try:
        n, crc, size, listed, units = _HEAD.unpack_from(raw)
        lanes = -(-n // STEPS)
        if not 0 < n <= BLOCK or len(raw) != _HEAD.size + listed + 2 * lanes + 2 * units or not 0 < size <= n:
            raise ValueError("a block has a wrong size")
        symbols = np.cumsum(np.frombuffer(zlib.decompress(raw[_HEAD.size : _HEAD.size + listed]), "<u4").astype(np.int64))
        used = np.frombuffer(raw, "<u2", lanes, _HEAD.size + listed).astype(np.int64)
        if len(symbols) != size or int(used.sum()) != units:
            raise ValueError("a block has a wrong size")
        ids = symbols[_decode(n, size, used, np.frombuffer(raw, "<u2", units, _HEAD.size + listed + 2 * lanes))].astype("<u4")
    except (struct.error, zlib.error) as e:
        raise ValueError("a block is damaged") from e
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids


def _decode(n: int, size: int, used: np.ndarray, units: np.ndarray) -> np.ndarray:
    lanes = len(used)
    tail, left = n - (lanes - 1) * STEPS, lanes
    stream = np.concatenate([units, np.zeros(1, np.uint16)]).astype(U64)
    end = np.cumsum(used)
    place, none = end - used, len(stream) - 1
    model, coder, grid = _Model(size, lanes), _Range(lanes), np.zeros((STEPS, lanes), np.int64)
    code = np.zeros(lanes, U64)

    def shift(k: np.ndarray) -> None:
        at = place[k]
        code[k] = code[k] << U64(16) | stream[np.where(at < end[k], at, none)]
        place[k] = at + 1

    for _ in range(4):
        shift(np.arange(lanes))
    for step in range(STEPS):
        if step == tail:
            left -= 1
            model.drop_last()
            coder.drop_last()
            code = code[:-1]
        if not left:
            break
        model.predict()
        part, value = coder.range >> U64(_MIX_BITS), code - coder.low
        source = (value >= part * model.start.take(model.context + 1)).astype(np.intp) + (value >= part * model.start.take(model.context + 2))
        at = model.context + source
        coder.narrow(part, model.start.take(at), model.weight.take(at))
        others = source == 2
        part = coder.range >> others * U64(_ID_BITS)
        now = np.where(source == 0, model.named2, model.named1)
        k = np.flatnonzero(others)
        value, own = code[k] - coder.low[k], part[k]
        # the quotient in doubles may be off by one
        share = np.minimum(value / own, (1 << _ID_BITS) - 1).astype(U64)
        share -= own * share > value
        share += own * (share + U64(1)) <= value
        now[k] = np.searchsorted(model.below, share.astype(np.int64), "right")
        np.clip(now, 1, size, out=now)
        symbol = now.astype(np.int64) - 1
        start, width = model.id_start.take(symbol), model.id_size.take(symbol)
        start *= others
        np.copyto(width, U64(1), where=~others)
        coder.narrow(part, start, width)
        for k in coder.shifts():
            shift(k)
        grid[step, :left] = symbol
        model.learn(symbol, now, model.named2 == now, model.named1 == now, at)
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


class Writer:
    """Writes one file to a stream, block by block: at most a block and one document are in memory besides the index."""

    def __init__(self, out, end_id: int):
        self.out, self.end_id, self.at = out, end_id, len(MAGIC)
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.blocks: list[tuple[int, int]] = []
        self.waiting, self.held, self.ids = [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as little-endian u32."""
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK:
            self._blocks(BLOCK)

    def _blocks(self, least: int) -> None:
        ids, at = np.frombuffer(b"".join(self.waiting), "<u4"), 0
        while len(ids) - at >= least:
            own = ids[at : at + BLOCK]
            block = encode_block(own)
            self.blocks.append((self.at, len(own)))
            self.out.write(block)
            self.at += len(block)
            at += len(own)
        self.waiting, self.held = [ids[at:].tobytes()], len(ids) - at

    def close(self) -> None:
        if self.held:
            self._blocks(1)
        index = np.array([-1 if d is None else d for d in self.doc_ids], "<i8").tobytes() + np.array([d is None for d in self.doc_ids], "u1").tobytes() + np.array(self.sizes, "<u8").tobytes()
        footer = json.dumps({"end_id": self.end_id, "documents": len(self.doc_ids), "ids": self.ids, "index": self.at, "blocks": self.blocks}).encode()
        self.out.write(index + footer + _TAIL.pack(zlib.crc32(index + footer), len(footer), MAGIC))


class Reader:
    """Index and blocks of a file that can be read at any place."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        if size < len(MAGIC) + _TAIL.size or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token-id file")
        crc, length, magic = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC or length > size - _TAIL.size:
            raise ValueError("the index is damaged")
        raw = self._read(size - _TAIL.size - length, length)
        try:
            footer = json.loads(raw)
            n, self.end = footer["documents"], footer["index"]
            index = self._read(self.end, 17 * n)
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("the index is damaged") from e
        if zlib.crc32(index + raw) != crc:
            raise ValueError("the index is damaged")
        self.end_id, self.ids, self.blocks = footer["end_id"], footer["ids"], footer["blocks"]
        doc_ids, null = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(doc_ids, null, strict=True)]
        self.sizes = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, k: int) -> np.ndarray:
        """The ids of block k alone; raises ValueError if it is damaged."""
        at, n = self.blocks[k]
        ids = decode_block(self._read(at, (self.blocks[k + 1][0] if k + 1 < len(self.blocks) else self.end) - at))
        if len(ids) != n:
            raise ValueError("ids are missing")
        return ids

    def documents(self, keep_damaged: bool = False) -> Iterator[tuple[int, list[bytes | None]]]:
        """(first document, ids of it and the next ones) as blocks complete them; None for one that a damaged block holds a part of."""
        ends, done, first, held = np.cumsum(self.sizes), 0, 0, b""
        lost: list[tuple[int, int]] = []  # ids of damaged blocks that documents to come may hold
        for k, (_, size) in enumerate(self.blocks):
            try:
                held += self.block(k).tobytes()
            except ValueError:
                if not keep_damaged:
                    raise
                held += bytes(4 * size)
                lost.append((done, done + size))
            done += size
            at = start = done - len(held) // 4
            last, out = int(np.searchsorted(ends, done, "right")), []
            for end in ends[first:last].tolist():
                out.append(None if any(x < end and at < y for x, y in lost) else held[4 * (at - start) : 4 * (end - start)])
                at = end
            held, lost = held[4 * (at - start) :], [(x, y) for x, y in lost if y > at]
            yield first, out
            first = last
        if first < len(self.sizes) and not self.sizes[first:].any():
            yield first, [b""] * (len(self.sizes) - first)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Writes the ids of every document and an end id, in ascending doc_id order (nulls first, then by a hash of the text).

    Returns a manifest, one entry for each file in order: file, documents, ids. A task begins a new file after FILE_IDS
    ids, and rows that are equal in all columns are dealt by their place in the input, so neither a large partition nor
    a hot doc_id has to fit in memory. A file counts only if it is listed, so files of attempts that failed or ran twice
    do no harm. Null texts are empty. An empty table gives no files.
    """
    spark = docs.sparkSession
    path = normal_uri(path or shared_path(spark, "tokens"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("place"))
    order = (F.col("d").asc_nulls_first(), F.xxhash64("t"), F.col("place"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, context = encoder(tokenizer).column, end_id.to_bytes(4, "little"), TaskContext.get()
        fs, folder = filesystem(path)
        name, file, writer, number = "", None, None, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            file.close()
            return pa.RecordBatch.from_pydict({"part": [context.partitionId()], "number": [number], "file": [f"{path}/{name}"], "documents": [len(writer.doc_ids)], "ids": [writer.ids]})

        for batch in slices(batches, "t", SLICE_BYTES):
            for d, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    name = f"part-{context.partitionId():06d}-{number:06d}-{context.taskAttemptId()}.twid"
                    file = fs.open_output_stream(f"{folder}/{name}")
                    writer = Writer(file, end_id)
                writer.add(d, ids + end)
                if writer.ids >= FILE_IDS:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    done = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "part long, number long, file string, documents long, ids long")
    return [{"file": r["file"], "documents": r["documents"], "ids": r["ids"]} for r in sorted(done.collect(), key=lambda r: (r["part"], r["number"]))]


def read_tokens(spark, manifest: list[dict], keep_ids: bool = False, keep_damaged: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as bytes) of every document in the files of a manifest.

    A damaged block raises an error; with ``keep_damaged``, ids and checksum of the documents in it are null instead.
    """
    base, listed = 0, []
    for entry in manifest:
        listed.append((entry["file"], base))
        base += entry["ids"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = filesystem(file)
                with fs.open_input_file(place) as f:
                    reader = Reader(f)
                    starts = np.cumsum(reader.sizes) - reader.sizes + base
                    for first, own in reader.documents(keep_damaged):
                        last = first + len(own)
                        arrays = [pa.array(reader.doc_ids[first:last], pa.int64()), pa.array(starts[first:last]), pa.array(reader.sizes[first:last]), pa.array([None if x is None else zlib.crc32(x) for x in own], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(own, pa.binary())] if keep_ids else [])], names=names)

    files = spark.createDataFrame(listed, "file string, base long").repartition(max(1, len(listed)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
