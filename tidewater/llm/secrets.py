"""Secret scans with a recursive decoding worklist.

Every text is scanned for the three base kinds (assigned values, access keys, long hex strings). Tokens that look URL-
escaped, Unicode-escaped or base64 are unwrapped into layers, compressed base64 payloads are inflated, and each layer is
scanned and searched for further layers in turn, until the worklist is empty. Escapes that can't be decoded stay as they
are; base64 is read at each of its four alignments and across wrapped lines, and every printable stretch counts. A layer whose content was seen before at
the same place is not visited again, so cycles end. Each layer keeps, for every character, the code point range of the
original text that it came from; spans found inside are reported there.

Scanning is a map over whole texts without a shuffle.

Defined results: null and empty texts have no spans; equal texts get equal spans; spans of one kind and place are listed
once. Compressed payloads are read to the end, all members, in pieces cut where no pattern can match across. Only where
the layers of one text inflate beyond ``RATIO`` times its length plus ``SPARE`` bytes, more than gzip or zlib reach in one
layer, is the rest not read; the place of each such payload is then listed as a span of kind ``unread``.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import mapped, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Bytes inflated at a time.
PIECE = 1 << 20
#: Bounds against decompression bombs: inflated bytes for each character of the text, and bytes besides.
RATIO, SPARE = 1100, 64 << 20
UNREAD = "unread"

# Regions are found first and looked into afterwards: each character is read once, however long a region is.
_URL, _TOKEN = re.compile(r"[!-~]+"), re.compile(r"\S+")
_URL_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"[ \t\r\n]+")
#: How gzip, zlib, bzip2, xz and zstandard start.
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Printable UTF-8, at least as long as the shortest secret; an encoded secret is longer.
_STRETCH = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]|\xc2[\xa0-\xbf]|[\xc3-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}"
)
_CONTROL = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\ufffc\ufffe-\U0010ffff]+")
#: Ends of pieces: no pattern matches across a space between two letters or digits, an empty line or a control character.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \t](?=[A-Za-z0-9])|\n\n|" + _CONTROL.pattern)
_WORD = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)\Z")
ADDED = [
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


@dataclass
class _Layer:
    """A decoded text; start[i] and end[i] bound the original code points of its character i, or of all if they are
    numbers. None: the text itself."""

    text: str
    start: list[int] | int | None = None
    end: list[int] | int | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.start, int):
            return self.start, self.end
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


@dataclass
class _Allowed:
    """Bytes that the layers of a text may still inflate to, and the places of payloads that were not read to the end."""

    left: int
    unread: set[tuple[int, int, str]]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def _from_bytes(raw: bytes, bounds) -> _Layer:
    """UTF-8 as a layer; bounds(i) is the original range of byte i."""
    text, start, end, at = raw.decode("utf-8"), [], [], 0
    for char in text:
        size = len(char.encode("utf-8"))
        start.append(bounds(at)[0])
        end.append(bounds(at + size - 1)[1])
        at += size
    return _Layer(text, start, end)


def _unescaped(layer: _Layer, region: re.Match, units: re.Pattern, decode) -> _Layer | None:
    """The region with its escapes decoded and other characters as they are; None if no escape can be decoded."""
    out, start, end, at, some = [], [], [], region.start(), False

    def plain(to: int) -> None:
        for i in range(at, to):
            a, b = layer.span(i, i + 1)
            out.append(layer.text[i])
            start.append(a)
            end.append(b)

    for unit in units.finditer(layer.text, region.start(), region.end()):
        own = decode(layer, unit)
        if own is None:
            continue
        some = True
        plain(unit.start())
        out.append(own.text)
        start += own.start
        end += own.end
        at = unit.end()
    plain(region.end())
    return _Layer("".join(out), start, end) if some else None


def _url_unit(layer: _Layer, unit: re.Match) -> _Layer | None:
    """The unit decoded, except bytes that are no printable UTF-8, which stay escaped; None if all stay."""
    raw = bytes.fromhex(unit[0].replace("%", ""))
    out, start, end, at, some = [], [], [], 0, False
    while at < len(raw):
        size = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
        try:
            char = raw[at : at + size].decode("utf-8")
        except UnicodeDecodeError:
            char, size = "", 1
        first, last = unit.start() + 3 * at, unit.start() + 3 * (at + size)
        decoded = char.isprintable() and char != "" or char in ("\n", "\r", "\t")
        some |= decoded
        for x, i, j in [(char, first, last)] if decoded else [(layer.text[i], i, i + 1) for i in range(first, last)]:
            a, b = layer.span(i, j)
            out.append(x)
            start.append(a)
            end.append(b)
        at += size
    return _Layer("".join(out), start, end) if some else None


def _unicode_unit(layer: _Layer, unit: re.Match) -> _Layer | None:
    body = unit[0]
    if len(body) == 12 and body[6:8] == "\\u":
        a, b = layer.span(unit.start(), unit.end())
        return _Layer(chr(0x10000 + (int(body[2:6], 16) - 0xD800) * 0x400 + int(body[8:], 16) - 0xDC00), [a], [b])
    point = int(body[2:-1]) if body.startswith("&#") and body[2] not in "xX" else int(re.sub(r"[^0-9A-Fa-f]", "", body[2:]), 16)
    if point > 0x10FFFF or 0xD800 <= point < 0xE000 or not point:
        return None
    a, b = layer.span(unit.start(), unit.end())
    return _Layer(chr(point), [a], [b])


def _inflate(raw: memoryview | bytes, read: list[int]) -> Iterator[bytes]:
    """The content of gzip, zlib, bzip2, xz or zstandard members in pieces, as far as they are sound; read[0] is the end of whole members."""
    size = len(raw)
    try:
        while raw:
            if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78":
                member, rest = zlib.decompressobj(31 if raw[0] == 0x1F else 15), raw
                while not member.eof:
                    piece = member.decompress(rest, PIECE)
                    rest = member.unconsumed_tail
                    if piece:
                        yield piece
                    elif not rest:
                        return
                raw = member.unused_data
            elif raw[:3] == b"BZh" or raw[:6] == b"\xfd7zXZ\x00":
                member, rest = bz2.BZ2Decompressor() if raw[:3] == b"BZh" else lzma.LZMADecompressor(), raw
                while not member.eof:
                    piece, rest = member.decompress(rest, PIECE), b""
                    if piece:
                        yield piece
                    elif member.needs_input:
                        return
                raw = member.unused_data
            elif raw[:4] == b"\x28\xb5\x2f\xfd":
                import zstandard

                member, at = zstandard.ZstdDecompressor().decompressobj(), 0
                while not member.eof:
                    if at >= len(raw):
                        return
                    # 256 bytes become 8 MB at most
                    if piece := member.decompress(raw[at : at + 256]):
                        yield piece
                    at += 256
                raw = member.unused_data + raw[at:]
            else:
                return
            raw = raw.lstrip(b"\0")
            read[0] = size - len(raw)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, MemoryError):
        return
    except Exception as e:  # zstandard has its own error class
        if type(e).__name__ != "ZstdError":
            raise


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """The printable stretches of the pieces; one that goes on in the next piece is cut at a safe place or held back."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in pieces:
        known, held, end = len(held), held + decoder.decode(piece), 0
        for m in _SAFE.finditer(held, max(0, known - 2)):
            end = m.end()
        yield from (x for x in _CONTROL.split(held[:end]) if len(x) >= 12)
        held = held[end:]
    yield from (x for x in _CONTROL.split(held + decoder.decode(b"", True)) if len(x) >= 12)


def _allowed(pieces: Iterator[bytes], allowed: _Allowed, place: tuple[int, int]) -> Iterator[bytes]:
    for piece in pieces:
        allowed.left -= len(piece)
        if allowed.left < 0:
            allowed.unread.add((*place, UNREAD))
            return
        yield piece


def _base64(layer: _Layer, m: re.Match, allowed: _Allowed) -> Iterator[_Layer]:
    """Printable stretches and inflated payloads of a base64 run, read from each of its first four characters."""
    body, place = m[0].rstrip("="), None
    if _BREAK.search(body):
        place = [m.start() + i for i, c in enumerate(body) if not c.isspace()]
        body = _BREAK.sub("", body)
    if len(body) < 16 or _WORD.match(body):
        return
    body = body.replace("-", "+").replace("_", "/")
    for skip in range(4):
        own = body[skip : len(body) - ((len(body) - skip) % 4 == 1)]
        raw = base64.b64decode(own + "=" * (-len(own) % 4))

        def bounds(i: int, skip: int = skip) -> tuple[int, int]:
            # byte i comes from the characters that hold its bits
            at = skip + 4 * (i // 3) + i % 3
            return layer.span(m.start() + at, m.start() + at + 2) if place is None else layer.span(place[at], place[at + 1] + 1)

        at, inside = 0, []
        while magic := _MAGIC.search(raw, at):
            read, whole = [1], (bounds(magic.start())[0], layer.span(m.start(), m.end())[1])
            for inner in _texts(_allowed(_inflate(memoryview(raw)[magic.start() :], read), allowed, whole)):
                yield _Layer(inner, *whole)
            if (*whole, UNREAD) in allowed.unread:
                break
            at = magic.start() + read[0]
            inside.append((magic.start(), at))
        for stretch in _STRETCH.finditer(raw):
            if any(a <= stretch.start() and stretch.end() <= b for a, b in inside):
                continue
            yield _from_bytes(stretch[0], lambda i, first=stretch.start(), bounds=bounds: bounds(first + i))


def _layers(layer: _Layer, allowed: _Allowed) -> Iterator[_Layer | None]:
    text = layer.text
    if "%" in text:
        for m in _URL.finditer(text):
            if _URL_UNIT.search(text, m.start(), m.end()):
                yield _unescaped(layer, m, _URL_UNIT, _url_unit)
    if "\\" in text or "&#" in text:
        for m in _TOKEN.finditer(text):
            if _UNICODE.search(text, m.start(), m.end()):
                yield _unescaped(layer, m, _UNICODE, _unicode_unit)
    for m in _BASE64.finditer(text):
        yield from _base64(layer, m, allowed)
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            yield from _base64(layer, m, allowed)


_END = object()
_ORDER = (*KINDS, UNREAD)


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text, each (start, end, kind) by start and then kind as listed."""
    if not text:
        return [], []
    base = base_spans(text)
    allowed = _Allowed(RATIO * len(text) + SPARE, set())
    # layers are made one at a time, the innermost first, so that no more than a chain of them is in memory
    found, seen, work = {*base}, set(), [_layers(_Layer(text), allowed)]
    while work:
        if (inner := next(work[-1], _END)) is _END:
            work.pop()
            continue
        if inner is None or not inner.text:
            continue
        key = hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *inner.span(0, len(inner.text))
        if key in seen:
            continue
        seen.add(key)
        found.update((*inner.span(a, b), kind) for a, b, kind in base_spans(inner.text))
        work.append(_layers(inner, allowed))
    found |= allowed.unread
    if len(found) == len(base):
        return base, base
    return base, sorted(found, key=lambda x: (x[0], _ORDER.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and digest of the base kinds, all spans as text, and all spans as an array, to each row."""
    docs = docs.drop(*(f.name for f in ADDED))
    schema = T.StructType([*docs.schema.fields, *ADDED])
    at = docs.columns.index(text)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts: list[list[int]] = [[], [], []]
            sums, spans, found = [], [], []
            for value in batch.column(at).to_pylist():
                base, every = scan(value)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(x[2] == kind for x in base))
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in every])
            extra = [*(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(found, kind_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *(f.name for f in ADDED)])

    return mapped(docs, run, schema)


def redact(scanned: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replaces the found spans by ``mark``; overlapping spans become one. Works on the rows of scan_secrets."""
    found = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"))))
    step = lambda s, x: F.struct(
        F.concat(s["out"], F.when(x["a"] >= s["at"], F.concat(F.substring(F.col(text), s["at"].cast("int") + 1, (x["a"] - s["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
        F.greatest(s["at"], x["b"]).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"].cast("int") + 1, F.lit(2**31 - 1))))
    return scanned.withColumn(text, F.when(F.size("found") > 0, done).otherwise(F.col(text)))
