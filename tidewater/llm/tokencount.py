"""Exact token counts at every prefix, by dynamic programming over a BPE vocabulary with byte fallback.

A text is cut where no piece of the vocabulary can span: before each run of the space mark that follows another
character. Within such a segment the last token of every prefix is unique: it is the suffix piece that is compatible
with the last token of the prefix before it, compatible meaning that the pair encodes as itself. So
``count[i] = count[i - len(last)] + 1``, and the counts of all prefixes of a text are the running sums over its
segments. Truncation and budget questions then need a lookup instead of another encoding.

Segments repeat, so each worker keeps a bounded table of solved ones. Long segments are solved by the same program.

Defined results: a null or empty text has one prefix with count 0. Rows are independent: ties and repeated rows get
equal answers; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.llm.common import slices

MARK = "▁"
#: Texts that normalisers change: runs of spaces and spaces at the ends, composed and decomposed, wide, circled and joined letters, case.
_REWRITTEN = ("a  b", "  a ", "a\nb\tc", "e\u0301 é Å \u212b", "ＡＢ１", "①½²", "ﬁ ﬀ", "ABC Straße", "a\u00a0b\u200bc", "…“x”")
#: Solved segments that a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 800_000, 48


class PrefixCounter:
    """Counts the tokens of all prefixes as a sentencepiece BPE model gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.rank = {pieces[i]: -self.model.get_score(i) for i in plain}
        self.longest = max(map(len, self.rank), default=1)
        self.adds_mark = bool(self.model.encode("a", out_type=str)[0].startswith(MARK)) or self.model.encode("a", out_type=str)[0] == MARK
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces span a space: this vocabulary can't be cut into segments")
        for text in _REWRITTEN:
            if self._surface(text) != (MARK if self.adds_mark else "") + text.replace(" ", MARK):
                raise ValueError("the model rewrites texts before it encodes them, so counts at its prefixes can't be read off")
        self.split: dict[str, tuple[str, str]] = {}
        self.suffixes: dict = {}
        for piece in self.rank:
            if len(piece) == 1 or self._is_whole(piece):
                node = self.suffixes
                for char in reversed(piece):
                    node = node.setdefault(char, {})
                node[""] = True
        self.fits: dict[tuple[str, str], bool] = {}
        self.solved: dict[str, bytes] = {}
        self.touching = {a + b for piece in self.rank for a, b in zip(piece, piece[1:], strict=False)}

    def _surface(self, text: str) -> str:
        """The text that the pieces spell."""
        raw = b""
        for i in self.model.encode(text):
            piece = self.model.id_to_piece(i)
            raw += bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.encode("utf-8")
        return raw.decode("utf-8", "replace")

    def _is_whole(self, piece: str) -> bool:
        """Whether the piece encodes as itself; notes the two parts of its last merge."""
        parts, rank = list(piece), self.rank
        while len(parts) > 2:
            ranked = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
            if not ranked:
                return False
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.split[piece] = (parts[0], parts[1])
        return True

    def _fit(self, left: str, right: str) -> bool:
        """Whether left + right encodes as the two: undoes their merges, last one first, and looks for a better merge across."""
        rank, split, limit = self.rank, self.split, float("inf")
        while True:
            if (across := rank.get(left + right)) is not None and across < limit:
                return False
            own_left = rank[left] if left in split else -1.0
            own_right = rank[right] if right in split else -1.0
            if own_left < 0 and own_right < 0:
                return True
            if own_left > own_right:
                limit, left = own_left, split[left][1]
            else:  # of equal merges the left one comes first
                limit, right = own_right + 0.5, split[right][0]

    def solve(self, segment: str) -> bytes:
        """count[i]: tokens of segment[:i], for i from 1, as 32-bit integers. Cuts where no piece has the two characters side by side."""
        touching, start, parts = self.touching, 0, []
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in touching:
                parts.append(segment[start:i])
                start = i
        if not parts:
            return self._solve(segment)
        out, before = [], 0
        for part in (*parts, segment[start:]):
            if (own := self.solved.get(part)) is None:
                own = self._solve(part)
                if len(part) <= KEPT_CHARS:
                    self.solved[part] = own
            counts = np.frombuffer(own, np.int32)
            out.append(counts + before)
            before += int(counts[-1])
        return np.concatenate(out).astype(np.int32).tobytes()

    def _solve(self, segment: str) -> bytes:
        n, fits, top = len(segment), self.fits, self.suffixes
        count, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            node, j, found = top, i, []
            while j:
                j -= 1
                if (node := node.get(segment[j])) is None:
                    break
                if "" in node:
                    found.append(j)
            while found:
                j = found.pop()
                piece = segment[j:i]
                if not j:
                    break
                pair = (last[j], piece)
                if (fit := fits.get(pair)) is None:
                    if len(fits) > 500_000:
                        fits.clear()
                    fit = fits[pair] = self._fit(*pair)
                if fit:
                    break
            else:  # a character outside the vocabulary: one token for each of its bytes
                j, piece = i - 1, segment[i - 1]
                count[i] = count[j] + len(piece.encode("utf-8", "surrogatepass")) - 1
                last[i], count[i] = piece, count[i] + 1
                continue
            last[i], count[i] = piece, count[j] + 1
        return np.array(count[1:], np.int32).tobytes()

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """count[i]: tokens of text[:i], for i from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int64)
        cut = _SEGMENT.findall((MARK if self.adds_mark else "") + text.replace(" ", MARK))
        try:
            joined = b"".join(map(self.solved.__getitem__, cut))
        except KeyError:
            if len(self.solved) > KEPT:
                self.solved.clear()
            once = {}
            for segment in {*cut}.difference(self.solved):
                (self.solved if len(segment) <= KEPT_CHARS else once)[segment] = self.solve(segment)
            joined = b"".join([self.solved.get(x) or once[x] for x in cut])
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        out = np.zeros(1 + int(size.sum()), np.int64)
        out[1:] = np.frombuffer(joined, np.int32)
        end = np.cumsum(size)
        own = out[end]
        out[1:] += np.repeat(np.cumsum(own) - own, size)
        if self.adds_mark:
            out = out[1:]
            out[0] = 0
        return out


_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def fitting_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens. Counts may fall as a character joins a token."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str, text: str = "text", budget: int = 4096, store: bool = False) -> DataFrame:
    """Adds n_tokens, fit_chars (longest prefix within ``budget``) and, with ``store``, prefix_counts (int32 bytes)."""
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType()), *[T.StructField("prefix_counts", T.BinaryType())] * store]
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for batch in slices(batches, text):
            tokens, fit, kept = [], [], []
            for value in batch.column(at).to_pylist():
                c = count.prefix_counts(value)
                if not value:
                    c = np.zeros(1, np.int64)
                tokens.append(int(c[-1]))
                fit.append(fitting_prefix(c, budget) if c[-1] > budget else len(c) - 1)
                if store:
                    kept.append(c.astype("<i4").tobytes())
            extra = [pa.array(tokens, pa.int64()), pa.array(fit, pa.int64()), *([pa.array(kept, pa.binary())] if store else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, schema)
