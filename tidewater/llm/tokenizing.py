"""Token ids of whole texts as the tokenizers library gives them, with a bounded table of solved chunks for each worker.

Two kinds of vocabulary can be cut at spaces without changing the ids, and texts repeat their words, so their chunks are
looked up before they are encoded: byte-level BPE, where a space belongs to the word after it, and BPE with word ends,
where white space is dropped. Chunks that are not known yet go through tiktoken's BPE core over the same merges where that
is safe, which is several times faster, and through the library itself otherwise. Any other vocabulary, and any text that
can't be cut safely, is encoded whole by the library.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewater.llm.common import TABLES

#: Chunks that a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 500_000, 64
#: Ids of kept chunks after which a worker forgets them.
KEPT_IDS = 8 << 20
#: Fixed value: the split of byte-level BPE that the library's ByteLevel pre-tokenizer applies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_END = "</w>"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """ids(text), many(texts): the ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}
        # for columns: the row of each chunk, and the number and first place in the pool of the ids of each row
        self.rows: dict[str, int] = {}
        self.size, self.first, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not spec.get("post_processor")
        byte_level = plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("end_of_word_suffix")
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = before.get("pretokenizers") or [{}]
        word_ends = plain and model.get("end_of_word_suffix") == _END and steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
        self.mode = "spaced" if byte_level else "dropped" if word_ends else "whole"
        if self.mode != "whole":
            self._core(model["vocab"], parts[0])

    def _core(self, vocabulary: dict[str, int], split: dict) -> None:
        import tiktoken

        alphabet = _byte_alphabet()
        ranks, added = {}, {*self.special}
        for piece, number in vocabulary.items():
            if piece in added:
                continue
            ends = self.mode == "dropped" and piece.endswith(_END) and piece != _END
            body = piece[: -len(_END)] if ends else piece
            ranks[bytes(alphabet[c] for c in body) + b"\x00" * ends] = number
        pattern = BYTE_LEVEL if self.mode == "spaced" else r"[^\x00]+\x00"
        self.core = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, number in ranks.items():
            self.sizes[number] = len(piece)
        if self.mode == "dropped":
            import regex

            self.words = regex.compile(split["pattern"]["Regex"] + r"|\n")

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _is_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _spaced(self, text: str) -> bytes:
        return self._library(text) if self._is_special(text) else np.array(self.core.encode_ordinary(text), "<u4").tobytes()

    def _texts(self, chunks: list[str]) -> list[str]:
        """The texts whose core encodings give the ids of chunks that hold no special string and no character from ɐ on.

        Chunks are without white space, so all go through each step at once, a line each.
        """
        if self.mode == "spaced":
            return [f" {c}" for c in chunks]
        lines = unicodedata.normalize("NFC", "\n".join(chunks)).lower().split("\n")
        plain = [x.isalpha() for x in lines]
        words = self.words.findall("\n".join([x for x, p in zip(lines, plain, strict=True) if not p]))
        cut = iter("\x00".join([*words, ""]).split("\n\x00"))
        return [f"{x}\x00" if p else next(cut) for x, p in zip(lines, plain, strict=True)]

    def _solve(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the chunks in another order, how many ids each has, all their ids). What the core can take is encoded in one call."""
        before, hard, whole = " " if self.mode == "spaced" else "", [], "\n".join(chunks)
        if self._is_special(whole) or self.mode == "dropped" and _BEYOND.search(whole):
            easy = []
            for chunk in chunks:
                (hard if self._is_special(chunk) or self.mode == "dropped" and _BEYOND.search(chunk) else easy).append(chunk)
            chunks = easy
        size, ids = np.zeros(0, np.int64), np.zeros(0, "<u4")
        if chunks:
            texts = self._texts(chunks)
            # the offsets of an Arrow array are the ends of the texts in bytes
            end = np.frombuffer(pa.array(texts, pa.large_string()).buffers()[1], np.int64)[1 : len(texts) + 1]
            ids = np.array(self.core.encode_ordinary("".join(texts)), "<u4")
            size = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), end, "right"), prepend=0)
        if hard:
            own = [np.frombuffer(self._library(before + chunk), "<u4") for chunk in hard]
            size, ids = np.concatenate([size, [*map(len, own)]]).astype(np.int64), np.concatenate([ids, *own])
        return [*chunks, *hard], size, ids

    def _cut(self, text: str | None) -> tuple[bytes, list[str]]:
        """Ids of the beginning of a text, and the chunks that follow."""
        if not text:
            return b"", []
        if self.mode == "whole" or self.mode == "dropped" and self._is_special(text):
            return self._library(text), []
        if self.mode == "spaced":
            if len(text.split()) - 1 != text.count(" ") + text.count("\n"):  # white space is not all single spaces and line ends
                return self._spaced(text), []
            head, *rest = text.split(" ")
            return self._spaced(head), rest
        # str.split knows more kinds of white space, which belong to chunks
        return b"", _ASCII_SPACE.split(text) if _OTHER_SPACE.search(text) else text.split()

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each of a batch of texts; chunks that are not known yet are solved together."""
        known, parts = self.known, [self._cut(t) for t in texts]
        if len(known) > KEPT:
            known.clear()
        solved, size, ids = self._solve([*set().union(*(x[1] for x in parts)).difference(known)])
        raw, edge = ids.tobytes(), [0, *(4 * np.cumsum(size)).tolist()]
        known.update((c, raw[a:b]) for c, a, b in zip(solved, edge, edge[1:], strict=False))
        out = [head + b"".join(map(known.__getitem__, chunks)) for head, chunks in parts]
        for chunk in solved:
            if len(chunk) > KEPT_CHARS:
                del known[chunk]
        return out

    def column(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a column. Where white space is dropped, words are told apart column-wise, so that only
        the distinct ones are looked at in Python."""
        if self.mode != "dropped":
            return self.many(texts.to_pylist())
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if special.any():
            whole = [self._library(t) if x else None for t, x in zip(texts.to_pylist(), special, strict=True)]
            texts = pc.if_else(pa.array(special), "", texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        # words hold no line end, so one string of them is cut faster than an array is read
        listed, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(listed)], listed), "\n")[0].as_py().split("\n") if len(listed) else []
        rows = self.rows
        if len(rows) > KEPT or len(self.pool) > KEPT_IDS:
            rows.clear()
            self.size, self.pool = self.size[:0], self.pool[:0]
        if new := [w for w in words if w not in rows]:
            solved, size, ids = self._solve(new)
            rows.update(zip(solved, range(len(self.size), len(self.size) + len(size)), strict=True))
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, ids])
            self.first = np.cumsum(self.size) - self.size
        own = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))[which]
        size_of = self.size[own]
        end = np.cumsum(size_of)
        place = np.arange(int(size_of.sum())) + np.repeat(self.first[own] - (end - size_of), size_of)
        raw = self.pool[place].tobytes()
        edge = 4 * np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = [raw[a:b] for a, b in itertools.pairwise(edge.tolist())]
        return [w if x else o for w, x, o in zip(whole, special, out, strict=True)] if special.any() else out

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]


_ASCII_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BEYOND = re.compile("[\x00ɐ-\U0010ffff]")
_ENCODERS: dict[str, Encoder] = TABLES.setdefault("encoders", {})


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
