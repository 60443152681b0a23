"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, languages x 2**16 buckets, learned from a bounded sample of labelled rows
and broadcast (256 KB a language). Scoring is a map over whole texts without a shuffle: the n-grams of a batch of texts
are hashed at once, counted sparsely by text and bucket, and multiplied with the matrix.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0. Rows are scored one
by one, so repeated rows and ties get equal answers (equal scores go to the language first in sorted order); texts of
more than a million characters are read in pieces that end before a space. Other columns pass through untouched. With no
labelled row at all every text is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import U64, least_hashed, mapped, mix, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled documents that the model may be fitted on.
FIT_ROWS = 20_000
#: Characters of a long text that one step works on, and of texts that are scored at once.
PIECE, BATCH_BYTES = 1 << 20, 512 << 10
#: N-grams whose evidence a probability rests on at most.
EVIDENCE = 60
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray  # languages
    weight: np.ndarray  # languages x buckets, float32


def _letters(text: str) -> np.ndarray:
    """Lower-cased letters with the marks that follow them, each run of other characters as one space; a mark alone is no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds(points)
    # a mark counts if the last character that is no mark is a letter
    last = np.maximum.accumulate(np.where(kind != 3, np.arange(len(kind)), 0))
    kept = kind[last] == 2
    kept_or_first = kept.copy()
    kept_or_first[1:] |= kept[:-1]
    kept_or_first[0] = True
    return np.where(kept, points, 32)[kept_or_first]


_KNOWN = np.zeros(0x110000, np.int8)


def _kinds(points: np.ndarray) -> np.ndarray:
    """2 for Unicode letters, 3 for marks, 1 for others; classes of code points are looked up once."""
    got = _KNOWN[points]
    if not got.all():
        for p in np.unique(points[got == 0]):
            _KNOWN[p] = {"L": 2, "M": 3}.get(unicodedata.category(chr(p))[0], 1)
        got = _KNOWN[points]
    return got


def _buckets(points: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of every order that lies in one row."""
    p, rows, out = points.astype(U64), [], []
    row = np.zeros(len(p), np.int64) if row is None else row
    for n in ORDERS:
        if len(p) >= n:
            h = np.full(len(p) - n + 1, n, U64)
            for k in range(n):
                h = h * U64(0x100000001B3) + p[k : len(p) - n + 1 + k]
            inside = row[: len(h)] == row[n - 1 :]
            rows.append(row[: len(h)][inside])
            out.append((mix(h[inside]) >> U64(48)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pieces(text: str) -> list[str]:
    """Long texts in pieces that end before a space, so that one step works on a bounded text."""
    out, at = [], 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at + 1, at + PIECE)
        end = end if end > 0 else at + PIECE
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the n-grams of a batch of texts, sorted, and which texts have a letter."""
    points = [_letters(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    whole = np.concatenate(points) if points else np.zeros(0, np.uint32)
    lettered = np.bincount(row, weights=whole != 32, minlength=len(texts)) > 0
    row, bucket = _buckets(whole, row)
    key = np.sort((row.astype(U64) << U64(16)) | bucket.astype(U64))
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(key)))
    return (key[edge] >> U64(16)).astype(np.int64), (key[edge] & U64(0xFFFF)).astype(np.int64), count, lettered


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Fits on the whole texts of about ``rows`` labelled rows at most, those of smallest key hash.

    The number of rows is a documented bound of the training sample; a key with more than a hundredth of it is left out
    unless there is no other, and then bounded. Only hashes of keys come to the driver to find the sample; its texts stay
    where they are, and (label, bucket) sums, languages x buckets numbers at most, come back.
    """
    known = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(label).alias("label"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"))
    keys = least_hashed(known.select("key"), F.col("key"), rows, labelled.where(F.col(label).isNotNull()).select(label))
    taken, hot, bound = 0, [], None
    for r in keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy("h").limit(rows).collect():
        if taken >= rows:
            break
        if r["n"] > max(1, rows // 100):
            hot.append(r["h"])
        else:
            taken, bound = taken + r["n"], r["h"]
    h = F.xxhash64("key")
    if bound is not None:
        sample = known.where((h <= bound) & ~h.isin(*hot)) if hot else known.where(h <= bound)
    else:
        sample = known.where(h.isin(*hot)).limit(rows) if hot else known.limit(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            labels = batch.column(0).to_pylist()
            names = sorted({*labels})
            place = {x: k for k, x in enumerate(names)}
            sums, n = np.zeros((len(names), BUCKETS + 1), np.int64), np.zeros(len(names), np.int64)
            for name, value in zip(labels, batch.column(1).to_pylist(), strict=True):
                sums[place[name], BUCKETS] += 1
                for piece in _pieces(value):
                    sums[place[name], :BUCKETS] += np.bincount(_buckets(_letters(piece))[1], minlength=BUCKETS)
            at, bucket = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in at], pa.string()), pa.array(bucket), pa.array(sums[at, bucket])], names=["label", "bucket", "n"])

    counted = mapped(sample.select("label", "text"), count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    got: dict[str, np.ndarray] = {}
    for r in counted.toLocalIterator():
        if r["label"] not in got:
            got[r["label"]] = np.zeros(BUCKETS + 1, np.int64)
        got[r["label"]][r["bucket"]] = r["n"]
    names = tuple(sorted(got))
    if not names:
        return Model((), np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    both = np.array([got[x] for x in names], np.float64)
    sums, n = both[:, :BUCKETS], both[:, BUCKETS]
    used = max(1, int((sums.sum(0) > 0).sum()))
    weight = np.log((sums + 0.5) / (sums.sum(1, keepdims=True) + 0.5 * used))
    return Model(names, np.log((n + 1) / (n.sum() + len(names))), weight.astype(np.float32))


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Most probable language of each text of a batch and its probability.

    The n-grams of all texts are counted at once, and the sparse counts meet one row of the matrix after the other. The
    log likelihood is scaled down to that of ``EVIDENCE`` n-grams in longer texts, so that probabilities do not depend on the
    length of a text beyond that. They compare the learned languages only: text of another one may well score near 1.
    """
    pieces = [_pieces(t) if t else [] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
    row, bucket, count, lettered = _counts([p for own in pieces for p in own])
    row, some = owner[row], np.bincount(owner, weights=lettered, minlength=len(texts)) > 0
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.languages or not some.any():
        return names, scores
    size = np.maximum(np.bincount(row, weights=count, minlength=len(texts)), 1)
    likely = np.stack([np.bincount(row, weights=count * w[bucket], minlength=len(texts)) for w in model.weight], 1)
    whole, tempered = model.prior + likely, model.prior + likely * np.minimum(1, EVIDENCE / size)[:, None]
    best = whole.argmax(1)
    ahead = tempered - tempered[np.arange(len(texts)), best][:, None]
    scores = np.where(some, 1.0 / np.exp(np.clip(ahead, -700, 700)).sum(1), 0.0)
    return [model.languages[k] if x else UNDETERMINED for k, x in zip(best, some, strict=True)], scores


def identify(docs: DataFrame, model: Model, text: str = "text", prediction: str = "lang_pred", probability: str = "score") -> DataFrame:
    """Adds the predicted language and its posterior probability to every row (existing columns of these names go)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(prediction, probability)
    schema = T.StructType([*docs.schema.fields, T.StructField(prediction, T.StringType()), T.StructField(probability, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, BATCH_BYTES):
            names, scores = score(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, prediction, probability])

    return mapped(docs, run, schema)
