"""Text quality by votes of the nearest labelled texts in a latent-semantic space.

A text is a vector of hashed terms in two blocks, words and word shapes (letter case, marks,
digits, "as the word before"), weighted by 1 + ln tf and by inverse document frequency over
all texts. Truncated singular vectors of a bounded labelled sample span the latent space. The
labelled vectors are broadcast (``MOST_LABELLED`` x ``RANK`` floats at most); each block of
texts takes its cosines with all of them as one exact product, and the nearest vote with the
fourth power of their similarity as weight, so that the closest count most.

Defined cases: a null or empty text has no terms and gets the share of label 1 in the sample;
ties at the last place go to the vector that comes first; labels that are null, or of absent
texts, are left out; without labels every score is 0.5; repeated labels count once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import annotate, blobs, bounded_batches, quoted, slices

#: Bound of the labelled sample, and of what is broadcast.
MOST_LABELLED = 4_000
WORD_TERMS, SHAPE_TERMS, RANK, NEAREST = 2_048, 512, 64, 25
TERMS = WORD_TERMS + SHAPE_TERMS
CHUNK = 2_000_000
CUT = 0.7


# bytes of a kind look alike: runs of letters and digits shrink to one sign, of others to two
_KINDS = bytes(ord("0") if 48 <= c <= 57 else 2 if 65 <= c <= 90 else 1 if 97 <= c <= 122 or c >= 0x80 else c for c in range(256))
_ONE = np.zeros(256, bool)
_ONE[[ord("0"), 1, 2]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), 32]] = True


def _shapes(data: bytes) -> bytes:
    """The text with every word replaced by its shape; white space stays."""
    kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
    same = np.zeros(len(kinds), bool)
    same[1:] = kinds[1:] == kinds[:-1]
    third = np.zeros(len(kinds), bool)
    third[2:] = same[2:] & same[1:-1]
    return kinds[~(same & (_ONE[kinds] | third)) | _WHITE[kinds]].tobytes()


class _Known(dict):
    """The term of each word, found once."""

    def __init__(self, terms: int, first: int) -> None:
        self.terms, self.first = terms, first

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.first + zlib.crc32(word) % self.terms
        return n


def counts(rows: list[bytes]) -> np.ndarray:
    """Term counts, rows x TERMS; the last term counts words equal to the one before (letter case aside)."""
    out = np.zeros((len(rows), TERMS), np.float32)
    words, shapes = _Known(WORD_TERMS, 0), _Known(SHAPE_TERMS - 1, WORD_TERMS)
    for i, data in enumerate(rows):
        own = data.lower().split()
        if not own:
            continue
        again = sum(map(eq, own, islice(own, 1, None)))
        terms = np.array([words[w] for w in own] + [shapes[w] for w in _shapes(data).split()], np.int64)
        out[i] = np.bincount(terms, minlength=TERMS)
        out[i, -1] = again
    return out


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted terms, each of the two blocks of unit length."""
    out = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0).astype(np.float32) * idf
    for block in (out[:, :WORD_TERMS], out[:, WORD_TERMS:]):
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    space: np.ndarray  # terms x rank
    points: np.ndarray  # labelled texts x rank, unit length
    labels: np.ndarray


def _blocks(column: pa.Array):
    rows = blobs(column)
    for at in slices([len(x) + 500 for x in rows], CHUNK):
        yield rows[at]


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all texts each term occurs; the driver gets TERMS sums."""

    def run(batches):
        total = np.zeros(TERMS + 1, np.int64)
        for b in batches:
            for rows in _blocks(b.column(0)):
                total[:-1] += (counts(rows) > 0).sum(0)
                total[-1] += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], names=["k", "n"])

    sums = {r["k"]: r["n"] for r in bounded_batches(docs).select(quoted(text).alias("t")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    found = np.array([sums.get(k, 0) for k in range(TERMS + 1)], np.int64)
    return found[:-1], int(found[-1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """The model from labelled rows (``train`` is over ``labels``), at most about ``most`` of them by hash."""
    frequency, n = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    rows = labels.filter(train & quoted(label).isNotNull() & quoted(key).isNotNull()).select(quoted(key).alias("k"), quoted(label).cast("int").alias("y"))
    have = rows.count()
    chance = F.pmod(F.xxhash64(F.lit(77), "k"), F.lit(1 << 30))
    some = rows.filter(chance < min(1 << 30, (1 << 30) * most // max(have, 1))).groupBy("k").agg(F.max("y").alias("y"))
    # about ``most`` small rows, whatever the size of the table: they may be broadcast
    texts = docs.select(quoted(key).alias("k"), quoted(text).alias("t")).join(F.broadcast(some.orderBy("k").limit(2 * most)), "k")

    def run(column: pa.Array) -> list:
        return [[x.tobytes() for rows in _blocks(column) for x in counts(rows).astype("<u4")]]

    found = annotate(texts, run, ["t"], T.StructType([T.StructField("count", T.BinaryType())]), ["k", "y"]).dropDuplicates(["k"]).orderBy("k").collect()
    if not found:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    whole = vectors(np.frombuffer(b"".join(r["count"] for r in found), "<u4").reshape(len(found), TERMS).astype(np.float32), idf)
    space = _span(whole, min(RANK, len(found)))
    return Model(idf, space, _unit(whole @ space), np.array([r["y"] for r in found], np.float32))


def _span(whole: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    near = np.random.default_rng(5).standard_normal((whole.shape[1], min(rank + 16, whole.shape[1]))).astype(np.float32)
    for _ in range(6):
        near = np.linalg.qr(whole.T @ (whole @ near))[0]
    _, _, turn = np.linalg.svd(whole @ near, full_matrices=False)
    return np.ascontiguousarray((near @ turn.T)[:, :rank], np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def votes(model: Model, own: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors of each row."""
    if not len(model.labels):
        return np.full(len(own), 0.5)
    cosine = own @ model.points.T
    k = min(nearest, cosine.shape[1])
    best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(cosine, best, 1).min(1, keepdims=True)
    level = np.count_nonzero(cosine >= last, axis=1) > k  # ties at the last place: the first ones vote
    best[level] = np.argsort(-cosine[level], axis=1, kind="stable")[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, best, 1), 0).astype(np.float64) ** 4
    total = weight.sum(1)
    share = (weight * model.labels[best]).sum(1)
    prior = float(model.labels.mean())
    return np.clip(np.where(total > 1e-12, share / np.maximum(total, 1e-12), prior), 0, 1)


def score(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT, keep: list[str] | None = None) -> DataFrame:
    """Append score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list:
        m = sent.value
        found = [np.round(votes(m, _unit(vectors(counts(rows), m.idf) @ m.space)), 9) for rows in _blocks(column)]
        scores = np.concatenate(found) if found else np.zeros(0)
        return [scores, (scores >= cut).astype(np.int32)]

    return annotate(docs, run, [text], T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), keep)
