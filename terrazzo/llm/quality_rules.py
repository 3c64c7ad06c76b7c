"""Quality rules: base counts, and divergence from language references.

A reference is the mean histogram of the texts of one language, over all labelled texts: one
of character classes and one of common words. A word (lower-cased, without marks at its ends)
is common if it makes up ``COMMON_SHARE`` of the words of a language. Which words those are is
learned: every task keeps a bounded summary of the words of each language (counters that all
lose the same when there are too many, so that none with a large share can be missed), the
merged summaries name candidates, at most about 1 / COMMON_SHARE a language, and a second scan
counts these exactly.

A text is compared with every reference by the Jensen-Shannon distance (base 2); the closest
by the sum of both decides, of ties the first by name. Texts shorter than
``Limits.min_words`` are too short for a histogram: only the base rules judge them.

Defined cases: a null or empty text has zero counts and fails the base rules; null languages
and texts without words take no part in references, every other language has one; without
references the divergence is null and passes; repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import annotate, blobs, bounded_batches, frugal, joined, quoted, slices
from .scratch import Scratch

#: A word is common from this share of a language's words on; counters that a summary keeps.
COMMON_SHARE, COUNTERS = 0.004, 2_000
CLASSES = ("lower vowel", "lower consonant", "upper", "digit", "space", "line end", "sentence mark", "symbol", "other mark", "beyond ascii")
SYMBOLS = b"#*$%&|<>"
SPACE = bytes(range(9, 14)) + b" "
CHUNK = 2_000_000
SCALE = 1_000_000


def _table() -> np.ndarray:
    out = np.full(256, 8, np.uint8)
    for k, chars in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), bytes(range(48, 58)), b" \t\x0b\x0c\r", b"\n", b".,;:!?'\"()-", SYMBOLS)):
        out[list(chars)] = k
    out[0xC0:] = 9  # lead bytes; continuation bytes are no character of their own
    out[0x80:0xC0] = 10
    return out


_CLASS = _table()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


_MARKS = b".,;:!?\"'()"


class _Ids(dict):
    """Numbers words as they come, and notes the bin of each in the list of common words."""

    def __init__(self, bins: dict[bytes, int]) -> None:
        self.known, self.bins = bins, []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.bins.append(self.known.get(word.lower().strip(_MARKS), len(self.known)))
        return n


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def _histograms(rows: list[bytes], bins: dict[bytes, int]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all rows, their ends, class and common-word counts of each row, bytes and byte ends."""
    data, ends = joined(rows)
    n = len(rows)
    row = np.repeat(np.arange(n), np.diff(ends))
    classes = np.bincount(row * 11 + _CLASS[data], minlength=11 * n).reshape(n, 11)[:, :10]
    ids, width = _Ids(bins), len(bins) + 1
    words = [[ids[w] for w in x.split()] for x in rows]
    flat = np.fromiter((i for x in words for i in x), np.int64)
    word_ends = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
    own = np.array(ids.bins, np.int64)[flat] if len(flat) else flat
    of = np.repeat(np.arange(n), np.diff(word_ends))
    common = np.bincount(of * width + own, minlength=n * width).reshape(n, -1)
    return flat, word_ends, classes, common, data, ends


def _repeats(flat: np.ndarray, ends: np.ndarray, size: int = 5) -> np.ndarray:
    """Words of each row that lie in a window of ``size`` words found twice or more in the row."""
    n = len(ends) - 1
    out = np.zeros(n, np.int64)
    if len(flat) < size:
        return out
    row = np.repeat(np.arange(n), np.diff(ends))
    # windows get exact numbers: each step numbers the pairs (window so far, next word)
    width = int(flat.max()) + 1
    own = row[: len(flat) - size + 1] == row[size - 1 :]
    at = np.flatnonzero(own)
    if not len(at):
        return out
    ids = np.unique(row[at] * width + flat[at], return_inverse=True)[1]
    for k in range(1, size):
        ids = np.unique(ids * width + flat[at + k], return_inverse=True)[1]
    often = at[np.bincount(ids)[ids] > 1]
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + size, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, ends)


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0
    full = [x for x in lines if x.strip(SPACE)]
    return len(full) - len(set(full))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows of p (n x k) from rows of q (m x k), as n x m."""
    out = np.empty((len(p), len(q)))
    for j, r in enumerate(q):
        mid = (p + r) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(p > 0, p * np.log2(p / mid), 0).sum(1)
            b = np.where(r > 0, r * np.log2(r / mid), 0).sum(1)
        out[:, j] = np.sqrt(np.clip((a + b) / 2, 0, 1))
    return out


@dataclass(frozen=True)
class References:
    langs: tuple[str, ...]
    classes: np.ndarray  # langs x character classes
    common: np.ndarray  # langs x common words and "other"
    words: tuple[bytes, ...] = ()

    @property
    def bins(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


@dataclass(frozen=True)
class Limits:
    """A histogram of n words is kept up to ``floor + noise / sqrt(n)``: short texts scatter more."""

    min_words: int = 20
    class_floor: float = 0.15
    class_noise: float = 0.9
    common_floor: float = 0.22
    common_noise: float = 1.0


class Summary:
    """Counts of frequent words in bounded room: no word is undercounted by more than ``lost``."""

    def __init__(self, room: int = COUNTERS) -> None:
        self.room, self.counts, self.total, self.lost = room, Counter(), 0, 0

    def add(self, words: Counter) -> None:
        self.counts.update(words)
        self.total += words.total()
        if len(self.counts) > 8 * self.room:
            self.trim()

    def trim(self) -> None:
        if len(self.counts) > self.room:
            # the first counter that goes is taken off all; it is at most total / (room + 1)
            off = sorted(self.counts.values(), reverse=True)[self.room]
            self.counts = Counter({w: n - off for w, n in self.counts.items() if n > off})
            self.lost += off


def _labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return bounded_batches(docs).filter(quoted(lang).isNotNull() & quoted(text).isNotNull()).select(quoted(lang).cast("string").alias("l"), quoted(text).alias("t"))


def candidates(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = COMMON_SHARE) -> list[bytes]:
    """All words with at least that share of a language's words, and few others."""

    def run(batches):
        own: dict[str, Summary] = {}
        for b in batches:
            langs, rows = b.column(0).to_pylist(), blobs(b.column(1))
            met: dict[str, Counter] = {}
            for label, data in zip(langs, rows, strict=True):
                met.setdefault(label, Counter()).update(data.lower().split())
            for label, words in met.items():
                bare: Counter = Counter()
                for w, n in words.items():
                    bare[w.strip(_MARKS)] += n
                own.setdefault(label, Summary()).add(bare)
        for label, summary in own.items():
            summary.trim()
            words = [None, *summary.counts]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array([summary.total, *summary.counts.values()], pa.int64()), pa.array([summary.lost] + [0] * (len(words) - 1), pa.int64())], names=["l", "w", "n", "lost"])

    parts = _labelled(docs, text, lang).mapInArrow(frugal(run), "l string, w binary, n long, lost long")
    # written once, as both of what follows would read the texts again; one row a language is broadcast
    sums = Scratch(docs.sparkSession, "common").write(parts.groupBy("l", "w").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")), "sums")
    whole = sums.filter(F.col("w").isNull()).select(F.col("l").alias("of"), F.col("n").alias("total"), F.col("lost").alias("undercount"))
    often = sums.filter(F.col("w").isNotNull()).join(F.broadcast(whole), F.col("l") == F.col("of")).filter(F.col("n") >= share * F.col("total") - F.col("undercount"))
    return sorted({bytes(r["w"]) for r in often.select("w").distinct().collect()} - {b""})


def learn_references(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = COMMON_SHARE) -> References:
    """Mean histograms by language over all texts; what reaches the driver is languages x bins.

    Shares are summed as whole numbers, so the result doesn't depend on the order of rows.
    """
    words = candidates(docs, text, lang, share)
    bins, width = {w: i for i, w in enumerate(words)}, len(words) + 1

    def run(batches):
        for b in batches:
            langs, rows = b.column(0).to_pylist(), blobs(b.column(1))
            sums: dict[str, np.ndarray] = {}
            for part in slices([len(x) for x in rows], CHUNK):
                _, _, classes, common, _, _ = _histograms(rows[part], bins)
                full = common.sum(1) > 0
                scaled = np.hstack([np.rint(np.hstack([_shares(classes), _shares(common)]) * SCALE).astype(np.int64), common, np.ones((len(full), 1), np.int64)])
                for at, label in enumerate(langs[part]):
                    if full[at]:
                        sums.setdefault(label, np.zeros(scaled.shape[1], np.int64))[:] += scaled[at]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["l", "v"])

    parts = _labelled(docs, text, lang).mapInArrow(frugal(run), "l string, v array<long>")
    sums = parts.select("l", F.posexplode("v").alias("k", "v")).groupBy("l", "k").agg(F.sum("v").alias("v"))
    found: dict[str, dict[int, int]] = {}
    for r in sums.collect():
        found.setdefault(r["l"], {})[r["k"]] = r["v"]
    langs, first = tuple(sorted(found)), len(CLASSES)
    whole = np.array([[found[x][k] for k in range(first + 2 * width)] for x in langs], float).reshape(len(langs), first + 2 * width)
    exact = whole[:, first + width :]
    # exact counts drop the candidates that are not common after all; "other" takes their shares
    common = (exact[:, :-1] >= share * exact.sum(1, keepdims=True)).any(0)
    shares = whole[:, first : first + width]
    kept = np.hstack([shares[:, :-1][:, common], shares[:, -1:] + shares[:, :-1][:, ~common].sum(1, keepdims=True)])
    return References(langs, _shares(whole[:, :first]), _shares(kept), tuple(w for w, c in zip(words, common, strict=True) if c))


FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("class_jsd", T.DoubleType()), T.StructField("common_jsd", T.DoubleType()), T.StructField("closest", T.StringType())]
)


def judge(docs: DataFrame, references: References, text: str = "text", limits: Limits = Limits(), keep: list[str] | None = None) -> DataFrame:
    """Append the base counts, the verdict ``kept``, both divergences and the closest language."""
    bins = references.bins

    def part(rows: list[bytes]) -> list:
        flat, word_ends, classes, common, data, ends = _histograms(rows, bins)
        n_words = np.diff(word_ends)
        spaces = _IS_SPACE[data]
        chars = _sums(~spaces & ((data & 0xC0) != 0x80), ends)
        repeat = _repeats(flat, word_ends)
        failed = (n_words < 10) | (100 * repeat > 20 * n_words)
        good = np.ones(len(rows), bool)
        a = b = lang = [None] * len(rows)
        if references.langs:
            near, far = js_distance(_shares(classes), references.classes), js_distance(_shares(common), references.common)
            best = np.argmin(near + far, 1)
            rows_at = np.arange(len(rows))
            da, db = near[rows_at, best], far[rows_at, best]
            long = n_words >= limits.min_words
            noise = 1 / np.sqrt(np.maximum(n_words, 1))
            good = ~long | ((da <= limits.class_floor + limits.class_noise * noise) & (db <= limits.common_floor + limits.common_noise * noise))
            a, b, lang = [x if y else None for x, y in zip(da.tolist(), long, strict=True)], [x if y else None for x, y in zip(db.tolist(), long, strict=True)], [references.langs[k] for k in best]
        return [n_words.tolist(), chars.tolist(), _sums(_IS_SYMBOL[data], ends).tolist(), [_dup_lines(x) for x in rows], repeat.tolist(), failed.tolist(), (good & ~failed).tolist(), a, b, lang]

    def run(texts: pa.Array) -> list:
        rows = blobs(texts)
        out: list[list] = [[] for _ in FIELDS.fields]
        for at in slices([len(x) for x in rows], CHUNK):
            for whole, some in zip(out, part(rows[at]), strict=True):
                whole.extend(some)
        return out

    return annotate(docs, run, [text], FIELDS, keep)
