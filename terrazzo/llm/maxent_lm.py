"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(slot | class, history) * P(word | slot). A word's
class is a hash of its ending. The class is predicted by a softmax over hashed features of the
history: the word before, the two words before, the word before the last (a skip), and the
classes of both. Within a class the ``SLOTS - 1`` words that occur most have a slot each and
all others share one; the slot is predicted by a second softmax over (class, hashed feature):
the class before, the word before and the skip. Only within the shared slot a word has its
add-one share, with one place for all unseen words. All three factors sum to one.

Weights are trained by distributed gradient updates: in each round every task starts from the
same weights, takes AdaGrad steps over its share of that round's documents in small batches,
and gives back its change of each feature; changes are averaged by tokens over the tasks that
met the feature. Every training document is used in one round. As averages are over tasks,
``score`` depends in its third digit or so on how the input is cut into tasks; counts,
``base_score`` and a task that runs again do not.

Counts cover the whole corpus. Batches of documents send their words' counts by hash range,
get the corpus counts back, and never send a text; the driver sees totals by class and the
``CLASSES * (SLOTS - 1)`` words with slots.

Defined cases: a null or empty text is its end token alone; a null id is not held out and
learns; without training tokens every share is one and weights are zero; of words that occur
equally often that with the smaller hash gets a slot.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import annotate, blobs, bounded_batches, quoted, slices
from .scratch import Scratch

CLASSES = 32
ONE, TWO, SKIP = 4_096, 4_096, 2_048
PAIRS = (CLASSES + 1) ** 2
#: First weight of each kind of feature: class before, word, two words, skipped word, two classes.
STARTS = np.cumsum([0, CLASSES + 1, ONE, TWO, SKIP])
FEATURES = int(STARTS[-1] + PAIRS)
#: Slots of a class: the first is shared. Features of slots: class before, word, skipped word.
SLOTS, SLOT_ONE, SLOT_SKIP = 32, 256, 128
SLOT_STARTS = np.cumsum([0, CLASSES + 1, SLOT_ONE])
#: Rows of weights: class features, then slot features by class; below 2^16. Both softmaxes are as wide.
WEIGHTS = FEATURES + int(SLOT_STARTS[-1] + SLOT_SKIP) * CLASSES
assert SLOTS == CLASSES and TWO & (TWO - 1) == 0
ROUNDS, BATCH, RATE = 2, 16_384, 0.15
CHUNK = 1_500_000
END = b"\xff"  # no word: never in UTF-8
_CLOSE = b" " + END + b" "
_LOWEST = -(1 << 63)
_U = np.uint64
_BLANKS = b"\t\n\x0b\x0c\r "
_LANES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first bytes of eight


@dataclass(frozen=True)
class Tokens:
    row: np.ndarray
    word: np.ndarray
    hashes: np.ndarray  # by word
    classes: np.ndarray
    sizes: np.ndarray  # by row


_MARKS = b".,;:!?"
_IS_MARK = np.isin(np.arange(256), list(_MARKS))
#: Longer words are hashed and classed one by one.
LONG = 64


@cache
def _kinds() -> np.ndarray:
    """Class of each ending: two bytes, one byte (from 2^16 on), none (last)."""
    endings = [*(k.to_bytes(2, "big") for k in range(1 << 16)), *(bytes([k]) for k in range(256)), b""]
    return np.array([1 + zlib.crc32(x) % (CLASSES - 1) for x in endings], np.int64)


def _classes(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Classes of words, the first of which is the end token: by the last two bytes before marks."""
    end = at + sizes
    more = np.flatnonzero(sizes <= LONG)
    while len(more):  # those that may end in a mark
        more = more[_IS_MARK[raw[end[more] - 1]]]
        end[more] -= 1
        more = more[end[more] > at[more]]
    for k in np.flatnonzero(sizes > LONG).tolist():
        end[k] = at[k] + len(raw[at[k] : end[k]].tobytes().rstrip(_MARKS))
    left = end - at
    ending = np.where(left > 1, raw[end - 2].astype(np.int64) << 8 | raw[end - 1], np.where(left > 0, (1 << 16) + raw[end - 1].astype(np.int64), -1))
    kinds = _kinds()[ending]
    kinds[0] = 0
    return kinds


def _hashes(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time, each time mixed by steps that can be undone."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    hashes = sizes.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    own = np.flatnonzero(sizes <= LONG)
    for k in range(0, LONG, 8):
        own = own[sizes[own] > k]
        if not len(own):
            break
        h = hashes[own] ^ (eight[at[own] + k] & _LANES[np.minimum(sizes[own] - k, 8)])
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> _U(shift)
            h *= _U(factor)
        hashes[own] = h ^ (h >> _U(31))
    for k in np.flatnonzero(sizes > LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(raw[at[k] : at[k] + sizes[k]].tobytes())
    return hashes


def tokens(rows: list[bytes]) -> Tokens:
    """Words of lower-cased rows, each row closed by an end token; words are numbered as they come, the end token first."""
    data = b"".join([END, b" ", *[x + _CLOSE for x in rows]])
    byte = np.frombuffer(data, np.uint8)
    inside = (byte - np.uint8(9) > 4) & (byte != 32)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # ends and starts by turns: the first start is 0
    at = np.concatenate([[0], np.cumsum(edges[::2] - np.concatenate([[0], edges[1::2]]))])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data.translate(None, _BLANKS))]).dictionary_encode()
    word = words.indices.to_numpy()[1:].astype(np.int64)
    known = words.dictionary
    at = np.frombuffer(known.buffers()[1], np.int64, len(known) + 1)
    raw = np.concatenate([np.frombuffer(known.buffers()[2], np.uint8, at[-1]), np.zeros(8, np.uint8)])
    at, own = at[:-1], np.diff(at)
    sizes = np.diff(np.flatnonzero(word == 0), prepend=-1)
    return Tokens(np.repeat(np.arange(len(rows)), sizes), word, _hashes(raw, at, own), _classes(raw, at, own), sizes)


def _lowered(column: pa.Array):
    rows = [x.lower() for x in blobs(column)]  # of bytes: A-Z alone
    for at in slices([len(x) + 8 for x in rows], CHUNK):
        yield at, rows[at]


def features(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights of each token: 5 x tokens for its class, 3 x tokens for its slot."""
    n, none = len(t.word), len(t.hashes)  # none: the number of no word
    start = np.cumsum(t.sizes) - t.sizes
    one, two = (np.concatenate([np.full(k, none), t.word])[:n] for k in (1, 2))
    one[start] = two[start] = two[start[t.sizes > 1] + 1] = none
    # what depends on a word alone is told once a word
    h1, h2 = (np.append(t.hashes, _U(k)) * _U(0x9E3779B97F4A7C15) for k in (1, 2))
    kinds = np.append(t.classes, CLASSES)
    by_one, by_skip = ((h >> _U(40)).astype(np.int64) % m for h, m in ((h1, ONE), (h2, SKIP)))
    both = h1.take(one) ^ ((h2 * _U(0xC2B2AE3D27D4EB4F)) ^ (h2 >> _U(31))).take(two)
    of_class, of_slot = np.empty((5, n), np.int64), np.empty((3, n), np.int64)
    of_class[0] = c1 = kinds.take(one)
    of_class[1] = (STARTS[1] + by_one).take(one)
    of_class[2] = (both >> _U(40) & _U(TWO - 1)).astype(np.int64)
    of_class[2] += STARTS[2]
    of_class[3] = (STARTS[3] + by_skip).take(two)
    of_class[4] = (STARTS[4] + kinds * (CLASSES + 1)).take(one) + kinds.take(two)
    kind = FEATURES + t.classes.take(t.word)
    of_slot[0] = c1 * CLASSES + kind
    of_slot[1] = ((SLOT_STARTS[1] + by_one % SLOT_ONE) * CLASSES).take(one) + kind
    of_slot[2] = ((SLOT_STARTS[2] + by_skip % SLOT_SKIP) * CLASSES).take(two) + kind
    return of_class, of_slot


@dataclass(frozen=True)
class Slots:
    """The words with a slot of their own, by hash, and what the shared slots hold."""

    hashes: np.ndarray  # sorted
    slots: np.ndarray
    counts: np.ndarray
    closed: np.ndarray  # classes x slots: a large negative number where no word is
    rest: np.ndarray  # log10 of the shared slot's places by class

    @classmethod
    def of(cls, heads: list[tuple[int, int, int]], by_class: np.ndarray, words: np.ndarray) -> Slots:
        """From (class, hash, count), largest counts first, and tokens and words by class."""
        taken = np.ones(CLASSES, np.int64)
        closed = np.full((CLASSES, SLOTS), -1e4, np.float32)
        closed[:, 0] = 0
        tokens_, distinct, rows = by_class.astype(np.int64), words.astype(np.int64), []
        for kind, h, n in heads:
            rows.append((h, taken[kind], n))
            closed[kind, taken[kind]] = 0
            taken[kind] += 1
            tokens_[kind] -= n
            distinct[kind] -= 1
        rows.sort()
        h, slots, counts = (np.array([r[k] for r in rows], t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
        return cls(h, slots, counts, closed, np.log10(tokens_ + distinct + 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot (0: the shared one) and corpus count (0 there) of each word."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        own = self.hashes[at] == hashes
        return np.where(own, self.slots[at], 0), np.where(own, self.counts[at], 0)


#: Logits that lie no farther apart, or from 0, need no shift of their own: exponentials of 32-bit numbers neither overflow nor vanish.
WIDE = 80


def _activations(weights: np.ndarray, found: np.ndarray, more: np.ndarray | None = None, near: bool = False, room: np.ndarray | None = None) -> np.ndarray:
    """Sums of the features' weights, shifted so that exponentials are bounded: by the largest of all, or of each token if they lie far apart.

    ``more`` closes slots; the first slot of a token is always open. ``near`` sums are known
    to lie within ``WIDE`` of 0, closed slots apart, and stay as they are.
    """
    n = found.shape[1]
    z, own = np.empty((2, n, weights.shape[1]), np.float32) if room is None else (room[-1, :n], room[0, :n])
    weights.take(found[0], axis=0, out=z, mode="clip")
    for f in found[1:]:
        z += weights.take(f, axis=0, out=own, mode="clip")
    if near:
        return z
    top, low = (z.max(), z.min()) if len(z) else (0, 0)
    if more is not None:
        z += more
    z -= top if top - low < WIDE else z.max(1, keepdims=True)
    return z


_ONES = np.ones(CLASSES, np.float32)
_FLAT = np.arange(BATCH) * CLASSES


def _room() -> np.ndarray:
    """Room for rows of a batch, used again for every batch: new memory costs more than the sums in it."""
    return np.empty((4, BATCH, CLASSES), np.float32)


def _farthest(weights: np.ndarray) -> float:
    return max(float(weights.max()), -float(weights.min()))


def _nest(weights: np.ndarray) -> np.ndarray:
    """Adds the weights of the class before to those of the two classes, in place; gives what these were."""
    pairs = weights[STARTS[4] : FEATURES]
    before = pairs.copy()
    pairs.reshape(CLASSES + 1, CLASSES + 1, CLASSES)[:] += weights[: CLASSES + 1, None]
    return before


def _by_kind(weights: np.ndarray) -> np.ndarray:
    """The weights of slots by the class before and the class: sums with ``Slots.closed`` close slots."""
    return weights[FEATURES : FEATURES + (CLASSES + 1) * CLASSES].reshape(CLASSES + 1, CLASSES, CLASSES)


def log_share(weights: np.ndarray, found: np.ndarray, target: np.ndarray, more: np.ndarray | None = None, near: bool = False, room: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the probability of each token's class or slot."""
    z = _activations(weights, found, more, near, room)
    own = z.ravel().take(np.arange(len(z)) * z.shape[1] + target)
    return own - np.log(np.exp(z, out=z) @ _ONES)


def token_logs(weights: np.ndarray, slots: Slots, t: Tokens) -> np.ndarray:
    """log10 P of each token, less log10(its corpus count + 1)."""
    of_class, of_slot = features(t)
    slot, count = slots.find(t.hashes)
    kind, own = t.classes.take(t.word), slot.take(t.word)
    near = len(of_class) * _farthest(weights) < WIDE
    weights, room = weights.copy(), _room()
    _nest(weights)
    if near:
        _by_kind(weights)[:] += slots.closed
    out = np.empty(len(kind))
    for a in range(0, len(kind), BATCH):
        s = slice(a, a + BATCH)
        out[s] = log_share(weights, of_class[1:, s], kind[s], None, near, room)
        out[s] += log_share(weights, of_slot[:, s], own[s], None if near else slots.closed.take(kind[s], axis=0), near, room)
    return out / np.log(10) - np.where(own > 0, np.log10(count + 1).take(t.word), slots.rest.take(kind))


#: Groups of rows up to this size are added up side by side, all k-th rows at once; larger ones by a product each.
SHORT = 24


def _sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``rows`` by groups: each is a run of ``order`` from one of ``first`` on."""
    if room is None:
        room = np.empty((3, len(order), rows.shape[1]), rows.dtype)
    size = np.diff(first, append=len(order))
    out = room[2, : len(first)]
    short = np.minimum(size, SHORT + 1).astype(np.uint8)
    below = np.cumsum(np.bincount(short, minlength=SHORT + 2))  # groups of up to k rows
    rank = np.argsort(short, kind="stable")[: below[SHORT]]
    at = first[rank]
    total = rows.take(order[at], axis=0, out=room[0, : len(at)], mode="clip")
    for k in range(1, SHORT):
        a = below[k]
        if a == len(at):
            break
        total[a:] += rows.take(order[at[a:] + k], axis=0, out=room[1, : len(at) - a], mode="clip")
    out[rank] = total
    large = np.flatnonzero(size > SHORT)
    if len(large):
        at = order[np.repeat(size > SHORT, size)]
        own = rows.take(at, axis=0, out=room[0, : len(at)], mode="clip")
        ones, a = np.ones(size.max(), rows.dtype), 0
        for k, n in zip(large.tolist(), size[large].tolist(), strict=True):
            np.dot(ones[:n], own[a : a + n], out=out[k])
            a += n
    return out


def _step(weights: np.ndarray, squares: np.ndarray, at: np.ndarray, g: np.ndarray, room: np.ndarray) -> None:
    s, w = room[:2, : len(at)]
    squares.take(at, axis=0, out=s, mode="clip")
    s += np.multiply(g, g, out=w)
    squares[at] = s
    s += np.float32(1e-6)
    np.divide(g, np.sqrt(s, out=s), out=s)
    s *= np.float32(RATE)
    weights.take(at, axis=0, out=w, mode="clip")
    w -= s
    weights[at] = w


def train_part(weights: np.ndarray, squares: np.ndarray, found: np.ndarray, target: np.ndarray, closed: np.ndarray | None = None, kind: np.ndarray | None = None) -> None:
    """AdaGrad steps in place, one for every batch of tokens."""
    nested = closed is None  # the last feature of classes is the first with one more: its sums add up to the first's
    # a step moves no weight by more than the rate
    near = len(found) * (_farthest(weights) + RATE * -(-found.shape[1] // BATCH)) < WIDE
    room = _room()
    if near and not nested:
        _by_kind(weights)[:] += closed  # weights of closed slots are 0 and stay so
    for a in range(0, found.shape[1], BATCH):
        f, y = found[:, a : a + BATCH], target[a : a + BATCH]
        if nested:
            before = _nest(weights)
            slope = _activations(weights, f[1:], None, near, room)
            weights[STARTS[4] : FEATURES] = before
        else:
            slope = _activations(weights, f, None if near else closed.take(kind[a : a + BATCH], axis=0), near, room)
        np.exp(slope, out=slope)
        slope *= (1 / (slope @ _ONES))[:, None]
        slope.reshape(-1)[_FLAT[: len(y)] + y] -= 1
        for k in range(int(nested), len(f)):
            key = f[k].astype(np.uint16)  # 16 bits: sorted by radix
            order = np.argsort(key, kind="stable")
            own = key[order]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            g, own = _sums(slope, order, new, room), own[new].astype(np.int64)
            _step(weights, squares, own, g, room)
            if nested and k == len(f) - 1:
                first = (own - STARTS[4]) // (CLASSES + 1)
                new = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
                _step(weights, squares, first[new], np.add.reduceat(g, new, axis=0), room)
    if near and not nested:
        _by_kind(weights)[:] -= closed


def train(docs: DataFrame, slots: Slots, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from ``docs`` (k0, k1, t), WEIGHTS x CLASSES."""
    weights = np.zeros((WEIGHTS, CLASSES), np.float32)
    for k in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(weights)

        def run(batches, sent=sent):
            own, squares, met, n = sent.value.copy(), np.zeros((WEIGHTS, CLASSES), np.float32), np.zeros(WEIGHTS, bool), 0
            for b in batches:
                for _, rows in _lowered(b.column(0)):
                    t = tokens(rows)
                    of_class, of_slot = features(t)
                    kind = t.classes[t.word]
                    train_part(own, squares, of_class, kind)
                    train_part(own, squares, of_slot, slots.find(t.hashes)[0][t.word], slots.closed, kind)
                    met[of_class.ravel()] = met[of_slot.ravel()] = True
                    n += len(t.word)
            at = np.flatnonzero(met)
            change = (own - sent.value)[at]
            for a in range(0, len(at), 4_000):
                some = slice(a, a + 4_000)
                yield pa.RecordBatch.from_arrays([pa.array(at[some], pa.int32()), pa.array(np.full(len(at[some]), n), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(change[some].ravel()), CLASSES).cast(pa.list_(pa.float32()))], names=["f", "n", "v"])

        changes = docs.filter(F.pmod(F.xxhash64(F.lit(13), "k0", "k1"), F.lit(rounds)) == k).select("t").mapInArrow(run, "f int, n long, v array<float>")
        sums = changes.groupBy("f").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[c] * F.col("n")).alias(f"v{c}") for c in range(CLASSES)])
        # WEIGHTS rows at most
        for r in sums.collect():
            weights[r["f"]] += np.array(r[2:], np.float64) / r["n"]
        weights = np.round(weights, 6)  # sums may come in any order
    return weights


def _packed(*columns: np.ndarray) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + b"".join([np.ascontiguousarray(c).tobytes() for c in columns]))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    whole = zstd.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(whole[:8], "little"), 8, []
    for k in kinds:
        out.append(np.frombuffer(whole, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def corpus_counts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Per document k0, k1, known (tokens) and share (sum of log10(c + 1)); tokens and words by class; words with slots.

    ``docs`` has k0, k1, t and learns. Each batch numbers its words. Its documents stay, as
    word numbers and counts, in one row; its words go out by hash range and their corpus
    counts come back.
    """
    total = docs.select(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    ranges = max(1, -(-total // 25_000_000))

    def cut(batches):
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            k0, k1, learns = b.column(0).to_numpy(), b.column(1).to_numpy(), np.array(b.column(3).to_pylist(), bool)
            for at, rows in _lowered(b.column(2)):
                t = tokens(rows)
                words = len(t.hashes)
                pair, n = np.unique(t.row * words + t.word, return_counts=True)
                row, word = pair // words, pair % words
                count = np.bincount(word, n * learns[at][row], minlength=words).astype(np.int64)
                batch = task << 32 | k
                k += 1
                out = [(batch, -1, _packed(k0[at], k1[at]), _packed(row.astype(np.int32), word.astype(np.int32), n.astype(np.int32)))]
                # the high bits of a hash choose the range
                place = ((t.hashes >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
                order = np.lexsort((t.hashes, place))
                edges = np.searchsorted(place[order], np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(edges)):
                    x = order[edges[r] : edges[r + 1]]
                    out.append((batch, int(r), _packed(t.hashes[x], count[x], x.astype(np.int32), t.classes[x].astype(np.int8)), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["batch", "part", "a", "b"])

    # written once: both branches below read the same batches, whatever executors are lost
    parts = scratch.write(docs.select("k0", "k1", "t", "learns").mapInArrow(cut, "batch long, part int, a binary, b binary"), "parts")

    def add_up(table: pa.Table) -> pa.Table:
        batch = table.column("batch").to_pylist()
        cols = [_unpacked(x, "u8", "i8", "i4", "i1") for x in table.column("a").to_pylist()]
        h, n, _, kind = (np.concatenate(c) for c in zip(*cols, strict=True))
        ids, first, which = np.unique(h, return_index=True, return_inverse=True)
        whole = np.bincount(which, n, minlength=len(ids)).astype(np.int64)
        out, at = [], 0
        for b, c in zip(batch, cols, strict=True):
            out.append((b, _packed(c[2], whole[which[at : at + len(c[2])]]), None, None, None, None))
            at += len(c[2])
        known = whole > 0
        sums = [np.bincount(kind[first], w, minlength=CLASSES).astype(np.int64).tolist() for w in (whole, known)]
        out.append((None, None, sums[0] + sums[1], None, None, None))
        # the words of this range that may get a slot
        order = np.lexsort((ids, -whole, kind[first]))
        own = kind[first][order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        for x in order[(place < SLOTS - 1) & known[order]].tolist():
            out.append((None, None, None, int(kind[first[x]]), int(ids[x].astype(np.int64)), int(whole[x])))
        return pa.Table.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["batch", "c", "sums", "kind", "hash", "n"])

    back = scratch.write(parts.filter("part >= 0").select("batch", "part", "a").repartition(2 * ranges, "part").groupBy("part").applyInArrow(add_up, "batch long, c binary, sums array<long>, kind int, hash long, n long"), "counts")
    most = back.filter(F.col("kind").isNotNull()).withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy(F.col("n").desc(), "hash"))).filter(F.col("k") < SLOTS)
    heads = [(r["kind"], r["hash"] % (1 << 64), r["n"]) for r in most.orderBy("kind", "k").select("kind", "hash", "n").collect()]
    totals = back.filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(2 * CLASSES, np.int64)
    for r in totals:
        sums[r["k"]] = r["n"]

    def share(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [_unpacked(x, "i4", "i8") for x in right.column("c").to_pylist()]
        at, c = (np.concatenate(x) for x in zip(*found, strict=True))
        corpus = np.zeros(int(at.max()) + 1, np.int64)
        corpus[at] = c
        out = []
        for keys, docs_ in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            k0, k1 = _unpacked(keys, "i8", "i8")
            row, word, n = _unpacked(docs_, "i4", "i4", "i4")
            own = corpus[word]
            out.append((k0, k1, np.bincount(row, n * (own > 0), minlength=len(k0)).astype(np.int64), np.bincount(row, n * np.log10(own + 1), minlength=len(k0))))
        whole = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(x) for x in whole], names=["k0", "k1", "known", "share"])

    kept = parts.filter("part < 0").select("batch", "a", "b")
    both = [df.repartition(2 * ranges, "batch").groupBy("batch") for df in (kept, back.filter(F.col("batch").isNotNull()).select("batch", "c"))]
    told = both[0].cogroup(both[1]).applyInArrow(share, "k0 long, k1 long, known long, share double")
    return told, sums[:CLASSES], sums[CLASSES:], heads


def score(docs: DataFrame, held_out: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(docs.sparkSession, "lm")
    base = bounded_batches(docs).select(quoted(key).alias("id"), quoted(held_out).alias("held"), F.coalesce(quoted(key).cast("long"), F.lit(_LOWEST)).alias("k0"), F.xxhash64(quoted(text)).alias("k1"), quoted(text).alias("t"), (~quoted(held_out)).alias("learns"))
    told, by_class, words, heads = corpus_counts(base, scratch)
    slots = Slots.of(heads, by_class, words)
    weights = train(base.filter("learns").select("k0", "k1", "t"), slots)
    sent = docs.sparkSession.sparkContext.broadcast((weights, slots))

    def run(column: pa.Array) -> list:
        n, logs = [], []
        for _, rows in _lowered(column):
            t = tokens(rows)
            n.append(t.sizes)
            logs.append(np.bincount(t.row, token_logs(*sent.value, t), minlength=len(rows)))
        return [np.concatenate(n), np.concatenate(logs)] if n else [[], []]

    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("context", T.DoubleType())])
    own = annotate(base, run, ["t"], fields, ["id", "held", "k0", "k1"])
    total, distinct = int(by_class.sum()), int(words.sum())
    # rows alike in id and text have equal shares
    out = own.join(told.dropDuplicates(["k0", "k1"]), ["k0", "k1"], "left")
    return out.select(F.col("id").alias(key), F.col("held").alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("share") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"), (F.col("share") + F.col("context")).alias("score"))
