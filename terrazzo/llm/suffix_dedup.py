"""Removal of repeated passages by sorted suffixes.

A byte goes if a string of ``span`` bytes that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one. Matches are judged on the input.

Sparse suffixes. Every window of ``span`` bytes picks the leftmost of its ``lead``-byte
strings with the least hash; suffixes start at the picked places (about 3 in 100). The pick
depends on the window's bytes alone, so equal windows pick the same place, at the same
offset, and comparing suffixes there, with what stands before them, loses no match.

1. Suffixes are range-partitioned by their leading tokens, with splitters from a sample, and
   large ranges once more by a hash of the leading tokens. Equal leading tokens fall in one
   bucket, so a boundary never parts a match. A suffix brings a hash of all bytes of the
   windows that picked it. In a bucket, suffixes alike in all that are covered by the earliest
   at once; batches do this too before the shuffle, so a passage that everyone has costs a row
   a batch. Where unlike suffixes share the leading tokens, the earliest of each kind is asked
   for its bytes.
2. Those bytes (``2 * span`` at most) are range-partitioned likewise, sorted by multikey
   quicksort on 8-byte tokens, ahead and (reversed) behind; common prefixes of neighbours give
   for each offset the classes of equal windows, and all but the first of a class are covered.
3. Leading tokens with more unlike suffixes than a bucket holds, as the sample tells, stay out
   of buckets. Their windows, all of them, are told apart by two 64-bit hashes of their bytes
   ahead and behind; the first place of each comes from an aggregation that combines before
   its shuffle, so no task holds such a group.
4. Covered runs are grouped by document and cut.

Defined cases: a null text is empty; texts shorter than ``span`` lose nothing; a null id comes
before all others; rows alike in id and text are one document, and do not cover one another;
among rows of one id, that with the smaller text hash comes first. Text columns are cut at
whole characters: a character that loses a byte goes.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import annotate, blobs, bounded_batches, frugal, frugal_group, joined, quoted, slices
from .scratch import Scratch

SPAN, LEAD = 100, 32
CHUNK = 600_000
#: Suffixes in a bucket, splitters at most (ranges beyond are parted by hash), sampled suffixes a bucket.
IN_BUCKET, SPLITTERS, SAMPLED = 150_000, 4_096, 16
#: Leading tokens that are kept out of buckets: this many of the largest at most, which bounds all
#: others to suffixes / MOST_HOT.
MOST_HOT = 100_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[_U(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64))))


@cache
def _letters(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


class Suffixes:
    """The picked places of some documents."""

    def __init__(self, rows: list[bytes], span: int, lead: int) -> None:
        self.data, self.ends = joined(rows)
        n = len(self.data)
        size = 1 << max(16, n.bit_length())
        self.power, self.inverse = _powers(size)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[_U(0)], np.cumsum(_letters()[self.data] * self.power[:n])])
        first = [s for a, b in zip(self.ends, self.ends[1:]) if b - a >= span for s in (a, b - span + 1)]
        empty = np.zeros(0, np.int64)
        if not first:
            self.doc = self.at = self.start = self.low = self.high = empty
            self.gram = self.whole = empty.astype(np.uint64)
            return
        gram = _mix(self.hashes(np.arange(n - lead + 1), lead))
        pick = self._leftmost_least(gram, span - lead + 1)
        # windows that lie in one document
        edge = np.zeros(n + 1, np.int8)
        edge[first[::2]] += 1
        np.add.at(edge, first[1::2], -1)
        window = np.flatnonzero(np.cumsum(edge[:n]) > 0)
        pick = pick[window]
        doc = np.searchsorted(self.ends, window, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])]))
        old = np.concatenate([new[1:], [len(window)]]) - 1
        self.doc, self.at = doc[new], pick[new]
        self.low, self.high = self.at - window[old], self.at - window[new]  # offsets of the windows
        self.gram = gram[self.at]
        with np.errstate(over="ignore"):
            self.whole = _mix(self.hashes(self.at - self.high, self.high - self.low + span) + (self.low * 256 + self.high).astype(np.uint64))
        self.start = self.at - self.ends[self.doc]

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + length] - self.sums[at]) * self.inverse[at]

    def windows(self, own: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
        """All windows that picked the suffixes ``own``: suffix, place in its document, two hashes of the bytes."""
        n = self.high[own] - self.low[own] + 1
        of = np.repeat(own, n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.low[of]
        at = self.at[of] - offset
        with np.errstate(over="ignore"):
            other = np.concatenate([[_U(0)], np.cumsum(_letters(11)[self.data] * self.power[: len(self.data)])])
            hashes = [_mix((x[at + span] - x[at]) * self.inverse[at]) for x in (self.sums, other)]
        return of, self.start[of] - offset, *hashes

    @staticmethod
    def _leftmost_least(gram: np.ndarray, width: int) -> np.ndarray:
        """For each run of ``width`` hashes the place of the least, the leftmost of ties."""
        now, size, out, have = (gram & ~_U(0xFFFFFFFF)) | np.arange(len(gram), dtype=np.uint64), 1, None, 0
        while width:
            if width & 1:
                if out is None:
                    out, have = now, size
                else:
                    n = min(len(out), len(now) - have)
                    out, have = np.minimum(out[:n], now[have : have + n]), have + size
            width >>= 1
            if width:
                now, size = np.minimum(now[:-size], now[size:]), 2 * size
        return (out & _U(0xFFFFFFFF)).astype(np.int64)

    def leading(self, lead: int) -> np.ndarray:
        """Leading tokens, as fixed strings that compare like the bytes."""
        grid = self.data[self.at[:, None] + np.arange(lead)]
        # zeros at an end would not count in numpy's strings: their places are kept apart by 1
        return np.ascontiguousarray(np.minimum(grid, 254) + 1).view(f"S{lead}").ravel()


def _packed(*columns: np.ndarray) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(b"".join([len(columns[0]).to_bytes(8, "little"), *[np.ascontiguousarray(c).tobytes() for c in columns]]))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    whole = zstd.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(whole[:8], "little"), 8, []
    for k in kinds:
        out.append(np.frombuffer(whole, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _firsts(k0: np.ndarray, k1: np.ndarray, at: np.ndarray, *kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by kind and then place; where a kind begins; and which come truly later than its first."""
    order = np.lexsort((at, k1, k0, *kinds[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in kinds:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return order, new, (k0[order] != k0[first]) | (k1[order] != k1[first]) | (at[order] != at[first])


BUCKET, SPENT, CROWD = 0, 1, 2
COVERED = "k0 long, k1 long, run long"
ASKED = "kind int, k0 long, k1 long, run long"


def _batch(out: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, types, strict=True)], names=names)


def _run(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return start << 32 | end


def multikey_order(tokens: np.ndarray) -> np.ndarray:
    """Order of rows by their tokens: each pass parts the runs still equal by the next token."""
    n = len(tokens)
    order = np.argsort(tokens[:, 0], kind="stable")
    run = np.concatenate([[0], np.cumsum(tokens[order[1:], 0] != tokens[order[:-1], 0])]) if n else np.zeros(0, np.int64)
    for d in range(1, tokens.shape[1]):
        many = np.bincount(run)[run] > 1
        if not many.any():
            break
        at = np.flatnonzero(many)
        own = order[at]
        own = own[np.lexsort((tokens[own, d], run[at]))]
        order[at] = own
        new = run[1:] != run[:-1]
        new |= tokens[order[1:], d] != tokens[order[:-1], d]
        run = np.concatenate([[0], np.cumsum(new)])
    return order


def _sorted(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row among the sorted rows, and common prefixes of sorted neighbours."""
    n, width = grid.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = grid
    order = multikey_order(padded.view(">u8").astype(np.uint64))
    differ = grid[order[1:]] != grid[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), width)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, common


def surroundings(data: np.ndarray, place: np.ndarray, steps: np.ndarray, n: np.ndarray, at_once: int = 8_192) -> np.ndarray:
    """A row a place: the bytes at ``steps`` from it, 0 after the first ``n``.

    Some thousand rows at a time, as a place takes eight times the memory of its byte.
    """
    out = np.zeros((len(place), len(steps)), np.uint8)
    for a in range(0, len(place), at_once):
        x = slice(a, a + at_once)
        at = np.clip(place[x, None] + steps, 0, len(data) - 1)
        out[x] = np.where(np.arange(len(steps)) < n[x, None], data[at], 0)
    return out


def compare(k0, k1, start, low, high, left: np.ndarray, right: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes with their bytes behind (reversed) and ahead: least and largest covered offset (-1: none)."""
    n = len(k0)
    ahead, common_ahead = _sorted(right)
    behind, common_behind = _sorted(left)
    least, most = np.full(n, 1 << 30), np.full(n, -1)
    place = np.lexsort((start, k1, k0))
    for o in range(int(low.min()), int(high.max()) + 1):
        own = place[(low[place] <= o) & (o <= high[place])]
        if len(own) < 2:
            continue
        a = np.concatenate([[0], np.cumsum(common_ahead < span - o)])[ahead[own]]
        b = np.concatenate([[0], np.cumsum(common_behind < o)])[behind[own]]
        _, first, which = np.unique(a * n + b, return_index=True, return_inverse=True)
        dup = own[first[which] != np.arange(len(own))]
        least[dup], most[dup] = np.minimum(least[dup], o), np.maximum(most[dup], o)
    return least, most


def keyed_rows(docs: DataFrame, text: str, key: str, columns: list[str]) -> DataFrame:
    """k0 and k1 tell documents apart, in order; t is the text, row the other columns."""
    others = [quoted(c) for c in columns if c != text]
    return bounded_batches(docs).select(F.struct(*(others or [F.lit(0).alias("_")])).alias("row"), quoted(text).alias("t"), F.coalesce(quoted(key).cast("long"), F.lit(-(1 << 63))).alias("k0"), F.xxhash64(quoted(text)).alias("k1"))


def covered(keyed: DataFrame, span: int = SPAN, lead: int = LEAD) -> DataFrame:
    """The covered runs of each document of ``keyed_rows``: k0, k1, runs (start << 32 | end)."""
    total = keyed.select(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    suffixes = max(1, total // 30)
    buckets = -(-suffixes // IN_BUCKET)
    ranges = min(SPLITTERS, buckets)
    parts = -(-buckets // ranges)  # of a range, by hash
    every = max(1, suffixes // (buckets * SAMPLED))
    scratch = Scratch(keyed.sparkSession, "suffixes")

    def sampled(batches):
        for b in batches:
            rows = blobs(b.column(0))
            for at in slices([len(x) for x in rows], CHUNK):
                s = Suffixes(rows[at], span, lead)
                some = np.flatnonzero(_mix(s.whole) % _U(thin) == 0)
                s.at = s.at[some]
                yield pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in s.leading(lead)], pa.binary()), pa.array(s.whole[some].view(np.int64))], names=["lead", "whole"])

    # texts are thinned before suffixes, so that the sample reads few of them
    part = min(every, 64)
    thin = max(1, every // part)
    sample = keyed.filter(F.pmod(F.xxhash64("k0", "k1"), F.lit(part)) == 0).select("t").mapInArrow(frugal(sampled), "lead binary, whole long")
    kinds = scratch.write(sample.distinct().groupBy("lead").agg(F.count(F.lit(1)).alias("n")), "sample")
    crowded = kinds.filter(F.col("n") * every > IN_BUCKET).orderBy(F.col("n").desc(), "lead").limit(MOST_HOT)
    hot = np.sort(np.array([bytes(r["lead"]) for r in crowded.select("lead").collect()], dtype=f"S{lead}"))
    # splitters need about SAMPLED leading tokens a range
    met_ = kinds.filter(F.pmod(F.xxhash64("lead"), F.lit(parts)) == 0).select("lead", F.least("n", F.lit(SAMPLED)).alias("n"))
    lines = sorted(x for r in met_.collect() for x in [bytes(r["lead"])] * r["n"])
    cuts = np.array([lines[len(lines) * k // ranges] for k in range(1, ranges)] if lines else [], dtype=f"S{lead}")

    def bucket_of(leading: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, leading, "right") * parts + (_mix(gram) % _U(parts)).astype(np.int64)

    def suffix_rows(batches):
        for b in batches:
            ids, hashes, rows = b.column(0).to_numpy(), b.column(1).to_numpy(), blobs(b.column(2))
            for at in slices([len(x) for x in rows], CHUNK):
                s = Suffixes(rows[at], span, lead)
                k0, k1 = ids[at][s.doc], hashes[at][s.doc]
                # alike within the batch: the earliest stands for all
                order, new, later = _firsts(k0, k1, s.start, s.gram, s.whole)
                dup = order[~new & later]
                begin = s.start[dup] - s.high[dup]
                spent = _packed(k0[dup], k1[dup], _run(begin, s.start[dup] - s.low[dup] + span))
                # what is covered already goes along, in a bucket of any number
                found, what, made = [int(abs(k1[0])) % buckets if len(k1) else 0], [SPENT], [spent]
                own = np.sort(order[new])
                leading = s.leading(lead)[own]
                if len(hot):
                    crowd = np.isin(leading, hot)
                    of, place, h0, h1 = s.windows(own[crowd], span)
                    for a in range(0, len(of), 50_000):
                        x = slice(a, a + 50_000)
                        found.append(-1)
                        what.append(CROWD)
                        made.append(_packed(h0[x], h1[x], k0[of[x]], k1[of[x]], place[x].astype(np.int64)))
                    own, leading = own[~crowd], leading[~crowd]
                bucket = bucket_of(leading, s.gram[own])
                own, bucket = own[np.argsort(bucket, kind="stable")], np.sort(bucket)
                edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(own)]]) if len(own) else [0]
                for a, z in zip(edges, edges[1:]):
                    x = own[a:z]
                    found.append(int(bucket[a]))
                    what.append(BUCKET)
                    made.append(_packed(s.gram[x], s.whole[x], k0[x], k1[x], s.start[x].astype(np.int32), s.low[x].astype(np.uint8), s.high[x].astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(what, pa.int32()), pa.array(made, pa.binary())], names=["bucket", "what", "blob"])

    def crowd_rows(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in _unpacked(data, "u8", "u8", "i8", "i8", "i8")], names=["h0", "h1", "k0", "k1", "at"])

    def alike(table: pa.Table) -> pa.Table:
        out = []
        for data in table.filter(pc.equal(table.column("what"), SPENT)).column("blob").to_pylist():
            k0, k1, run = _unpacked(data, "i8", "i8", "i8")
            out.append((np.zeros(len(k0), np.int64), k0, k1, run))
        cols = [np.concatenate(x) for x in zip(*[_unpacked(x, "u8", "u8", "i8", "i8", "i4", "u1", "u1") for x in table.filter(pc.equal(table.column("what"), BUCKET)).column("blob").to_pylist()], strict=True)]
        if not cols:
            return pa.Table.from_batches([_batch(out, ["kind", "k0", "k1", "run"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()])])
        gram, whole, k0, k1 = cols[:4]
        start, low, high = (c.astype(np.int64) for c in cols[4:])
        order, new, later = _firsts(k0, k1, start, gram, whole)
        dup = order[~new & later]
        out.append((np.zeros(len(dup), np.int64), k0[dup], k1[dup], _run(start[dup] - high[dup], start[dup] - low[dup] + span)))
        # one of each kind; leading tokens that have two kinds or more ask for bytes
        one = order[new]
        g = gram[one]
        same = np.zeros(len(one), bool)
        same[1:] |= g[1:] == g[:-1]
        same[:-1] |= g[1:] == g[:-1]
        ask = one[same]
        out.append((np.ones(len(ask), np.int64), k0[ask], k1[ask], start[ask] << 16 | low[ask] << 8 | high[ask]))
        return pa.Table.from_batches([_batch(out, ["kind", "k0", "k1", "run"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()])])

    first = keyed.select("k0", "k1", "t").mapInArrow(frugal(suffix_rows), "bucket int, what int, blob binary")
    if len(hot):
        first = scratch.write(first, "first")
    met = scratch.write(first.filter(F.col("what") != CROWD).groupBy("bucket").applyInArrow(frugal_group(alike), ASKED), "met")
    asked = met.filter(F.col("kind") == 1).groupBy("k0", "k1").agg(F.collect_list("run").alias("places"))

    def contexts(batches):
        for b in batches:
            ids, hashes, rows, places = b.column(0).to_numpy(), b.column(1).to_numpy(), blobs(b.column(2)), b.column(3)
            for at in slices([len(x) for x in rows], CHUNK):
                data, ends = joined(rows[at])
                own = places.slice(at.start, at.stop - at.start)
                flat = np.sort(own.flatten().to_numpy()) if len(own) == 1 else own.flatten().to_numpy()
                doc = np.repeat(np.arange(len(own)), np.array(own.value_lengths().to_pylist(), np.int64))
                start, low, high = flat >> 16, flat >> 8 & 255, flat & 255
                begin, length = ends[doc] + start - high, high - low + span
                lead_at = ends[doc] + start
                tokens = np.ascontiguousarray(np.minimum(data[lead_at[:, None] + np.arange(lead)], 254) + 1).view(f"S{lead}").ravel()
                bucket = np.searchsorted(cuts, tokens, "right") * parts + np.array([zlib.crc32(x) % parts for x in tokens.tolist()] if parts > 1 else 0, np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else [0]
                found, made = [], []
                for a, z in zip(edges, edges[1:]):
                    x = order[a:z]
                    n = length[x]
                    where = np.repeat(begin[x] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    found.append(int(bucket[x[0]]))
                    made.append({"head": _packed(ids[at][doc[x]], hashes[at][doc[x]], start[x].astype(np.int32), low[x].astype(np.uint8), high[x].astype(np.uint8)), "bytes": zstd.ZstdCompressor(level=1).compress(data[where].tobytes())})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([m["head"] for m in made], pa.binary()), pa.array([m["bytes"] for m in made], pa.binary())], names=["bucket", "head", "bytes"])

    def sweep(table: pa.Table) -> pa.Table:
        heads = [np.concatenate(x) for x in zip(*[_unpacked(x, "i8", "i8", "i4", "u1", "u1") for x in table.column("head").to_pylist()], strict=True)]
        data = np.frombuffer(b"".join([zstd.ZstdDecompressor().decompress(x) for x in table.column("bytes").to_pylist()]), np.uint8)
        k0, k1 = heads[:2]
        start, low, high = (c.astype(np.int64) for c in heads[2:])
        length = high - low + span
        place = np.concatenate([[0], np.cumsum(length)[:-1]]) + high  # of the suffix in the data
        _, keep = np.unique(np.stack([k0, k1, start]), axis=1, return_index=True)  # rows that repeat
        k0, k1, start, low, high, place = (c[keep] for c in (k0, k1, start, low, high, place))
        right = surroundings(data, place, np.arange(span), span - low)
        left = surroundings(data, place, -1 - np.arange(span - lead), high)
        least, most = compare(k0, k1, start, low, high, left, right, span)
        dup = np.flatnonzero(most >= 0)
        return pa.Table.from_batches([_batch([(k0[dup], k1[dup], _run(start[dup] - most[dup], start[dup] - least[dup] + span))], ["k0", "k1", "run"], [pa.int64()] * 3)])

    # as the last join has the same columns, the texts are shuffled once for both
    told = keyed.join(asked.hint("shuffle_hash"), ["k0", "k1"]).select("k0", "k1", "t", "places", "row")
    swept = told.mapInArrow(frugal(contexts), "bucket int, head binary, bytes binary").groupBy("bucket").applyInArrow(frugal_group(sweep), COVERED)
    runs = met.filter(F.col("kind") == 0).select("k0", "k1", "run").union(swept)
    if len(hot):
        crowd = first.filter(F.col("what") == CROWD).select("blob").mapInArrow(frugal(crowd_rows), "h0 long, h1 long, k0 long, k1 long, at long")
        places = crowd.groupBy("h0", "h1").agg(F.min(F.struct("k0", "k1", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h0", "h1", "first")
        # a window that everyone has is a long row of one key: Spark splits those (AQE)
        later = crowd.join(places.hint("merge"), ["h0", "h1"]).filter(F.struct("k0", "k1", "at") != F.col("first"))
        runs = runs.union(later.select("k0", "k1", (F.shiftleft(F.col("at"), 32) + F.col("at") + span).alias("run")))
    return runs.groupBy("k0", "k1").agg(F.collect_list("run").alias("runs"))


def _spans(runs: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs, from runs that may overlap or touch."""
    if not runs:
        return []
    flat = np.sort(np.array(runs, np.int64))
    start, end = flat >> 32, np.maximum.accumulate(flat & 0xFFFFFFFF)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.concatenate([new[1:], [True]])].tolist()))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN, lead: int = LEAD, keep: list[str] | None = None, cut_text: bool = False) -> DataFrame:
    """Append n_bytes, n_removed, n_spans and kept_sha256; with ``cut_text``, cut the text itself too."""
    columns = docs.columns if keep is None else keep
    keyed = keyed_rows(docs, text, key, columns)
    told = keyed.join(covered(keyed, span, lead).hint("shuffle_hash"), ["k0", "k1"], "left").select("row", "t", "runs")

    def cut(texts: pa.Array, found: pa.Array) -> list:
        out: list[tuple] = []
        for data, own in zip(blobs(texts), found.to_pylist(), strict=True):
            spans = _spans(own)
            kept, at = [], 0
            for s, e in spans:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            whole = b"".join(kept)
            out.append((len(data), len(data) - len(whole), len(spans), hashlib.sha256(whole).hexdigest(), "".join([x.decode(errors="ignore") for x in kept]) if cut_text else None))
        return [list(x) for x in zip(*out, strict=True)] if out else [[]] * 5

    fields = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("_cut", T.StringType())])
    out = annotate(told, cut, ["t", "runs"], fields, ["row", "t"])
    names = fields.names[:-1]
    whole = F.when(F.col("t").isNotNull(), F.col("_cut")) if cut_text else F.col("t")
    return out.select(*[(whole if c == text else F.col("row").getField(c)).alias(c) for c in columns if c not in names], *names)
