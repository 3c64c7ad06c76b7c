"""Byte-level BPE with vectorised pre-tokenisation, and its inverse.

Codepoints become symbols of a small alphabet (class, plus what the next characters decide);
an automaton over them tells where a piece begins. The automaton runs as a scan of its
transition functions: blocks compose their functions side by side, a doubling scan joins the
blocks, and the states of all characters follow. No regular expression runs. Pieces then get
their ids by pair merging, which also runs over all new pieces of a batch at once; a piece's
ids are cached. Token byte offsets are returned on demand, so ids decode to exact slices.

The pieces are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Defined cases: a null or empty text has no tokens and decodes to no bytes; special tokens'
strings are ordinary text; equal texts give equal ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import annotate, slices

CHUNK = 1_500_000
CACHED = 300_000
LONG = 64
BLOCK = 128

# symbols: letter, number, other, last white space before something else (a blank, or
# another), any other white space, an apostrophe before s t m d, one before re ve ll
L, N, O, BLANK, LAST, MID, ONE, TWO = range(8)
# states: fresh, in letters, in numbers, in others, after a blank, after other white space,
# one or two letters of a contraction due
FRESH, IN_L, IN_N, IN_O, BLANKED, SPACED, DUE1, DUE2 = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here", both by symbol and state; symbol + 8 starts a text."""
    step, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for symbol in range(8):
        for state in range(8):
            if state == DUE2 or state == DUE1:
                step[symbol, state] = DUE1 if state == DUE2 else FRESH
                continue
            kind, run = {L: (IN_L, IN_L), N: (IN_N, IN_N), O: (IN_O, IN_O), ONE: (IN_O, IN_O), TWO: (IN_O, IN_O), BLANK: (BLANKED, None), LAST: (SPACED, None), MID: (SPACED, SPACED)}[symbol]
            joins = state == run or state == BLANKED and symbol not in (BLANK, LAST, MID)
            if symbol in (ONE, TWO) and not joins:
                kind = DUE1 if symbol == ONE else DUE2
            step[symbol, state], begins[symbol, state] = kind, not joins
    step[8:], begins[8:] = step[:8, [FRESH]], True
    return step, begins


_STEP, _BEGINS = _machine()
# The characters with the property White_Space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    """L, N, O or MID by codepoint."""
    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    out = np.full(0x110000, O, np.uint8)
    out[first == ord("L")], out[first == ord("N")] = L, N
    out[_SPACES] = MID
    return out


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automaton's symbols; ``starts`` holds the first position of each (not empty) text."""
    out = _classes()[points]
    n = len(points)
    after = np.full(n, 255, np.uint8)  # the next class within the text
    after[:-1] = out[1:]
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = last[-1:] = True
    after[last] = 255
    edge = (out == MID) & (after != MID) & (after != 255)
    out[edge] = np.where(points[edge] == 32, BLANK, LAST)
    at = np.flatnonzero((points == ord("'")) & ~last)
    one = points[at + 1]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = ONE
    at = at[~last[at + 1]]
    pair = points[at + 1].astype(np.int64) << 32 | points[at + 2]
    out[at[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = TWO
    out[starts] += 8
    return out


def begins(symbol: np.ndarray) -> np.ndarray:
    """Where pieces begin, by a scan of the symbols' transition functions."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, MID, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat = _STEP.ravel()
    # the function of each block: for every state before it, the state after it
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in grid:
        whole = flat[(row.astype(np.int16) * 8)[:, None] + whole]
    # inclusive scan of functions over blocks, by doubling
    k = 1
    while k < blocks:
        whole[k:] = np.take_along_axis(whole[k:], whole[:-k], 1)
        k *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((BLOCK, blocks), bool)
    starts = _BEGINS.ravel()
    for j, row in enumerate(grid):
        key = row.astype(np.int16) * 8 + state
        out[j], state = starts[key], flat[key]
    return out.T.ravel()[:n]


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all texts after one another, and the n + 1 ends of the texts in that list."""
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if not len(points):
        return [], np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(begins(symbols(points, ends[:-1][size > 0])))
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(wide)])
    data = "".join(texts).encode()
    cuts = [*offset[at].tolist(), len(data)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])], np.searchsorted(at, ends, "left")


class Vocabulary:
    """Ranks of byte strings: pair merging, encoding with a cache, and decoding."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.wide = max(self.tokens) + 1
        found = [(ranks[t[:k]] * self.wide + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.merged = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = self._look(np.repeat(self.bytes, 256) * self.wide + np.tile(self.bytes, 256)).reshape(256, 256)
        self.cache: dict[bytes, tuple[tuple[int, ...], str]] = {}

    def _look(self, key: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a very large number for those that don't merge."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], np.iinfo(np.int64).max)

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many short pieces: in each round every piece makes its lowest, leftmost merge."""
        out: list[tuple[int, ...]] = [()] * len(words)
        if not words:
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        token = self.bytes[data]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        none = np.iinfo(np.int64).max
        rank = np.full(len(token), none)
        rank[:-1] = np.where(word[1:] == word[:-1], self.first[data[:-1], data[1:]], none)
        done_token, done_word = [], []
        while len(token):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.concatenate([starts, [len(token)]]))
            over = np.repeat(least == none, length)
            if over.any():
                done_token.append(token[over]), done_word.append(word[over])
                token, word, rank = token[~over], word[~over], rank[~over]
                continue
            hit = np.flatnonzero(rank == np.repeat(least, length))
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost
            token[hit] = rank[hit]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))
            token, word, rank = token[keep], word[keep], rank[keep]
            # only the pairs on either side of a merge are new
            for at in (moved, moved - 1):
                at = at[at >= 0]
                inner = at + 1 < len(token)
                inner[inner] = word[at[inner]] == word[at[inner] + 1]
                rank[at[~inner]] = none
                at = at[inner]
                rank[at] = self._look(token[at] * self.wide + token[at + 1])
        token, word = np.concatenate(done_token), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat, ends = token[order].tolist(), np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """Ids of one long piece, with a heap of pairs and linked neighbours."""
        token: list[int] = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def pair(i: int) -> tuple[int, int, int, int] | None:
            r = ranks.get(tokens[token[i]] + tokens[token[after[i]]])
            return None if r is None else (r, i, token[i], token[after[i]])

        heap = [x for i in range(n - 1) if (x := pair(i))]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if token[i] != a or (j := after[i]) >= n or token[j] != b:
                continue
            token[i], token[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if x := pair(i):
                    heapq.heappush(heap, x)
            if before[i] >= 0 and (x := pair(before[i])):
                heapq.heappush(heap, x)
        return tuple(t for t in token if t >= 0)

    def encode(self, found: list[bytes]) -> list[tuple[tuple[int, ...], str]]:
        """Ids of each piece, and those as decimals joined by commas."""
        known = self.cache
        if len(known) > CACHED:
            known.clear()
        new = [w for w in dict.fromkeys(found) if w not in known]
        whole = {w: (self.ranks[w],) for w in new if w in self.ranks}
        short = [w for w in new if w not in whole and len(w) <= LONG]
        whole |= dict(zip(short, self.merge_all(short), strict=True))
        whole |= {w: self.merge_long(w) for w in new if w not in whole}
        for w, ids in whole.items():
            known[w] = ids, ",".join(map(str, ids))
        return [known[w] for w in found]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def vocabulary(path: str) -> Vocabulary:
    """From a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``ids`` and ``offsets`` (the byte at which each token starts)."""

    def run(texts: pa.Array) -> list:
        v = vocabulary(path)
        ids, offsets = [], []
        for _, parts in _encoded(v, texts):
            own = list(chain.from_iterable(x[0] for x in parts))
            ids.append(own)
            offsets.append(np.concatenate([[0], np.cumsum([len(v.tokens[i]) for i in own])[:-1]]).astype(np.int32).tolist() if own else [])
        return [ids, offsets]

    return annotate(df, run, [text], T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType()))]), keep)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Append ``decoded``, the bytes of the ids; an id beyond the vocabulary fails the job."""
    return annotate(df, lambda column: [[None if x is None else vocabulary(path).decode(x) for x in column.to_pylist()]], [ids], T.StructType([T.StructField("decoded", T.BinaryType())]), keep)


def _encoded(v: Vocabulary, texts: pa.Array):
    """For each text, in chunks of bounded size: the text and its pieces' ids."""
    rows = [x or "" for x in texts.to_pylist()]
    for at in slices([len(x) for x in rows], CHUNK):
        some = rows[at]
        found, ends = pieces(some)
        coded = v.encode(found)
        for k, t in enumerate(some):
            yield t, coded[ends[k] : ends[k + 1]]


def digest(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens and the SHA-256 of the ids and of the bytes that they decode to."""

    def run(texts: pa.Array) -> list:
        v = vocabulary(path)
        n, coded, decoded = [], [], []
        for _, parts in _encoded(v, texts):
            ids = list(chain.from_iterable([x[0] for x in parts]))
            n.append(len(ids))
            coded.append(hashlib.sha256(",".join([x[1] for x in parts]).encode()).hexdigest())
            decoded.append(hashlib.sha256(v.decode(ids)).hexdigest())
        return [n, coded, decoded]

    return annotate(df, run, [text], T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]), keep)
