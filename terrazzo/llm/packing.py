"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Texts are tokenised and cut into pieces of at most ``capacity`` tokens. The largest pieces open
a sequence each, a little fewer than the total needs (but all over half the capacity, which
never share one). In a superstep pieces and gaps are range-sorted by size, from the largest
down. A sweep through each range gives every piece the smallest gap before it that no other
piece has taken; what a range leaves over is matched across ranges by rank: of the pieces
that want the same gaps, the first ranks get the nearest ranges with gaps left. Each gap takes
one piece a superstep; then gaps are updated and the next superstep begins. After
``SUPERSTEPS`` of them the pieces left over, the smallest ones, are fitted by counts: rows of
one size are alike, so a last best-fit sweep runs over counts by size, and every row looks up
its sequence by its rank within its size.

The number of supersteps is fixed, whatever the number of ranges. Each leaves tables in the
shared folder. The driver sees counts by size (twice ``capacity`` at most) and two counts a
range, never pieces.

Defined cases: a null or empty text is the closing id alone; a document of n tokens gives
ceil(n / capacity) pieces; null ids and repeated rows are documents of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from functools import cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import annotate, frugal, quoted
from .scratch import Scratch

CAPACITY = 4096
END = 1
CACHED = 400_000
RANGE_ROWS = 60_000
SUPERSTEPS = 3
PIECE, GAP, PLACED, UPDATED = 0, 1, 2, 3
_TAIL = ".,;:!?)]}\"|*#$%&"


_TAIL_BYTES, _HIGH = _TAIL.encode(), [bytes([b | 0x80]) for b in range(256)]
_WORD_END = "</w>"


def _plain(word: str) -> bool:
    return word.isascii() and word.isalpha() and word.islower()


def _closed(word: str, end: bool) -> bytes:
    """A token's letters as bytes, that which closes a word with its high bit set."""
    letters = word.encode()
    return letters[:-1] + _HIGH[letters[-1]] if end else letters


class WordTokens:
    """A tokenizer's ids (packed 32-bit little-endian) by word between ASCII white space.

    Its normaliser drops white space and its pieces never span it, so words can be encoded
    apart; a letter run and a tail of marks can be too, as they are pieces of their own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # words of ASCII letters by the same ranks with a faster library: the letter that closes
        # a word is a byte of its own
        ranks = {_closed(x.removesuffix(_WORD_END), x.endswith(_WORD_END)): i for x, i in self.tokenizer.get_vocab().items() if _plain(x.removesuffix(_WORD_END))}
        self.letters = tiktoken.Encoding(path, pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closing[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True

    @staticmethod
    def split(word: str) -> tuple[str, ...]:
        """A letter run and its tail of marks, each one piece for the tokenizer; or no parts."""
        core = word.rstrip(_TAIL)
        if not core:
            return (word,)
        if not (core.isascii() or (core[-1] < "\u0530" and unicodedata.is_normalized("NFC", core))) or not core.lower().isalpha():
            return ()
        return (core, word[len(core) :]) if len(core) < len(word) else (core,)

    def learn(self, new: set[bytes]) -> None:
        """Ids of words: ASCII letters and a tail of marks at once, all others in parts by the tokenizer."""
        encode, cores, tails, words, others = self.letters._core_bpe.encode_single_piece, self.cores, self.tails, self.words, []
        for w in new:
            core = w.rstrip(_TAIL_BYTES)
            if not (core.isalpha() and core.islower()):
                others.append(w)
                continue
            own = cores.get(core)
            if own is None:
                own = cores[core] = array("I", encode(core[:-1] + _HIGH[core[-1]])).tobytes()
            if len(core) < len(w):
                tail = w[len(core) :]
                if tail not in tails:
                    tails[tail] = np.array(self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                own += tails[tail]
            words[w] = own
        if others:
            self._learn_others(others)

    def _learn_others(self, new: list[bytes]) -> None:
        cut, parts, odd = [], set(), []
        for w in new:
            own = self.split(w.decode())
            cut.append(own)
            parts.update(own)
            if not own:
                odd.append(w)
        one_by_one = [w.decode() for w in odd]
        for some in batched(parts - self.parts.keys(), 2_000):
            # a piece ends with a token that closes it, so that many pieces can be told apart
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some):
                whole, at = ids.tobytes(), (4 * ends).tolist()
                self.parts.update(zip(some, [whole[a:z] for a, z in zip([0, *at], at)], strict=False))
            else:
                one_by_one += some
        for some in batched(one_by_one, 2_000):
            for p, e in zip(some, self.tokenizer.encode_batch_fast(list(some), add_special_tokens=False), strict=True):
                self.parts[p] = np.array(e.ids, "<u4").tobytes()
        get = self.parts.__getitem__
        for w, own in zip(new, cut, strict=True):
            self.words[w] = b"".join(map(get, own)) if own else self.parts[w.decode()]

    def encode(self, texts: pa.Array):
        """Packed ids of each text, some hundred texts at a time."""
        for at in range(0, len(texts), 250):
            some = []
            for t in texts.slice(at, 250).to_pylist():
                # lower case first where it can't differ, for fewer words to learn
                if t and "<|" not in t and "Σ" not in t and "İ" not in t and unicodedata.is_normalized("NFC", t):
                    t = t.lower()
                some.append((t or "").encode().split())
            every = set(chain.from_iterable(some))
            if len(self.words) + len(every) > CACHED:
                self.words.clear()
            for own in (self.parts, self.cores, self.tails):
                if len(own) > CACHED:
                    own.clear()
            self.learn(every - self.words.keys())
            get = self.words.__getitem__
            yield from (b"".join(map(get, r)) for r in some)


@cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def tokenize(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``ids``: the text's ids and the closing id, packed as 32-bit little-endian."""
    return annotate(df, lambda texts: [[x + _CLOSE for x in word_tokens(path).encode(texts)]], [text], T.StructType([T.StructField("ids", T.BinaryType())]), keep)


_CLOSE = np.array([END], "<u4").tobytes()
PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def pieces(df: DataFrame, path: str, keep: list[str], text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a text's ids: piece, start, length and the checksum of its ids.

    Ids are cut text by text, so no column of ids is held.
    """

    def cut(texts: pa.Array) -> list:
        out = []
        for x in word_tokens(path).encode(texts):
            x += _CLOSE
            n = len(x) // 4
            out.append([{"piece": k, "start": s, "length": min(capacity, n - s), "ids_crc32": zlib.crc32(x[4 * s : 4 * min(n, s + capacity)])} for k, s in enumerate(range(0, n, capacity))])
        return [out]

    whole = annotate(df, cut, [text], T.StructType([T.StructField("_pieces", T.ArrayType(PIECES))]), keep)
    return whole.select(*[quoted(c) for c in keep], F.inline("_pieces"))


SWEPT = T.StructType([T.StructField("what", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("range", T.IntegerType()), T.StructField("rank", T.LongType())])
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


class Gaps:
    """Open gaps by size: stacks, and a mask of the sizes that have any."""

    def __init__(self) -> None:
        self.stacks: dict[int, list] = {}
        self.mask = 0

    def push(self, size: int, item) -> None:
        if size > 0:
            self.stacks.setdefault(size, []).append(item)
            self.mask |= 1 << size

    def successor(self, size: int) -> int:
        """The smallest open size that holds ``size``, or 0."""
        above = self.mask >> size
        return size + (above & -above).bit_length() - 1 if above else 0

    def pop(self, size: int):
        own = self.stacks[size]
        item = own.pop()
        if not own:
            self.mask &= ~(1 << size)
        return item


def _sweeper(capacity: int):
    """A range's rows, largest first and gaps before pieces of their size, to placed pieces, updated gaps, and ranks of what is left.

    Pieces left are ranked as they come, gaps from the largest, so the last ranks are the
    smallest gaps.
    """

    def sweep(batches):
        own, open_, wanting = TaskContext.get().partitionId(), [], 0
        for b in batches:
            out = []
            for kind, i, n in zip(*(b.column(c).to_pylist() for c in ("what", "id", "size")), strict=True):
                if kind == GAP:
                    open_.append((i, n))
                elif open_:
                    seq, gap = open_.pop()
                    out.append((PLACED, i, n, seq, capacity - gap, own, 0))
                    if gap > n:
                        out.append((UPDATED, seq, gap - n, None, None, own, 0))
                else:
                    out.append((PIECE, i, n, None, None, own, wanting))
                    wanting += 1
            yield from _rows(out)
        yield from _rows([(GAP, seq, gap, None, None, own, k) for k, (seq, gap) in enumerate(open_)])

    return sweep


def _rows(out: list[tuple]):
    if out:
        whole = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=SWEPT.names)
        yield from whole.to_batches(max_chunksize=50_000)


def match_ranges(left: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Ranges (range, pieces left, gaps left), largest sizes first, to runs of pieces and of gaps: (range, first rank, first match, n).

    Pieces of a range take the gaps of the nearest ranges before it, the smallest gaps first.
    Matches are numbers; a run of gaps counts down from its first rank.
    """
    open_: list[list[int]] = []
    pieces_, gaps_, match = [], [], 0
    for at, wanting, gaps in left:
        rank = 0
        while rank < wanting and open_:
            before, n = open_[-1]
            used = min(n, wanting - rank)
            pieces_.append((at, rank, match, used))
            gaps_.append((before, n - 1, match, used))
            rank, match = rank + used, match + used
            open_[-1][1] -= used
            if not open_[-1][1]:
                open_.pop()
        if gaps:
            open_.append([at, gaps])
    return pieces_, gaps_


def _numbered(pieces_: list[tuple], gaps_: list[tuple]):
    """Rows left over to ``number``: the match that their range and rank belong to, or -1."""

    def table(runs: list[tuple], down: bool) -> tuple:
        rows = sorted((r, first - n + 1 if down else first, first, match, n) for r, first, match, n in runs)
        r, low, first, match, n = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
        return r << 40 | low, r, low, first, match, n

    sides = {PIECE: table(pieces_, False), GAP: table(gaps_, True)}

    def look(batches):
        for b in batches:
            what, at, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("what", "range", "rank"))
            number = np.full(len(what), -1)
            for kind, (marks, r, low, first, match, n) in sides.items():
                own = np.flatnonzero(what == kind)
                if not len(marks) or not len(own):
                    continue
                run = np.maximum(np.searchsorted(marks, at[own] << 40 | rank[own], "right") - 1, 0)
                fits = (r[run] == at[own]) & (rank[own] >= low[run]) & (rank[own] < low[run] + n[run])
                step = first[run] - rank[own] if kind == GAP else rank[own] - first[run]
                number[own] = np.where(fits, match[run] + step, -1)
            yield pa.RecordBatch.from_arrays([b.column("what"), b.column("id"), b.column("size"), pa.array(number)], names=["what", "id", "size", "number"])

    return look


def superstep(state: DataFrame, scratch: Scratch, capacity: int, ranges: int, name: str = "") -> tuple[DataFrame, DataFrame]:
    """Placed pieces (id, seq, at), and the state (what, id, size) of what is left, after one round of matches."""
    order = [F.col("size").desc(), F.col("what").desc(), F.col("id")]
    swept = scratch.write(state.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(frugal(_sweeper(capacity)), SWEPT), f"swept{name}")
    rest = swept.filter(F.col("what").isin(PIECE, GAP))
    # two numbers a range
    left = rest.groupBy("range").agg(F.count_if(F.col("what") == PIECE).alias("p"), F.count_if(F.col("what") == GAP).alias("g")).collect()
    numbered = rest.select("what", "id", "size", "range", "rank").mapInArrow(frugal(_numbered(*match_ranges(sorted(tuple(r) for r in left)))), "what int, id long, size int, number long")
    pieces_, gaps_ = (numbered.filter((F.col("what") == kind) & (F.col("number") >= 0)).select("number", F.col("id").alias(i), F.col("size").alias(n)) for kind, i, n in ((PIECE, "id", "size"), (GAP, "seq", "gap")))
    met = scratch.write(pieces_.join(gaps_, "number").select("id", "size", "seq", "gap"), f"met{name}")
    placed = swept.filter(F.col("what") == PLACED).select("id", "seq", "at").union(met.select("id", "seq", (capacity - F.col("gap")).alias("at")))
    over = numbered.filter(F.col("number") < 0).select("what", "id", "size")
    updated = swept.filter(F.col("what") == UPDATED).select(F.lit(GAP).alias("what"), "id", "size").union(met.filter("gap > size").select(F.lit(GAP), "seq", F.col("gap") - F.col("size")))
    return placed, over.union(updated)


def _ranked(batches):
    """Rows (what, id, size) with their rank among the task's rows of that kind and size."""
    own, met = TaskContext.get().partitionId(), {}
    for b in batches:
        out = []
        for kind, i, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            k = met[kind, n] = met.get((kind, n), -1) + 1
            out.append((kind, i, n, None, None, own, k))
        yield from _rows(out)


def match_by_rank(pieces_: dict[int, int], gaps_: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]], dict[int, int]]:
    """Best fit of counts by size: runs of pieces, runs of gaps, sequences opened by size.

    Rows of one size are alike, so a rank says which row is meant. Sizes are swept from the
    largest down; each takes the smallest gaps that hold it, as many pieces a gap as fit, gaps
    are updated by whole runs and the sweep repeats until nothing is left. A run of pieces is
    (size, first rank, n, pieces a sequence, first sequence, place there), one of gaps (size,
    first rank, n, first sequence). Sequences are numbers from 0, gaps' first.
    """
    gaps, told, opened, number = Gaps(), [], {}, 0
    runs_of_gaps = []
    for g, n in sorted(gaps_.items()):
        runs_of_gaps.append((g, 0, n, number))
        gaps.push(g, (number, n))
        number += n
    for s in sorted(pieces_, reverse=True):
        rank, left = 0, pieces_[s]
        while left:
            g = gaps.successor(s)
            if g:
                seq, m = gaps.pop(g)
            else:
                g, seq, m = capacity, number, max(1, left // (capacity // s))
                number += m
                opened[s] = opened.get(s, 0) + m
            per = g // s
            used = min(m, left // per)
            if used:
                told.append((s, rank, used * per, per, seq, capacity - g))
                gaps.push(g - per * s, (seq, used))
            else:  # fewer pieces than one gap holds
                per, used = left, 1
                told.append((s, rank, left, left, seq, capacity - g))
                gaps.push(g - left * s, (seq, 1))
            rank, left = rank + used * per, left - used * per
            if used < m:
                gaps.push(g, (seq + used, m - used))
    return told, runs_of_gaps, opened


def _looked_up(told: list[tuple[int, ...]], runs_of_gaps: list[tuple[int, ...]]):
    """Rows with their rank within (what, size) to the sequence's number and the place there."""
    runs = sorted([(PIECE, *r) for r in told] + [(GAP, g, first, n, 1, seq, 0) for g, first, n, seq in runs_of_gaps])
    what, size, first, _, per, seq, at = (np.array(c, np.int64) for c in zip(*runs, strict=True))
    mark = lambda w, n, r: w << 60 | n << 44 | r
    starts = mark(what, size, first)

    def look(batches):
        for b in batches:
            w, i, n, r = (b.column(c).to_numpy().astype(np.int64) for c in ("what", "id", "size", "rank"))
            run = np.searchsorted(starts, mark(w, n, r), "right") - 1
            step = r - first[run]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(i), pa.array(seq[run] + step // per[run]), pa.array(at[run] + step % per[run] * n, pa.int32())], names=["what", "id", "number", "at"])

    return look


def _counts(rows: DataFrame) -> dict[int, dict[int, int]]:
    """Rows by what and size: at most two times ``capacity`` numbers."""
    out: dict[int, dict[int, int]] = {PIECE: {}, GAP: {}}
    for r in rows.groupBy("what", "size").agg(F.sum("n").alias("n")).collect():
        out[r["what"]][r["size"]] = r["n"]
    return out


def place(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, supersteps: int = SUPERSTEPS) -> DataFrame:
    """Sequences for ``items`` (id, length): rows id, seq, at for all that joined a sequence.

    An item without a row here opened the sequence that bears its id; sequences opened by
    counts have numbers below 0.
    """
    state = items.filter((F.col("length") < capacity) & (F.col("length") > 0)).select(F.lit(PIECE).alias("what"), "id", F.col("length").cast("int").alias("size"))
    sizes = _counts(state.withColumn("n", F.lit(1)))[PIECE]
    if not sizes:
        return items.select("id", F.col("id").alias("seq"), F.lit(0).alias("at")).limit(0)
    # the largest pieces open a sequence: all over half the capacity, and nearly as many as the total needs
    need, count_ = sum(s * n for s, n in sizes.items()) // capacity, sum(sizes.values())
    need -= need // 100
    least, share = capacity, 1.0
    for size in sorted(sizes, reverse=True):
        if 2 * size <= capacity and need <= 0:
            break
        least, share = size, 1.0 if 2 * size > capacity else min(1.0, need / sizes[size])
        need -= sizes[size]
    some = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))
    opens = (F.col("size") > least) | ((F.col("size") == least) & some)
    state = state.select(F.when(opens, GAP).otherwise(PIECE).alias("what"), "id", F.when(opens, capacity - F.col("size")).otherwise(F.col("size")).alias("size"))
    ranges, done = max(1, -(-count_ // range_rows)), None
    for k in range(supersteps):
        placed, state = superstep(state, scratch, capacity, ranges, str(k))
        done = placed if done is None else done.union(placed)
    # written first, else a task has a second Python worker for the numbers, and both stay for the session
    left = scratch.write(scratch.write(state, "unranked").mapInArrow(frugal(_ranked), SWEPT), "left")
    counts = left.groupBy("what", "size", "range").agg(F.count(F.lit(1)).alias("n"))
    totals = _counts(counts)
    if not totals[PIECE]:
        return done
    # ranks across tasks: rows of a size before a task's
    before = counts.select("what", "size", "range", (F.sum("n").over(W.partitionBy("what", "size").orderBy("range")) - F.col("n")).alias("before"))
    ranked = left.join(before, ["what", "size", "range"]).select("what", "id", "size", (F.col("rank") + F.col("before")).alias("rank"))
    told, runs_of_gaps, _ = match_by_rank(totals[PIECE], totals[GAP], capacity)
    met = scratch.write(ranked.mapInArrow(frugal(_looked_up(told, runs_of_gaps)), "what int, id long, number long, at int"), "met")
    old = sum(totals[GAP].values())
    joined = met.filter((F.col("what") == PIECE) & (F.col("number") < old)).join(met.filter(F.col("what") == GAP).select("number", F.col("id").alias("seq")), "number").select("id", "seq", "at")
    new = met.filter(F.col("number") >= old).select("id", (old - 1 - F.col("number")).alias("seq"), "at")
    last = joined.union(new)
    return last if done is None else done.union(last)


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: the key, piece, start, length, ids_crc32, sequence_id and offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, path, [key], text, capacity)
    # ids are fixed by the write, so a lost task can't change them later
    items = scratch.write(cut.withColumn("id", F.monotonically_increasing_id()), "pieces")
    met = place(items.select("id", "length"), scratch, capacity)
    return items.join(met, "id", "left").select(quoted(key), "piece", "start", "length", "ids_crc32", F.coalesce("seq", "id").alias("sequence_id"), F.coalesce(F.col("at").cast("long"), F.lit(0)).cast("long").alias("offset"))
