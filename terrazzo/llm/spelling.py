"""Spelling variants: words one edit apart, found by forward and backward automata.

The words of a corpus, as they stand and reversed, are parted into ranges of sorted order. For
each range a task builds a minimal acyclic automaton whose states know how many words they
lead to, so that a walk sums up to the word's number (a perfect hash). A word with at most one
error keeps one half: so its first half is walked exactly in the forward automata, and its
second half, reversed, in the backward ones; the other half is completed with one inserted,
deleted or replaced letter. A word is asked for in every range that can hold its exact half.
What the forward search finds as well is left out of the backward one, so each pair is found
once. Only counts and the best neighbour of each word leave the task, and the forms are
followed to their roots by pointer jumping over written tables.

Words hold letters up to U+00FF; inside they are Latin-1 bytes, whose order is that of code
points. Every range holds about ``RANGE_WORDS`` words. The driver sees a sample of words for
the splitters, ``SAMPLED`` a range, and no others. A word goes to several ranges only if its
exact half (3 letters or more) begins more words than a range holds.

Defined cases: a null text has no words; a null key leaves its runs as they are (nothing is
dropped from them); repeated rows count again; other columns are not read; texts of any length
are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, quoted
from .scratch import Scratch

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_ONE_IN = 6, 5, 5, 199
RANGE_WORDS, SAMPLED = 20_000, 40
HELD_WORDS = 300_000


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH, drop_one_in: int | None = DROP_ONE_IN) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased; a run whose hash with the key is a multiple of ``drop_one_in`` loses a letter."""
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)

    def dropped(run: bytes, start: int) -> bytes:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % drop_one_in:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    def run(batches):
        held: dict[bytes, int] = {}

        def flush():
            whole = pa.table({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            yield from whole.to_batches(max_chunksize=50_000)

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = runs.finditer((t.as_py() or "").encode("latin-1", "replace").lower())
                own: Counter[bytes] = Counter()
                while some := [m[0] for m in islice(found, 100_000)]:
                    own.update(some)
                start = None if k is None or not drop_one_in else zlib.crc32(f"{k}:".encode())
                for w, n in own.items():
                    if start is not None:
                        w = dropped(w, start)
                        if len(w) < least_length:
                            continue
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    rows = bounded_batches(docs).select(quoted(key).cast("string").alias("key"), quoted(text).alias("text"))
    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """A minimal acyclic automaton over sorted words; a walk gives the word's number."""

    def __init__(self, words: list[bytes]) -> None:
        self.arcs: list[dict[int, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        # the states of the last word that are still open: whether final, and arcs so far
        path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]

        def close(final: bool, arcs: list[tuple[int, int]]) -> int:
            mark = (final, *arcs)
            state = known.get(mark)
            if state is None:
                state = known[mark] = len(self.arcs)
                skip, own = int(final), {}
                for c, t in arcs:
                    own[c] = (t, skip)
                    skip += self.count[t]
                self.arcs.append(own)
                self.final.append(final)
                self.count.append(skip)
            return state

        last = b""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            for at in range(len(last), same, -1):
                path[at - 1][1].append((last[at - 1], close(*path.pop())))
            path += [(k == len(w), []) for k in range(same + 1, len(w) + 1)]
            last = w
        for at in range(len(last), 0, -1):
            path[at - 1][1].append((last[at - 1], close(*path.pop())))
        self.start = close(*path.pop())

    def number(self, word: bytes, state: int | None = None, number: int = 0) -> int | None:
        """Words before this one, or None if it is unknown."""
        state = self.start if state is None else state
        arcs = self.arcs
        for c in word:
            arc = arcs[state].get(c)
            if arc is None:
                return None
            state, number = arc[0], number + arc[1]
        return number if self.final[state] else None

    def one_error(self, word: bytes, exact: int) -> set[int]:
        """Numbers of the words with the same first ``exact`` letters and one edit after them."""
        state, number, arcs, found = self.start, 0, self.arcs, set()
        for c in word[:exact]:
            arc = arcs[state].get(c)
            if arc is None:
                return found
            state, number = arc[0], number + arc[1]
        walk = self.number
        for at in range(exact, len(word) + 1):
            rest = word[at:]
            for c, (to, skip) in arcs[state].items():
                found.add(walk(rest, to, number + skip))  # a letter more
                if rest and c != rest[0]:
                    found.add(walk(rest[1:], to, number + skip))  # another letter
            if rest:
                found.add(walk(rest[1:], state, number))  # a letter less
                arc = arcs[state].get(rest[0])
                if arc is None:
                    break
                state, number = arc[0], number + arc[1]
        found.discard(None)
        return found


def _after(prefix: bytes) -> bytes | None:
    """The least string above all that begin with ``prefix``."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def _dealt(splitters: tuple[list[bytes], list[bytes]]):
    """Words to their range in both orders, and to the ranges that may hold their exact half."""

    def run(batches):
        for b in batches:
            out = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                half = len(w) // 2
                for way, (x, exact) in enumerate(((w, half), (w[::-1], len(w) - half))):
                    own = splitters[way]
                    out.append((2 * bisect_right(own, x) + way, False, x, n, 0))
                    above = _after(x[:exact])
                    last = len(own) if above is None else bisect_left(own, above)
                    out += [(2 * r + way, True, x, n, exact) for r in range(bisect_right(own, x[:exact]), last + 1)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32()]
            yield from pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["range", "asks", "word", "n", "exact"]).to_batches(max_chunksize=50_000)

    return run


def _search(batches):
    """Sorted rows of ranges, words before questions, to each question's count and best answer there."""
    at, words, counts, automaton = None, [], [], None
    for b in batches:
        out = []
        for own, asks, w, n, exact in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if own != at:
                at, words, counts, automaton = own, [], [], None
            if not asks:
                words.append(w)
                counts.append(n)
                continue
            if automaton is None:
                automaton = Automaton(words)
            found = automaton.one_error(w, exact)
            backward = own % 2
            if backward:
                # a pair that keeps the first half too is found forward
                kept = w[exact:]
                found = [k for k in found if not words[k].endswith(kept)]
            best, form = max(((counts[k], words[k]) for k in found), key=lambda x: x[0], default=(None, None))
            if best is not None:
                form = min(words[k][::-1] if backward else words[k] for k in found if counts[k] == best)
            out.append((w[::-1] if backward else w, n, len(found), best, form))
        if out:
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["word", "n", "n_near", "form_n", "form"])


def _splitters(words: DataFrame, ranges: int, total: int) -> tuple[list[bytes], list[bytes]]:
    """Splitters of the words and of the reversed words, from a sample by hash of ``SAMPLED`` words a range."""
    if ranges < 2:
        return [], []
    share = min(1 << 30, int((1 << 30) * SAMPLED * ranges / total) + 1)
    sample = [bytes(r[0]) for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share).select("word").collect()]
    out = []
    for own in (sorted(sample), sorted(w[::-1] for w in sample)):
        out.append(sorted({own[len(own) * k // ranges] for k in range(1, ranges)}) if own else [])
    return out[0], out[1]


def near_words(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """(word, n) to (word, n, n_near, form_n, form): the words one edit away, and the most frequent of them (ties: the least).

    ``words`` must be a written table of distinct words, as Latin-1 bytes.
    """
    total = words.count()
    splitters = _splitters(words, -(-total // range_words), total)
    dealt = words.select("word", "n").mapInArrow(_dealt(splitters), "range long, asks boolean, word binary, n long, exact int")
    found = dealt.repartition("range").sortWithinPartitions("range", "asks", "word").mapInArrow(_search, "word binary, n long, n_near long, form_n long, form binary")
    best = F.min(F.when(F.col("form_n").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def _rooted(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for words with a form, by pointer jumping: chains halve each round, and are short as counts grow along them."""
    now, k = scratch.write(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        k += 1
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = scratch.write(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots{k}")
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def group_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, drop_one_in: int | None = DROP_ONE_IN, range_words: int = RANGE_WORDS) -> DataFrame:
    """Words of the corpus with the form that each is a variant of, and that chain's root.

    A word's form is its most frequent neighbour, if that occurs ``ratio`` times as often.
    Returns word, form, root (strings), n, n_near and form_n (null without a form).
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(count_words(docs, text, key, least_length, drop_one_in).filter(F.col("n") >= least_count), "words")
    near = scratch.write(near_words(words, range_words), "near")
    is_form = F.col("form_n") >= ratio * F.col("n")
    near = near.select("word", "n", "n_near", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    whole = near.join(_rooted(near.filter("form is not null"), scratch), "word", "left")
    said = lambda c: F.decode(c, "ISO-8859-1")
    return whole.select(said(F.col("word")).alias("word"), said(F.col("form")).alias("form"), said(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
