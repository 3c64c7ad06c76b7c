"""Phrases that recur, mined from vertical positional inverted lists.

Texts are read in blocks of some two million words. A block keeps, for each of its words, the
sorted list of the positions where it occurs (pieces of text leave a gap, so what isn't side
by side has no adjacent positions). A list is as long as the word is frequent; the blocks'
lengths are added up, and words that are rare in the whole corpus are left out. Frequent
phrases are then extended word by word: in each block the positions of the frequent phrases of
k - 1 words are merge-joined with the adjacent ones, which gives the lists of the phrases of k
words; their lengths are added up over blocks, and so on. A phrase is only looked at where both
its parts are frequent.

Lengths meet by bucket: a block sends its words or phrases, hashed into buckets, as sorted
arrays; a bucket adds them up and answers every block with the numbers of the frequent ones.
Buckets grow in number with the corpus, not in size, and a block asks once a phrase, however
often it occurs there, so no key is hot. Lists, questions and answers are tables in the shared
folder; the driver sees totals only.

Defined cases: a null or empty text has no words; a null language is ``und``; null ids and
repeated rows count as texts of their own; a text of any length is read whole (blocks may part
it between pieces, across which no phrase runs); columns beside text and language are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import bounded_batches, quoted
from .scratch import Scratch

LONGEST, LEAST, COVER_PERCENT, TOP = 3, 10, 50, 2000
BLOCK_WORDS, BUCKET_BYTES, BUCKET_KEYS = 1 << 21, 1 << 25, 1 << 20
_SPACED = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_PIECE = re.compile(rb"[^\n]+")


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


class Block:
    """Words of consecutive texts, as they come."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids = array("i")
        number = count()
        self.words: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))

    def read(self, text: str | None, lang: str) -> Iterator[None]:
        """Add a text; yields whenever the block is full, to be cleared."""
        text = (text or "").encode().lower().translate(_SPACED)
        for piece in text.split(b"\n") if len(text) < 1 << 20 else (m[0] for m in _PIECE.finditer(text)):
            own = piece.split()
            if own:
                self.ids.extend(map(self.words[lang].__getitem__, own))
                self.ids.append(-1)
                if len(self.ids) >= BLOCK_WORDS:
                    yield

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        """The block's lists, and its questions by language and bucket: words in order and how often each occurs."""
        parts, old = [], []
        for lang, own in sorted(self.words.items()):
            dealt = defaultdict(list)
            for w in own:
                dealt[zlib.crc32(w) % buckets].append(w)
            for bucket in sorted(dealt):
                parts.append((lang, bucket, dealt[bucket]))
                old += [own[w] for w in dealt[bucket]]
        new = np.zeros(len(old) + 1, np.int32)
        new[np.array(old, np.int64)] = np.arange(len(old), dtype=np.int32)
        new[-1] = -1
        word = new[np.frombuffer(self.ids, np.int32)]
        at = np.argsort(word, kind="stable").astype(np.int32)
        lengths = np.bincount(word[word >= 0], minlength=len(old)).astype(np.int32)
        at = at[len(word) - lengths.sum() :]
        yield ("list", block, 0, None, None, _pack(_steps(at)), _pack(lengths))
        first = 0
        for part, (lang, bucket, words) in enumerate(parts):
            yield ("ask", block, part, bucket, lang, zstandard.ZstdCompressor(level=1).compress(b"\n".join(words)), _pack(lengths[first : first + len(words)]))
            first += len(words)


_LISTS = "kind string, block long, part int, bucket long, lang string, data binary, lengths binary"
_ANSWERS = "kind string, block long, part int, data binary, id long, lang string, word string, a long, b long, f long"


def _batch(schema: str, columns: dict[str, list | np.ndarray], rows: int) -> pa.RecordBatch:
    """A batch with nulls for the columns left out."""
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types[t]) if n in columns else pa.nulls(rows, types[t]) for n, t in named], names=[n for n, _ in named])


def _lists(buckets: int):
    """Texts (text, lang) to lists and questions, a block at a time."""

    def run(batches):
        task, numbers, held = TaskContext.get().partitionId(), count(), Block()

        def flush():
            for row in held.rows(task << 36 | next(numbers), buckets):
                yield _batch(_LISTS, {f.split()[0]: [x] for f, x in zip(_LISTS.split(", "), row, strict=True)}, 1)
            held.clear()

        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for _ in held.read(t.as_py(), lang):
                    yield from flush()
        if held.ids:
            yield from flush()

    return run


def _by_bucket(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by bucket to (bucket, its rows without the bucket)."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for bucket, own in groupby(rows, key=lambda r: r[0]):
        yield bucket, [r[1:] for r in own]


def _frequent_words(buckets: int, least: int):
    """Questions (bucket, block, part, lang, data, lengths) to answers, the frequent words and the languages' totals."""

    def run(batches):
        for bucket, rows in _by_bucket(batches):
            totals: dict[str, dict[bytes, int]] = {}
            for _, _, lang, data, lengths in rows:
                own = totals.setdefault(lang, {})
                for w, n in zip(zstandard.ZstdDecompressor().decompress(data).split(b"\n"), _unpack(lengths, np.int32).tolist(), strict=True):
                    own[w] = own.get(w, 0) + n
            yield _batch(_ANSWERS, {"kind": ["total"] * len(totals), "lang": list(totals), "f": [sum(x.values()) for x in totals.values()]}, len(totals))
            kept = [(lang, w, n) for lang, own in totals.items() for w, n in own.items() if n >= least]
            number = {(lang, w): bucket + buckets * k for k, (lang, w, _) in enumerate(kept)}
            for at in range(0, len(kept), 50_000):
                langs, words, n = zip(*kept[at : at + 50_000], strict=True)
                yield _batch(_ANSWERS, {"kind": ["phrase"] * len(n), "id": [number[x] for x in zip(langs, words, strict=True)], "lang": langs, "word": [w.decode() for w in words], "f": n}, len(n))
            for block, part, lang, data, _ in rows:
                found = np.array([number.get((lang, w), -1) for w in zstandard.ZstdDecompressor().decompress(data).split(b"\n")], np.int64)
                yield _batch(_ANSWERS, {"kind": ["answer"], "block": [block], "part": [part], "data": [_pack(found)]}, 1)

    return run


def _frequent_phrases(buckets: int, least: int):
    """Questions (bucket, block, part, a, b, lengths) to answers and the frequent phrases."""

    def run(batches):
        for bucket, rows in _by_bucket(batches):
            a, b = (np.concatenate([np.cumsum(_unpack(r[k], np.int64)) for r in rows]) for k in (2, 3))
            n = np.concatenate([_unpack(r[4], np.int32) for r in rows]).astype(np.int64)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            total = np.add.reduceat(n[order], first)
            number = np.full(len(first), -1)
            kept = np.flatnonzero(total >= least)
            number[kept] = bucket + buckets * np.arange(len(kept))
            for at in range(0, len(kept), 50_000):
                some = kept[at : at + 50_000]
                yield _batch(_ANSWERS, {"kind": ["phrase"] * len(some), "id": number[some], "a": a[first[some]], "b": b[first[some]], "f": total[some]}, len(some))
            found = np.empty(len(a), np.int64)
            found[order] = np.repeat(number, np.diff(np.append(first, len(a))))
            at = 0
            for block, part, _, _, lengths in rows:
                own = found[at : at + len(_unpack(lengths, np.int32))]
                at += len(own)
                yield _batch(_ANSWERS, {"kind": ["answer"], "block": [block], "part": [part], "data": [_pack(own)]}, 1)

    return run


def _adjacent(at: np.ndarray, phrase: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a block's phrase lists with the adjacent ones.

    ``at`` holds the positions of all phrases in order, ``phrase`` which one occurs there.
    Returns the positions of the longer phrases, which one each is, the numbers of their two
    parts and the lengths of their lists.
    """
    met = np.flatnonzero(at[1:] == at[:-1] + 1)
    own, which, lengths = np.unique(phrase[met].astype(np.int64) * len(number) + phrase[met + 1], return_inverse=True, return_counts=True)
    return at[met], which, number[own // len(number)], number[own % len(number)], lengths


def _dealt(a: np.ndarray, b: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of phrases, and the order in which they are asked for."""
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.lexsort((b, a, bucket))


def _extended(level: int, buckets: list[int]):
    """A block's lists and answers (block, level, part, data, lengths), sorted, to questions about phrases of ``level`` words."""

    def run(batches):
        for block, rows in _by_bucket(batches):
            lists = next(r for r in rows if r[0] == 0)
            lengths = _unpack(lists[3], np.int32)
            at = np.cumsum(_unpack(lists[2], np.int32), dtype=np.int32)
            answers = [np.concatenate([_unpack(r[2], np.int64) for r in rows if r[0] == k]) if any(r[0] == k for r in rows) else np.zeros(0, np.int64) for k in range(1, level)]
            number, phrase = answers[0], np.repeat(np.arange(len(lengths)), lengths)
            order = np.argsort(at)
            at, phrase = at[order], phrase[order]
            for k in range(2, level + 1):
                frequent = number[phrase] >= 0
                at, phrase, a, b, lengths = _adjacent(at[frequent], phrase[frequent], number)
                bucket, order = _dealt(a, b, buckets[k - 2])
                if k < level:
                    number = np.full(len(a), -1)
                    number[order] = answers[k - 1]
            a, b, lengths, bucket = a[order], b[order], lengths[order].astype(np.int32), bucket[order]
            ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(a) else []
            for part, (i, j) in enumerate(pairwise([0, *ends])):
                yield _batch(_ASKS, {"bucket": [int(bucket[i])], "block": [block], "part": [part], "a": [_pack(_steps(a[i:j]))], "b": [_pack(_steps(b[i:j]))], "lengths": [_pack(lengths[i:j])]}, 1)

    return run


_ASKS = "bucket long, block long, part int, a binary, b binary, lengths binary"


def _write_kinds(df: DataFrame, scratch: Scratch, name: str):
    """Write by kind; returns a reader of one kind."""
    df.write.mode("overwrite").partitionBy("kind").parquet(f"{scratch.folder}/{name}")
    return lambda kind: scratch.spark.read.schema(df.schema).parquet(f"{scratch.folder}/{name}").filter(F.col("kind") == kind)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """Words by language (lang, n), and the frequent phrases of 1 to ``longest`` words: one table a length.

    Columns: id, lang, words, f (exact frequency), ``before`` and ``after`` (frequencies of the
    shorter phrases that it begins and ends with, by length), and from two words on a and b (its
    two parts of one word less).
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    rows = bounded_batches(docs).select(quoted(text).alias("text"), F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = max(1, -(-size // BUCKET_BYTES))
    lists = _write_kinds(rows.mapInArrow(_lists(words), _LISTS), scratch, "lists")
    asked = lists("ask").select("bucket", "block", "part", "lang", "data", "lengths")
    answers = [_write_kinds(asked.repartition("bucket").sortWithinPartitions("bucket", "block", "part").mapInArrow(_frequent_words(words, least), _ANSWERS), scratch, "answers1")]
    totals = scratch.write(answers[0]("total").groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    buckets = [max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_KEYS))] * (longest - 1)
    none = F.array().cast("array<long>")
    out = [answers[0]("phrase").select("id", "lang", F.array("word").alias("words"), "f", none.alias("before"), none.alias("after"))]
    for level in range(2, longest + 1):
        told = lists("list").select("block", F.lit(0).alias("level"), "part", "data", "lengths")
        for k, own in enumerate(answers):
            told = told.union(own("answer").select("block", F.lit(k + 1), "part", "data", F.lit(None).cast("binary")))
        asked = told.repartition("block").sortWithinPartitions("block", "level", "part").mapInArrow(_extended(level, buckets), _ASKS)
        found = asked.repartition("bucket").sortWithinPartitions("bucket", "block", "part").mapInArrow(_frequent_phrases(buckets[level - 2], least), _ANSWERS)
        answers.append(_write_kinds(found, scratch, f"answers{level}"))
        first = out[-1].select(F.col("id").alias("a"), "lang", "words", F.concat("before", F.array("f")).alias("before"))
        last = out[-1].select(F.col("id").alias("b"), F.element_at("words", -1).alias("word"), F.concat("after", F.array("f")).alias("after"))
        whole = answers[-1]("phrase").select("id", "a", "b", "f").join(first, "a").join(last, "b")
        out.append(scratch.write(whole.select("id", "lang", F.concat("words", F.array("word")).alias("words"), "f", "before", "after", "a", "b"), f"phrases{level}"))
    return totals, out


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits, for counts below 10 ** 16."""
    exact = lambda x: x.cast("decimal(16,0)")
    return F.call_function("div", exact(a) * exact(a) * F.lit(1_000_000).cast("decimal(7,0)"), exact(l) * exact(r))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases by the score of their weakest cut.

    A cut after the first k words scores floor(1000000 * a * a / (l * r)), in exact decimals;
    the least counts, ties to the smallest k. Phrases inside a longer one that occurs at least
    ``cover_percent`` per cent as often are left out. (A longer phrase that covers one also has
    a part one word longer that does, so one length more is enough to look at.)
    Returns lang, rank, phrase, a, l, r, n, score.
    """
    totals, tables = phrases(docs, text, lang, longest, least)
    found = None
    for k in range(2, longest + 1):
        own = tables[k - 1]
        if k < longest:
            parts = tables[k].select(F.col("a").alias("id"), "f").union(tables[k].select("b", "f"))
            own = own.join(parts.groupBy("id").agg(F.max("f").alias("cover")), "id", "left").filter(~F.coalesce(100 * F.col("cover") >= cover_percent * F.col("f"), F.lit(False)))
        cuts = []
        for j in range(1, k):
            l, r = F.element_at("before", j), F.element_at("after", k - j)  # noqa: E741
            cuts.append(F.struct(score(F.col("f"), l, r).alias("score"), F.lit(j).alias("k"), l.alias("l"), r.alias("r")))
        own = own.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut"))
        found = own if found is None else found.union(own)
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each share of a language, then the first of those
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows from DuckDB.
ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^ \t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL)
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, c.w, j, l.f AS l, r.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN grams l ON l.lang = c.lang AND l.k = c.j AND l.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN grams r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = array_to_string(c.w[c.j + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(f) AS f FROM (SELECT *, unnest([1, 2]) AS i FROM cand WHERE k = 3) GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON b.k = 2 AND i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
