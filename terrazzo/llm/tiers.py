"""Hierarchical packing of token sequences into windows of several lengths.

Documents are routed to tiers of context sizes (2048, 1024, 512 and 256 tokens): what is over
the largest window is cut into whole windows, and the rest goes to the smallest window that
holds it. Tiers are packed from the longest down. A piece opens a window of its tier; its gap
takes the largest pieces of shorter tiers that fit, and where none fits, the start of the
shortest piece left, whose rest goes back to the tier of its new length. So every window is
full, and a window is cut at most once. What a block of documents leaves over at its end, less
than one window, is cut at powers of two. Sequences are then dealt to step groups of about
``step_tokens`` tokens each: tiers from the longest down, always to the groups with the fewest
tokens, so groups end up with like totals and like shares of each tier.

Tokens never leave the task that made them: a block of some four million tokens is packed
where it was read, with no shuffle. Dealing takes counts by task and tier, a running sum over
tasks (a row a task) and a few dozen runs of ranks, whatever the size of the corpus.

Defined cases: a null or empty text is the closing id alone; null ids and repeated rows are
documents of their own; other columns are not read, so their names can't clash; a text of any
length is packed whole (its ids are held by one task); an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .columns import bounded_batches, quoted
from .scratch import Scratch

TIERS = (2048, 1024, 512, 256)
END = 1
STEP_TOKENS = 1 << 17
BLOCK_TOKENS = 1 << 22


class ByteTokens:
    """Ids of a byte-level BPE vocabulary, whose ids are the ranks of its merges.

    Texts are encoded by the same ranks with a faster library; those that hold the text of a
    special token go to the tokenizer of the file itself, which gives it its own id.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a vocabulary writes bytes as letters: printable ones as they are, others from 256 up
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in x): i for x, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.ranks = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids and the closing id."""
        text = text or ""
        if any(s in text for s in self.special):
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            found = self.ranks.encode_to_numpy(text, disallowed_special=())
        return np.append(found, np.uint32(END)).astype("<u4")


@cache
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


class Stock:
    """Pieces (document, start) by size, and a mask of the sizes that have any."""

    def __init__(self) -> None:
        self.stacks: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def put(self, size: int, piece: tuple[int, int]) -> None:
        if size:
            self.stacks.setdefault(size, []).append(piece)
            self.mask |= 1 << size

    def take(self, size: int) -> tuple[int, int]:
        own = self.stacks[size]
        piece = own.pop()
        if not own:
            self.mask &= ~(1 << size)
        return piece

    def most(self, at_most: int) -> int:
        """The largest size up to ``at_most``, or 0."""
        return max(0, (self.mask & ((2 << at_most) - 1)).bit_length() - 1)

    def least(self) -> int:
        """The smallest size, or 0."""
        return max(0, (self.mask & -self.mask).bit_length() - 1)


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length), each as long as a tier; the last few as long as powers of two."""
    top, stock, out = tiers[0], Stock(), []
    for d, n in enumerate(lengths):
        whole = n - n % top
        out += [[(d, s, top)] for s in range(0, whole, top)]
        stock.put(n - whole, (d, whole))
    for k, window in enumerate(tiers):
        shorter = tiers[k + 1] if k + 1 < len(tiers) else 0
        while (size := stock.most(window)) > shorter:
            own, gap = [(*stock.take(size), size)], window - size
            while gap and stock.mask:
                size = stock.most(gap)
                if size:
                    own.append((*stock.take(size), size))
                else:
                    # nothing fits: the start of the shortest piece does
                    size = stock.least()
                    d, start = stock.take(size)
                    own.append((d, start, gap))
                    stock.put(size - gap, (d, start + gap))
                    size = gap
                gap -= size
            out += _powers(own, window - gap) if gap else [own]
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces, cut into sequences as long as the powers of two that make up their total."""
    out, rest = [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        room, own = total & 1 << bit, []
        while room:
            d, start, n = rest.pop()
            used = min(n, room)
            own.append((d, start, used))
            if used < n:
                rest.append((d, start + used, n - used))
            room -= used
        if own:
            out.append(own)
    return out


_PLACE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.IntegerType()), ("task", T.IntegerType()), ("rank", T.LongType())]


def packed(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (its sequence's length), and the sequence's rank in its tier within the task."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(n, t) for n, t in _PLACE]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        task, tokens = TaskContext.get().partitionId(), byte_tokens(path)
        sequence, ranks, keys, ids, held = task << 36, {}, [], [], 0

        def block():
            nonlocal sequence
            rows = []
            for own in pack_block([len(x) for x in ids], tiers):
                tier, offset = sum(p[2] for p in own), 0
                rank = ranks[tier] = ranks.get(tier, -1) + 1
                for d, start, n in own:
                    rows.append((d, start, n, zlib.crc32(ids[d][start : start + n]), len(ids[d]), sequence, offset, tier, task, rank))
                    offset += n
                sequence += 1
            d, *rest = zip(*rows, strict=True)
            columns = [pa.array(x, t) for x, t in zip(rest, arrow.types[1:], strict=True)]
            yield from pa.Table.from_arrays([pa.concat_arrays(keys).take(pa.array(d)), *columns], schema=arrow).to_batches(max_chunksize=50_000)

        for b in batches:
            first = 0
            for i, t in enumerate(b.column(1)):
                ids.append(tokens.ids(t.as_py()))
                held += len(ids[-1])
                if held >= block_tokens:
                    keys.append(b.column(0).slice(first, i + 1 - first).cast(arrow.types[0]))
                    yield from block()
                    keys, ids, held, first = [], [], 0, i + 1
            keys.append(b.column(0).slice(first).cast(arrow.types[0]))
        if ids:
            yield from block()

    return bounded_batches(docs).select(quoted(key).alias("key"), quoted(text).alias("text")).mapInArrow(run, schema)


def deal(counts: dict[int, int], groups: int) -> list[tuple[int, int, int, int, int]]:
    """Sequences of each tier dealt to groups: runs (tier, first rank, sequences a group, first group, groups).

    From the longest tier down, sequences go to the groups with the fewest tokens. Groups with
    equal tokens are one class, so the work depends on classes, not on groups.
    """
    classes, out = [(0, 0, groups)], []  # tokens, first group, groups
    for tier in sorted(counts, reverse=True):
        rank, left = 0, counts[tier]
        while left:
            classes.sort()
            tokens, first, n = classes.pop(0)
            each = max(1, (classes[0][0] - tokens) // tier) if classes else left // n
            if each * n > left or not each:
                each = left // n
            if each:
                out.append((tier, rank, each, first, n))
                classes.append((tokens + each * tier, first, n))
            else:  # fewer sequences than groups
                n, rest, each = left, n - left, 1
                out.append((tier, rank, 1, first, n))
                classes += [(tokens + tier, first, n), (tokens, first + n, rest)]
            rank, left = rank + each * n, left - each * n
    return out


def step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``pieces`` with ``step_group``: groups of sequences with about ``step_tokens`` tokens each.

    ``pieces`` must be a written table: it is read for its counts, then for its rows.
    """
    counts = pieces.filter(F.col("offset") == 0).groupBy("tier", "task").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("tier").orderBy("task")) - F.col("n")).drop("n")
    totals = {r["tier"]: r["n"] for r in counts.groupBy("tier").agg(F.sum("n").alias("n")).collect()}
    groups = max(1, round(sum(t * n for t, n in totals.items()) / step_tokens))
    runs = pieces.sparkSession.createDataFrame(deal(totals, groups), "run_tier int, first_rank long, each long, first_group long, n_groups long")
    whole = pieces.join(before, ["tier", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    step: Column = F.col("rank") - F.col("first_rank")
    near = (F.col("tier") == F.col("run_tier")) & step.between(0, F.col("each") * F.col("n_groups") - 1)
    # at most a few dozen runs
    return whole.join(F.broadcast(runs), near).withColumn("step_group", F.col("first_group") + F.floor(step / F.col("each")).cast("long")).drop("run_tier", "first_rank", "each", "first_group", "n_groups", "before")


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Per piece: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and step_group."""
    pieces = Scratch(docs.sparkSession, "tiers").write(packed(docs, path, text, key, tiers), "pieces")
    return step_groups(pieces, step_tokens).select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
