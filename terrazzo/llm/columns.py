"""Row-wise Arrow operators: helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def quoted(name: str) -> Column:
    """The column of this very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows and bytes of an Arrow batch: texts of a batch are held at once, by Spark and by a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to send rows to Python in small batches.

    The two settings stay in the session: they bound memory and change no result.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


#: Batches after which a task gives back what it has freed.
GIVEN_BACK = 4


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker outlives its tasks, and its allocators keep what any of them used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def frugal(run: Callable) -> Callable:
    """``run`` over Arrow batches, giving freed memory back every few batches and at the end."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(run(batches), 1):
            yield b
            del b
            if k % GIVEN_BACK == 0:
                give_back()
        give_back()

    return own


def frugal_group(run: Callable) -> Callable:
    """``run`` over a group's table, giving freed memory back after each."""

    def own(table: pa.Table) -> pa.Table:
        out = run(table)
        del table
        give_back()
        return out

    return own


def annotate(
    df: DataFrame,
    fn: Callable[..., list],
    args: list[str | Column],
    fields: T.StructType,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``fields``, which ``fn`` computes from ``args`` one Arrow batch at a time.

    The kept columns (all by default) travel in one struct, so no name can clash inside; a
    kept column named like an output is replaced by it. No shuffle.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    row = F.struct(*[quoted(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    src = bounded_batches(df).select(row.alias("r"), *[(quoted(a) if isinstance(a, str) else a).alias(f"a{i}") for i, a in enumerate(args)])
    schema = T.StructType([T.StructField("r", src.schema["r"].dataType), *fields.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(*[b.column(i) for i in range(1, b.num_columns)])
            cols = [pa.array(x, type=f.type, from_pandas=True) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(out, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=arrow.names)

    out = src.mapInArrow(frugal(run), schema)
    return out.select(*[F.col("r").getField(c).alias(c) for c in kept], *fields.names)


def blobs(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive runs of rows of at most ``most`` bytes together (one row at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes after one another, and the n + 1 offsets of the rows."""
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in rows], out=ends[1:])
    return np.frombuffer(b"".join(rows), np.uint8), ends


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls in no bucket (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
