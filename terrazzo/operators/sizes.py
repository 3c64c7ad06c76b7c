"""When a side of a join may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_table

#: Bytes up to which a table is broadcast, by Catalyst's own estimate of its size.
LIMIT = 64 << 20
#: Rows up to which a table is broadcast, where they are counted.
ROWS = 200_000


def small(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is bounded; else as it is (a shuffle join)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def by_key(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``df``, a row a key, as ``small``; if it is not, each partition's rows make a hash table, so a longer other side is not sorted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df.hint("shuffle_hash")


def counted(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` as a table in the shared folder, to be broadcast if it has few rows, and never if it has more.

    For sums by district: Catalyst can't tell how few they are, so a join would shuffle the rows
    of all units, and it takes a file for as small as its compression makes it.
    """
    table = shared_table(df)
    return F.broadcast(table) if table.count() <= rows else table.hint("merge")
