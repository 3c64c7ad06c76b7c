"""Low-variance resampling of weighted rows, and running sums by stretches of ids.

A running sum over all rows is that within stretches of consecutive ids, plus the sums of the
stretches before (one row a stretch). Both add in the order of ids, so the sums, and what is
drawn by them, are the same however rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from .sizes import small

#: Ids whose rows are added up in one task.
STRETCH = 1_000


def numbered(rows: DataFrame, *order: Column, name: str = "at") -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, which leaves no ties.

    Rows are sorted into ranges; the rows of the ranges before (a row a range) and the place
    within a range add up.
    """
    # written once, as a range sort reads its input twice, and once more, so that ranges stay as they are
    dealt = shared_table(shared_table(rows).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("s")).select("_range", (F.sum("s").over(W.orderBy("_range")) - F.col("s")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(small(sums), "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")


def cumulative(rows: DataFrame, weight: str = "w", key: str = "id", stretch: int = STRETCH, n: int | None = None) -> DataFrame:
    """``rows`` with ``lo`` and ``hi``: the shares of all weight before each row, and with it, in the order of ``key``.

    Keys are long and unique, weights not negative; a row's ``lo`` is the ``hi`` of the one before.
    ``n`` may say that keys are all below it: one stretch needs no sums of others.
    """
    if n is not None and n <= stretch:
        one = W.partitionBy(F.lit(0)).orderBy(key)
        upto, whole = F.sum(weight).over(one), F.sum(weight).over(one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        placed = rows.withColumn("_upto", upto).withColumn("_whole", whole)
        before = F.coalesce(F.lag("_upto").over(one), F.lit(0.0))
        return placed.withColumn("lo", before / F.col("_whole")).withColumn("hi", F.col("_upto") / F.col("_whole")).drop("_upto", "_whole")
    order = W.partitionBy("_stretch").orderBy(key)
    own = rows.withColumn("_stretch", F.floor(F.col(key) / stretch)).withColumn("_upto", F.sum(weight).over(order))
    sums = own.groupBy("_stretch").agg(F.max("_upto").alias("_sum"))
    before = W.orderBy("_stretch")  # one row a stretch
    ahead = F.coalesce(F.sum("_sum").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select("_stretch", ahead.alias("_ahead"), (ahead + F.col("_sum")).alias("_whole")).withColumn("_whole", F.max("_whole").over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    whole = own.join(sums, "_stretch")
    lo = F.when(F.row_number().over(order) == 1, F.col("_ahead")).otherwise(F.col("_ahead") + F.lag("_upto").over(order))
    return whole.withColumn("lo", lo / F.col("_whole")).withColumn("hi", (F.col("_ahead") + F.col("_upto")) / F.col("_whole")).drop("_stretch", "_upto", "_ahead", "_whole")


def picks(n: int, offset: Column) -> Column:
    """The picks (from 0) that fall on a row with ``lo`` and ``hi``: an array of ``n * share`` numbers, rounded up or down.

    Pick i lies at (i + ``offset``) / n, so all rows together have each pick once.
    """
    first, last = (F.greatest(F.ceil(F.col(c) * n - offset), F.lit(0)).cast("long") for c in ("lo", "hi"))
    return F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<long>"))


def low_variance(rows: DataFrame, n: int, offset: float, weight: str = "w", key: str = "id", name: str = "pick", keys_below: int | None = None) -> DataFrame:
    """``n`` rows with replacement, in proportion to ``weight``: each comes n * share times, rounded up or down.

    ``name`` numbers the picks from 0. One offset (0 to 1) is drawn for all. Rows of one pick
    come from one row's task; no row meets another.
    """
    return cumulative(rows, weight, key, n=keys_below).withColumn(name, F.explode(picks(n, F.lit(offset)))).drop("lo", "hi")
