"""The data behind plots: one DataFrame each, ready to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scatter(stats: DataFrame, draws: DataFrame, x: str, y: str) -> DataFrame:
    """draw, x, y, is_ref."""
    return stats.join(draws.select("draw", "is_ref"), "draw").select("draw", F.col(x).alias("x"), F.col(y).alias("y"), "is_ref")


def top_two(stats: DataFrame, column: str) -> DataFrame:
    """draw, first, second: the two largest values of a draw's districts."""
    place = F.row_number().over(W.partitionBy("draw").orderBy(F.col(column).desc(), "district"))
    ranked = stats.select("draw", F.col(column).alias("v"), place.alias("k")).filter("k <= 2")
    return ranked.groupBy("draw").agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias("second"))


def trace(stats: DataFrame, draws: DataFrame, column: str, district: int = 1) -> DataFrame:
    """chain, iteration, value: one district's statistic along each chain, references left out."""
    own = stats.filter(F.col("district") == district).join(draws.filter(~F.col("is_ref")).select("draw", "chain"), "draw")
    return own.select("chain", F.row_number().over(W.partitionBy("chain").orderBy("draw")).alias("iteration"), F.col(column).alias("value"))


def running_median(series: DataFrame) -> DataFrame:
    """chain, iteration, median of the values so far (of ``trace``)."""
    upto = W.partitionBy("chain").orderBy("iteration").rowsBetween(W.unboundedPreceding, W.currentRow)
    return series.select("chain", "iteration", F.percentile("value", 0.5).over(upto).alias("median"))


def sorted_districts(stats: DataFrame, column: str) -> DataFrame:
    """draw, place, value: districts in order of a statistic, for box plots by place."""
    place = F.row_number().over(W.partitionBy("draw").orderBy(column, "district"))
    return stats.select("draw", place.alias("place"), F.col(column).alias("value"))


def core_sizes(cores: DataFrame) -> DataFrame:
    """draw, unit_id, core, size: null for cores of one unit."""
    n = F.count(F.lit(1)).over(W.partitionBy("draw", "core"))
    return cores.select("draw", "unit_id", "core", F.when(n > 1, n).alias("size"))
