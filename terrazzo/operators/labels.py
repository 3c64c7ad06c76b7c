"""Labels and ranks: renumbering, matching to a plan, ordering, the non-dominated draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from .overlap import joint_population
from .sizes import small


def by_first_appearance(assignments: DataFrame) -> DataFrame:
    """Districts numbered by their first unit."""
    first = assignments.groupBy("draw", "district").agg(F.min("unit_id").alias("first"))
    label = first.withColumn("label", F.row_number().over(W.partitionBy("draw").orderBy("first")))
    return assignments.join(label.drop("first"), ["draw", "district"]).select("draw", "unit_id", F.col("label").alias("district"))


def renumber(stats: DataFrame, column: str, descending: bool = False, seed: int = 1) -> DataFrame:
    """draw, district, label: districts ranked by a statistic, ties in an order drawn by hash."""
    x = F.col(column).desc() if descending else F.col(column).asc()
    return stats.select("draw", "district", F.row_number().over(W.partitionBy("draw").orderBy(x, F.xxhash64("draw", "district", F.lit(seed)))).alias("label"))


def relabel(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    return assignments.join(labels, ["draw", "district"]).select("draw", "unit_id", F.col("label").alias("district"))


def rank_districts(stats: DataFrame, column: str) -> DataFrame:
    """Rank within the draw, the lower district first among ties."""
    return stats.select("draw", "district", F.col(column), F.row_number().over(W.partitionBy("draw").orderBy(column, "district")).alias("rank"))


def kth(stats: DataFrame, column: str, k: int, largest: bool = True) -> DataFrame:
    """The k-th largest (or smallest) value of each draw."""
    order = F.col(column).desc() if largest else F.col(column).asc()
    ranked = stats.withColumn("k", F.row_number().over(W.partitionBy("draw").orderBy(order, "district")))
    return ranked.filter(F.col("k") == k).select("draw", F.col(column).alias("value"))


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment: shortest augmenting paths with potentials."""
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        best, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, col = start, -1
        while row >= 0:
            slack = cost[row] - row_price[row] - col_price + (0 if col < 0 else best[col])
            better = ~done & (slack < best - 1e-12)
            best[better], came[better] = slack[better], col
            col = int(np.argmin(np.where(done, np.inf, best)))
            done[col] = True
            row = int(row_of[col])
        length = best[col]
        used = done & (best <= length)
        for c in np.flatnonzero(used & (row_of >= 0)):
            row_price[row_of[c]] += length - best[c]
        row_price[start] += length
        col_price[used] += best[used] - length
        while col >= 0:  # turn the path around
            before = int(came[col])
            row_of[col] = start if before < 0 else row_of[before]
            col = before
    out = np.empty(n, np.int64)
    out[row_of] = np.arange(n)
    return out


def match_to(assignments: DataFrame, plan: DataFrame, units: DataFrame, ndists: int, pop: str = "pop") -> DataFrame:
    """draw, district, label, pop_overlap: labels that share the most population with a plan.

    Joint populations are sums in Spark; a draw's k x k table is assigned in its task.
    """
    joint = joint_population(assignments, plan, units, pop)
    listed = joint.groupBy("draw").agg(F.collect_list(F.struct("district", "ref", F.col("p").cast("double").alias("p"))).alias("cells"))

    def solve(batches):
        for pdf in batches:
            out = []
            for draw, cells in zip(pdf["draw"], pdf["cells"]):
                table = np.zeros((ndists, ndists))
                for c in cells:
                    table[c["district"] - 1, c["ref"] - 1] = c["p"]
                to = assign(-table)
                kept = table[np.arange(ndists), to].sum() / max(table.sum(), 1)
                out += [(draw, d + 1, int(to[d]) + 1, float(kept)) for d in range(ndists)]
            yield pd.DataFrame(out, columns=["draw", "district", "label", "pop_overlap"])

    return listed.mapInPandas(solve, "draw int, district int, label int, pop_overlap double")


def _lowest_so_far(scores: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Of rows in order of both scores and the key, those whose second score is below all before.

    Rows are range-sorted by the first score; the least second score of the ranges before (a
    row a range) and of the rows before within a range are all that is asked for.
    """
    # written first, as a range sort reads its input twice, once for a sample
    dealt = shared_table(shared_table(scores).repartitionByRange(first).withColumn("_range", F.spark_partition_id()))
    lows = dealt.groupBy("_range").agg(F.min(second).alias("_low"))
    ahead = lows.select("_range", F.min("_low").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_ahead"))
    within = F.min(second).over(W.partitionBy("_range").orderBy(first, second, key).rowsBetween(W.unboundedPreceding, -1))
    before = F.least("_ahead", "_within")  # nulls (nothing before) are left out
    kept = dealt.withColumn("_within", within).join(small(ahead), "_range").filter(before.isNull() | (F.col(second) < before))
    return kept.select(*scores.columns)


def not_dominated(scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that no other dominates (smaller is better); of equal rows the first stays.

    With two scores, rows in order of the first are kept while the second falls. With more,
    batches are reduced to their own frontiers, in ever fewer tasks, so that frontiers alone
    meet; the last task holds as many rows as its frontier and those it is compared with.
    """
    if len(columns) == 1:
        return scores.orderBy(*columns, key).limit(1)
    if len(columns) == 2:
        return _lowest_so_far(scores, key, *columns)

    def frontiers(batches):
        front = None
        for pdf in batches:
            pdf = (pdf if front is None else pd.concat([front, pdf])).sort_values([*columns, key], kind="stable").reset_index(drop=True)
            x, kept = pdf[columns].to_numpy(float), []
            for i in range(len(x)):  # what beats a row comes before it in this order
                if not kept or not (x[kept] <= x[i]).all(1).any():
                    kept.append(i)
            front = pdf.iloc[kept]
        if front is not None:
            yield front

    parts, best = 64, scores.mapInPandas(frontiers, scores.schema)
    while parts >= 1:
        best = best.repartition(parts, F.xxhash64(key)).mapInPandas(frontiers, scores.schema)
        parts //= 8
    return best


def closest_to_centres(points: DataFrame) -> DataFrame:
    """The nearest draw of each cluster (draw, cluster, dist)."""
    return points.groupBy("cluster").agg(F.min_by("draw", F.struct("dist", "draw")).alias("draw"), F.min("dist").alias("dist"))


def chain_positions(draws: DataFrame) -> DataFrame:
    return draws.withColumn("iteration", F.row_number().over(W.partitionBy("chain").orderBy("draw")))
