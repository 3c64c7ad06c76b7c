"""Plans beside plans and units beside units: overlaps, distances, co-occurrence, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from .sizes import LIMIT, ROWS, counted, small


#: Classes of units whose plans meet in a tile of pairs; draws that a tile compares at once.
TILE, AT_ONCE = 512, 256
#: Units of a class that are spread at once (Spark holds all pairs of two chunks); pairs of units that a task makes; units that are broadcast.
CHUNK, IN_TASK, UNITS = 100, 20_000_000, LIMIT // 8


def alike(rows: DataFrame, columns: list[str], by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of units whose ``rows`` have the same ``columns``, apart for each ``by``.

    Tables of all units (by, h1, h2, h3, unit_id), of classes (by, h1, h2, h3, first and last unit,
    size), and the rows of first units only. Sums of hashes tell classes apart, so no row is
    sorted, and none but those of first units is written; 40 bits each, so that no sum overflows.
    """
    sums = [F.sum(F.shiftright(F.xxhash64(F.lit(k), *columns), 24)).alias(f"h{k}") for k in (1, 2, 3)]
    same = [*by, "h1", "h2", "h3"]
    units = shared_table(rows.groupBy("unit_id", *by).agg(*sums))
    classes = shared_table(units.groupBy(*same).agg(F.min("unit_id").alias("first"), F.max("unit_id").alias("last"), F.count(F.lit(1)).alias("size")))
    found = classes.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).first()
    if (found["size"] or 1) == 1:
        return units, classes, rows
    first = classes.select(F.col("first").alias("unit_id"), *by)
    first = F.broadcast(first) if found["n"] <= ROWS else first.hint("shuffle_hash")
    return units, classes, shared_table(rows.join(first, ["unit_id", *by], "left_semi").select("unit_id", *by, *columns))


def cooccurrence(assignments: DataFrame, least: float = 0.0, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """unit_i < unit_j, p: share of draws in which two units have one district; pairs never together, or below ``least``, are absent.

    Units with the same districts in all draws are one class, so plans are compared once a pair
    of classes. Classes are dealt to blocks of about ``tile``, and two blocks meet in a task, as
    arrays of districts by draw: their pairs are counted by products of one-hot rows, and those
    below the floor don't leave the task. What is left is spread to pairs of units by chunks of
    the classes' units. No pair of rows of the assignments is joined.
    """
    units, own, first = alike(assignments, ["draw", "district"], [])
    draws = first.select("draw").distinct()
    # one row a draw: counted, as Catalyst can't tell, and would shuffle the rows of all units by draw
    numbered = counted(draws.select("draw", (F.row_number().over(W.orderBy("draw")) - 1).alias("at")))
    whole = numbered.agg(F.count(F.lit(1)).alias("n"))
    plans = first.join(numbered, "draw").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("at", "district"))).alias("d"))
    plans = plans.select(F.col("unit_id").alias("rep"), F.transform("d", lambda x: x["at"]).alias("at"), F.transform("d", lambda x: x["district"]).alias("d"))
    classes = shared_table(plans.join(own.select(F.col("first").alias("rep"), "size"), "rep"))
    many = classes.count()
    blocks = max(1, -(-many // tile))
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    dealt = classes.crossJoin(F.broadcast(whole)).select("rep", "size", block.alias("block"), "n", "at", "d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"))
    met = dealt.select(F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "rep", "size", "block", "n", "at", "d")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        sides = []
        for k in key:
            own = pdf[pdf["block"] == k].sort_values("rep")
            plan = np.full((len(own), n), -1, np.int64)
            for row, at, d in zip(plan, own["at"], own["d"]):
                row[at] = d
            sides.append((own["rep"].to_numpy(), own["size"].to_numpy(), plan))
        (a, many_a, left), (b, many_b, right) = sides
        together = np.zeros((len(a), len(b)), np.float32)
        for s in range(0, n, AT_ONCE):
            labels, code = np.unique(np.concatenate([left[:, s : s + AT_ONCE], right[:, s : s + AT_ONCE]]), return_inverse=True)
            code = code.reshape(len(a) + len(b), -1)
            for k in np.flatnonzero(labels >= 0):
                hot = (code == k).astype(np.float32)
                together += hot[: len(a)] @ hot[len(a) :].T
        # a class meets itself if it has two units or more
        i, j = np.nonzero((together > 0) & (together >= least * n) & ((a[:, None] < b[None, :]) | ((a[:, None] == b[None, :]) & (many_a[:, None] > 1)) if key[0] == key[1] else True))
        return pd.DataFrame({"i": a[i], "j": b[j], "p": together[i, j].astype(float) / n, "rows": many_a[i] * many_b[j]})

    kind = assignments.schema["unit_id"].dataType.simpleString()
    pairs = shared_table(met.groupBy("x", "y").applyInPandas(count, f"i {kind}, j {kind}, p double, rows long"))
    tasks = max(1, -(-(pairs.agg(F.sum("rows")).first()[0] or 0) // IN_TASK))
    part = F.pmod(F.xxhash64("unit_id"), F.ceil(F.col("size") / chunk)).alias("part")
    of = own.select("h1", "h2", "h3", F.col("first").alias("rep"), "size")
    chunks = shared_table(units.join(F.broadcast(of) if many <= ROWS else of.hint("merge"), ["h1", "h2", "h3"]).select("rep", part, "unit_id").groupBy("rep", "part").agg(F.collect_list("unit_id").alias("units")))
    few = units.count() <= UNITS
    one, other = (chunks.select(F.col("rep").alias(r), F.col("part").alias(f"part_{r}"), F.col("units").alias(f"units_{r}")) for r in "ij")
    same = F.col("i") == F.col("j")
    # few units come to the tasks that spread them, whose rows are dealt before
    meet = pairs.select("i", "j", "p").join(one.drop("units_i") if few else one, "i").join(other.drop("units_j") if few else other, "j").filter(~same | (F.col("part_i") <= F.col("part_j")))
    meet = meet.repartition(tasks, "i", "j", "part_i", "part_j").withColumn("whole", ~same | (F.col("part_i") < F.col("part_j")))
    if few:
        meet = meet.join(F.broadcast(one), ["i", "part_i"]).join(F.broadcast(other), ["j", "part_j"])
    rows = meet.select("p", "whole", "units_j", F.explode("units_i").alias("u")).select("p", "whole", "u", F.explode("units_j").alias("v"))
    return rows.filter(F.col("whole") | (F.col("u") < F.col("v"))).select(F.least("u", "v").alias("unit_i"), F.greatest("u", "v").alias("unit_j"), "p")


def population_overlap(old: DataFrame, new: DataFrame, units: DataFrame, pop: str = "pop", rows: bool | None = True) -> DataFrame:
    """Population of old x new districts; as shares of the old (True), the new (False), or raw (None)."""
    met = old.select("unit_id", F.col("district").alias("old")).join(new.select("unit_id", F.col("district").alias("new")), "unit_id").join(small(units.select("unit_id", F.col(pop).alias("p"))), "unit_id")
    raw = met.groupBy("old", "new").agg(F.sum("p").alias("overlap"))
    if rows is None:
        return raw
    return raw.withColumn("overlap", F.try_divide(F.col("overlap").cast("double"), F.sum("overlap").over(W.partitionBy("old" if rows else "new"))))


def joint_population(assignments: DataFrame, plan: DataFrame, units: DataFrame, pop: str = "pop") -> DataFrame:
    """draw, ref, district, p: population in both."""
    ref = plan.select("unit_id", F.col("district").alias("ref")).join(units.select("unit_id", F.col(pop).alias("p")), "unit_id")
    return assignments.join(small(ref), "unit_id").groupBy("draw", "ref", "district").agg(F.sum("p").alias("p"))


def _information(joint: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Variation of information from joint populations; cells below 1 are skipped."""
    j = F.col("p").cast("double")
    pa, pb = F.sum("p").over(W.partitionBy(*by, a)), F.sum("p").over(W.partitionBy(*by, b))
    term = F.when(j >= 1, -j * (2 * F.log(j) - F.log(pa.cast("double")) - F.log(pb.cast("double"))))
    told = joint.withColumn("term", term).groupBy(*by).agg((F.sum("term") / F.sum("p")).alias("vi"))
    return told.select(*by, F.when(F.abs("vi") <= 1e-9, 0.0).otherwise(F.col("vi")).alias("vi"))


def information_to(assignments: DataFrame, plan: DataFrame, units: DataFrame, pop: str = "pop") -> DataFrame:
    """Variation of information between each draw and one plan."""
    return _information(joint_population(assignments, plan, units, pop), ["draw"], "ref", "district")


def _distances_by_joins(assignments: DataFrame, units: DataFrame, pop: str) -> DataFrame:
    """The same for maps of any size: one row per pair and joint district, by a join on the unit."""
    a = assignments.select("unit_id", F.col("draw").alias("i"), F.col("district").alias("a"))
    b = assignments.select("unit_id", F.col("draw").alias("j"), F.col("district").alias("b"))
    met = a.join(b, "unit_id").filter("i < j").join(small(units.select("unit_id", F.col(pop).alias("p"))), "unit_id")
    joint = met.groupBy("i", "j", "a", "b").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    apart = F.abs(F.col("a") - F.col("b"))
    plain = joint.groupBy("i", "j").agg(F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).alias("hamming"), F.sum(apart * F.col("n")).alias("manhattan"), F.sqrt(F.sum(apart * apart * F.col("n")).cast("double")).alias("euclidean"))
    return plain.join(_information(joint, ["i", "j"], "a", "b"), ["i", "j"])


#: Units up to which whole plans meet in a task; draws of a block.
MOST_UNITS, BLOCK = 200_000, 64
DISTANCES = "i int, j int, hamming long, manhattan long, euclidean double, vi double"


def _pair_rows(i: int, a: np.ndarray, others: np.ndarray, draws: list[int], p: np.ndarray, k: int) -> list[tuple]:
    """Distances of plan ``a`` from other plans; districts are numbered below ``k``."""
    gap = np.abs(others - a)
    out = []
    for j, b, g in zip(draws, others, gap):
        joint = np.bincount(a * k + b, p, k * k).reshape(k, k)
        pa, pb = np.broadcast_to(joint.sum(1)[:, None], joint.shape), np.broadcast_to(joint.sum(0)[None, :], joint.shape)
        on = joint >= 1
        vi = float((-joint[on] * (2 * np.log(joint[on]) - np.log(pa[on]) - np.log(pb[on]))).sum() / p.sum())
        out.append((min(i, j), max(i, j), int((g > 0).sum()), int(g.sum()), float(np.sqrt((g * g).sum())), 0.0 if abs(vi) <= 1e-9 else vi))
    return out


def distances(assignments: DataFrame, units: DataFrame, pop: str = "pop") -> DataFrame:
    """Hamming, Manhattan and Euclidean distance and variation of information of all pairs of draws i < j.

    Plans are rows of arrays and meet in tiles of two blocks of draws, so what is shuffled are
    plans times blocks, not pairs times units. All draws must have the same units.
    """
    if units.limit(MOST_UNITS + 1).count() > MOST_UNITS:
        return _distances_by_joins(assignments, units, pop)
    own = assignments.join(small(units.select("unit_id", F.col(pop).cast("double").alias("p"))), "unit_id")
    plans = own.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("unit_id", "district", "p"))).alias("u"))
    blocks = max(1, -(-assignments.select("draw").distinct().count() // BLOCK))
    block = F.pmod(F.xxhash64("draw"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with")
    dealt = plans.select("draw", block.alias("block"), F.transform("u", lambda x: x["unit_id"]).alias("ids"), F.transform("u", lambda x: x["district"]).alias("plan"), F.transform("u", lambda x: x["p"]).alias("p")).select("*", every)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        plan, ids, p = np.stack(pdf["plan"]), np.stack(pdf["ids"]), np.asarray(pdf["p"].iloc[0], float)
        if (ids != ids[0]).any():
            raise ValueError("draws of unlike units")
        least, draws, of = plan.min(), pdf["draw"].tolist(), pdf["block"].to_numpy()
        plan, k = plan - least, int(plan.max() - least) + 1
        left, right = (of == of.min()), (of == of.max())
        rows = []
        for i in np.flatnonzero(left):
            to = [j for j in np.flatnonzero(right) if (j > i if of.min() == of.max() else True)]
            if to:
                rows += _pair_rows(draws[i], plan[i], plan[to], [draws[j] for j in to], p, k)
        return pd.DataFrame(rows, columns=["i", "j", "hamming", "manhattan", "euclidean", "vi"])

    met = dealt.select(F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "draw", "block", "ids", "plan", "p")
    # a tile of two blocks needs both: a block without draws leaves none
    return met.groupBy("x", "y").applyInPandas(lambda key, pdf: tile(pdf) if key[0] == key[1] or pdf["block"].nunique() == 2 else pd.DataFrame([], columns=["i", "j", "hamming", "manhattan", "euclidean", "vi"]), DISTANCES)


def diversity(assignments: DataFrame, units: DataFrame, pop: str = "pop", n_max: int = 100, seed: int = 1) -> DataFrame:
    """Half the variation of information of pairs among at most ``n_max`` draws, picked by hash."""
    some = assignments.select("draw").distinct().orderBy(F.xxhash64("draw", F.lit(seed))).limit(n_max)
    return distances(assignments.join(F.broadcast(some), "draw"), units, pop).select("i", "j", (F.col("vi") / 2).alias("diversity"))


def projected(assignments: DataFrame, stats: DataFrame, column: str) -> DataFrame:
    """The district's value at each unit, draw by draw."""
    return assignments.join(counted(stats.select("draw", "district", F.col(column).alias("value"))), ["draw", "district"]).select("draw", "unit_id", "value")


def projective_average(assignments: DataFrame, stats: DataFrame, column: str) -> DataFrame:
    return projected(assignments, stats, column).groupBy("unit_id").agg(F.avg("value").alias("value"))


def projective_contrast(assignments: DataFrame, stats: DataFrame, column: str, reference: int, norm: bool = False) -> DataFrame:
    """Value of draw ``reference`` minus the mean of the others, over their deviation if ``norm``."""
    every = projected(assignments, stats, column)
    base = every.filter(F.col("draw") != reference).groupBy("unit_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    gap = F.col("value") - F.col("mean")
    own = every.filter(F.col("draw") == reference).join(base, "unit_id")
    return own.select("unit_id", (F.try_divide(gap, F.col("sd")) if norm else gap).alias("contrast"))


def contrast_p_values(assignments: DataFrame, stats: DataFrame, column: str, reference: int) -> DataFrame:
    """Share of draws whose own contrast is at least as large as the reference's, unit by unit."""
    every = projected(assignments, stats, column)
    mean = every.filter(F.col("draw") != reference).groupBy("unit_id").agg(F.avg("value").alias("mean"))
    gap = every.join(mean, "unit_id").select("draw", "unit_id", F.abs(F.round(F.col("value") - F.col("mean"), 12)).alias("gap"))
    own = gap.filter(F.col("draw") == reference).select("unit_id", F.col("gap").alias("own"))
    return gap.join(own, "unit_id").groupBy("unit_id").agg(F.avg((F.col("gap") >= F.col("own")).cast("int")).alias("p"))


def contrast_departures(assignments: DataFrame, stats: DataFrame, column: str, reference: int) -> tuple[DataFrame, DataFrame, int]:
    """What ``estimates.rank_discoveries`` asks for: (unit_id, rank) of all draws but ``reference``, (unit_id, c) of that one, and the number of draws.

    A draw departs at a unit by its value less the mean over the draws; sizes are compared to
    twelve digits. Ranks count draws of one unit, so no unit's draws meet another's.
    """
    every = projected(assignments, stats, column)
    mean = every.filter(F.col("draw") != reference).groupBy("unit_id").agg(F.avg("value").alias("mean"))
    gap = every.join(mean, "unit_id").select("draw", "unit_id", F.abs(F.round(F.col("value") - F.col("mean"), 12)).alias("gap"))
    drawn = gap.filter(F.col("draw") != reference)
    upto = F.count(F.lit(1)).over(W.partitionBy("unit_id").orderBy("gap").rangeBetween(W.unboundedPreceding, W.currentRow))
    own = gap.filter(F.col("draw") == reference).select("unit_id", F.col("gap").alias("own"))
    as_far = drawn.join(own, "unit_id").groupBy("unit_id").agg(F.count_if(F.col("gap") >= F.col("own")).alias("c"))
    n = assignments.filter(F.col("draw") != reference).select("draw").distinct().count()
    return drawn.select("unit_id", upto.alias("rank")), as_far, n


def share_unchanged(assignments: DataFrame, plan: DataFrame) -> DataFrame:
    """Share of units whose label is that of a plan, by draw."""
    ref = plan.select("unit_id", F.col("district").alias("ref"))
    return assignments.join(small(ref), "unit_id").groupBy("draw").agg(F.avg((F.col("district") == F.col("ref")).cast("int")).alias("unchanged"))
