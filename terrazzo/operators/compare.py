"""Comparing plans and sets of plans: unit overlap, splits between sets, classification, a plane of plans."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from . import overlap, spectral
from .sizes import ROWS, counted, small

#: Draws whose matrix of distances may be formed on the driver, for linkage.
MOST_DRAWS = 2_000

_WEIGHTS = {
    # a pair's weight as x_i * y_j + y_i * x_j, from a unit's population
    "s": (lambda p: F.lit(1.0), lambda p: p),
    "m": (lambda p: F.lit(0.5), lambda p: p),
    "g": (lambda p: F.sqrt(p), lambda p: F.sqrt(p) / 2),
    "n": (lambda p: F.lit(1.0), lambda p: F.lit(0.5)),
}


def unit_overlap(old: DataFrame, new: DataFrame, units: DataFrame, weighting: str = "s", normalize: bool = True, pop: str = "pop") -> DataFrame:
    """unit_id, overlap: mean over all units of the weighted change of being in one district.

    Plans have (unit_id, district). Weights of a pair: ``s`` sum, ``m`` mean, ``g`` geometric
    mean of the populations, ``n`` none. Pairs together in one plan only are those of either
    plan less twice those of both, so sums over districts and cells do; no pair is formed.
    """
    x, y = (f(F.col("p")) for f in _WEIGHTS[weighting])
    both = old.select("unit_id", F.col("district").alias("a")).join(new.select("unit_id", F.col("district").alias("b")), "unit_id")
    rows = both.join(small(units.select("unit_id", F.col(pop).cast("double").alias("p"))), "unit_id").select("unit_id", "a", "b", x.alias("x"), y.alias("y"))
    whole = units.agg(F.count(F.lit(1)).alias("v"), F.sum(pop).alias("total"))
    total = lambda by, c: rows.groupBy(*by).agg(F.sum("x").alias(f"x{c}"), F.sum("y").alias(f"y{c}"))
    met = rows.join(total(["a"], 1), "a").join(total(["b"], 2), "b").join(total(["a", "b"], 3), ["a", "b"])
    apart = F.col("x") * (F.col("y1") + F.col("y2") - 2 * F.col("y3")) + F.col("y") * (F.col("x1") + F.col("x2") - 2 * F.col("x3"))
    scale = F.col("v") * F.col("total") if normalize else F.col("v")
    return met.crossJoin(F.broadcast(whole)).select("unit_id", (apart / scale).alias("overlap"))


def overlap_index(old: DataFrame, new: DataFrame, units: DataFrame, weighting: str = "s", normalize: bool = True, pop: str = "pop") -> DataFrame:
    """One row ``index``: the mean over all pairs of different units."""
    own = unit_overlap(old, new, units, weighting, normalize, pop)
    n = units.agg(F.count(F.lit(1)).alias("v"))
    return own.agg(F.sum("overlap").alias("s")).crossJoin(F.broadcast(n)).select((F.col("s") / (F.col("v") - 1)).alias("index"))


def smoothed_cooccurrence(assignments: DataFrame, ndists: int) -> DataFrame:
    """unit_i < unit_j, p: (together + 1 / ndists) / (draws + 1); pairs never together are left out (their p is that of 0)."""
    n = assignments.select("draw").distinct().count()
    return overlap.cooccurrence(assignments).select("unit_i", "unit_j", ((F.col("p") * n + 1 / ndists) / (n + 1)).alias("p"))


def _splits(sets: DataFrame, ndists: int, thresh: float) -> DataFrame:
    """grp, split, unit_id, value, part, separation of pairs of sets: rows grp, side (1 or 2), draw, unit_id, district.

    The difference of the two smoothed co-occurrences is applied to a vector without forming
    it: co-occurrence times a vector is the vector's sum over each district, sent back to the
    district's units, and smoothing adds a share of the whole sum and of the vector itself.
    Units with the same districts in all draws are one node, whose entry is theirs times the root
    of their number, so rounds grow with unlike units only. What tells units of a class apart has
    the vector's own share as its eigenvalue, whatever the class: one class a group is parted in two for it.
    A node's row holds the numbers of all its districts, so a round is one pass over nodes.
    """
    spark = sets.sparkSession
    by = ["grp", "side", "draw", "district"]
    units, classes, rows = overlap.alike(sets.withColumn("unit_id", F.col("unit_id").cast("long")), by[1:], ["grp"])
    every = shared_table(rows.select(*by).distinct())
    counts = {(r["grp"], r["side"]): r["n"] for r in every.groupBy("grp", "side").agg(F.countDistinct("draw").alias("n")).collect()}
    groups, share = sorted({g for g, _ in counts}), 1 / ndists
    n = {k: counts.get(k, 0) for g in groups for k in ((g, 1), (g, 2))}
    scalars = small(spark.createDataFrame([(g, share / (n[g, 1] + 1) - share / (n[g, 2] + 1), (n[g, 2] + share) / (n[g, 2] + 1) - (n[g, 1] + share) / (n[g, 1] + 1)) for g in groups], "grp string, all_ double, own double"))
    weights = small(spark.createDataFrame([(g, side, (1 if side == 1 else -1) / (k + 1)) for (g, side), k in n.items()], "grp string, side int, weight double"))
    # numbers from 0 in each group; a row a district and draw
    cells = shared_table(every.join(weights, ["grp", "side"]).select(*by, "weight", (F.row_number().over(W.partitionBy("grp").orderBy(*by[1:])) - 1).cast("int").alias("cell")))
    few = cells.count() <= ROWS
    own_cells = rows.join(F.broadcast(cells) if few else cells.hint("merge"), by).groupBy("unit_id", "grp").agg(F.collect_list(F.struct("cell", "weight")).alias("cells"))
    if few:  # one more cell holds all units
        last = cells.groupBy("grp").agg((F.max("cell") + 1).alias("cell"))
        scalars = F.broadcast(scalars.join(F.broadcast(last), "grp"))
        own_cells = own_cells.join(scalars, "grp").withColumn("cells", F.concat("cells", F.array(F.struct("cell", F.col("all_").alias("weight"))))).drop("cell")
    else:
        own_cells = own_cells.join(scalars, "grp")
    parted = small(classes.filter("size > 1").groupBy("grp").agg(F.min("first").alias("parted")))
    halves = F.array(F.struct(F.col("first").alias("node"), F.lit(1).cast("long").alias("size")), F.struct(F.col("last").alias("node"), (F.col("size") - 1).alias("size")))
    made = classes.join(parted, "grp", "left").select("grp", F.col("first").alias("unit_id"), F.when(F.col("first") == F.col("parted"), halves).otherwise(F.array(F.struct(F.col("first").alias("node"), "size"))).alias("nodes"))
    nodes = own_cells.join(made, ["unit_id", "grp"]).select("grp", "all_", "own", "cells", F.inline("nodes"))
    nodes = shared_table(nodes.select("grp", "node", F.sqrt("size").alias("root"), "all_", "own", "cells"))

    def apply(v: DataFrame) -> DataFrame:
        x = (F.col("x") * F.col("root")).alias("x")
        sums = v.select("grp", F.inline("cells"), x).groupBy("grp", "cell").agg((F.max("weight") * F.sum("x")).alias("s"))
        if few:  # all sums of a group go to its nodes as one array
            whole = sums.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "s"))), lambda x: x["s"]).alias("s"))
            back, c = v, F.aggregate("cells", F.lit(0.0), lambda a, x: a + F.get("s", x["cell"]))
        else:
            whole = v.select("grp", x).groupBy("grp").agg(F.sum("x").alias("t"))
            met = v.select("grp", "node", F.inline("cells")).join(sums.hint("merge"), ["grp", "cell"])
            back, c = v.join(met.groupBy("grp", "node").agg(F.sum("s").alias("c")).hint("merge"), ["grp", "node"]), F.col("c") + F.col("all_") * F.col("t")
        return back.join(F.broadcast(whole), "grp").select(*v.columns, (F.col("root") * c + F.col("own") * F.col("x")).alias("w"))

    found = spectral.leading(nodes, apply, high=1, low=1).join(small(nodes.select("grp", "node", "root")), ["grp", "node"])
    found = counted(found.select("grp", "place", "eigenvalue", "node", (F.col("value") / F.col("root")).alias("value")))
    # the entry of largest size is positive (ties, to nine digits: the first unit)
    sign = F.max_by(F.signum("value"), F.struct(F.round(F.abs("value"), 9), -F.col("node")))
    tops = small(found.groupBy("grp", "place").agg((thresh * F.max(F.abs("value"))).alias("cut"), F.when(sign < 0, -1.0).otherwise(1.0).alias("sign")))
    found = found.join(tops, ["grp", "place"]).withColumn("value", F.col("value") * F.col("sign"))
    part = (F.col("value") > F.col("cut")).cast("int") - (F.col("value") < -F.col("cut")).cast("int")
    same = ["grp", "h1", "h2", "h3"]
    of = classes.join(parted, "grp", "left").select(*same, "first", F.when(F.col("first") == F.col("parted"), F.col("last")).otherwise(F.col("first")).alias("rest"))
    node = F.when(F.col("unit_id") == F.col("first"), F.col("first")).otherwise(F.col("rest"))
    own_units = units.join(small(of), same).select("grp", "unit_id", node.alias("node"))
    # split 2 is the largest eigenvalue of the negative, so the smallest of the difference
    return own_units.join(found, ["grp", "node"]).select("grp", F.when(F.col("place") == 1, 1).otherwise(2).alias("split"), F.col("unit_id").cast("int").alias("unit_id"), "value", part.alias("part"), (F.col("eigenvalue") * F.signum(F.col("place").cast("double"))).alias("separation"))


def compare_sets(one: DataFrame, two: DataFrame, ndists: int, thresh: float = 0.1) -> DataFrame:
    """split, unit_id, value, part, separation: where two sets of draws keep units together unlike each other.

    Split 1 is the leading eigenvector of the difference of smoothed co-occurrences, split 2
    that of its negative; parts 1 and -1 are units beyond ``thresh`` of the largest entry. No
    matrix of pairs of units is formed.
    """
    sets = [d.select(F.lit("").alias("grp"), F.lit(side).alias("side"), "draw", "unit_id", "district") for side, d in ((1, one), (2, two))]
    return _splits(sets[0].union(sets[1]), ndists, thresh).drop("grp")


def _dense(pairs: DataFrame, column: str) -> tuple[list[int], np.ndarray]:
    """Draws and the symmetric matrix of (i, j, column); refused beyond ``MOST_DRAWS``."""
    ends = pairs.select(F.explode(F.array("i", "j")).alias("d")).distinct().orderBy("d").limit(MOST_DRAWS + 1)
    ids = [r["d"] for r in ends.collect()]
    if len(ids) > MOST_DRAWS:
        raise ValueError(f"more than {MOST_DRAWS} draws")
    at, out = {d: k for k, d in enumerate(ids)}, np.zeros((len(ids), len(ids)))
    for r in pairs.select("i", "j", F.col(column).cast("double").alias("x")).collect():
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["x"]
    return ids, out


def complete_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of clusters by their farthest members; a merge's cluster takes the number n + its place."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, out = list(range(n)), []
    for k in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((name[i], name[j], float(d[i, j])))
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        name[i] = n + k
    return out


# The names of the groups at each depth.
LEVELS = (("I", "II"), ("A", "B"), ("1", "2"), ("a", "b"), ("i", "ii"))


def classify(pairs: DataFrame, k: int = 8, column: str = "vi") -> DataFrame:
    """draw, label, height: ``k`` groups by complete linkage, named by the last merges from the top (I.A.1.a.i).

    Below the fifth level groups keep the name of the fifth with their number appended.
    """
    ids, distance = _dense(pairs, column)
    merges, n = complete_linkage(distance), len(ids)
    inner = {n + t: m for t, m in enumerate(merges)}
    split = {n + t for t in range(max(0, n - k), n - 1)}
    members = {i: [i] for i in range(n)}
    for t, (a, b, _) in enumerate(merges):
        members[n + t] = members[a] + members[b]
    rows, stack = [], [(n + len(merges) - 1 if merges else 0, ())] if n else []
    while stack:
        node, path = stack.pop()
        if node in split:
            for side, child in enumerate(sorted(inner[node][:2], key=lambda c: min(members[c]))):
                stack.append((child, (*path, side)))
            continue
        named = [LEVELS[d][s] if d < len(LEVELS) else str(s + 1) for d, s in enumerate(path)] or ["I"]
        height = inner[node][2] if node in inner else 0.0
        rows += [(ids[i], ".".join(named), height) for i in members[node]]
    return pairs.sparkSession.createDataFrame(rows, "draw int, label string, height double")


def contrast_of_classes(classes: DataFrame, assignments: DataFrame, ndists: int, thresh: float = 0.1) -> DataFrame:
    """parent and ``compare_sets`` of the two groups under each name that classification split.

    A draw belongs to one side of every name above its own; all names go through the same rounds.
    """
    steps = F.split("label", r"\.")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), ".").alias("grp"), F.element_at(steps, (k + 1).cast("int")).alias("name")))
    sides = classes.select("draw", F.explode(above).alias("s")).select("draw", "s.grp", "s.name")
    ends = sides.groupBy("grp").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a <> b")
    if ends.isEmpty():
        raise ValueError("a single group has no split")
    sets = sides.join(small(ends), "grp").select("grp", F.when(F.col("name") == F.col("a"), 1).otherwise(2).alias("side"), "draw").join(assignments, "draw")
    return _splits(sets.select("grp", "side", "draw", "unit_id", "district"), ndists, thresh).withColumnRenamed("grp", "parent")


def plane(pairs: DataFrame, column: str = "vi") -> DataFrame:
    """draw, x, y: classical scaling of pairwise distances to two dimensions.

    Centred squared distances are applied to a vector as sums over pairs, so no matrix is formed.
    """
    both = shared_table(pairs.select("i", "j", (F.col(column).cast("double") ** 2).alias("d")).select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("node"), "d"), F.struct(F.col("j").alias("a"), F.col("i").alias("node"), "d"))).alias("p")).select(F.col("p.a").cast("long").alias("a"), F.col("p.node").cast("long").alias("node"), "p.d"))

    def centred(v: DataFrame, c: str) -> DataFrame:
        return v.crossJoin(F.broadcast(v.agg(F.avg(c).alias("_mean")))).withColumn(c, F.col(c) - F.col("_mean")).drop("_mean")

    def apply(v: DataFrame) -> DataFrame:
        sums = both.join(small(centred(v, "x")), "node").groupBy("grp", "a").agg((-0.5 * F.sum(F.col("d") * F.col("x"))).alias("w"))
        return centred(sums.select("grp", F.col("a").alias("node"), "w"), "w")

    found = spectral.leading(both.select(F.lit("").alias("grp"), "node").distinct(), apply, high=2)
    at = lambda k: F.coalesce(F.max(F.when(F.col("place") == k, F.col("value") * F.sqrt(F.greatest("eigenvalue", F.lit(0.0))))), F.lit(0.0))
    return found.groupBy(F.col("node").cast("int").alias("draw")).agg(at(1).alias("x"), at(2).alias("y"))


def clustered_plane(pairs: DataFrame, k: int = 5, column: str = "vi", seed: int = 1) -> DataFrame:
    """draw, x, y, cluster: the plane of plans, parted by k-means."""
    points = VectorAssembler(inputCols=["x", "y"], outputCol="at").transform(plane(pairs, column))
    return KMeans(k=k, seed=seed, featuresCol="at", predictionCol="cluster").fit(points).transform(points).select("draw", "x", "y", (F.col("cluster") + 1).alias("cluster"))
