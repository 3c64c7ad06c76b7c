"""Constraints as penalties of districts, and scorers of draws, as DataFrame expressions.

A ``Penalty`` gives (draw, district, penalty) for an ensemble; ``evaluate`` sums strengths. Inside
a sampler's step the same penalty is asked for one district of one plan: ``local`` takes unit
columns (``needs``, and ``given``), the district's mask, the plan and the graph. A
``Scorer`` gives (draw, score) and adds, subtracts, scales and stacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, labels, overlap, tally
from .sizes import small

BY = ["draw", "district"]


@dataclass(frozen=True)
class Penalty:
    name: str
    strength: float
    of: Callable[[DataFrame, DataFrame], DataFrame]  # assignments, units -> draw, district, penalty
    local: Callable | None = None
    needs: tuple[str, ...] = ()
    given: Callable[[], dict] | None = None  # what ``local`` needs beside unit columns, by name; as small as the map


def _local_share(group: str, total: tuple[str, ...], fn: Callable[[float], float]) -> dict:
    """``local`` and ``needs`` of a function of a district's share."""

    def local(columns: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        whole = sum(float(columns[c][inside].sum()) for c in total)
        return fn(float(columns[group][inside].sum()) / whole if whole else 0.0)

    return {"local": local, "needs": (group, *total)}


def _local_nearest(s: float, targets: tuple[float, ...]) -> float:
    return min(reversed(targets), key=lambda t: abs(s - t))


def _share(group: Column | str, total: Column | str, fn: Callable[[Column], Column]):
    def of(asg: DataFrame, units: DataFrame) -> DataFrame:
        both = tally.tally(asg, units, g=group, t=total)
        return both.select(*BY, fn(tally.share("g", "t")).alias("penalty"))

    return of


def pop_dev(strength: float, target: float, pop: str = "pop") -> Penalty:
    return Penalty("pop_dev", strength, lambda a, u: tally.tally(a, u, p=pop).select(*BY, F.pow(F.col("p") / target - 1, 2).alias("penalty")), lambda c, inside, plan, g: (float(c[pop][inside].sum()) / target - 1) ** 2, (pop,))


def grp_pow(strength: float, group: str, total: str = "pop", to_group: float = 0.5, to_other: float = 0.5, power: float = 1.0) -> Penalty:
    return Penalty("grp_pow", strength, _share(group, total, lambda s: F.pow(F.abs(s - to_group) * F.abs(s - to_other), F.lit(power))), **_local_share(group, (total,), lambda s: (abs(s - to_group) * abs(s - to_other)) ** power))


def _nearest(s: Column, targets: list[float]) -> Column:
    """The nearest target; of two equally near the later."""
    best = F.lit(targets[0])
    for t in targets[1:]:
        best = F.when(F.abs(s - t) <= F.abs(s - best), F.lit(t)).otherwise(best)
    return best


def grp_hinge(strength: float, group: str, total: str = "pop", targets: tuple[float, ...] = (0.55,)) -> Penalty:
    return Penalty("grp_hinge", strength, _share(group, total, lambda s: F.sqrt(F.greatest(_nearest(s, list(targets)) - s, F.lit(0.0)))), **_local_share(group, (total,), lambda s: max(_local_nearest(s, targets) - s, 0.0) ** 0.5))


def grp_inv_hinge(strength: float, group: str, total: str = "pop", targets: tuple[float, ...] = (0.55,)) -> Penalty:
    return Penalty("grp_inv_hinge", strength, _share(group, total, lambda s: F.sqrt(F.greatest(s - _nearest(s, list(targets)), F.lit(0.0)))), **_local_share(group, (total,), lambda s: max(s - _local_nearest(s, targets), 0.0) ** 0.5))


def compet(strength: float, dvote: str, rvote: str, power: float = 0.5) -> Penalty:
    return Penalty("compet", strength, _share(dvote, F.col(dvote) + F.col(rvote), lambda s: F.pow(F.abs(s - 0.5) * F.abs(s - 0.5), F.lit(power))), **_local_share(dvote, (dvote, rvote), lambda s: abs(s - 0.5) ** (2 * power)))


def segregation(strength: float, group: str, total: str = "pop") -> Penalty:
    def of(asg: DataFrame, units: DataFrame) -> DataFrame:
        both = tally.tally(asg, units, g=group, t=total)
        every = W.partitionBy("draw")
        T, P = F.sum("t").over(every), F.sum("g").over(every) / F.sum("t").over(every)
        return both.select(*BY, (F.col("t") * F.abs(tally.share("g", "t") - P) / (2 * T * P * (1 - P))).alias("penalty"))

    def local(c: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        g_, t = float(c[group].sum()), float(c[total].sum())
        own, p = float(c[total][inside].sum()), g_ / t
        return own * abs((float(c[group][inside].sum()) / own if own else 0.0) - p) / (2 * t * p * (1 - p))

    return Penalty("segregation", strength, of, local, (group, total))


def status_quo(strength: float, plan: DataFrame, ndists: int, pop: str = "pop") -> Penalty:
    """Entropy of a district's population over the current districts, scaled."""

    def of(asg: DataFrame, units: DataFrame) -> DataFrame:
        joint = overlap.joint_population(asg, plan, units, pop)
        n = plan.select(F.countDistinct("district").alias("n")).first()["n"]
        f = F.col("p") / F.sum("p").over(W.partitionBy(*BY))
        return joint.withColumn("f", f).groupBy(*BY).agg((-F.sum(F.when(F.col("f") > 0, F.col("f") * F.log("f"))) / ndists / F.log(F.lit(float(n)))).alias("penalty"))

    def given() -> dict:
        return {"status_quo": np.array([r["district"] for r in plan.orderBy("unit_id").collect()])}

    def local(c: dict, inside: np.ndarray, plan_: np.ndarray, g) -> float:
        current = c["status_quo"]
        p = np.array([float(c[pop][inside & (current == d)].sum()) for d in np.unique(current)])
        f = p[p > 0] / p.sum()
        return float(-(f * np.log(f)).sum() / ndists / np.log(len(np.unique(current))))

    return Penalty("status_quo", strength, of, local, (pop,), given)


def incumbency(strength: float, incumbents: DataFrame) -> Penalty:
    """Incumbents (unit_id) in a district beyond the first."""

    def of(asg: DataFrame, units: DataFrame) -> DataFrame:
        n = asg.join(small(incumbents.select("unit_id").withColumn("here", F.lit(1))), "unit_id", "left").groupBy(*BY).agg(F.count("here").alias("n"))
        return n.select(*BY, F.greatest(F.col("n") - 1, F.lit(0)).cast("double").alias("penalty"))

    def given() -> dict:
        return {"incumbents": [r["unit_id"] for r in incumbents.select("unit_id").collect()]}

    def local(c: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        return max(float(inside[c["incumbents"]].sum()) - 1, 0.0)

    return Penalty("incumbency", strength, of, local, (), given)


def splits(strength: float, county: str = "county", kind: str = "splits") -> Penalty:
    """Split counties that a district touches: ``splits`` (2 districts or more), ``multisplits`` (3 or more), ``total_splits`` (districts beyond the first)."""
    value = {"splits": (F.col("n") > 1).cast("double"), "multisplits": (F.col("n") > 2).cast("double"), "total_splits": (F.col("n") - 1).cast("double")}[kind]

    def of(asg: DataFrame, units: DataFrame) -> DataFrame:
        n = tally.county_pieces(asg, units, county)
        touched = tally.placed(asg, units, county).select(*BY, county).distinct()
        return touched.join(n, ["draw", county]).groupBy(*BY).agg(F.sum(value).alias("penalty"))

    def local(c: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        found = [len(set(plan[(c[county] == k) & (plan > 0)].tolist())) for k in set(c[county][inside].tolist())]
        return float(sum({"splits": n > 1, "multisplits": n > 2, "total_splits": n - 1}[kind] for n in found))

    return Penalty(kind, strength, of, local, (county,))


def polsby(strength: float, perimeters: DataFrame, area: str = "area") -> Penalty:
    def given() -> dict:
        return {"borders": np.array([(r["from_id"], r["to_id"], r["edge"]) for r in perimeters.select("from_id", "to_id", "edge").collect()], float)}

    def local(c: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        beside, own = c["borders"][:, 0].astype(int), c["borders"][:, 1].astype(int)
        out = c["borders"][inside[own] & ((beside < 0) | ~inside[beside]), 2].sum()
        return 1 - 4 * 3.14159265 * float(c[area][inside].sum()) / out**2

    return Penalty("polsby", strength, lambda a, u: tally.polsby_popper(a, u, perimeters, area).select(*BY, (1 - F.col("polsby")).alias("penalty")), local, (area,), given)


def spread(strength: float, denominator: float = 1.0, pop: str = "pop", x: str = "gx", y: str = "gy") -> Penalty:
    def local(c: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        w, px, py = (c[k][inside].astype(float) for k in (pop, x, y))
        return float((w.sum() * (w * (px**2 + py**2)).sum() - (w * px).sum() ** 2 - (w * py).sum() ** 2) / denominator)

    return Penalty("spread", strength, lambda a, u: tally.squared_spread(a, u, x, y, pop, denominator).select(*BY, F.col("spread").alias("penalty")), local, (pop, x, y))


def edges_removed(strength: float, edges: DataFrame) -> Penalty:
    """Edges that leave the district, half of each counted on either side."""

    def of(asg: DataFrame, units: DataFrame) -> DataFrame:
        cut = graph.cut_edges(edges, asg).select("draw", F.explode(F.array("a", "b")).alias("district")).groupBy(*BY).agg((F.count(F.lit(1)) / 2).alias("penalty"))
        return asg.select(*BY).distinct().join(cut, BY, "left").select(*BY, F.coalesce("penalty", F.lit(0.0)).alias("penalty"))

    def local(c: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        return sum(int((~inside[g.near[v]]).sum()) for v in np.flatnonzero(inside)) / 2

    return Penalty("edges_removed", strength, of, local)


def log_st(strength: float, edges: DataFrame, county: str | None = None) -> Penalty:
    """Log number of spanning trees of each district, in two levels with ``county``; those of a plan are their sum."""

    def local(c: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        ids = np.flatnonzero(inside).tolist()
        pairs = [(v, int(w)) for v in ids for w in g.near[v] if inside[w] and v < w]
        return graph.two_level_trees(ids, pairs, {v: c[county][v] for v in ids} if county else None) or 0.0

    return Penalty("log_st", strength, lambda a, u: graph.log_trees(edges, a, u if county else None, county).select(*BY, F.col("log_trees").alias("penalty")), local, (county,) if county else ())


def qps(strength: float, cities: str, ndists: int, pop: str = "pop") -> Penalty:
    """Cities (0: none) in parts: sum of p (1 - p) over a city's shares, by districts, and the log of the number of cities."""

    def of(asg: DataFrame, units: DataFrame) -> DataFrame:
        own = tally.placed(asg, units, cities, pop).filter(F.col(cities) > 0).groupBy(*BY, cities).agg(F.sum(pop).alias("p"))
        share = F.col("p") / F.sum("p").over(W.partitionBy("draw", cities))
        told = own.select(*BY, cities, (share * (1 - share)).alias("v")).groupBy(*BY).agg((F.sum("v") / ndists + F.log(F.count(F.lit(1)).cast("double"))).alias("penalty"))
        return asg.select(*BY).distinct().join(told, BY, "left").select(*BY, F.coalesce("penalty", F.lit(0.0)).alias("penalty"))

    def local(c: dict, inside: np.ndarray, plan: np.ndarray, g) -> float:
        own = np.unique(c[cities][inside & (c[cities] > 0)])
        share = np.array([float(c[pop][inside & (c[cities] == k)].sum()) / float(c[pop][c[cities] == k].sum()) for k in own])
        return float((share * (1 - share)).sum() / ndists + np.log(len(own))) if len(own) else 0.0

    return Penalty("qps", strength, of, local, (cities, pop))


def custom(name: str, strength: float, fn: Callable[[DataFrame, DataFrame], DataFrame], local: Callable | None = None, needs: tuple[str, ...] = ()) -> Penalty:
    """A user's own penalty: ``fn`` over the whole ensemble at once, ``local`` for one district inside a sampler."""
    return Penalty(name, strength, fn, local, needs)


def evaluate(asg: DataFrame, units: DataFrame, penalties: list[Penalty]) -> DataFrame:
    """draw, penalty: the weighted sum over districts and constraints."""
    parts = [p.of(asg, units).select("draw", (F.col("penalty") * p.strength).alias("v")) for p in penalties]
    return reduce(DataFrame.union, parts).groupBy("draw").agg(F.sum("v").alias("penalty"))


@dataclass(frozen=True)
class Scorer:
    of: Callable[[DataFrame], DataFrame]  # assignments -> draw, score

    def _with(self, other: Scorer | float, fn: Callable[[Column, Column], Column]) -> Scorer:
        if isinstance(other, Scorer):
            return Scorer(lambda a: self.of(a).join(other.of(a).withColumnRenamed("score", "o"), "draw").select("draw", fn(F.col("score"), F.col("o")).alias("score")))
        return Scorer(lambda a: self.of(a).select("draw", fn(F.col("score"), F.lit(float(other))).alias("score")))

    def __add__(self, other: Scorer | float) -> Scorer:
        return self._with(other, lambda x, y: x + y)

    def __sub__(self, other: Scorer | float) -> Scorer:
        return self._with(other, lambda x, y: x - y)

    def __mul__(self, other: Scorer | float) -> Scorer:
        return self._with(other, lambda x, y: x * y)

    __rmul__ = __mul__


def stack(**scorers: Scorer) -> Callable[[DataFrame], DataFrame]:
    """Several scores of a draw side by side."""

    def of(asg: DataFrame) -> DataFrame:
        parts = [s.of(asg).withColumnRenamed("score", n) for n, s in scorers.items()]
        return reduce(lambda x, y: x.join(y, "draw"), parts)

    return of


def score_frac_kept(edges: DataFrame) -> Scorer:
    return Scorer(lambda a: graph.edges_removed(edges, a).select("draw", F.col("frac_kept").alias("score")))


def score_group_share(units: DataFrame, group: str, total: str = "pop", k: int = 1) -> Scorer:
    return Scorer(lambda a: labels.kth(tally.group_share(a, units, group, total), "share", k).select("draw", F.col("value").alias("score")))


def score_pop_dev(units: DataFrame, pop: str = "pop") -> Scorer:
    return Scorer(lambda a: tally.parity(a, units, pop).select("draw", F.col("parity").alias("score")))


def score_splits(units: DataFrame, county: str = "county", multi: bool = False) -> Scorer:
    def of(a: DataFrame) -> DataFrame:
        return tally.county_pieces(a, units, county).groupBy("draw").agg(F.avg((F.col("n") > (2 if multi else 1)).cast("int")).alias("score"))

    return Scorer(of)


def score_polsby(units: DataFrame, perimeters: DataFrame, area: str = "area", k: int = 1) -> Scorer:
    return Scorer(lambda a: labels.kth(tally.polsby_popper(a, units, perimeters, area), "polsby", k, largest=False).select("draw", F.col("value").alias("score")))


def score_status_quo(units: DataFrame, plan: DataFrame, ndists: int, pop: str = "pop") -> Scorer:
    return Scorer(lambda a: overlap.information_to(a, plan, units, pop).select("draw", (1 - F.col("vi") / 2 / F.log(F.lit(float(ndists)))).alias("score")))


def penalty_curve(penalty: Callable[[Column], Column], spark) -> DataFrame:
    """A penalty of a share along 0..1 in steps of 0.001."""
    return spark.range(1001).select((F.col("id") / 1000).alias("share")).withColumn("penalty", penalty(F.col("share")))
