"""Exact enumeration of connected partitions, as a loop of DataFrame steps over the units.

A state holds what later units need to know: the connected piece of every frontier unit, the
district of each piece, the weight of each open district and the number of closed ones. One
step decides the next unit: every state is expanded by all choices, and equal states meet in
a ``groupBy`` that adds their counts. States, not partitions, are the rows.

The states and choices also make a graph in which partitions are numbered paths: they are
listed, sampled evenly, found by number and numbered by walks through its layers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import cached_property, reduce
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_table

#: Units of a map whose partitions are enumerated, unit by unit.
MOST_UNITS = 10_000
State = tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...], int]  # pieces, districts, weights, closed


def _tidy(pieces: list[int], district: dict[int, int], weight: dict[int, int], closed: int) -> State:
    """The state with pieces and districts numbered by first appearance."""
    new_piece: dict[int, int] = {}
    new_district: dict[int, int] = {}
    for p in pieces:
        new_piece.setdefault(p, len(new_piece))
    for p in new_piece:
        new_district.setdefault(district[p], len(new_district))
    return tuple(new_piece[p] for p in pieces), tuple(new_district[district[p]] for p in new_piece), tuple(weight[d] for d in new_district), closed


def choices(state: State, beside: list[int], leaving: list[int], own: int, k: int, low: int, high: int) -> Iterator[tuple[int, State]]:
    """Districts of a new unit and the states after a unit of weight ``own`` joins: ``beside`` and ``leaving`` are frontier places, the new unit's the last."""
    pieces, districts, weights, closed = state
    for d in range(len(weights) + (len(weights) + closed < k)):
        weight = dict(enumerate(weights))
        weight[d] = weight.get(d, 0) + own
        if weight[d] > high:
            continue
        now, district, fresh = list(pieces), dict(enumerate(districts)), len(districts)
        district[fresh] = d
        touched = {pieces[i] for i in beside if districts[pieces[i]] == d}
        now = [fresh if p in touched else p for p in now] + [fresh]
        done, fine = closed, True
        for i in leaving:
            p = now[i]
            now[i] = -1
            if p in now:
                continue
            # the piece left the frontier: its district must be this piece alone, and heavy enough
            if any(q >= 0 and q != p and district[q] == district[p] for q in now) or weight[district[p]] < low:
                fine = False
                break
            done += 1
        if fine:
            yield d, _tidy([p for p in now if p >= 0], district, weight, done)


def _text(state: State) -> str:
    return ";".join(",".join(map(str, x)) for x in (*state[:3], (state[3],)))


def _state(text: str) -> State:
    a, b, c, d = (tuple(int(x) for x in part.split(",") if x) for part in text.split(";"))
    return a, b, c, d[0]


def _steps(edges: DataFrame, units: DataFrame, weight: str) -> list[tuple[int, list[int], list[int], int]]:
    """Unit by unit: the unit, its frontier neighbours' places, places that leave, its weight. The map is one small graph."""
    load = {r["unit_id"]: int(r["w"]) for r in units.select("unit_id", F.col(weight).alias("w")).limit(MOST_UNITS + 1).collect()}
    if len(load) > MOST_UNITS:
        raise ValueError(f"a map of more than {MOST_UNITS} units")
    near: dict[int, set[int]] = {v: set() for v in load}
    for r in edges.collect():
        near[r["src"]].add(r["dst"])
    order, seen = [], set()
    while len(order) < len(load):  # breadth first keeps the frontier short
        queue = [min(set(load) - seen)]
        seen.add(queue[0])
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in sorted(near[v] - seen):
                seen.add(w)
                queue.append(w)
    at = {v: i for i, v in enumerate(order)}
    front: list[int] = []
    out = []
    for i, v in enumerate(order):
        beside = [k for k, w in enumerate(front) if w in near[v]]
        front.append(v)
        leaving = [k for k, w in enumerate(front) if all(at[x] <= i for x in near[w])]
        out.append((v, beside, leaving, load[v]))
        front = [w for k, w in enumerate(front) if k not in leaving]
    return out


def count_partitions(spark: SparkSession, edges: DataFrame, units: DataFrame, k: int, weight: str, low: int, high: int) -> DataFrame:
    """One row ``n``: connected partitions into k districts of weights within [low, high]."""
    states = spark.createDataFrame([(_text(((), (), (), 0)),)], "state string").select("state", F.lit(1).cast("decimal(38,0)").alias("n"))
    for _, beside, leaving, own in _steps(edges, units, weight):

        def expand(batches, beside=beside, leaving=leaving, own=own):
            for pdf in batches:
                out = [(_text(s), n) for t, n in zip(pdf["state"], pdf["n"]) for _, s in choices(_state(t), beside, leaving, own, k, low, high)]
                yield pd.DataFrame(out, columns=["state", "n"])

        states = shared_table(states.mapInPandas(expand, "state string, n decimal(38,0)").groupBy("state").agg(F.sum("n").cast("decimal(38,0)").alias("n")))
    return states.filter(F.col("state") == _text(((), (), (), k))).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


_FIRST = ((), (), (), 0)


def _labels(path: list[int], steps: list[tuple[int, list[int], list[int], int]]) -> list[int]:
    """Districts by unit (from 1, by unit order) that a path of choices stands for."""
    out = [0] * len(steps)
    front: list[tuple[int, int]] = []  # piece and true district of each frontier place
    fresh = made = 0
    for d, (v, beside, leaving, _) in zip(path, steps, strict=True):
        named: list[int] = []  # districts as the state numbers them: by their first piece's place
        for _, t in front:
            if t not in named:
                named.append(t)
        if d < len(named):
            true = named[d]
        else:
            true, made = made, made + 1
        fresh += 1
        touched = {front[i][0] for i in beside if front[i][1] == true}
        front = [(fresh, t) if p in touched else (p, t) for p, t in front] + [(fresh, true)]
        out[v] = true
        front = [x for i, x in enumerate(front) if i not in leaving]
    order: dict[int, int] = {}
    return [order.setdefault(t, len(order) + 1) for t in out]


def _path(plan: list[int], steps: list[tuple[int, list[int], list[int], int]], k: int, low: int, high: int) -> list[tuple[str, int]] | None:
    """States and choices that lead to a plan (labels by unit), or None if they don't."""
    state, front, out = _FIRST, [], []
    for v, beside, leaving, own in steps:
        named: list[int] = []
        for t in front:
            if t not in named:
                named.append(t)
        d = named.index(plan[v]) if plan[v] in named else len(named)
        after = dict(choices(state, beside, leaving, own, k, low, high)).get(d)
        if after is None:
            return None
        out.append((_text(state), d))
        front = [x for i, x in enumerate([*front, plan[v]]) if i not in leaving]
        state = after
    return out if state == ((), (), (), k) else None


def _plans(paths: DataFrame, steps: list[tuple[int, list[int], list[int], int]]) -> DataFrame:
    """draw, plan from draw, path."""

    def name(batches):
        for pdf in batches:
            yield pd.DataFrame([(r, _labels(list(p), steps)) for r, p in zip(pdf["draw"], pdf["path"])], columns=["draw", "plan"])

    return paths.mapInPandas(name, "draw long, plan array<int>")


_COUNT = "decimal(38,0)"


class PartitionDag:
    """All connected partitions of a map, as a graph of states in layers.

    Nodes are what the units so far leave open, edges the choices of the next unit's district.
    Each edge knows how many partitions lie behind it and behind the choices before it, so
    partitions are numbered from 0 and any of them can be found by its number, or its number
    from its labels, without a row for every partition: the tables grow with states.
    """

    def __init__(self, spark: SparkSession, edges: DataFrame, units: DataFrame, k: int, weight: str, low: int, high: int) -> None:
        self.spark, self.k, self.low, self.high = spark, k, low, high
        self.steps = _steps(edges, units, weight)
        self.end = _text(((), (), (), k))
        nodes, ways = spark.createDataFrame([(_text(_FIRST),)], "state string"), []
        for _, beside, leaving, own in self.steps:

            def expand(batches, beside=beside, leaving=leaving, own=own):
                for pdf in batches:
                    out = [(t, d, _text(s)) for t in pdf["state"] for d, s in choices(_state(t), beside, leaving, own, k, low, high)]
                    yield pd.DataFrame(out, columns=["was", "d", "state"])

            ways.append(shared_table(nodes.mapInPandas(expand, "was string, d int, state string")))
            nodes = ways[-1].select("state").distinct()
        behind = spark.createDataFrame([(self.end,)], "state string").withColumn("n", F.lit(1).cast(_COUNT))
        #: A layer's edges: was, d, state, and ``a`` (partitions before them) up to ``z``, of those behind ``was``.
        self.layers: list[DataFrame] = []
        before = W.partitionBy("was").orderBy("d")  # as many rows as a unit has choices
        for own in reversed(ways):
            met = own.join(behind, "state").select("was", "d", "state", "n", F.sum("n").over(before).cast(_COUNT).alias("z"))
            self.layers.append(shared_table(met.select("was", "d", "state", (F.col("z") - F.col("n")).cast(_COUNT).alias("a"), "z")))
            behind = self.layers[-1].groupBy(F.col("was").alias("state")).agg(F.max("z").alias("n"))
        self.layers.reverse()

    @cached_property
    def count(self) -> int:
        """How many partitions there are."""
        return int((self.layers[0].agg(F.max("z").alias("n")).first()["n"] or 0) if self.layers else 0)

    def at(self, ranks: DataFrame) -> DataFrame:
        """draw, plan of the partitions with given numbers (draw, rank); numbers beyond the last give no row."""
        walk = ranks.select("draw", F.col("rank").cast(_COUNT).alias("rank"), F.lit(_text(_FIRST)).alias("was"), F.array().cast("array<int>").alias("path"))
        for layer in self.layers:
            met = walk.join(layer, "was").filter((F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("z")))
            walk = shared_table(met.select("draw", (F.col("rank") - F.col("a")).cast(_COUNT).alias("rank"), F.col("state").alias("was"), F.concat("path", F.array("d")).alias("path")))
        return _plans(walk.select("draw", "path"), self.steps)

    def slice(self, first: int, n: int) -> DataFrame:
        """draw (the number), plan of ``n`` partitions from number ``first`` on."""
        upto = min(first + n, self.count)
        return self.at(self.spark.range(first, max(first, upto)).select(F.col("id").alias("draw"), F.col("id").alias("rank")))

    def sample(self, n: int, seed: int = 1) -> DataFrame:
        """draw, plan of ``n`` partitions with replacement, each as likely as any other."""
        total = self.count
        if not total:
            raise ValueError("there is no such partition")

        def draw(batches):
            for pdf in batches:
                yield pd.DataFrame({"draw": pdf["id"], "rank": [Decimal(Random(f"{seed}:{i}").randrange(total)) for i in pdf["id"]]})

        return self.at(self.spark.range(1, n + 1).mapInPandas(draw, f"draw long, rank {_COUNT}"))

    def rank(self, plans: DataFrame) -> DataFrame:
        """draw, rank of plans (draw, plan: labels by unit); plans that are none of the partitions have no row."""
        steps, k, low, high = self.steps, self.k, self.low, self.high

        def walk(batches):
            for pdf in batches:
                out = [(r, t, was, d) for r, p in zip(pdf["draw"], pdf["plan"]) for t, (was, d) in enumerate(_path(list(p), steps, k, low, high) or [])]
                yield pd.DataFrame(out, columns=["draw", "layer", "was", "d"])

        taken = shared_table(plans.select(F.col("draw").cast("long").alias("draw"), "plan").mapInPandas(walk, "draw long, layer int, was string, d int"))
        met = [taken.filter(F.col("layer") == t).join(own.select("was", "d", "a"), ["was", "d"]).select("draw", "a") for t, own in enumerate(self.layers)]
        return reduce(DataFrame.union, met).groupBy("draw").agg(F.sum("a").cast(_COUNT).alias("rank"))


def list_partitions(spark: SparkSession, edges: DataFrame, units: DataFrame, k: int, weight: str, low: int, high: int) -> DataFrame:
    """draw, plan: every connected partition; a row each, so for maps that have few."""
    dag = PartitionDag(spark, edges, units, k, weight, low, high)
    return dag.slice(0, dag.count)


def sample_partitions(spark: SparkSession, edges: DataFrame, units: DataFrame, k: int, weight: str, low: int, high: int, n: int, seed: int = 1) -> DataFrame:
    """draw, plan: ``n`` connected partitions, each as likely as any other, with replacement."""
    return PartitionDag(spark, edges, units, k, weight, low, high).sample(n, seed)
