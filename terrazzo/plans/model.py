"""Maps and ensembles of plans as DataFrames.

A map is ``units`` (one row per unit, with ``unit_id``) and ``edges`` (src, dst, both
directions). An ensemble is ``assignments`` (draw, unit_id, district), ``stats`` (draw,
district and any columns) and ``draws`` (draw, draw_name, is_ref, chain, wgt). Verbs return
new objects; nothing runs until an action.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import nearest
from ..operators.sizes import small
from ..sources.shared import shared_table

#: Names searched for the population column, in this order.
POPULATION_NAMES = ("pop", "population", "total_pop", "POP100")


@dataclass(frozen=True)
class PlanMap:
    units: DataFrame
    edges: DataFrame
    ndists: int
    bounds: tuple[float, float, float]
    pop: str = "pop"
    existing: str | None = None
    merge_index: DataFrame | None = None

    def __repr__(self) -> str:
        return f"PlanMap({self.ndists} districts, population '{self.pop}' in [{self.bounds[0]:g}, {self.bounds[2]:g}], existing {self.existing})"

    @property
    def target(self) -> float:
        return self.bounds[1]

    @property
    def pop_tol(self) -> float:
        """The smaller of both sides' relative tolerances."""
        low, target, high = self.bounds
        return min(1 - low / target, high / target - 1)

    def with_pop_tol(self, tol: float) -> PlanMap:
        return replace(self, bounds=(self.target * (1 - tol), self.target, self.target * (1 + tol)))

    def with_edges(self, edges: DataFrame) -> PlanMap:
        """Another graph over the same units; ids are shifted so that the least is 0."""
        least = edges.agg(F.min("src").alias("low"))
        return replace(self, edges=edges.crossJoin(F.broadcast(least)).select((F.col("src") - F.col("low")).alias("src"), (F.col("dst") - F.col("low")).alias("dst")))

    def existing_plan(self) -> DataFrame:
        if self.existing is None:
            raise ValueError("the map has no existing plan")
        return self.units.select("unit_id", F.col(self.existing).alias("district"))

    # verbs over units
    def mutate(self, **columns: Column) -> PlanMap:
        return replace(self, units=self.units.withColumns(columns))

    def select(self, *columns: str) -> PlanMap:
        needed = {"unit_id", self.pop, *([self.existing] if self.existing else [])}
        if missing := needed - set(columns):
            raise ValueError(f"a map needs {sorted(missing)}")
        return replace(self, units=self.units.select(*columns))

    def rename(self, **names: str) -> PlanMap:
        """``new=old``; roles follow."""
        units, pop, existing = self.units, self.pop, self.existing
        for new, old in names.items():
            units = units.withColumnRenamed(old, new)
            pop, existing = (new if old == pop else pop), (new if old == existing else existing)
        return replace(self, units=units, pop=pop, existing=existing)

    def filter(self, condition: Column) -> PlanMap:
        """The units that match and the edges among them, with ids made dense; bounds stay."""
        kept = self.units.filter(condition)
        ids = dense_ids(kept.select("unit_id"))
        units = kept.join(ids, "unit_id").drop("unit_id").withColumnRenamed("new_id", "unit_id")
        ndists = self.ndists
        if self.existing:
            ndists = units.select(F.countDistinct(self.existing).alias("n")).first()["n"]
        return replace(self, units=units, edges=reduce_edges(self.edges, ids), ndists=ndists, merge_index=None)

    def transmute(self, **columns: Column) -> PlanMap:
        """Only these columns, besides the ones that a map needs."""
        needed = ["unit_id", self.pop, *([self.existing] if self.existing else [])]
        return replace(self, units=self.units.select(*needed, *[c.alias(n) for n, c in columns.items() if n not in needed]))

    def arrange(self, *keys: str | Column) -> PlanMap:
        """Units listed by ``keys``; ids, and so the graph and all plans, stay as they are."""
        return replace(self, units=self.units.orderBy(*keys))

    def distinct(self, *keys: str) -> PlanMap:
        """The first unit (by id) of each combination of ``keys``, with the edges among them."""
        first = self.units.groupBy(*keys).agg(F.min("unit_id").alias("unit_id")).select("unit_id").withColumn("_first", F.lit(True))
        marked = replace(self, units=self.units.join(first, "unit_id", "left"))
        kept = marked.filter(F.col("_first"))
        return replace(kept, units=kept.units.drop("_first"))

    def slice(self, low: int, high: int) -> PlanMap:
        return self.filter(F.col("unit_id").between(low, high))

    def take(self, *ids: int) -> PlanMap:
        """Units by id, in any order and number."""
        return self.filter(F.col("unit_id").isin(*ids))

    def join(self, other: DataFrame, on: str | list[str], how: str = "left") -> PlanMap:
        return replace(self, units=self.units.join(other, on, how))

    def summarise(self, keys: Sequence[str], *aggregates: Column) -> PlanMap:
        """One unit per key combination, the quotient graph, and the index back to old units."""
        groups = self.units.select(*keys, "unit_id").withColumn("group", F.min("unit_id").over(W.partitionBy(*keys)))
        ids = dense_ids(groups.select(F.col("group").alias("unit_id")).distinct())
        index = groups.join(ids, groups["group"] == ids["unit_id"]).select(groups["unit_id"].alias("unit_id"), F.col("new_id").alias("merged_unit_id"))
        units = self.units.join(index, "unit_id").groupBy(F.col("merged_unit_id").alias("unit_id"), *keys).agg(F.sum(self.pop).alias(self.pop), *aggregates)
        return replace(self, units=units, edges=quotient_edges(self.edges, index), merge_index=index, existing=self.existing if self.existing in units.columns else None)

    def bounds_hold(self) -> bool:
        return self.bounds[0] < self.bounds[1] < self.bounds[2]

    def problems(self) -> list[str]:
        """What keeps this from being a map: bounds, missing or odd columns, one-way edges, ends without a unit."""
        out = [] if self.bounds_hold() else ["bounds are not lower < target < upper"]
        kinds = dict(self.units.dtypes)
        out += [f"{c} is not a numeric column" for c in (self.pop, self.existing) if c and kinds.get(c, "string") == "string"]
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if self.edges.join(back, ["src", "dst"], "left_anti").limit(1).count():
            out.append("an edge has no way back")
        if self.edges.join(self.units.select(F.col("unit_id").alias("src")), "src", "left_anti").limit(1).count():
            out.append("an edge ends in no unit")
        return out

    def subset(self, condition: Column, ndists: int) -> PlanMap:
        """The units that match as a map of ``ndists`` districts of its own, under the tolerance of this one."""
        kept, tol = self.filter(condition), self.pop_tol
        target = kept.units.agg(F.sum(self.pop).alias("p")).first()["p"] / ndists
        return replace(kept, ndists=ndists, bounds=(target * (1 - tol), target, target * (1 + tol)))


def check_kinds(**wanted: tuple[object, type]) -> None:
    """Raise ``TypeError`` for every argument (name=(value, kind)) of another kind."""
    wrong = [f"{name} must be {kind.__name__}, not {type(value).__name__}" for name, (value, kind) in wanted.items() if not isinstance(value, kind)]
    if wrong:
        raise TypeError("; ".join(wrong))


def build_map(units: DataFrame, edges: DataFrame | None = None, ndists: int | None = None, existing: str | None = None, pop_tol: float | None = None, pop: str | None = None, corners: DataFrame | None = None) -> PlanMap:
    """A map with inferred roles: population by name, districts from the existing plan, tolerance 1 % or its parity.

    Without ``edges`` the graph comes from outlines: ``corners`` with unit_id, ring, pos, x, y.
    """
    check_kinds(units=(units, DataFrame))
    if edges is None:
        if corners is None:
            raise ValueError("either edges or corners of outlines are needed")
        check_kinds(corners=(corners, DataFrame))
        edges = shared_table(nearest.adjacency_of_outlines(corners))
    check_kinds(edges=(edges, DataFrame))
    pop = pop or next((c for c in POPULATION_NAMES if c in units.columns), None)
    if pop is None:
        raise ValueError(f"no population column among {POPULATION_NAMES}")
    if dict(units.dtypes)[pop] == "string":
        raise ValueError("population must be numeric")
    total = units.agg(F.sum(pop).alias("p"), F.count(F.when(F.col(pop).isNull(), 1)).alias("missing")).first()
    if total["missing"]:
        raise ValueError("population has missing values")
    by = units.groupBy(existing).agg(F.sum(pop).alias("p")) if existing else None
    if ndists is None:
        if by is None:
            raise ValueError("either ndists or an existing plan is needed")
        ndists = by.count()
    target = total["p"] / ndists
    if pop_tol is None:
        worst = by.agg(F.max(F.abs(F.col("p") / target - 1)).alias("d")).first()["d"] if by is not None else None
        pop_tol = max(worst, 1e-9) if worst is not None else 0.01
    return PlanMap(units, edges, ndists, (target * (1 - pop_tol), target, target * (1 + pop_tol)), pop, existing)


def dense_ids(ids: DataFrame) -> DataFrame:
    """unit_id -> new_id, 0.. in order of unit_id.

    Ranks come from ranges: rows are counted by range, and the offsets joined back, so no
    window runs over all rows.
    """
    ranged = ids.withColumn("block", F.floor(F.col("unit_id") / 65_536))
    counts = ranged.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # one row for 65,536 units
    before = counts.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("before"))
    own = ranged.withColumn("k", F.row_number().over(W.partitionBy("block").orderBy("unit_id")) - 1)
    return own.join(small(before), "block").select("unit_id", (F.col("k") + F.col("before")).cast("int").alias("new_id"))


def reduce_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The induced subgraph under unit_id -> new_id."""
    a, b = (ids.select(F.col("unit_id").alias(c), F.col("new_id").alias(f"new_{c}")) for c in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def quotient_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges between groups (unit_id -> merged_unit_id), without loops and copies."""
    return reduce_edges(edges, index.withColumnRenamed("merged_unit_id", "new_id")).filter("src <> dst").distinct()


@dataclass(frozen=True)
class Ensemble:
    assignments: DataFrame
    stats: DataFrame
    draws: DataFrame
    map: PlanMap
    info: dict = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"Ensemble({self.map.ndists} districts, {self.info or 'no sampling information'})"

    def mutate(self, **columns: Column) -> Ensemble:
        return replace(self, stats=self.stats.withColumns(columns))

    def filter(self, condition: Column) -> Ensemble:
        """District rows that match; draws without any row left go."""
        stats = self.stats.filter(condition)
        return self._only(stats.select("draw").distinct(), stats)

    def _only(self, draws: DataFrame, stats: DataFrame | None = None) -> Ensemble:
        keep = lambda df: df.join(draws, "draw", "left_semi")
        return replace(self, assignments=keep(self.assignments), stats=keep(self.stats) if stats is None else stats, draws=keep(self.draws))

    def transmute(self, **columns: Column) -> Ensemble:
        return replace(self, stats=self.stats.select("draw", "district", *[c.alias(n) for n, c in columns.items() if n not in ("draw", "district")]))

    def arrange(self, *keys: str | Column) -> Ensemble:
        """Statistics listed by ``keys``; everything is keyed by (draw, district), so no order is relied on."""
        return replace(self, stats=self.stats.orderBy(*keys))

    def distinct(self, *keys: str) -> Ensemble:
        """The first row (by draw and district) of each combination of ``keys``; draws without a row go."""
        first = self.stats.groupBy(*keys).agg(F.min(F.struct("draw", "district")).alias("_at")).select("_at.draw", "_at.district")
        stats = self.stats.join(first, ["draw", "district"], "left_semi")
        return self._only(stats.select("draw").distinct(), stats)

    def slice(self, low: int, high: int) -> Ensemble:
        """Rows ``low`` to ``high`` of the statistics, by draw and district."""
        n = self.map.ndists
        return self.filter(((F.col("draw") - 1) * n + F.col("district")).between(low, high))

    def with_assignments(self, assignments: DataFrame) -> Ensemble:
        """Other plans under the same draws, with the population tally done anew; other statistics go."""
        return ensemble(assignments, self.map, self.draws, **self.info)

    def acceptance_rate(self) -> DataFrame:
        """Share of steps that moved, by chain; null where the sampler doesn't note moves."""
        moved = F.col("moved").cast("int") if "moved" in self.draws.columns else F.lit(None).cast("int")
        return self.draws.groupBy("chain").agg(F.avg(moved).alias("rate"))

    def sampling_info(self) -> dict:
        """What is known of the sampling: its arguments, and districts, population column and bounds of the map."""
        return {**self.info, "ndists": self.map.ndists, "pop": self.map.pop, "bounds": self.map.bounds, "existing": self.map.existing}

    def sampled(self) -> Ensemble:
        return self._only(self.draws.filter(~F.col("is_ref")).select("draw"))

    def references(self) -> Ensemble:
        return self._only(self.draws.filter("is_ref").select("draw"))

    def thin(self, warmup: int = 0, every: int = 1) -> Ensemble:
        return self._only(self.draws.filter((F.col("draw") > warmup) & ((F.col("draw") - warmup - 1) % every == 0)).select("draw"))

    def last(self) -> DataFrame:
        """The assignment of the last draw."""
        top = self.draws.agg(F.max("draw").alias("draw"))
        return self.assignments.join(F.broadcast(top), "draw").select("unit_id", "district")

    def matrix(self) -> DataFrame:
        """draw and the array of its districts by unit."""
        return self.assignments.groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "district"))), lambda x: x["district"]).alias("plan"))

    def weights(self) -> DataFrame:
        return self.draws.select("draw", "wgt")

    def unit(self, unit_id: int) -> DataFrame:
        return self.assignments.filter(F.col("unit_id") == unit_id).select("draw", "district")

    def n_references(self) -> int:
        return self.draws.filter("is_ref").count()

    def join(self, other: DataFrame, on: str | list[str], how: str = "left") -> Ensemble:
        return replace(self, stats=self.stats.join(other, on, how))

    def summarise(self, keys: Sequence[str], *aggregates: Column) -> DataFrame:
        return self.stats.groupBy(*keys).agg(*aggregates)

    def pipe(self, fn: Callable, *args, **kwargs):
        return fn(self, *args, **kwargs)

    def pull_back(self) -> DataFrame:
        """Assignments of the units before the map was merged."""
        if self.map.merge_index is None:
            raise ValueError("the map was not merged")
        own = self.assignments.withColumnRenamed("unit_id", "merged_unit_id")
        return self.map.merge_index.join(own, "merged_unit_id").select("draw", "unit_id", "district")

    def is_valid(self) -> bool:
        """Labels start at 1 and every draw has the same largest label."""
        by = self.assignments.groupBy("draw").agg(F.min("district").alias("low"), F.max("district").alias("high"))
        found = by.agg(F.min("low").alias("a"), F.max("low").alias("b"), F.min("high").alias("c"), F.max("high").alias("d")).first()
        return found["a"] == found["b"] == 1 and found["c"] == found["d"]


def ensemble(assignments: DataFrame, map_: PlanMap, draws: DataFrame | None = None, **info) -> Ensemble:
    """An ensemble with its population tally; districts without units count 0.

    Labels that start at 0 are shifted to start at 1.
    """
    least = assignments.agg(F.min("district").alias("low"))
    shifted = assignments.crossJoin(F.broadcast(least)).select("draw", "unit_id", (F.col("district") + F.when(F.col("low") == 0, 1).otherwise(0)).cast("int").alias("district"))
    every = shifted.select("draw").distinct()
    if draws is None:
        draws = every.select("draw", F.lit(None).cast("string").alias("draw_name"), F.lit(False).alias("is_ref"), F.lit(1).alias("chain"), F.lit(None).cast("double").alias("wgt"))
    tally = shifted.join(small(map_.units.select("unit_id", map_.pop)), "unit_id").groupBy("draw", "district").agg(F.sum(map_.pop).alias("total_pop"))
    grid = every.select("draw", F.explode(F.sequence(F.lit(1), F.lit(map_.ndists))).alias("district"))
    stats = grid.join(tally, ["draw", "district"], "left").select("draw", "district", F.coalesce("total_pop", F.lit(0)).alias("total_pop"))
    return Ensemble(shifted, stats, draws, map_, info)


def from_arrays(plans: DataFrame, map_: PlanMap, **info) -> Ensemble:
    """From draw and plan (array of labels by unit)."""
    long = plans.select("draw", F.posexplode("plan").alias("unit_id", "district"))
    return ensemble(long, map_, **info)


def add_reference(plans: Ensemble, plan: DataFrame, name: str) -> Ensemble:
    """Prepend a named plan (unit_id, district) as draw 0; labels by first appearance, weight 0."""
    if plans.draws.filter(F.col("draw_name") == name).limit(1).count():
        raise ValueError(f"there is a draw named {name}")
    first = plan.groupBy("district").agg(F.min("unit_id").alias("first"))
    label = first.withColumn("label", F.row_number().over(W.orderBy("first")))  # districts of one plan: few rows
    own = plan.join(F.broadcast(label), "district").select(F.lit(0).alias("draw"), "unit_id", F.col("label").alias("district"))
    tally = own.join(plans.map.units.select("unit_id", plans.map.pop), "unit_id").groupBy("draw", "district").agg(F.sum(plans.map.pop).alias("total_pop"))
    draw = plans.draws.sparkSession.range(1).select(F.lit(0).alias("draw"), F.lit(name).alias("draw_name"), F.lit(True).alias("is_ref"), F.lit(None).cast("int").alias("chain"), F.lit(0.0).alias("wgt"))
    return replace(plans, assignments=own.unionByName(plans.assignments), stats=tally.unionByName(plans.stats, allowMissingColumns=True), draws=draw.unionByName(plans.draws))


def bind(first: Ensemble, *rest: Ensemble) -> Ensemble:
    """Ensembles of one map after one another; chain is the argument's number, draws are shifted."""
    out, shift = [], 0
    for k, e in enumerate((first, *rest), 1):
        if e.map.ndists != first.map.ndists or e.map.pop != first.map.pop:
            raise ValueError("ensembles of unlike maps")
        moved = F.col("draw") + shift
        out.append((e.assignments.withColumn("draw", moved), e.stats.withColumn("draw", moved), e.draws.withColumn("draw", moved).withColumn("chain", F.lit(k))))
        shift += e.draws.agg(F.max("draw").alias("n")).first()["n"] or 0
    parts = [list(x) for x in zip(*out, strict=True)]
    joined = []
    for p in parts:
        whole = p[0]
        for x in p[1:]:
            whole = whole.unionByName(x, allowMissingColumns=True)
        joined.append(whole)
    info = dict(first.info)
    if all("n_eff" in e.info for e in (first, *rest)):
        info["n_eff"] = sum(e.info["n_eff"] for e in (first, *rest))
    return Ensemble(*joined, first.map, info)
