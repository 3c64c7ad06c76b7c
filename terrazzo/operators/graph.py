"""Operators over the unit graph: components, quotients, cut edges, cores, colouring, trees."""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from .sizes import small


def same_label_edges(edges: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Edges whose ends share ``by`` and the group; groups: by..., unit_id, grp."""
    a = groups.select(*by, F.col("unit_id").alias("src"), "grp")
    b = groups.select(*by, F.col("unit_id").alias("dst"), F.col("grp").alias("other"))
    return a.join(small(edges), "src").join(b, [*by, "dst"]).filter("grp = other").select(*by, "src", "dst")


def components(edges: DataFrame, groups: DataFrame, by: list[str] | None = None, name: str = "component") -> DataFrame:
    """Number of each unit's connected piece within its group: 1, 2, ... by first unit.

    Labels spread along edges inside groups and jump to the label of their label, so the
    rounds grow with the log of a piece's width; each round is a table in the shared folder.
    """
    by = by or []
    inner = shared_table(same_label_edges(edges, groups, by))
    label = groups.select(*by, "unit_id", "grp", F.col("unit_id").alias("root"))
    while True:
        near = inner.join(label.select(*by, F.col("unit_id").alias("dst"), "root"), [*by, "dst"]).groupBy(*by, F.col("src").alias("unit_id")).agg(F.min("root").alias("near"))
        moved = label.join(near, [*by, "unit_id"], "left").select(*by, "unit_id", "grp", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("to"))
        jump = label.select(*by, F.col("unit_id").alias("to"), F.col("root").alias("beyond"))
        new = shared_table(moved.join(jump, [*by, "to"]).select(*by, "unit_id", "grp", "was", F.least("to", "beyond").alias("root")))
        label = new.drop("was")
        if not new.filter("was <> root").limit(1).count():
            break
    rank = F.dense_rank().over(W.partitionBy(*by, "grp").orderBy("root"))
    return label.select(*by, "unit_id", F.col("grp").alias("group"), rank.cast("int").alias(name))


def pieces(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """Connected pieces of each district: draw, district, n_pieces."""
    own = components(edges, assignments.withColumnRenamed("district", "grp"), ["draw"])
    return own.groupBy("draw", F.col("group").alias("district")).agg(F.max("component").cast("long").alias("n_pieces"))


def is_connected(edges: DataFrame, units: DataFrame) -> bool:
    whole = components(edges, units.select("unit_id", F.lit(1).alias("grp")))
    return whole.filter("component > 1").limit(1).count() == 0


#: Draws whose districts of a unit make one row.
SLOTS = 32


def unit_rows(assignments: DataFrame) -> DataFrame:
    """unit_id, block, plan: the unit's districts in draws ``SLOTS * block`` and on, null where a draw lacks it."""
    slot = F.pmod(F.col("draw"), F.lit(SLOTS))
    plan = F.array(*[F.max(F.when(slot == k, F.col("district"))) for k in range(SLOTS)])
    return assignments.groupBy("unit_id", F.floor(F.col("draw") / SLOTS).alias("block")).agg(plan.alias("plan"))


def cut_edges(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """Undirected edges between districts: draw, src, dst, a, b.

    Ends meet as rows of many draws, of which only those that differ become rows of their own.
    """
    rows = unit_rows(assignments)
    a = rows.select(F.col("unit_id").alias("src"), "block", F.col("plan").alias("a"))
    b = rows.select(F.col("unit_id").alias("dst"), "block", F.col("plan").alias("b"))
    met = a.join(small(edges.filter("src < dst")), "src").join(b.hint("merge"), ["block", "dst"])
    ends = F.transform(F.arrays_zip("a", "b"), lambda x, k: F.struct(k.alias("k"), x["a"].alias("a"), x["b"].alias("b")))
    cut = met.select("block", "src", "dst", F.explode(F.filter(ends, lambda x: x["a"] != x["b"])).alias("c"))
    draw = (F.col("block") * SLOTS + F.col("c.k")).cast(assignments.schema["draw"].dataType)
    return cut.select(draw.alias("draw"), "src", "dst", "c.a", "c.b")


def edges_removed(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cut edges and the share of edges kept, by draw."""
    total = edges.filter("src < dst").agg(F.count(F.lit(1)).alias("e"))
    n = assignments.select("draw").distinct().join(cut_edges(edges, assignments).groupBy("draw").agg(F.count(F.lit(1)).alias("n")), "draw", "left")
    return n.crossJoin(F.broadcast(total)).select("draw", F.coalesce("n", F.lit(0)).alias("removed"), (1 - F.coalesce("n", F.lit(0)) / F.col("e")).alias("frac_kept"))


def district_graph(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """Neighbouring districts a < b with the number of edges between them."""
    return cut_edges(edges, assignments).groupBy("draw", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n_edges"))


def boundary_units(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """Units with a neighbour in another district."""
    cut = cut_edges(edges, assignments)
    return cut.select("draw", F.explode(F.array("src", "dst")).alias("unit_id")).distinct()


def within_steps(edges: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """draw, unit_id: units up to ``steps`` edges from any of ``start`` (draw, unit_id), draw by draw.

    Breadth first in layers from all starts at once; only the newest layer spreads.
    """
    seen = layer = start.select("draw", "unit_id").distinct()
    for _ in range(steps):
        beyond = layer.withColumnRenamed("unit_id", "src").join(small(edges), "src").select("draw", F.col("dst").alias("unit_id")).distinct()
        layer = shared_table(beyond.join(seen, ["draw", "unit_id"], "left_anti"))
        seen = seen.union(layer)
    return seen


def cores(edges: DataFrame, assignments: DataFrame, within: int = 1, focus: int | None = None) -> DataFrame:
    """Core ids: interior units share an id with their piece of the district's interior.

    Units up to ``within`` steps from another district are on the boundary and stand alone.
    With ``focus``, only those in that district or up to ``within`` steps from it are; the
    boundary elsewhere belongs to the cores.
    """
    edge = within_steps(edges, boundary_units(edges, assignments), within - 1)
    if focus is not None:
        near = within_steps(edges, assignments.filter(F.col("district") == focus), within)
        edge = edge.join(near, ["draw", "unit_id"], "left_semi")
    marked = assignments.join(edge.withColumn("outer", F.lit(True)), ["draw", "unit_id"], "left").withColumn("outer", F.coalesce("outer", F.lit(False)))
    inner = marked.filter(~F.col("outer")).select("draw", "unit_id", F.col("district").alias("grp"))
    piece = components(edges, inner, ["draw"]).select("draw", "unit_id", F.col("component"))
    own = marked.join(piece, ["draw", "unit_id"], "left")
    first = F.when(F.col("outer"), F.col("unit_id")).otherwise(F.min("unit_id").over(W.partitionBy("draw", "district", "outer", "component")))
    return own.withColumn("first", first).select("draw", "unit_id", F.dense_rank().over(W.partitionBy("draw").orderBy("first")).cast("long").alias("core"))


def freeze(edges: DataFrame, plan: DataFrame, frozen: DataFrame) -> DataFrame:
    """Group ids of a plan (unit_id, district): connected frozen units of a district share one."""
    marked = plan.join(frozen.select("unit_id").withColumn("frozen", F.lit(True)), "unit_id", "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    piece = components(edges, marked.filter("frozen").select("unit_id", F.col("district").alias("grp")))
    own = marked.join(piece.select("unit_id", "component"), "unit_id", "left")
    first = F.when(F.col("frozen"), F.min("unit_id").over(W.partitionBy("district", "frozen", "component"))).otherwise(F.col("unit_id"))
    return own.withColumn("first", first).select("unit_id", F.col("first").alias("frozen_with"))


def county_multigraph(edges: DataFrame, units: DataFrame, county: str = "county") -> DataFrame:
    """Edges between counties: county, neighbour, src, dst."""
    c = units.select("unit_id", F.col(county).alias("c"))
    a, b = c.select(F.col("unit_id").alias("src"), F.col("c").alias("county")), c.select(F.col("unit_id").alias("dst"), F.col("c").alias("neighbour"))
    return edges.join(small(a), "src").join(small(b), "dst").filter("county <> neighbour").select("county", "neighbour", "src", "dst")


def relabel_counties(edges: DataFrame, units: DataFrame, county: str = "county") -> DataFrame:
    """Counties in several pieces become ``name-piece``."""
    piece = components(edges, units.select("unit_id", F.col(county).cast("string").alias("grp")))
    many = F.max("component").over(W.partitionBy("group")) > 1
    return piece.select("unit_id", F.when(many, F.concat_ws("-", "group", F.col("component").cast("string"))).otherwise(F.col("group")).alias("county"))


def together_on_edges(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """Share of draws in which the ends of an edge are in one district."""
    a = assignments.select("draw", F.col("unit_id").alias("src"), F.col("district").alias("a"))
    b = assignments.select("draw", F.col("unit_id").alias("dst"), F.col("district").alias("b"))
    return a.join(small(edges.filter("src < dst")), "src").join(b, ["draw", "dst"]).groupBy("src", "dst").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("weight"))


def share_columns(units: DataFrame) -> list[str]:
    """Columns of floating-point numbers that are all shares, from 0 to 1; one pass over the units."""
    real = [c for c, kind in units.dtypes if kind in ("double", "float")]
    if not real:
        return []
    ends = units.agg(*[F.bool_and(F.col(c).between(0, 1)).alias(c) for c in real]).first()
    return [c for c in real if ends[c]]


def merge_units(units: DataFrame, keys: list[str], pop: str = "pop", shares: list[str] | None = None) -> DataFrame:
    """One row per key: shares by population, other numbers summed, texts joined by ``~``.

    ``shares`` are told by ``share_columns`` unless given.
    """
    shares = share_columns(units.drop(*keys)) if shares is None else shares
    kinds = dict(units.dtypes)
    rest = [c for c in units.columns if c not in (*keys, "unit_id")]
    agg = []
    for c in rest:
        if c in shares:
            agg.append(F.try_divide(F.sum(F.col(c) * F.col(pop)), F.sum(pop)).alias(c))
        elif kinds[c] == "string":
            agg.append(F.array_join(F.array_sort(F.collect_set(c)), "~").alias(c))
        else:
            agg.append(F.sum(c).alias(c))
    return units.groupBy(*keys).agg(*agg)


def frontier_sizes(ordered: DataFrame) -> DataFrame:
    """Frontier after each edge of an ordered list (pos, a, b): vertices begun and not ended."""
    ends = ordered.select("pos", F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    change = ordered.select("pos", F.lit(0).alias("d")).union(ends.select(F.col("first").alias("pos"), F.lit(1).alias("d"))).union(ends.select(F.col("last").alias("pos"), F.lit(-1).alias("d"))).groupBy("pos").agg(F.sum("d").alias("d"))
    # one row per edge of one map's order: bounded by the map, not by the ensemble
    return change.select("pos", F.sum("d").over(W.orderBy("pos")).alias("frontier"))


def log_tree_count(pairs: list[tuple[int, int]], n: int) -> float | None:
    """Log number of spanning trees of a graph of n vertices (edges may repeat); None if it isn't connected.

    Vertices are taken out one by one, those of least degree first: the trees of a graph are
    the vertex's degree times those of the graph without it, with weight w * w' / degree
    between any two of its neighbours. Memory is what fills in, not n squared.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b in pairs:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + 1.0
            near[b][a] = near[b].get(a, 0.0) + 1.0
    queue = [(len(x), v) for v, x in enumerate(near)]
    heapify(queue)
    gone, total, left = [False] * n, 0.0, n
    while left > 1:
        size, v = heappop(queue)
        if gone[v] or size != len(near[v]):
            continue
        own, degree = list(near[v].items()), sum(near[v].values())
        if degree <= 0:
            return None
        gone[v], left, total = True, left - 1, total + math.log(degree)
        for i, (x, w) in enumerate(own):
            del near[x][v]
            for y, u in own[:i]:
                near[x][y] = near[y][x] = near[x].get(y, 0.0) + w * u / degree
        for x, _ in own:
            heappush(queue, (len(near[x]), x))
    return total


def two_level_trees(members: list[int], pairs: list[tuple[int, int]], county: dict[int, object] | None) -> float | None:
    """Trees of each connected part of a county, and of the graph of those parts."""
    if county is None:
        at = {v: k for k, v in enumerate(members)}
        return log_tree_count([(at[a], at[b]) for a, b in pairs], len(members))
    root = {v: v for v in members}

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for a, b in pairs:
        if county[a] == county[b]:
            root[top(a)] = top(b)
    parts: dict[int, dict[int, int]] = {}
    for v in members:
        own = parts.setdefault(top(v), {})
        own[v] = len(own)
    inner: dict[int, list[tuple[int, int]]] = {k: [] for k in parts}
    number, between = {k: i for i, k in enumerate(parts)}, []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x == y and county[a] == county[b]:
            inner[x].append((parts[x][a], parts[x][b]))
        else:
            between.append((number[x], number[y]))
    logs = [log_tree_count(between, len(parts)), *[log_tree_count(inner[k], len(own)) for k, own in parts.items()]]
    return None if None in logs else sum(logs)


def log_trees(edges: DataFrame, assignments: DataFrame, units: DataFrame | None = None, county: str | None = None) -> DataFrame:
    """Log number of spanning trees of each district; null if it isn't connected.

    With ``county`` (a column of ``units``) trees have two levels: one within each connected
    part of a county in the district, and one of the parts. A district's edges meet in a task,
    which takes vertices out one by one, so a large district needs the memory of its fill.
    """
    of = assignments.select("draw", F.col("unit_id").alias("src"), "district")
    inner = same_label_edges(edges, assignments.withColumnRenamed("district", "grp"), ["draw"]).filter("src < dst")
    listed = inner.join(of, ["draw", "src"]).groupBy("draw", "district").agg(F.collect_list(F.struct("src", "dst")).alias("pairs"))
    named = assignments.join(small(units.select("unit_id", F.col(county).cast("string").alias("c"))), "unit_id") if county else assignments.withColumn("c", F.lit(None).cast("string"))
    sized = named.groupBy("draw", "district").agg(F.collect_list(F.struct("unit_id", "c")).alias("members")).join(listed, ["draw", "district"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in assignments.schema.fields}

    def kirchhoff(batches):
        for pdf in batches:
            out = []
            for draw, district, members, pairs in zip(pdf["draw"], pdf["district"], pdf["members"], pdf["pairs"]):
                ids = [m["unit_id"] for m in members]
                own = {m["unit_id"]: m["c"] for m in members} if county else None
                out.append((draw, district, two_level_trees(ids, [] if pairs is None else [(e["src"], e["dst"]) for e in pairs], own)))
            yield pd.DataFrame(out, columns=["draw", "district", "log_trees"]).astype({"log_trees": "float64"})

    return sized.mapInPandas(kirchhoff, f"draw {kinds['draw']}, district {kinds['district']}, log_trees double")


def colours(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    """A proper colouring of each draw's districts, most neighbours first, lowest free colour."""
    near = district_graph(edges, assignments)
    both = near.select("draw", "a", "b").union(near.select("draw", F.col("b").alias("a"), F.col("a").alias("b")))
    listed = assignments.select("draw", F.col("district").alias("a")).distinct().join(both.groupBy("draw", "a").agg(F.collect_list("b").alias("near")), ["draw", "a"], "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        near_ = {a: set(() if n is None else n) for a, n in zip(pdf["a"], pdf["near"])}
        colour: dict[int, int] = {}
        for a in sorted(near_, key=lambda x: (-len(near_[x]), x)):
            used = {colour[b] for b in near_[a] if b in colour}
            colour[a] = next(k for k in range(1, len(near_) + 2) if k not in used)
        return pd.DataFrame({"draw": pdf["draw"].iloc[0], "district": list(colour), "colour": list(colour.values())})

    return listed.groupBy("draw").applyInPandas(greedy, "draw int, district int, colour int")
