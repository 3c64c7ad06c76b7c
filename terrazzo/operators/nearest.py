"""Distances between units and between districts, and adjacency from outlines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from . import graph, tally

BY = ["draw", "district"]
#: Kilometres; fixed value.
EARTH = 6_371.0


def great_circle(units: DataFrame, near: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """i, j, km for the pairs of ``near`` (i, j), by the haversine formula."""
    a, b = (units.select(F.col("unit_id").alias(c), F.radians(lon).alias(f"x{c}"), F.radians(lat).alias(f"y{c}")) for c in ("i", "j"))
    half = F.pow(F.sin((F.col("yj") - F.col("yi")) / 2), 2) + F.cos("yi") * F.cos("yj") * F.pow(F.sin((F.col("xj") - F.col("xi")) / 2), 2)
    return near.join(a, "i").join(b, "j").select("i", "j", (2 * EARTH * F.asin(F.least(F.sqrt(half), F.lit(1.0)))).alias("km"))


def centroids(assignments: DataFrame, units: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """draw, district, x, y: mean places of the units."""
    return tally.placed(assignments, units, x, y).groupBy(*BY).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))


def centroid_gaps(assignments: DataFrame, units: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """draw, unit_id, district, gap: a unit's distance from its district's centroid."""
    own = tally.placed(assignments, units, x, y).select("draw", "district", "unit_id", F.col(x).alias("ux"), F.col(y).alias("uy"))
    return own.join(centroids(assignments, units, x, y), BY).select("draw", "unit_id", "district", F.hypot(F.col("ux") - F.col("x"), F.col("uy") - F.col("y")).alias("gap"))


def _neighbours(edges: DataFrame, assignments: DataFrame) -> DataFrame:
    near = graph.district_graph(edges, assignments)
    return near.select("draw", F.col("a").alias("district"), F.col("b").alias("other")).union(near.select("draw", "b", "a"))


def nearest_district(edges: DataFrame, assignments: DataFrame, units: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """draw, district, other, gap: the adjacent district with the nearest centroid; ties to the smaller label."""
    at = centroids(assignments, units, x, y)
    met = _neighbours(edges, assignments).join(at, BY).join(at.select("draw", F.col("district").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")), ["draw", "other"])
    gap = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    first = F.min(F.struct(F.round(gap, 9).alias("gap"), "other"))
    return met.groupBy(*BY).agg(first.alias("m")).select(*BY, "m.other", "m.gap")


def lightest_neighbour(edges: DataFrame, assignments: DataFrame, units: DataFrame, pop: str = "pop") -> DataFrame:
    """draw, district, other, share: the adjacent district with the least population share; ties to the smaller label."""
    own = tally.tally(assignments, units, p=pop)
    share = own.select("draw", F.col("district").alias("other"), (F.col("p") / F.sum("p").over(W.partitionBy("draw"))).alias("share"))
    met = _neighbours(edges, assignments).join(share, ["draw", "other"])
    return met.groupBy(*BY).agg(F.min(F.struct("share", "other")).alias("m")).select(*BY, "m.other", "m.share")


def sides_of(corners: DataFrame) -> DataFrame:
    """unit_id, x1, y1, x2, y2: sides of closed rings (unit_id, ring, pos, x, y); sides without length are left out."""
    ring = W.partitionBy("unit_id", "ring").orderBy("pos")
    first = F.first(F.struct("x", "y")).over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    to = F.coalesce(F.lead(F.struct("x", "y")).over(ring), first)
    sides = corners.withColumn("to", to).select("unit_id", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), F.col("to.x").cast("double").alias("x2"), F.col("to.y").cast("double").alias("y2"))
    return sides.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _in_cells(sides: DataFrame, size: float, eps: float) -> DataFrame:
    """``sides`` once for each cell of a square grid that they run through or along."""
    cell = lambda c: F.floor(c / size).cast("long")
    west, east = F.least("x1", "x2"), F.greatest("x1", "x2")
    own = sides.withColumn("cx", F.explode(F.sequence(cell(west - eps), cell(east + eps))))
    # the part of the side within its column, from edge to edge
    along = lambda x: F.when(F.col("x1") == F.col("x2"), None).otherwise(F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    low, high = F.greatest(west, F.col("cx") * size - eps), F.least(east, (F.col("cx") + 1) * size + eps)
    south, north = F.least("y1", "y2"), F.greatest("y1", "y2")
    a, b = F.coalesce(F.least(along(low), along(high)), south), F.coalesce(F.greatest(along(low), along(high)), north)
    # near-vertical sides: never beyond the side's own height
    return own.withColumn("cy", F.explode(F.sequence(cell(F.greatest(a, south) - eps), cell(F.least(b, north) + eps))))


def adjacency_of_outlines(corners: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Rook neighbours (src, dst, both directions) from outlines: unit_id, ring, pos, x, y.

    Corners follow one another by ``pos`` in each closed ring; a hole is a ring of its own.
    Neighbours share a stretch of their sides, whole or in part (a long side beside two short
    ones, an island in a hole), or lie over one another in part, so that their sides cross. A
    shared corner alone does not count. Lengths up to ``tol`` of the map's extent are nothing.

    Sides are hashed to the cells of a grid as wide as a typical side, so only sides that pass
    through one cell, and in one direction where they overlap, meet.
    """
    sides = shared_table(sides_of(corners))
    told = sides.agg(F.percentile_approx(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 0.5).alias("size"), F.max(F.greatest(F.abs("x1"), F.abs("y1"), F.abs("x2"), F.abs("y2"))).alias("most")).first()
    if not told["size"]:
        return sides.select(F.col("unit_id").alias("src"), F.col("unit_id").alias("dst"))
    eps = tol * told["most"]
    placed = shared_table(_in_cells(sides, told["size"], eps))
    # directions from 0 to pi in a hundred classes; those next to a border are in both
    turn = F.pmod(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")) * (100 / math.pi), F.lit(100.0))
    classes = F.array_distinct(F.array(*[F.pmod(F.floor(turn + d).cast("int"), F.lit(100)) for d in (-1e-3, 1e-3)]))
    names = ["unit_id", "x1", "y1", "x2", "y2"]
    other = [F.col(c).alias(f"o_{c}") for c in names]
    turned = placed.withColumn("turn", F.explode(classes))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.hypot(dx, dy)
    off = lambda x, y: ((F.col(x) - F.col("x1")) * dy - (F.col(y) - F.col("y1")) * dx) / length
    at = lambda x, y: ((F.col(x) - F.col("x1")) * dx + (F.col(y) - F.col("y1")) * dy) / length
    p, q = at("o_x1", "o_y1"), at("o_x2", "o_y2")
    shared = (F.abs(off("o_x1", "o_y1")) <= eps) & (F.abs(off("o_x2", "o_y2")) <= eps) & (F.least(length, F.greatest(p, q)) - F.greatest(F.lit(0.0), F.least(p, q)) > eps)
    beside = turned.join(turned.select("cx", "cy", "turn", *other), ["cx", "cy", "turn"]).filter((F.col("unit_id") < F.col("o_unit_id")) & shared)
    # sides that cross: each has its ends on both sides of the other
    odx, ody = F.col("o_x2") - F.col("o_x1"), F.col("o_y2") - F.col("o_y1")
    o_off = lambda x, y: ((F.col(x) - F.col("o_x1")) * ody - (F.col(y) - F.col("o_y1")) * odx) / F.hypot(odx, ody)
    parted = lambda f, g: (F.abs(f) > eps) & (F.abs(g) > eps) & (F.signum(f) != F.signum(g))
    cross = parted(off("o_x1", "o_y1"), off("o_x2", "o_y2")) & parted(o_off("x1", "y1"), o_off("x2", "y2"))
    over = placed.join(placed.select("cx", "cy", *other), ["cx", "cy"]).filter((F.col("unit_id") < F.col("o_unit_id")) & cross)
    met = beside.select("unit_id", "o_unit_id").union(over.select("unit_id", "o_unit_id")).distinct()
    return met.select(F.explode(F.array(F.struct(F.col("unit_id").alias("src"), F.col("o_unit_id").alias("dst")), F.struct(F.col("o_unit_id").alias("src"), F.col("unit_id").alias("dst")))).alias("e")).select("e.src", "e.dst")


def edge_lines(edges: DataFrame, units: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """src < dst with both centroids: x, y, to_x, to_y."""
    a = units.select(F.col("unit_id").alias("src"), F.col(x).alias("x"), F.col(y).alias("y"))
    b = units.select(F.col("unit_id").alias("dst"), F.col(x).alias("to_x"), F.col(y).alias("to_y"))
    return edges.filter("src < dst").join(a, "src").join(b, "dst").select("src", "dst", "x", "y", "to_x", "to_y")
