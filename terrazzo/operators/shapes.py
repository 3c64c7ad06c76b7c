"""Compactness from outlines: convex hulls, enclosing circles and radii of districts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from . import tally
from .nearest import sides_of
from .sizes import small

BY = ["draw", "district"]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, of points sorted by x and y."""
    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    rows = sorted({(float(x), float(y)) for x, y in points})
    if len(rows) < 3:
        return np.array(rows)
    return np.array(half(rows)[:-1] + half(rows[::-1])[:-1])


def area(corners: np.ndarray) -> float:
    """Area within a ring of corners."""
    x, y = corners.T
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def enclosing_radius(points: np.ndarray) -> float:
    """Radius of the least circle around points: the circle grows until its farthest point is inside."""
    def around(on: list[np.ndarray]) -> tuple[np.ndarray, float]:
        if len(on) == 1:
            return on[0], 0.0
        if len(on) == 2:
            return (on[0] + on[1]) / 2, float(np.hypot(*(on[0] - on[1])) / 2)
        a, b, c = on
        m = 2 * np.array([b - a, c - a])
        if abs(np.linalg.det(m)) < 1e-12:
            far = max(((p, q) for p in on for q in on), key=lambda e: np.hypot(*(e[0] - e[1])))
            return around(list(far))
        at = np.linalg.solve(m, [(b**2 - a**2).sum(), (c**2 - a**2).sum()])
        return at, float(np.hypot(*(at - a)))

    inside = lambda circle, p: np.hypot(*(p - circle[0])) <= circle[1] + 1e-9
    circle = around([points[0]])
    for i, p in enumerate(points):
        if inside(circle, p):
            continue
        circle = around([p])
        for j, q in enumerate(points[:i]):
            if inside(circle, q):
                continue
            circle = around([p, q])
            for r in points[:j]:
                if not inside(circle, r):
                    circle = around([p, q, r])
    return circle[1]


def hulls(assignments: DataFrame, units: DataFrame, corners: DataFrame, size: str = "area") -> DataFrame:
    """draw, district, hull_ratio (area over that of its hull), reock (area over that of the least circle around it).

    Corners are unit_id, x, y. Of the corners at one height only the two ends can be on a hull,
    so Spark keeps those before a district's points meet in a task.
    """
    at = corners.select("unit_id", "x", "y").distinct()
    ends = assignments.join(at, "unit_id").groupBy(*BY, "y").agg(F.min("x").alias("a"), F.max("x").alias("z"))
    own = ends.groupBy(*BY).agg(F.collect_list(F.struct("a", "z", "y")).alias("rows")).join(tally.tally(assignments, units, size=size), BY)

    def measure(batches):
        for pdf in batches:
            out = []
            for draw, district, rows, size_ in zip(pdf["draw"], pdf["district"], pdf["rows"], pdf["size"]):
                around = hull(np.array([(r[c], r["y"]) for r in rows for c in ("a", "z")], float))
                out.append((draw, district, float(size_) / area(around), float(size_) / (np.pi * enclosing_radius(around) ** 2)))
            yield pd.DataFrame(out, columns=["draw", "district", "hull_ratio", "reock"])

    return own.mapInPandas(measure, "draw int, district int, hull_ratio double, reock double")


def outline_centroids(corners: DataFrame) -> DataFrame:
    """unit_id, area, mx, my: signed area of a unit's rings, and its first moments (holes run the other way round)."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return sides_of(corners).groupBy("unit_id").agg((F.sum(cross) / 2).alias("area"), (F.sum((F.col("x1") + F.col("x2")) * cross) / 6).alias("mx"), (F.sum((F.col("y1") + F.col("y2")) * cross) / 6).alias("my"))


def boyce_clark(assignments: DataFrame, corners: DataFrame, rays: int = 16) -> DataFrame:
    """draw, district, boyce_clark: one less half the mean departure of ``rays`` radii from even shares.

    Radii go from the district's centroid to the farthest point of its outline on each ray. If
    the centroid lies outside (an odd-even count of sides west of it says so), the centroid of
    the nearest unit takes its place (ties: the first unit). Sides meet only the rays between
    their two ends, seen from the centre; of each ray the farthest meeting is kept, so sides
    between units of a district need not be taken out. Units' outlines may run either way
    round, with holes the other way. A ray that meets nothing has radius 0.
    """
    sides = shared_table(sides_of(corners))
    unit = shared_table(outline_centroids(corners).select("unit_id", F.abs("area").alias("area"), (F.col("mx") * F.signum("area")).alias("mx"), (F.col("my") * F.signum("area")).alias("my")))
    own = assignments.select("draw", "unit_id", "district").join(small(unit), "unit_id")
    middle = own.groupBy(*BY).agg((F.sum("mx") / F.sum("area")).alias("cx"), (F.sum("my") / F.sum("area")).alias("cy"))
    # sides of all units: those between two of them count twice, so not at all
    around = assignments.select("draw", "unit_id", "district").join(small(sides), "unit_id").join(small(middle), BY)
    spans = (F.col("y1") > F.col("cy")) != (F.col("y2") > F.col("cy"))
    west = F.col("x1") + (F.col("cy") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) < F.col("cx")
    inside = around.groupBy(*BY, "cx", "cy").agg((F.count_if(spans & west) % 2 == 1).alias("inside"))
    gap = F.round(F.hypot(F.col("mx") / F.col("area") - F.col("cx"), F.col("my") / F.col("area") - F.col("cy")), 9)
    nearest = own.join(small(inside.filter("not inside")), BY).groupBy(*BY).agg(F.min_by(F.struct((F.col("mx") / F.col("area")).alias("x"), (F.col("my") / F.col("area")).alias("y")), F.struct(gap, "unit_id")).alias("n"))
    centre = inside.join(nearest, BY, "left").select(*BY, F.coalesce("n.x", "cx").alias("cx"), F.coalesce("n.y", "cy").alias("cy"))
    step = 2 * np.pi / rays
    seen = around.drop("cx", "cy").join(small(centre), BY).select(*BY, (F.col("x1") - F.col("cx")).alias("ax"), (F.col("y1") - F.col("cy")).alias("ay"), (F.col("x2") - F.col("cx")).alias("bx"), (F.col("y2") - F.col("cy")).alias("by"))
    turn = F.atan2(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"))
    start = F.atan2("ay", "ax")
    first, last = F.least(start, start + turn) / step, F.greatest(start, start + turn) / step
    met = seen.withColumn("ray", F.explode(F.sequence(F.ceil(first - 1e-9).cast("int"), F.greatest(F.floor(last + 1e-9), F.ceil(first - 1e-9)).cast("int"))))
    dx, dy = F.cos(F.col("ray") * step), F.sin(F.col("ray") * step)
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    across = dx * ey - dy * ex
    # along a ray through both ends the farther end counts
    flat = F.greatest(F.hypot("ax", "ay"), F.hypot("bx", "by"))
    on = F.try_divide(dx * F.col("ay") - dy * F.col("ax"), -across)
    radius = F.when(F.abs(across) <= 1e-12 * F.greatest(F.hypot(ex, ey), F.lit(1e-300)), F.when(F.abs(dx * F.col("ay") - dy * F.col("ax")) <= 1e-9 * flat, flat)).when(on.between(-1e-9, 1 + 1e-9), (F.col("ax") * ey - F.col("ay") * ex) / across)
    far = met.withColumn("r", radius).filter("r >= 0").groupBy(*BY, F.pmod("ray", F.lit(rays)).alias("ray")).agg(F.max("r").alias("r"))
    total = far.groupBy(*BY).agg(F.collect_list("r").alias("r"), F.sum("r").alias("t"))  # a number a ray
    even = 100 / rays
    departure = F.aggregate("r", F.lit(0.0), lambda a, r: a + F.abs(r / F.col("t") * 100 - even)) + (rays - F.size("r")) * even
    return total.select(*BY, (1 - departure / 200).alias("boyce_clark"))
