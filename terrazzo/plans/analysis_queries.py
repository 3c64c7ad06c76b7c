"""More registered queries: comparison, distances, frames, files, search, and a large map."""

from __future__ import annotations

import uuid
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import estimates
from ..operators import compare, frames, graph, labels, nearest, overlap, penalties, shapes, tally
from ..sources import customer_grid, enumeration_files
from ..sources import nation_grid as grid
from ..sources.shared import shared_folder
from . import enumeration, model, sampling, search
from .queries import _CUT, _JOINT, _PERIMS, _SHARES, _VOTES, ORACLES, QUERIES, _checked, _existing, _numbered, _perimeters, _r, _sampled, query


def _z(c: str):
    return (F.round(F.col(c).cast("double"), 6) + 0.0).alias(c)


# comparison of plans

_PAIR = ", pair AS (SELECT a.unit_id AS i, b.unit_id AS j, CAST(a.pop AS DOUBLE) AS pi, CAST(b.pop AS DOUBLE) AS pj, ABS(CAST(a.existing = b.existing AS INT) - CAST(x.district = y.district AS INT)) AS apart FROM units a CROSS JOIN units b JOIN asg x ON x.unit_id = a.unit_id AND x.draw = 1 JOIN asg y ON y.unit_id = b.unit_id AND y.draw = 1) "


@query(_PAIR + "SELECT i AS unit_id, ROUND(SUM(apart * (pi + pj)) / 25 / (SELECT SUM(pop) FROM units), 6) AS overlap FROM pair GROUP BY i")
def unit_population_overlap(e):
    return compare.unit_overlap(e.map.existing_plan(), e.assignments.filter("draw = 1"), e.map.units).select("unit_id", _r("overlap"))


@query(_PAIR + "SELECT ROUND(SUM(apart * SQRT(pi * pj)) / 300, 6) AS \"index\" FROM pair WHERE i < j")
def unit_overlap_index(e):
    return compare.overlap_index(e.map.existing_plan(), e.assignments.filter("draw = 1"), e.map.units, "g", normalize=False).select(_r("index"))


_HALVES = ", c AS (SELECT CASE WHEN a.draw <= 25 THEN 1 ELSE 2 END AS part, a.unit_id AS unit_i, b.unit_id AS unit_j, (COUNT(*) + 1 / 5.0) / 26 AS p FROM asg a JOIN asg b ON a.draw = b.draw AND a.district = b.district AND a.unit_id < b.unit_id GROUP BY 1, 2, 3) "


@query(_HALVES + "SELECT unit_i, unit_j, ROUND(p, 6) AS p FROM c WHERE part = 1")
def smoothed_cooccurrence(e):
    return compare.smoothed_cooccurrence(e.assignments.filter("draw <= 25"), 5).select("unit_i", "unit_j", _r("p"))


@query("SELECT split, CAST(25 AS BIGINT) AS units, TRUE AS parted, TRUE AS apart FROM (VALUES (1), (2)) t(split)")
def compared_sets(e):
    found = compare.compare_sets(e.assignments.filter("draw <= 25"), e.assignments.filter("draw > 25"), 5)
    return found.groupBy("split").agg(F.count(F.lit(1)).alias("units"), (F.countDistinct("part") > 1).alias("parted"), (F.max("separation") > 0).alias("apart"))


@query("SELECT CAST(50 AS BIGINT) AS draws, CAST(8 AS BIGINT) AS groups")
def classified_plans(e):
    return compare.classify(overlap.distances(e.assignments, e.map.units)).agg(F.count(F.lit(1)).alias("draws"), F.countDistinct("label").alias("groups"))


@query("SELECT CAST(50 AS BIGINT) AS draws, CAST(5 AS BIGINT) AS clusters, TRUE AS centred")
def plane_of_plans(e):
    found = compare.clustered_plane(overlap.distances(e.assignments, e.map.units))
    return found.agg(F.count(F.lit(1)).alias("draws"), F.countDistinct("cluster").alias("clusters"), ((F.abs(F.avg("x")) < 1e-9) & (F.abs(F.avg("y")) < 1e-9)).alias("centred"))


_VI = ", jt AS (SELECT a.draw AS i, b.draw AS j, a.district AS x, b.district AS y, CAST(SUM(u.pop) AS DOUBLE) AS p FROM asg a JOIN asg b ON a.unit_id = b.unit_id AND a.draw < b.draw JOIN units u ON u.unit_id = a.unit_id GROUP BY 1, 2, 3, 4), w AS (SELECT *, SUM(p) OVER (PARTITION BY i, j, x) AS px, SUM(p) OVER (PARTITION BY i, j, y) AS py FROM jt), v AS (SELECT i, j, SUM(CASE WHEN p >= 1 THEN -p * (2 * LN(p) - LN(px) - LN(py)) END) / SUM(p) AS vi FROM w GROUP BY 1, 2) "


@query(_VI + "SELECT i, j, ROUND(CASE WHEN ABS(vi) <= 1e-9 THEN 0.0 ELSE vi END, 6) AS vi FROM v")
def plan_information(e):
    return overlap.distances(e.assignments, e.map.units).select("i", "j", _r("vi"))


@query(_VI + ", d AS (SELECT CASE WHEN ABS(vi) <= 1e-9 THEN 0.0 ELSE vi / 2 END AS d FROM v) SELECT ROUND(QUANTILE_CONT(d, 0.1), 6) AS low, ROUND(QUANTILE_CONT(d, 0.9), 6) AS high, ROUND(AVG(d), 6) AS mean, AVG(d) <= 0.35 OR AVG(CAST(d <= 0.25 AS INT)) > 0.1 AS is_low FROM d")
def diversity_summary(e):
    return estimates.diversity_flags(overlap.diversity(e.assignments, e.map.units)).select(_r("low"), _r("high"), _r("mean"), "is_low")


# distances and neighbours

_PLACES = ", c AS (SELECT draw, district, AVG(gx) AS x, AVG(gy) AS y, SUM(pop) AS pop FROM asg JOIN units USING (unit_id) GROUP BY 1, 2), near AS (SELECT DISTINCT a.draw, a.district, b.district AS other FROM edges e JOIN asg a ON a.unit_id = e.src JOIN asg b ON b.unit_id = e.dst AND b.draw = a.draw WHERE a.district <> b.district) "


@query(_PLACES + ", g AS (SELECT n.*, ROUND(SQRT((c.x - o.x) ** 2 + (c.y - o.y) ** 2), 9) AS gap FROM near n JOIN c ON c.draw = n.draw AND c.district = n.district JOIN c o ON o.draw = n.draw AND o.district = n.other) SELECT draw, district, other, ROUND(gap, 6) AS gap FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY draw, district ORDER BY gap, other) = 1")
def nearest_districts(e):
    return nearest.nearest_district(e.map.edges, e.assignments, e.map.units).select("draw", "district", "other", _r("gap"))


@query(_PLACES + "SELECT n.draw, n.district, n.other, ROUND(o.pop / (SELECT CAST(SUM(pop) AS DOUBLE) FROM units), 6) AS share FROM near n JOIN c o ON o.draw = n.draw AND o.district = n.other QUALIFY ROW_NUMBER() OVER (PARTITION BY n.draw, n.district ORDER BY o.pop, n.other) = 1")
def lightest_neighbours(e):
    return nearest.lightest_neighbour(e.map.edges, e.assignments, e.map.units).select("draw", "district", "other", _r("share"))


@query(_PLACES + "SELECT draw, unit_id, a.district, ROUND(SQRT((gx - x) ** 2 + (gy - y) ** 2), 6) AS gap FROM asg a JOIN units USING (unit_id) JOIN c USING (draw, district)")
def centroid_gaps(e):
    return nearest.centroid_gaps(e.assignments, e.map.units).select("draw", "unit_id", "district", _r("gap"))


@query("SELECT a.unit_id AS i, b.unit_id AS j, ROUND(2 * 6371 * ASIN(LEAST(SQRT(SIN(RADIANS(b.gy - a.gy) * 4) ** 2 + COS(RADIANS(a.gy * 8)) * COS(RADIANS(b.gy * 8)) * SIN(RADIANS(b.gx - a.gx) * 5) ** 2), 1)), 4) AS km FROM edges JOIN units a ON a.unit_id = src JOIN units b ON b.unit_id = dst")
def great_circles(e):
    at = e.map.units.select("unit_id", (F.col("gx") * 10).alias("lon"), (F.col("gy") * 8).alias("lat"))
    return nearest.great_circle(at, e.map.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"))).select("i", "j", F.round("km", 4).alias("km"))


def _corners(e: model.Ensemble) -> DataFrame:
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])).alias("s")
    return e.map.units.select("unit_id", "gx", "gy", steps).select("unit_id", F.lit(0).alias("ring"), "s.pos", (F.col("gx") + F.col("s.dx")).alias("x"), (F.col("gy") + F.col("s.dy")).alias("y"))


@query("SELECT src, dst FROM edges")
def outline_adjacency(e):
    return nearest.adjacency_of_outlines(_corners(e))


# a convex polygon's area from the widths at its corners' heights, in halves: between neighbouring heights a hull is a trapezium
@query(
    """, pts AS (SELECT DISTINCT draw, district, gx + dx AS x, gy + dy AS y FROM asg JOIN units USING (unit_id), (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) c(dx, dy)),
hs AS (SELECT DISTINCT draw, district, y FROM pts),
lines AS (SELECT a.draw, a.district, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM pts a JOIN pts b ON a.draw = b.draw AND a.district = b.district AND a.y < b.y),
span AS (SELECT h.draw, h.district, h.y, GREATEST(MAX(p.x) FILTER (WHERE p.y = h.y), MAX(l.ax + (l.bx - l.ax) * (h.y - l.ay) / CAST(l.by_ - l.ay AS DOUBLE))) AS hi, LEAST(MIN(p.x) FILTER (WHERE p.y = h.y), MIN(l.ax + (l.bx - l.ax) * (h.y - l.ay) / CAST(l.by_ - l.ay AS DOUBLE))) AS lo
  FROM hs h JOIN pts p ON p.draw = h.draw AND p.district = h.district AND p.y = h.y JOIN lines l ON l.draw = h.draw AND l.district = h.district AND l.ay <= h.y AND l.by_ >= h.y GROUP BY 1, 2, 3),
strips AS (SELECT draw, district, (hi - lo + LEAD(hi - lo) OVER w) / 2 * (LEAD(y) OVER w - y) AS s FROM span WINDOW w AS (PARTITION BY draw, district ORDER BY y)),
n AS (SELECT draw, district, COUNT(*) AS n FROM asg GROUP BY 1, 2)
SELECT draw, district, ROUND(MIN(n) / SUM(s), 6) AS hull_ratio FROM strips JOIN n USING (draw, district) GROUP BY 1, 2"""
)
def hull_ratios(e):
    return shapes.hulls(e.assignments, e.map.units.withColumn("area", F.lit(1.0)), _corners(e)).select("draw", "district", _r("hull_ratio"))


# the least circle runs through two or three corners: of all such circles around every corner the smallest
@query(
    """, pts AS (SELECT DISTINCT draw, district, CAST(gx + dx AS DOUBLE) AS x, CAST(gy + dy AS DOUBLE) AS y FROM asg JOIN units USING (unit_id), (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) c(dx, dy)),
shown AS (SELECT draw, district, LIST({'x': x, 'y': y}) AS pts FROM pts GROUP BY 1, 2),
pairs AS (SELECT a.draw, a.district, (a.x + b.x) / 2 AS cx, (a.y + b.y) / 2 AS cy, SQRT((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2 AS r FROM pts a JOIN pts b ON a.draw = b.draw AND a.district = b.district AND (a.x, a.y) < (b.x, b.y)),
three AS (SELECT a.draw, a.district, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS by_, c.x - a.x AS cx, c.y - a.y AS cy, 2 * ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS d
  FROM pts a JOIN pts b ON a.draw = b.draw AND a.district = b.district AND (a.x, a.y) < (b.x, b.y) JOIN pts c ON b.draw = c.draw AND b.district = c.district AND (b.x, b.y) < (c.x, c.y)),
round_ AS (SELECT draw, district, ax, ay, (cy * (bx ** 2 + by_ ** 2) - by_ * (cx ** 2 + cy ** 2)) / d AS ux, (bx * (cx ** 2 + cy ** 2) - cx * (bx ** 2 + by_ ** 2)) / d AS uy FROM three WHERE d <> 0),
every AS (SELECT DISTINCT draw, district, ROUND(cx, 9) AS cx, ROUND(cy, 9) AS cy, ROUND(r, 9) AS r FROM pairs UNION SELECT draw, district, ROUND(ax + ux, 9), ROUND(ay + uy, 9), ROUND(SQRT(ux ** 2 + uy ** 2), 9) FROM round_),
fits AS (SELECT e.draw, e.district, MIN(e.r) AS r FROM every e WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.draw = e.draw AND p.district = e.district AND SQRT((p.x - e.cx) ** 2 + (p.y - e.cy) ** 2) > e.r + 1e-6) GROUP BY 1, 2),
n AS (SELECT draw, district, COUNT(*) AS n FROM asg GROUP BY 1, 2)
SELECT draw, district, ROUND(n / (PI() * r * r), 5) AS reock FROM fits JOIN n USING (draw, district)"""
)
def reock(e):
    return shapes.hulls(e.assignments, e.map.units.withColumn("area", F.lit(1.0)), _corners(e)).select("draw", "district", F.round("reock", 5).alias("reock"))


@query("SELECT CAST(50 AS BIGINT) AS rows_a_split, TRUE AS apart")
def contrasted_classes(e):
    found = compare.contrast_of_classes(compare.classify(overlap.distances(e.assignments, e.map.units), 3), e.assignments, 5)
    by = found.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.max("separation").alias("s"))
    return by.agg(F.max("n").alias("rows_a_split"), F.bool_and(F.col("s") > 0).alias("apart"))


@query("SELECT src, dst, a.gx AS x, a.gy AS y, b.gx AS to_x, b.gy AS to_y FROM edges JOIN units a ON a.unit_id = src JOIN units b ON b.unit_id = dst WHERE src < dst")
def edge_lines(e):
    return nearest.edge_lines(e.map.edges, e.map.units)


# frames behind plots


@query("SELECT draw, CAST(pop AS BIGINT) AS x, CAST(grp AS BIGINT) AS y, FALSE AS is_ref FROM tally")
def scatter_frame(e):
    both = tally.tally(e.assignments, e.map.units, p="pop", g="grp")
    return frames.scatter(both, e.draws, "p", "g")


@query(", s AS (SELECT draw, CAST(grp AS DOUBLE) / pop AS s, ROW_NUMBER() OVER (PARTITION BY draw ORDER BY CAST(grp AS DOUBLE) / pop DESC, district) AS k FROM tally) SELECT draw, ROUND(MAX(s) FILTER (WHERE k = 1), 6) AS first, ROUND(MAX(s) FILTER (WHERE k = 2), 6) AS second FROM s GROUP BY draw")
def top_two_shares(e):
    return frames.top_two(tally.group_share(e.assignments, e.map.units, "grp"), "share").select("draw", _r("first"), _r("second"))


@query("SELECT 1 AS chain, CAST(draw AS INT) AS iteration, CAST(pop AS BIGINT) AS value FROM tally WHERE district = 2")
def trace_frame(e):
    return frames.trace(e.stats, e.draws, "total_pop", 2)


@query("SELECT 1 AS chain, CAST(draw AS INT) AS iteration, MEDIAN(pop) OVER (ORDER BY draw ROWS UNBOUNDED PRECEDING) AS median FROM tally WHERE district = 2")
def running_medians(e):
    return frames.running_median(frames.trace(e.stats, e.draws, "total_pop", 2))


@query("SELECT draw, CAST(ROW_NUMBER() OVER (PARTITION BY draw ORDER BY pop, district) AS INT) AS place, CAST(pop AS BIGINT) AS value FROM tally")
def sorted_districts(e):
    return frames.sorted_districts(e.stats, "total_pop")


@query("SELECT draw, CAST(MIN(pop) AS BIGINT) AS low, CAST(MAX(pop) AS BIGINT) AS high FROM tally GROUP BY draw")
def column_extremes(e):
    return tally.extremes(e.stats, "total_pop")


@query("SELECT DISTINCT draw, CAST(0 AS BIGINT) AS clashes, TRUE AS few FROM asg")
def proper_colours(e):
    own = graph.colours(e.map.edges, e.assignments)
    near = graph.district_graph(e.map.edges, e.assignments).join(own.select("draw", F.col("district").alias("a"), F.col("colour").alias("ca")), ["draw", "a"]).join(own.select("draw", F.col("district").alias("b"), F.col("colour").alias("cb")), ["draw", "b"])
    return own.groupBy("draw").agg((F.max("colour") <= 5).alias("few")).join(near.groupBy("draw").agg(F.count_if(F.col("ca") == F.col("cb")).alias("clashes")), "draw").select("draw", "clashes", "few")


# partisan measures, shapes, penalties


@query(
    _VOTES
    + """, m AS (SELECT *, AVG(v) OVER (PARTITION BY draw) AS mean, ROW_NUMBER() OVER (PARTITION BY draw ORDER BY v, district) AS place FROM votes_by),
b AS (SELECT draw, COUNT(*) AS n, SUM(CAST(v > 0.5 AS INT)) AS seats, AVG(v) FILTER (WHERE v > 0.5) AS won, AVG(v) FILTER (WHERE v <= 0.5) AS lost,
  2 * AVG((CASE WHEN 2 * v - 1 >= 0 THEN 1 ELSE -1 END) * (2 * v - 1) ** 2 + 0.5 - CAST(v > 0.5 AS INT)) AS tau,
  (AVG(CAST(v + 0.51 - mean > 0.5 AS INT)) - AVG(CAST(v + 0.49 - mean > 0.5 AS INT))) / 0.02 AS responsiveness FROM m GROUP BY draw)
SELECT draw, ROUND(CASE WHEN seats > 0 AND seats < n THEN 2 / PI() * (ATAN((2 * won - 1) / (seats / CAST(n AS DOUBLE))) - ATAN((1 - 2 * lost) / ((n - seats) / CAST(n AS DOUBLE)))) END, 6) + 0.0 AS declination,
  ROUND(responsiveness, 6) + 0.0 AS responsiveness, ROUND(won - (1 - lost), 6) + 0.0 AS lopsided, ROUND(tau, 6) + 0.0 AS tau_gap FROM b"""
)
def partisan_shapes(e):
    found = tally.partisan(tally.vote_shares(e.assignments, e.map.units))
    return found.select("draw", *[_z(c) for c in ("declination", "responsiveness", "lopsided", "tau_gap")])


@query(_VOTES + ", m AS (SELECT draw, v, ROW_NUMBER() OVER (PARTITION BY draw ORDER BY v, district) AS place FROM votes_by), c AS (SELECT place, AVG(v) AS mean FROM m GROUP BY 1) SELECT draw, ROUND(SQRT(SUM((v - mean) ** 2)), 6) AS ranked_marginal FROM m JOIN c USING (place) GROUP BY draw")
def ranked_marginals(e):
    return tally.ranked_marginal(tally.vote_shares(e.assignments, e.map.units)).select("draw", _r("ranked_marginal"))


@query(_PERIMS + ", p AS (SELECT t.draw, t.district, SUM(edge) AS p FROM sides JOIN asg t ON t.unit_id = to_id LEFT JOIN asg f ON f.unit_id = from_id AND f.draw = t.draw WHERE from_id = -1 OR f.district <> t.district GROUP BY 1, 2), a AS (SELECT draw, district, COUNT(*) AS a FROM asg GROUP BY 1, 2) SELECT draw, district, ROUND(p / (2 * SQRT(3.14159265 * a)), 6) AS schwartzberg FROM p JOIN a USING (draw, district)")
def schwartzberg(e):
    units = e.map.units.withColumn("area", F.lit(1.0))
    return tally.polsby_popper(e.assignments, units, _perimeters(e)).select("draw", "district", _r("schwartzberg"))


@query(", own AS (SELECT draw, district, existing, CAST(SUM(pop) AS DOUBLE) AS p FROM asg JOIN units USING (unit_id) WHERE gy < 3 GROUP BY 1, 2, 3), f AS (SELECT *, p / SUM(p) OVER (PARTITION BY draw, existing) AS f FROM own), q AS (SELECT draw, district, SUM(f * (1 - f)) / 5 + LN(COUNT(*)) AS v FROM f GROUP BY 1, 2) SELECT draw, ROUND(SUM(v), 6) + 0.0 AS penalty FROM q GROUP BY draw")
def city_penalty(e):
    units = e.map.units.withColumn("city", F.when(F.col("gy") < 3, F.col("existing")).otherwise(0))
    return penalties.evaluate(e.assignments, units, [penalties.qps(1.0, "city", 5)]).select("draw", _z("penalty"))


@query(", s AS (SELECT draw, CAST(grp AS DOUBLE) / pop AS s, dvote / CAST(dvote + rvote AS DOUBLE) AS v FROM tally) SELECT draw, ROUND(SUM((ABS(s - 0.3) * ABS(s - 0.1)) ** 0.7 + GREATEST(s - 0.15, 0) ** 0.5 + ABS(v - 0.5)), 6) AS penalty FROM s GROUP BY draw")
def share_penalties(e):
    every = [penalties.grp_pow(1.0, "grp", to_group=0.3, to_other=0.1, power=0.7), penalties.grp_inv_hinge(1.0, "grp", targets=(0.15,)), penalties.compet(1.0, "dvote", "rvote")]
    return penalties.evaluate(e.assignments, e.map.units, every).select("draw", _r("penalty"))


# estimates

#: Inverse normal distribution function by Acklam's rational approximation, one Halley-free form; fixed values.
_PROBIT = """CASE WHEN p < 0.02425 THEN
 (((((-7.784894002430293e-03 * q1 - 3.223964580411365e-01) * q1 - 2.400758277161838e+00) * q1 - 2.549732539343734e+00) * q1 + 4.374664141464968e+00) * q1 + 2.938163982698783e+00) / ((((7.784695709041462e-03 * q1 + 3.224671290700398e-01) * q1 + 2.445134137142996e+00) * q1 + 3.754408661907416e+00) * q1 + 1)
WHEN p > 0.97575 THEN
 -(((((-7.784894002430293e-03 * q2 - 3.223964580411365e-01) * q2 - 2.400758277161838e+00) * q2 - 2.549732539343734e+00) * q2 + 4.374664141464968e+00) * q2 + 2.938163982698783e+00) / ((((7.784695709041462e-03 * q2 + 3.224671290700398e-01) * q2 + 2.445134137142996e+00) * q2 + 3.754408661907416e+00) * q2 + 1)
ELSE (((((-3.969683028665376e+01 * r + 2.209460984245205e+02) * r - 2.759285104469687e+02) * r + 1.383577518672690e+02) * r - 3.066479806614716e+01) * r + 2.506628277459239e+00) * q / (((((-5.447609879822406e+01 * r + 1.615858368580409e+02) * r - 1.556989798598866e+02) * r + 6.680131188771972e+01) * r - 1.328068155288572e+01) * r + 1) END"""


def _rhat_sql(chain: str) -> str:
    return (
        f", x0 AS (SELECT draw, CASE WHEN draw <= 25 THEN 1 ELSE 2 END AS half, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), x1 AS (SELECT *, {chain} AS chain FROM x0), "
        "both_ AS (SELECT 'bulk' AS kind, chain, x FROM x1 UNION ALL SELECT 'folded', chain, ABS(x - (SELECT MEDIAN(x) FROM x1)) FROM x1), "
        "ranked AS (SELECT kind, chain, (RANK() OVER (PARTITION BY kind ORDER BY x) + (COUNT(*) OVER (PARTITION BY kind, x) - 1) / 2.0) / (COUNT(*) OVER (PARTITION BY kind) + 1) AS p FROM both_), "
        "parts AS (SELECT kind, chain, CAST(p AS DOUBLE) AS p, CAST(p - 0.5 AS DOUBLE) AS q, CAST((p - 0.5) * (p - 0.5) AS DOUBLE) AS r, SQRT(-2 * LN(p)) AS q1, SQRT(-2 * LN(1 - p)) AS q2 FROM ranked), "
        f"z AS (SELECT kind, chain, {_PROBIT} AS z FROM parts), c AS (SELECT kind, chain, COUNT(*) AS n, AVG(z) AS m, VAR_SAMP(z) AS v FROM z GROUP BY 1, 2), "
        "k AS (SELECT kind, SQRT((AVG(n) * VAR_SAMP(m) / AVG(v) + AVG(n) - 1) / AVG(n)) AS rhat FROM c GROUP BY 1) "
    )


def _two_chains(e: model.Ensemble) -> DataFrame:
    return e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x")).withColumn("chain", F.when(F.col("draw") <= 25, 1).otherwise(2))


@query(_rhat_sql("half") + "SELECT 'x' AS \"column\", ROUND(MAX(rhat), 5) AS rhat FROM k")
def rhat_by_column(e):
    return estimates.rhats(_two_chains(e), ["x"]).select("column", F.round("rhat", 5).alias("rhat"))


@query(_rhat_sql("half * 2 - CAST(ROW_NUMBER() OVER (PARTITION BY half ORDER BY draw) <= 13 AS INT)") + "SELECT ROUND(MAX(rhat), 5) AS rhat FROM k")
def split_rhat(e):
    return estimates.rhats(_two_chains(e), ["x"], split=True).select(F.round("rhat", 5).alias("rhat"))


@query(", d AS (SELECT draw, draw % 7 AS ancestor, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), s AS (SELECT ancestor, SUM(x - (SELECT AVG(x) FROM d)) AS r FROM d GROUP BY 1) SELECT ROUND((SELECT AVG(x) FROM d), 6) AS estimate, ROUND(SQRT(SUM(r * r)) / 50, 6) AS se FROM s")
def interval_by_ancestors(e):
    draws = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x")).withColumn("ancestor", F.col("draw") % 7)
    return estimates.interval_by_ancestors(draws, "x").select(_r("estimate"), _r("se"))


@query(", c AS (SELECT draw, CASE WHEN draw <= 25 THEN 1 ELSE 2 END AS chain, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), b AS (SELECT chain, draw, x - AVG(x) OVER (PARTITION BY chain) AS x FROM c), s AS (SELECT chain, SUM(x * x) AS s FROM b GROUP BY 1), a AS (SELECT a.chain, SUM((1 - (z.draw - a.draw) / 5.0) * a.x * z.x) AS t FROM b a JOIN b z ON a.chain = z.chain AND z.draw - a.draw BETWEEN 1 AND 4 GROUP BY 1), e AS (SELECT chain, AVG(x) AS m, VAR_POP(x) AS v, COUNT(*) AS n FROM c GROUP BY 1) SELECT ROUND(SUM(m * n) / SUM(n), 6) AS estimate, ROUND(SQRT(SUM(v * GREATEST(1 + 2 * t / s, 0) * n)) / SUM(n), 6) AS se FROM e JOIN a USING (chain) JOIN s USING (chain)")
def interval_of_chains(e):
    return estimates.interval_of_chains(_two_chains(e), "x", 4).select(_r("estimate"), _r("se"))


@query(_SHARES + ", g AS (SELECT draw, unit_id, ABS(ROUND(s - (SELECT AVG(q.s) FROM proj q WHERE q.unit_id = proj.unit_id AND q.draw <> 1), 12)) AS g FROM proj), p AS (SELECT a.unit_id, AVG(CASE WHEN b.g >= a.g THEN 1.0 ELSE 0.0 END) AS p FROM g a JOIN g b ON a.unit_id = b.unit_id WHERE a.draw = 1 GROUP BY 1), n AS (SELECT COUNT(*) AS n, LEAST(1.0, AVG(CAST(p > 0.5 AS DOUBLE)) / 0.5) AS nulls FROM p), r AS (SELECT DISTINCT p, LEAST(1.0, nulls * n * p / COUNT(*) OVER (ORDER BY p)) AS r FROM p, n) SELECT unit_id, ROUND((SELECT MIN(r.r) FROM r WHERE r.p >= p.p), 6) AS q FROM p")
def contrast_discoveries(e):
    found = overlap.contrast_p_values(e.assignments, tally.group_share(e.assignments, e.map.units, "grp"), "share", 1)
    return estimates.false_discovery(found, "unit_id").select("unit_id", _r("q"))


ORACLES["rank_rhat"] = grid.SQL + _rhat_sql("half") + "SELECT ROUND(MAX(rhat), 5) AS rhat FROM k"


# labels and cores: SQL for what has one value whatever the ties

_CELLS = ", ".join(f"COALESCE(SUM(p) FILTER (WHERE district = {d} AND ref = {r}), 0) AS c{d}{r}" for d in range(1, 6) for r in range(1, 6))
_BEST = "GREATEST(" + ", ".join("+".join(f"c{d}{r}" for d, r in enumerate(to, 1)) for to in permutations(range(1, 6))) + ")"


@query(_JOINT + f", cells AS (SELECT draw, SUM(p) AS whole, {_CELLS} FROM joint GROUP BY draw) SELECT draw, ROUND(CAST({_BEST} AS DOUBLE) / whole, 6) AS pop_overlap FROM cells")
def matched_overlap(e):
    found = labels.match_to(e.assignments, e.map.existing_plan(), e.map.units, e.map.ndists)
    return found.select("draw", _r("pop_overlap")).distinct()


ORACLES["district_cores"] = (
    grid.SQL
    + _CUT
    + """, outer_ AS (SELECT draw, src AS unit_id FROM cut UNION SELECT draw, dst FROM cut), own AS (SELECT a.* FROM asg a WHERE NOT EXISTS (SELECT 1 FROM outer_ o WHERE o.draw = a.draw AND o.unit_id = a.unit_id)),
roots AS (
  WITH RECURSIVE reach(draw, district, root, unit_id) AS (
    SELECT draw, district, unit_id, unit_id FROM own
    UNION
    SELECT r.draw, r.district, r.root, a.unit_id FROM reach r JOIN edges e ON e.src = r.unit_id JOIN own a ON a.draw = r.draw AND a.unit_id = e.dst AND a.district = r.district
  ) SELECT draw, unit_id, MIN(root) AS first FROM reach GROUP BY 1, 2
), every AS (SELECT draw, unit_id, unit_id AS first FROM outer_ UNION ALL SELECT draw, unit_id, first FROM roots)
SELECT draw, unit_id, CAST(DENSE_RANK() OVER (PARTITION BY draw ORDER BY first) AS BIGINT) AS core FROM every"""
)


# verbs


@query(", ids AS (SELECT county, MIN(unit_id) AS unit_id FROM units GROUP BY 1) SELECT CAST(ROW_NUMBER() OVER (ORDER BY unit_id) - 1 AS INT) AS unit_id, county FROM ids")
def distinct_units(e):
    return e.map.distinct("county").units.select("unit_id", "county")


@query("SELECT unit_id, pop, existing, CAST(pop * 2 AS BIGINT) AS twice FROM units")
def transmuted_units(e):
    return e.map.transmute(twice=F.col("pop") * 2).units


@query("SELECT draw, district, CAST(pop AS BIGINT) AS total_pop FROM tally QUALIFY ROW_NUMBER() OVER (ORDER BY draw, district) BETWEEN 8 AND 31")
def sliced_stats(e):
    return e.slice(8, 31).stats.select("draw", "district", "total_pop")


@query("SELECT draw, 6 - district AS district, CAST(pop AS BIGINT) AS total_pop FROM tally")
def replaced_plans(e):
    return e.with_assignments(e.assignments.withColumn("district", 6 - F.col("district"))).stats.select("draw", "district", "total_pop")


@query("SELECT a.src, LIST_REVERSE_SORT(ARRAY_AGG(DISTINCT b.dst))::VARCHAR AS beyond FROM edges a JOIN edges b ON a.dst = b.src WHERE b.dst <> a.src AND NOT EXISTS (SELECT 1 FROM edges d WHERE d.src = a.src AND d.dst = b.dst) GROUP BY 1")
def second_neighbours(e):
    """Units two steps away: the union of the neighbours' neighbours less the unit and its own neighbours."""
    near = e.map.edges.groupBy("src").agg(F.collect_set("dst").alias("near"))
    further = e.map.edges.join(near.withColumnRenamed("src", "dst"), "dst").groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("far")).join(near, "src")
    left = F.sort_array(F.array_except(F.array_except("far", "near"), F.array("src")), False)
    return further.select("src", F.concat(F.lit("["), F.array_join(left.cast("array<string>"), ", "), F.lit("]")).alias("beyond"))


# files


def _folder(e: model.Ensemble) -> str:
    return f"{shared_folder(e.assignments.sparkSession)}/files-{uuid.uuid4().hex}"


@query("SELECT CAST(draw - 5 AS INT) AS draw, STRING_AGG(CAST(district AS VARCHAR), ',' ORDER BY unit_id) AS plan FROM asg WHERE draw BETWEEN 6 AND 25 GROUP BY 1")
def read_partitions(e):
    path = _folder(e)
    lines = e.matrix().select("draw", F.array_join(F.transform("plan", lambda d: (d - 1).cast("string")), " ").alias("value"))
    lines.coalesce(1).sortWithinPartitions("draw").select("value").write.text(path)
    found = enumeration_files.read_partitions(e.assignments.sparkSession, path, skip=5, n_max=20)
    return found.select("draw", F.array_join(F.col("plan").cast("array<string>"), ",").alias("plan"))


@query("SELECT DISTINCT CONCAT(src + 1, ' ', dst + 1) AS value FROM edges WHERE src < dst")
def edge_file(e):
    path = _folder(e)
    enumeration_files.write_edges(e.map.edges, path)
    return e.assignments.sparkSession.read.text(path)


@query("SELECT STRING_AGG(CAST(pop AS VARCHAR), ' ' ORDER BY unit_id) AS value FROM units")
def weight_file(e):
    path = _folder(e)
    enumeration_files.write_weights(e.map.units, path)
    return e.assignments.sparkSession.read.text(path)


@query("SELECT CAST(1 + (draw > 25)::INT AS INT) AS chain, CAST(ROW_NUMBER() OVER (PARTITION BY draw > 25 ORDER BY draw) AS INT) AS draw, draw AS t FROM (SELECT DISTINCT draw FROM asg WHERE draw % 3 = 0)")
def combined_checkpoints(e):
    path = _folder(e)
    steps = e.draws.select(F.when(F.col("draw") <= 25, 1).otherwise(2).alias("chain"), F.col("draw").alias("t"))
    for k in (1, 2):
        steps.filter(F.col("chain") == k).write.parquet(f"{path}/loop-{k}")
    return enumeration_files.combine_checkpoints(e.assignments.sparkSession, path, 3)


@query("SELECT CAST(40 AS BIGINT) AS edges, CAST(40 AS BIGINT) AS placed, TRUE AS small")
def edge_order(e):
    order = enumeration_files.low_frontier_order(e.map.edges)
    widest = graph.frontier_sizes(order).agg((F.max("frontier") <= 7).alias("small"))
    kept = order.join(e.map.edges, (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")))
    return order.agg(F.count(F.lit(1)).alias("edges")).crossJoin(kept.agg(F.countDistinct("pos").alias("placed"))).crossJoin(widest)


# samplers and search


def _plans_sql(n: int) -> str:
    return f"SELECT CAST({n} AS BIGINT) AS plans, CAST({n} AS BIGINT) AS connected, CAST({n} AS BIGINT) AS within_bounds"


_CORNERS = "".join(f", c{i}" for i in range(9))
_PARTITIONS = ORACLES["enumerated_corner"].replace("SELECT CAST(COUNT(*) // 6 AS BIGINT) AS n FROM p", "SELECT CONCAT_WS(','" + "".join(f", c{i} + 1" for i in range(9)) + ") AS plan, TRUE AS as_often FROM p") + " AND c0 = 0 AND STRPOS(CONCAT(" + _CORNERS[2:] + "), '1') < STRPOS(CONCAT(" + _CORNERS[2:] + "), '2')"


def _threes(m: model.PlanMap) -> model.PlanMap:
    """The 3 x 3 corner, a unit's weight being one, for districts of three."""
    corner = m.filter((F.col("gx") < 3) & (F.col("gy") < 3)).mutate(one=F.lit(1))
    return model.PlanMap(corner.units, corner.edges, 3, (3.0, 3.0, 3.0), "one")


@_sampled(_PARTITIONS.replace(", TRUE AS as_often", ""))
def listed_partitions(m):
    even = _threes(m)
    found = enumeration.list_partitions(even.units.sparkSession, even.edges, even.units, 3, "one", 3, 3)
    return found.select(F.array_join(F.col("plan").cast("array<string>"), ",").alias("plan"))


@_sampled(_PARTITIONS)
def sampled_partitions(m):
    """Even draws of the ten partitions of the corner: each within five standard deviations of a tenth."""
    even, n = _threes(m), 1_000
    found = enumeration.sample_partitions(even.units.sparkSession, even.edges, even.units, 3, "one", 3, 3, n, seed=3)
    return found.groupBy(F.array_join(F.col("plan").cast("array<string>"), ",").alias("plan")).agg((F.abs(F.count(F.lit(1)) / n - 0.1) < 5 * (0.09 / n) ** 0.5).alias("as_often"))


@_sampled(_PARTITIONS)
def smc_frequencies(m):
    """Every partition of a 3 x 3 corner into threes has one spanning tree a district, so all ten come equally often."""
    even, n = _threes(m), 1_000
    found = labels.by_first_appearance(model.from_arrays(sampling.smc(even, n, seed=21), even).assignments)
    plans = found.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("unit_id", "district"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["district"].cast("string")), ",")
    # four standard deviations, with room for the draws that resampling repeats
    return plans.groupBy(text.alias("plan")).agg((F.abs(F.count(F.lit(1)) / n - 0.1) < 6 * (0.09 / n) ** 0.5).alias("as_often"))


@_sampled("SELECT CAST(60 AS BIGINT) AS plans, TRUE AS few_splits")
def smc_with_counties(m):
    found = model.from_arrays(sampling.smc(m.with_pop_tol(0.3), 60, seed=5, counties="county"), m)
    return tally.county_splits(found.assignments, m.units).agg(F.count(F.lit(1)).alias("plans"), (F.max("splits") <= m.ndists - 1).alias("few_splits"))


@_sampled("SELECT TRUE AS lower")
def smc_with_penalties(m):
    """A strong penalty on removed edges leaves fewer of them than none does."""
    strong = [penalties.edges_removed(1.5, m.edges), penalties.splits(0.5)]
    cut = [graph.edges_removed(m.edges, model.from_arrays(sampling.smc(m, 150, seed=6, penalty=p), m).assignments).agg(F.avg("removed").alias(c)) for p, c in ((None, "free"), (strong, "held"))]
    return cut[0].crossJoin(cut[1]).select((F.col("held") < F.col("free")).alias("lower"))


@_sampled("SELECT chain, step, CAST(60 AS BIGINT) AS n, TRUE AS plausible FROM (VALUES (1), (2)) c(chain), (VALUES (1), (2), (3), (4)) s(step)")
def smc_diagnostics(m):
    run = estimates.step_flags(sampling.smc_run(m, 60, seed=9, runs=2).steps)
    good = (F.col("n_eff") > 1) & (F.col("n_eff") <= F.col("n")) & (F.col("accept_rate") > 0) & (F.col("accept_rate") <= 1) & (F.col("unique_parents") <= F.col("n")) & F.col("bottleneck").isNotNull()
    return run.select("chain", "step", "n", good.alias("plausible"))


@_sampled(_plans_sql(40))
def smc_resumed(m):
    """Partial plans that are taken up again and finished, with population tempering on the way."""
    begun = sampling.smc_run(m, 40, seed=14, steps=2, pop_temper=0.05).plans.select("draw", "plan")
    return _checked(m, sampling.smc(m, 40, seed=15, start=begun, pop_temper=0.05))


@_sampled("SELECT CAST(40 AS BIGINT) AS plans, TRUE AS partial, TRUE AS truncated")
def smc_partial(m):
    """Partial plans with truncated weights: those of the same run untruncated, cut at their quantile."""
    plain, cut = (sampling.smc_run(m, 40, seed=10, steps=2, resample=False, truncate=t).plans for t in (None, estimates.truncated))
    top = plain.agg(F.percentile("wgt", 1 - 40**-0.5).alias("top"))
    met = cut.join(plain.select("draw", F.col("wgt").alias("whole")), "draw").crossJoin(F.broadcast(top))
    held = F.abs(F.col("wgt") - F.least("whole", "top")) < 1e-12
    return met.agg(F.count(F.lit(1)).alias("plans"), F.bool_and(F.array_contains("plan", 0) & (F.array_max("plan") == 2)).alias("partial"), (F.bool_and(held) & F.bool_or(F.col("whole") > F.col("top"))).alias("truncated"))


@_sampled(_plans_sql(120))
def component_chains(m):
    return _checked(m, _numbered(sampling.chains(m, _existing(m, 4), 120, "components", seed=5, thin=4, eprob=0.1, lam=0.5), 120))


@_sampled("SELECT chain, TRUE AS moved FROM (VALUES (1), (2)) t(chain)")
def acceptance_rates(m):
    moves = sampling.chains(m, _existing(m, 2), 80, seed=15, accepted=True)
    return sampling.acceptance(moves).select("chain", F.col("rate").between(0.01, 1.0).alias("moved"))


def _unevenness(m: model.PlanMap):
    loads = np.array([r["pop"] for r in m.units.select("unit_id", "pop").orderBy("unit_id").limit(sampling.MOST_UNITS).collect()], float)
    even = m.target
    return lambda plan: float(np.abs(np.bincount(plan, loads)[1:] / even - 1).sum())


@_sampled(_plans_sql(80))
def tempered_chains(m):
    return _checked(m, _numbered(search.tempered(m, _existing(m, 2), 40, _unevenness(m), search.ladder(4), seed=3), 40))


@_sampled("SELECT CAST(90 AS BIGINT) AS plans, CAST(90 AS BIGINT) AS connected, CAST(90 AS BIGINT) AS within_bounds")
def parallel_tempering(m):
    return _checked(m, _numbered(search.parallel_tempering(m, _existing(m, 3), 30, _unevenness(m), search.ladder(3), every=10, seed=4), 30))


@query("SELECT CAST(400 AS BIGINT) AS picks, TRUE AS heavier")
def reweighted_draws(e):
    energy = e.stats.groupBy("draw").agg((F.max("total_pop") / e.map.target).alias("energy"))
    found = search.reweighted(e.draws, energy, 8.0, 400, seed=2).join(energy, "draw")
    return found.agg(F.count(F.lit(1)).alias("picks"), F.avg("energy").alias("a")).crossJoin(energy.agg(F.avg("energy").alias("b"))).select("picks", (F.col("a") > F.col("b")).alias("heavier"))


@_sampled(_plans_sql(8))
def compact_seed_and_grow(m):
    return _checked(m, search.compact_seed_and_grow(m, 8, seed=8))


@_sampled("SELECT CAST(11 AS BIGINT) AS units, TRUE AS connected")
def random_subgraph(m):
    own = search.random_subgraph(m, 11, seed=4)
    return own.units.agg(F.count(F.lit(1)).alias("units")).withColumn("connected", F.lit(graph.is_connected(own.edges, own.units)))


@_sampled("SELECT TRUE AS some_plans, CAST(0 AS BIGINT) AS beaten")
def frontier_bursts(m):
    start = sampling.smc(m, 4, seed=12).filter("draw = 1").select("plan")

    def scores(asg: DataFrame) -> DataFrame:
        kept = graph.edges_removed(m.edges, asg).select("draw", F.col("frac_kept").alias("kept"))
        return kept.join(tally.parity(asg, m.units).select("draw", (-F.col("parity")).alias("even")), "draw")

    front = search.frontier_bursts(m, start, scores, ["kept", "even"], 2, lambda b: 5 + b, seed=2)
    a, b = (front.select(F.col("kept").alias(f"k{x}"), F.col("even").alias(f"e{x}")) for x in "ab")
    worse = (F.col("kb") >= F.col("ka")) & (F.col("eb") >= F.col("ea")) & ((F.col("kb") > F.col("ka")) | (F.col("eb") > F.col("ea")))
    beaten = a.join(F.broadcast(b), worse, "left_semi").agg(F.count(F.lit(1)).alias("beaten"))  # a frontier of a few plans
    return front.agg((F.count(F.lit(1)) > 0).alias("some_plans")).crossJoin(beaten)


@_sampled("SELECT eprob, quartile, TRUE AS plausible FROM (VALUES (0.05::DOUBLE), (0.2::DOUBLE)) e(eprob), (VALUES (1), (2), (3), (4)) q(quartile)")
def parameter_report(m):
    found = search.parameter_report(m, _existing(m, 2), 16, {"eprob": [0.05, 0.2]}, seed=3)
    return found.select("eprob", "quartile", (F.col("median_parity").between(0, 0.2001) & F.col("acceptance").between(0, 1)).alias("plausible"))


#: By duality the least sum is the largest sum of k / 5 times the gaps, over whole k from -5 to 5 that differ by one at most between neighbours.
_DUAL = (
    ", near AS (SELECT DISTINCT a.draw, a.district AS a, b.district AS b FROM edges e JOIN asg a ON a.unit_id = e.src JOIN asg b ON b.unit_id = e.dst AND b.draw = a.draw WHERE a.district < b.district), "
    "gaps AS (SELECT draw, " + ", ".join(f"MAX(CASE WHEN district = {d} THEN pop END) - AVG(pop) AS g{d}" for d in range(1, 6)) + " FROM tally GROUP BY draw), "
    "beside AS (SELECT draw, " + ", ".join(f"BOOL_OR(a = {a} AND b = {b}) AS n{a}{b}" for a in range(1, 6) for b in range(a + 1, 6)) + " FROM near GROUP BY draw), "
    "k AS (SELECT " + ", ".join(f"k{d}.range AS k{d}" for d in range(1, 6)) + " FROM " + ", ".join(f"range(-5, 6) k{d}" for d in range(1, 6)) + ") "
    "SELECT draw, ROUND(MAX(" + " + ".join(f"k{d} * g{d}" for d in range(1, 6)) + ") / 5, 4) AS cost FROM k, gaps JOIN beside USING (draw) WHERE " + " AND ".join(f"(NOT n{a}{b} OR ABS(k{a} - k{b}) <= 1)" for a in range(1, 6) for b in range(a + 1, 6)) + " GROUP BY draw"
)


@query(_DUAL)
def least_moves(e):
    """What is left of every gap after the moves, and a fifth of the people moved."""
    moves = search.least_moves(e.assignments, e.map, 0.2, whole=False)
    flows = moves.select("draw", F.col("a").alias("district"), (-F.col("move")).alias("d")).union(moves.select("draw", "b", "move"))
    mean = F.avg("p").over(W.partitionBy("draw"))
    gaps = tally.tally(e.assignments, e.map.units, p="pop").select("draw", "district", (F.col("p") - mean).alias("d"))
    left = gaps.union(flows).groupBy("draw", "district").agg(F.sum("d").alias("d")).groupBy("draw").agg(F.sum(F.abs("d")).alias("left"))
    moved = moves.groupBy("draw").agg(F.sum("move").alias("moved"))
    return left.join(moved, "draw", "left").select("draw", F.round(F.col("left") + 0.2 * F.coalesce("moved", F.lit(0.0)), 4).alias("cost"))


# the customers' grid


def large(sql: str):
    """Register a function of the customers' ensemble under its name."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(customer_grid.customer_plans(spark, sf_dir))
        ORACLES[fn.__name__] = customer_grid.SQL + sql
        return fn

    return add


@large("SELECT draw, district, ROUND(CAST(SUM(grp) AS DOUBLE) / SUM(pop), 6) AS share FROM asg JOIN units USING (unit_id) GROUP BY 1, 2")
def large_group_share(e):
    return tally.group_share(e.assignments, e.map.units, "grp").select("draw", "district", _r("share"))


@large("SELECT a.draw, COUNT(*) AS removed FROM edges e JOIN asg a ON a.unit_id = e.src JOIN asg b ON b.unit_id = e.dst AND b.draw = a.draw WHERE a.district <> b.district GROUP BY 1")
def large_edges_removed(e):
    return graph.edges_removed(e.map.edges, e.assignments).select("draw", "removed")


@large(", n AS (SELECT draw, county, COUNT(DISTINCT district) AS n FROM asg JOIN units USING (unit_id) GROUP BY 1, 2) SELECT draw, COUNT(*) FILTER (WHERE n > 1) AS splits, COUNT(*) FILTER (WHERE n > 2) AS multisplits, CAST(SUM(n - 1) AS BIGINT) AS total_splits FROM n GROUP BY 1")
def large_county_splits(e):
    return tally.county_splits(e.assignments, e.map.units)


@large(", s AS (SELECT draw, district, CAST(SUM(grp) AS DOUBLE) / SUM(pop) AS s FROM asg JOIN units USING (unit_id) GROUP BY 1, 2) SELECT unit_id, ROUND(AVG(s), 6) AS value FROM asg JOIN s USING (draw, district) GROUP BY 1")
def large_projective_average(e):
    return overlap.projective_average(e.assignments, tally.group_share(e.assignments, e.map.units, "grp"), "share").select("unit_id", _r("value"))
