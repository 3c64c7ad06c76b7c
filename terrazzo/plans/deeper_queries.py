"""Registered queries: intervals from ancestors, discoveries, resampling, outlines, radii, numbered partitions, cores, trees, the large grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimates
from ..operators import compare, graph, labels, nearest, overlap, resample, shapes, tally
from ..sources import nation_grid as grid
from . import enumeration, model, sampling
from .analysis_queries import _CORNERS, _PARTITIONS, _threes, _z, large
from .queries import ORACLES, QUERIES, _r, _sampled, query

# leading eigenvectors: in SQL by squaring the dense matrix, shifted to be positive, until one projector is left

_GAP = ", c AS (SELECT CASE WHEN a.draw <= 25 THEN 1 ELSE 2 END AS part, a.unit_id AS i, b.unit_id AS j, COUNT(*) AS k FROM asg a JOIN asg b ON a.draw = b.draw AND a.district = b.district AND a.unit_id <> b.unit_id GROUP BY 1, 2, 3), gap AS MATERIALIZED (SELECT x.unit_id AS i, y.unit_id AS j, (COALESCE(a.k, 0) - COALESCE(b.k, 0)) / 26.0::DOUBLE AS g FROM units x CROSS JOIN units y LEFT JOIN c a ON a.part = 1 AND a.i = x.unit_id AND a.j = y.unit_id LEFT JOIN c b ON b.part = 2 AND b.i = x.unit_id AND b.j = y.unit_id), p0 AS MATERIALIZED (SELECT split, i, j, CASE WHEN split = 1 THEN g ELSE -g END + CASE WHEN i = j THEN (SELECT SQRT(SUM(g * g)) FROM gap) ELSE 0 END AS g FROM gap, (VALUES (1), (2)) s(split))"
_SQUARES = "".join(f", s{k} AS MATERIALIZED (SELECT a.split, a.i, b.j, SUM(a.g * b.g) AS g FROM p{k - 1} a JOIN p{k - 1} b ON a.split = b.split AND a.j = b.i GROUP BY 1, 2, 3), p{k} AS MATERIALIZED (SELECT split, i, j, g / SUM(CASE WHEN i = j THEN g ELSE 0 END) OVER (PARTITION BY split) AS g FROM s{k})" for k in range(1, 19))
_LEADING = _GAP + _SQUARES + ", x AS (SELECT split, SUM(p.g * gap.g) * CASE WHEN split = 1 THEN 1 ELSE -1 END AS x FROM p18 p JOIN gap USING (i, j) GROUP BY split) SELECT split, i AS unit_id, ROUND(g, 5) + 0.0 AS square, ROUND(x, 6) AS separation FROM p18 JOIN x USING (split) WHERE i = j"


@query(_LEADING)
def leading_splits(e):
    """What ``compare_sets`` finds without a matrix, against the projectors of the dense one."""
    found = compare.compare_sets(e.assignments.filter("draw <= 25"), e.assignments.filter("draw > 25"), 5)
    return found.select("split", "unit_id", (F.round(F.col("value") ** 2, 5) + 0.0).alias("square"), _r("separation"))


@large(", n AS (SELECT COUNT(*) AS units FROM units) SELECT split, units, TRUE AS unit, TRUE AS apart FROM n, (VALUES (1), (2)) s(split)")
def large_compared_sets(e):
    """Every customer is a unit; no pair of them is formed."""
    found = compare.compare_sets(e.assignments.filter("draw <= 50"), e.assignments.filter("draw > 50"), 10)
    return found.groupBy("split").agg(F.count(F.lit(1)).alias("units"), (F.abs(F.sum(F.col("value") ** 2) - 1) < 1e-6).alias("unit"), (F.max("separation") > 0).alias("apart"))


@large(", met AS (SELECT a.unit_id AS unit_i, b.unit_id AS unit_j, COUNT(*) AS k FROM asg a JOIN asg b ON a.draw = b.draw AND a.district = b.district AND a.unit_id < b.unit_id GROUP BY 1, 2) SELECT unit_i, unit_j, k / 100.0::DOUBLE AS p FROM met WHERE k >= 80")
def large_cooccurrence(e):
    return overlap.cooccurrence(e.assignments, least=0.8)


# resampling and ancestors

_CUMULATIVE = ", c AS (SELECT unit_id, pop, SUM(pop) OVER (ORDER BY unit_id) AS z, (SELECT SUM(pop) FROM units) AS t FROM units), k AS (SELECT unit_id, CAST(CEIL(CAST(z AS DOUBLE) / t * {n} - {u}) - GREATEST(CEIL(CAST(z - pop AS DOUBLE) / t * {n} - {u}), 0) AS BIGINT) AS copies FROM c) SELECT unit_id, copies FROM k WHERE copies > 0"


@large(_CUMULATIVE.format(n=1000, u="0.37::DOUBLE"))
def large_low_variance(e):
    """A thousand units drawn in proportion to their population; every unit's share of the draws is rounded up or down."""
    drawn = resample.low_variance(e.map.units.select(F.col("unit_id").alias("id"), F.col("pop").cast("double").alias("w")), 1000, 0.37)
    return drawn.groupBy(F.col("id").alias("unit_id")).agg(F.count(F.lit(1)).alias("copies"))


_LAGGED = ", d AS (SELECT draw, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), r AS (SELECT draw, x - (SELECT AVG(x) FROM d) AS r FROM d), s AS (SELECT lag, draw % (3 * lag) AS ancestor, SUM(r) AS s, COUNT(*) AS c FROM r, (VALUES (1), (2), (3)) l(lag) GROUP BY 1, 2), e AS (SELECT lag, SQRT(SUM(c * s * s)) / 50 AS e FROM s GROUP BY 1), q AS (SELECT (SELECT AVG(x) FROM d) AS estimate, QUANTILE_CONT(e, 0.75) AS se FROM e) "
#: 0.95 quantile of Student's t with 49 degrees of freedom; fixed value.
_T49 = "1.6765508919142629"


@query(_LAGGED + f"SELECT ROUND(estimate, 6) AS estimate, ROUND(se, 6) AS se, ROUND(estimate - {_T49} * se, 5) AS low, ROUND(estimate + {_T49} * se, 5) AS high FROM q")
def interval_by_lags(e):
    draws = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x"))
    ancestors = draws.select("draw", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("draw") % (3 * k)).alias("ancestor")) for k in (1, 2, 3)])).alias("a")).select("draw", "a.*")
    return estimates.interval_by_lags(draws, ancestors, "x").select(_r("estimate"), _r("se"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(f", d AS (SELECT draw, (draw - 1) // 10 AS chain, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), m AS (SELECT chain, AVG(x) AS m FROM d GROUP BY 1), q AS (SELECT (SELECT AVG(x) FROM d) AS estimate, STDDEV_SAMP(m) / 2 AS se FROM m) SELECT ROUND(estimate, 6) AS estimate, ROUND(se, 6) AS se, ROUND(estimate - {_T49} * se, 5) AS low, ROUND(estimate + {_T49} * se, 5) AS high FROM q")
def interval_of_runs(e):
    draws = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x")).withColumn("chain", F.floor((F.col("draw") - 1) / 10))
    return estimates.interval_of_runs(draws, "x").select(_r("estimate"), _r("se"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@_sampled("SELECT CAST(lag AS INT) AS lag, CAST(80 AS BIGINT) AS draws, TRUE AS particles, TRUE AS fewer FROM (VALUES (1), (2), (3)) l(lag)")
def smc_ancestors(m):
    """Draws by the particles they stem from: all known, and no more of an early step than of a later one."""
    run = sampling.smc_run(m, 80, seed=31)
    by = run.ancestors.groupBy("lag").agg(F.count(F.lit(1)).alias("draws"), F.bool_and(F.col("ancestor").between(0, 79)).alias("particles"), F.countDistinct("ancestor").alias("k"))
    later = by.select((F.col("lag") - 1).alias("lag"), F.col("k").alias("more"))
    return by.join(later, "lag", "left").select(F.col("lag").cast("int").alias("lag"), "draws", "particles", (F.col("k") <= F.coalesce("more", F.col("draws"))).alias("fewer"))


def _as_often(plans: DataFrame, even: model.PlanMap, n: int, width: float) -> DataFrame:
    found = labels.by_first_appearance(model.from_arrays(plans, even).assignments)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "district"))), lambda x: x["district"].cast("string")), ",")
    return found.groupBy("draw").agg(text.alias("plan")).groupBy("plan").agg((F.abs(F.count(F.lit(1)) / n - 0.1) < width * (0.09 / n) ** 0.5).alias("as_often"))


@_sampled(_PARTITIONS)
def smc_resumed_frequencies(m):
    """Partial plans, taken up again: the ten partitions of the corner come as often as in a whole run."""
    even, n = _threes(m), 1_000
    begun = sampling.smc_run(even, n, seed=41, steps=1).plans.select("draw", "plan")
    return _as_often(sampling.smc(even, n, seed=42, start=begun), even, n, 5)


@_sampled(_PARTITIONS)
def smc_tempered_frequencies(m):
    """Population tempering leaves the frequencies as they are (five standard deviations of weighted draws)."""
    even, n = _threes(m), 1_000
    wide = model.PlanMap(even.units, even.edges, 3, even.bounds, "one")
    return _as_often(sampling.smc(wide, n, seed=43, pop_temper=0.02), even, n, 5)


_SUMMARY_STEPS = ", t AS (SELECT draw, CASE WHEN draw <= 25 THEN 1 ELSE 2 END AS chain, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), steps AS (SELECT chain, CAST(draw AS INT) AS step, 3 AS k, x / 10 AS n_eff, 0.5::DOUBLE AS accept_rate, x / 100 AS sd_lp, draw AS unique_parents, 100 AS n FROM t WHERE draw % 10 = 0), flagged AS (SELECT *, LEAST(n_eff, unique_parents) < GREATEST(5, LEAST(40, 100.0)) AS warn FROM steps), lines AS (SELECT 'split' AS part, chain, step, UNNEST([{'item': 'n_eff', 'value': n_eff / n}, {'item': 'survivors', 'value': unique_parents / CAST(n AS DOUBLE)}, {'item': 'accept_rate', 'value': accept_rate}, {'item': 'sd_lp', 'value': sd_lp}, {'item': 'k', 'value': k::DOUBLE}], recursive := true), warn FROM flagged) SELECT part, chain, step, item, ROUND(value, 6) + 0.0 AS value, warn FROM lines"


@query(_SUMMARY_STEPS)
def summary_of_steps(e):
    """The lines on splits of a run's summary, for steps made from the plans' statistics."""
    stats = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x")).withColumn("chain", F.when(F.col("draw") <= 25, 1).otherwise(2))
    steps = stats.filter("draw % 10 = 0").select("chain", F.col("draw").cast("int").alias("step"), F.lit(3).alias("k"), (F.col("x") / 10).alias("n_eff"), F.lit(0.5).alias("accept_rate"), (F.col("x") / 100).alias("sd_lp"), F.col("draw").cast("long").alias("unique_parents"), F.lit(100).cast("long").alias("n"))
    told = estimates.run_summary(steps, stats, ["x"], overlap.diversity(e.assignments, e.map.units))
    return told.filter("part = 'split'").select("part", "chain", "step", "item", _z("value"), "warn")


# discoveries by ranks

_RANKED = (
    "WITH RECURSIVE "
    + grid.SQL.strip().removeprefix("WITH ")
    + """, shares AS (SELECT draw, district, CAST(grp AS DOUBLE) / pop AS s FROM tally), proj AS (SELECT draw, unit_id, s FROM asg JOIN shares USING (draw, district)),
mean AS (SELECT unit_id, AVG(s) AS m FROM proj WHERE draw <> 1 GROUP BY 1), g AS (SELECT draw, unit_id, ABS(ROUND(s - m, 12)) AS g FROM proj JOIN mean USING (unit_id)),
r AS (SELECT unit_id, COUNT(*) OVER (PARTITION BY unit_id ORDER BY g RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM g WHERE draw <> 1),
p AS (SELECT a.unit_id, COUNT(*) FILTER (WHERE b.g >= a.g) + 1 AS c FROM g a JOIN g b ON b.unit_id = a.unit_id AND b.draw <> 1 WHERE a.draw = 1 GROUP BY 1),
size AS (SELECT COUNT(*) AS m, 49 AS n FROM p), knot AS (SELECT DISTINCT (SELECT QUANTILE_DISC(c, k / 14.0::DOUBLE) FROM p) AS c FROM range(0, 15) t(k)),
ks AS (SELECT QUANTILE_DISC(c, [0, 1/14.0, 2/14.0, 3/14.0, 4/14.0, 5/14.0, 6/14.0, 7/14.0, 8/14.0, 9/14.0, 10/14.0, 11/14.0, 12/14.0, 13/14.0, 1]) AS c FROM p), knots AS (SELECT DISTINCT UNNEST(c) AS c FROM ks),
pi AS (SELECT LEAST(1.0, (m - (SELECT COUNT(*) FROM p WHERE 2 * c <= n)) / (m - (SELECT COUNT(*) FROM r WHERE 2 * r <= n) / CAST(n AS DOUBLE))) AS pi FROM size),
f AS (SELECT c, pi * (SELECT COUNT(*) FROM r WHERE r <= c) / 49.0 / (SELECT COUNT(*) FROM p WHERE p.c <= knots.c) AS f FROM knots, pi),
y AS (SELECT ROW_NUMBER() OVER (ORDER BY c) AS k, c / 49.0::DOUBLE AS x, CAST(MIN(f) OVER (ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS y FROM f),
s AS (SELECT a.k, a.x, a.y, b.x - a.x AS h, b.y AS yy, (b.y - a.y) / (b.x - a.x) AS s FROM y a JOIN y b ON b.k = a.k + 1),
m0 AS (SELECT y.k, CASE WHEN l.s IS NULL THEN r_.s WHEN r_.s IS NULL THEN l.s ELSE (l.s + r_.s) / 2 END AS m FROM y LEFT JOIN s l ON l.k = y.k - 1 LEFT JOIN s r_ ON r_.k = y.k),
step(k, own, next) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), (SELECT m FROM m0 WHERE k = 1)
  UNION ALL
  SELECT s.k, CASE WHEN s.s = 0 THEN 0 WHEN held THEN 3 * s.s / SQRT(a * a + b * b) * a ELSE v.next END, CASE WHEN s.s = 0 THEN 0 WHEN held THEN 3 * s.s / SQRT(a * a + b * b) * b ELSE m1 END
  FROM (SELECT step.next, s.*, m0.m AS m1, step.next / NULLIF(s.s, 0) AS a, m0.m / NULLIF(s.s, 0) AS b,
    COALESCE(2 * step.next / NULLIF(s.s, 0) + m0.m / NULLIF(s.s, 0) - 3 > 0 AND step.next / NULLIF(s.s, 0) + 2 * m0.m / NULLIF(s.s, 0) - 3 > 0
      AND step.next / NULLIF(s.s, 0) * (3 * step.next / NULLIF(s.s, 0) + 3 * m0.m / NULLIF(s.s, 0) - 6) < (2 * step.next / NULLIF(s.s, 0) + m0.m / NULLIF(s.s, 0) - 3) ** 2, FALSE) AS held
    FROM step JOIN s ON s.k = step.k + 1 JOIN m0 ON m0.k = s.k + 1) v JOIN s ON s.k = v.k
), slopes AS (SELECT k, own AS m FROM step WHERE k > 0 UNION ALL SELECT k + 1, next FROM step WHERE k = (SELECT MAX(k) FROM step)),
piece AS (SELECT s.*, a.m AS m0, b.m AS m1 FROM s JOIN slopes a ON a.k = s.k JOIN slopes b ON b.k = s.k + 1),
seen AS (SELECT p.unit_id, p.c / 49.0::DOUBLE AS p, piece.*, (p.c / 49.0::DOUBLE - x) / h AS t FROM p JOIN piece ON p.c / 49.0::DOUBLE <= x + h AND (p.c / 49.0::DOUBLE > x OR piece.k = 1))
SELECT unit_id, ROUND(p, 6) AS p, ROUND(y * (1 - t * t * (3 - 2 * t)) + yy * t * t * (3 - 2 * t) + h * m0 * t * (t - 1) * (t - 1) + h * m1 * t * t * (t - 1), 6) + 0.0 AS q FROM seen"""
)


@query()
def rank_discoveries(e):
    """Units where the first draw's share departs from the others', with false discovery rates against all draws' ranks."""
    ranks, own, n = overlap.contrast_departures(e.assignments, tally.group_share(e.assignments, e.map.units, "grp"), "share", 1)
    return estimates.rank_discoveries(ranks, own, n, "unit_id").select("unit_id", _r("p"), _z("q"))


ORACLES["rank_discoveries"] = _RANKED


# outlines


def _bricks(e: model.Ensemble) -> DataFrame:
    """Units as bricks two wide: every other row is shifted by one, so sides above one another are shared in part."""
    left = F.col("gx") * 2 + F.col("gy") % 2
    around = F.array(*[F.struct(F.lit(k).alias("pos"), (left + a).cast("double").alias("x"), (F.col("gy") + b).cast("double").alias("y")) for k, (a, b) in enumerate(((0, 0), (2, 0), (2, 1), (0, 1)))])
    return e.map.units.select("unit_id", F.lit(0).alias("ring"), F.explode(around).alias("c")).select("unit_id", "ring", "c.*")


_BRICKS = "SELECT a.unit_id AS src, b.unit_id AS dst FROM units a JOIN units b ON (a.gy = b.gy AND ABS(a.gx - b.gx) = 1) OR (ABS(a.gy - b.gy) = 1 AND ABS(2 * a.gx + a.gy % 2 - 2 * b.gx - b.gy % 2) < 2)"


@query(_BRICKS)
def brick_neighbours(e):
    return nearest.adjacency_of_outlines(_bricks(e))


@large(_BRICKS)
def large_brick_neighbours(e):
    return nearest.adjacency_of_outlines(_bricks(e))


def _tiles(e: model.Ensemble) -> DataFrame:
    around = F.array(*[F.struct(F.lit(k).alias("pos"), (F.col("gx") + a).cast("double").alias("x"), (F.col("gy") + b).cast("double").alias("y")) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    return e.map.units.select("unit_id", F.lit(0).alias("ring"), F.explode(around).alias("c")).select("unit_id", "ring", "c.*")


#: Radii of districts of unit squares: a ray leaves a square where it passes its farther wall or roof.
_RADII = """, place AS (SELECT draw, district, AVG(gx + 0.5) AS cx, AVG(gy + 0.5) AS cy FROM asg JOIN units USING (unit_id) GROUP BY 1, 2),
own AS (SELECT draw, district, unit_id, gx, gy, cx, cy FROM asg JOIN units USING (unit_id) JOIN place USING (draw, district)),
inside AS (SELECT draw, district, BOOL_OR(cx > gx - 1e-12 AND cx < gx + 1 - 1e-12 AND cy > gy - 1e-12 AND cy < gy + 1 - 1e-12) AS inside FROM own GROUP BY 1, 2),
moved AS (SELECT draw, district, gx + 0.5 AS cx, gy + 0.5 AS cy FROM own QUALIFY ROW_NUMBER() OVER (PARTITION BY draw, district ORDER BY ROUND(SQRT((gx + 0.5 - cx) ** 2 + (gy + 0.5 - cy) ** 2), 9), unit_id) = 1),
centre AS (SELECT p.draw, p.district, CASE WHEN inside THEN p.cx ELSE m.cx END AS cx, CASE WHEN inside THEN p.cy ELSE m.cy END AS cy FROM place p JOIN inside USING (draw, district) JOIN moved m USING (draw, district)),
rays AS (SELECT range AS k, CASE WHEN range IN (4, 12) THEN 0.0 ELSE COS(range * PI() / 8) END AS dx, CASE WHEN range IN (0, 8) THEN 0.0 ELSE SIN(range * PI() / 8) END AS dy FROM range(0, 16)),
cut AS (SELECT o.draw, o.district, k,
  GREATEST(CASE WHEN dx = 0 THEN CASE WHEN c.cx BETWEEN gx AND gx + 1 THEN -1e9 ELSE 1e9 END WHEN dx > 0 THEN (gx - c.cx) / dx ELSE (gx + 1 - c.cx) / dx END,
           CASE WHEN dy = 0 THEN CASE WHEN c.cy BETWEEN gy AND gy + 1 THEN -1e9 ELSE 1e9 END WHEN dy > 0 THEN (gy - c.cy) / dy ELSE (gy + 1 - c.cy) / dy END) AS enter,
  LEAST(CASE WHEN dx = 0 THEN 1e9 WHEN dx > 0 THEN (gx + 1 - c.cx) / dx ELSE (gx - c.cx) / dx END,
        CASE WHEN dy = 0 THEN 1e9 WHEN dy > 0 THEN (gy + 1 - c.cy) / dy ELSE (gy - c.cy) / dy END) AS leave
  FROM own o JOIN centre c USING (draw, district), rays),
r AS (SELECT draw, district, k, MAX(CASE WHEN enter <= leave + 1e-9 AND leave >= 0 THEN leave ELSE 0 END) AS r FROM cut GROUP BY 1, 2, 3),
t AS (SELECT *, SUM(r) OVER (PARTITION BY draw, district) AS t FROM r)
SELECT draw, district, ROUND(1 - SUM(ABS(r / t * 100 - 6.25)) / 200, 5) AS boyce_clark FROM t GROUP BY 1, 2"""


@query(_RADII)
def radii(e):
    return shapes.boyce_clark(e.assignments, _tiles(e)).select("draw", "district", F.round("boyce_clark", 5).alias("boyce_clark"))


# numbered partitions


@_sampled("SELECT CAST(117 AS BIGINT) AS n, CAST(117 AS BIGINT) AS unlike, TRUE AS own_number, TRUE AS in_the_list")
def numbered_partitions(m):
    """The 4 x 4 corner in fours: every partition's number finds it again, as does any slice of the list."""
    corner = m.filter((F.col("gx") < 4) & (F.col("gy") < 4)).mutate(one=F.lit(1))
    dag = enumeration.PartitionDag(m.units.sparkSession, corner.edges, corner.units, 4, "one", 4, 4)
    every = dag.slice(0, dag.count)
    text = F.array_join(F.col("plan").cast("array<string>"), ",")
    back = dag.rank(every).select("draw", (F.col("rank") == F.col("draw")).alias("same"))
    some = dag.slice(50, 9).select("draw", text.alias("t")).join(every.select("draw", text.alias("s")), "draw").agg(((F.count(F.lit(1)) == 9) & F.bool_and(F.col("t") == F.col("s"))).alias("in_the_list"))
    return every.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(text).alias("unlike")).crossJoin(back.agg(((F.count(F.lit(1)) == 117) & F.bool_and("same")).alias("own_number"))).crossJoin(some)


# cores and trees


@query()
def cores_near_a_district(e):
    return graph.cores(e.map.edges, e.assignments, 1, focus=2)


ORACLES["cores_near_a_district"] = ORACLES["district_cores"].replace("outer_ AS (SELECT draw, src AS unit_id FROM cut UNION SELECT draw, dst FROM cut)", "near AS (SELECT draw, unit_id FROM asg WHERE district = 2 UNION SELECT a.draw, e.dst FROM asg a JOIN edges e ON e.src = a.unit_id WHERE a.district = 2), outer_ AS (SELECT * FROM (SELECT draw, src AS unit_id FROM cut UNION SELECT draw, dst FROM cut) SEMI JOIN near USING (draw, unit_id))")

#: Districts of five squares: trees of each part of a county from its edges (parts are trees or hold one square of four), and of the graph of parts.
_LEVELS = """, own AS (SELECT a.draw, a.district, e.src, e.dst, u.county AS c, w.county AS d FROM edges e JOIN asg a ON a.unit_id = e.src JOIN asg b ON b.unit_id = e.dst AND b.draw = a.draw AND b.district = a.district JOIN units u ON u.unit_id = e.src JOIN units w ON w.unit_id = e.dst WHERE e.src < e.dst),
steps AS (SELECT draw, district, src, dst FROM own WHERE c = d UNION ALL SELECT draw, district, dst, src FROM own WHERE c = d),
part AS (
  WITH RECURSIVE reach(draw, district, root, unit_id) AS (
    SELECT draw, district, unit_id, unit_id FROM asg UNION SELECT r.draw, r.district, r.root, s.dst FROM reach r JOIN steps s ON s.draw = r.draw AND s.district = r.district AND s.src = r.unit_id
  ) SELECT draw, district, unit_id, MIN(root) AS part FROM reach GROUP BY 1, 2, 3
), between_ AS (SELECT o.draw, o.district, LEAST(p.part, q.part) AS a, GREATEST(p.part, q.part) AS b, COUNT(*) AS w FROM own o JOIN part p ON p.draw = o.draw AND p.unit_id = o.src JOIN part q ON q.draw = o.draw AND q.unit_id = o.dst WHERE p.part <> q.part GROUP BY 1, 2, 3, 4),
sizes AS (SELECT draw, district, COUNT(DISTINCT part) AS parts FROM part GROUP BY 1, 2),
links AS (SELECT draw, district, COUNT(*) AS links, SUM(LN(w)) AS l FROM between_ GROUP BY 1, 2)
SELECT s.draw, s.district, ROUND(COALESCE(l, 0), 6) + 0.0 AS log_trees FROM sizes s LEFT JOIN links USING (draw, district) WHERE COALESCE(links, 0) = parts - 1"""


@query(_LEVELS)
def two_level_trees(e):
    """Rows of the grid are counties: a county's part is a path with one tree, and parts in a row of rows are linked by as many trees as edges."""
    found = graph.log_trees(e.map.edges, e.assignments, e.map.units, "county")
    own = e.assignments.join(e.map.units.select("unit_id", "county"), "unit_id")
    # rows whose parts make a tree, which is what the SQL can tell
    cut = graph.same_label_edges(e.map.edges, e.assignments.withColumnRenamed("district", "grp"), ["draw"]).filter("src < dst")
    of = e.assignments.select("draw", F.col("unit_id").alias("src"), "district")
    piece = graph.components(e.map.edges, own.withColumn("grp", F.concat_ws("-", "district", "county")).select("draw", "unit_id", "grp"), ["draw"]).select("draw", "unit_id", F.concat_ws("-", "group", "component").alias("part"))
    a, b = (piece.select("draw", F.col("unit_id").alias(c), F.col("part").alias(f"p{c}")) for c in ("src", "dst"))
    pairs = cut.join(of, ["draw", "src"]).join(a, ["draw", "src"]).join(b, ["draw", "dst"]).filter("psrc <> pdst").groupBy("draw", "district").agg(F.countDistinct(F.array_sort(F.array("psrc", "pdst"))).alias("links"))
    parts = piece.join(e.assignments, ["draw", "unit_id"]).groupBy("draw", "district").agg(F.countDistinct("part").alias("parts"))
    tree = parts.join(pairs, ["draw", "district"], "left").filter(F.coalesce("links", F.lit(0)) == F.col("parts") - 1)
    return found.join(tree.select("draw", "district"), ["draw", "district"]).select("draw", "district", (F.round("log_trees", 6) + 0.0).alias("log_trees"))


# ranks on the large grid


@large(", v AS (SELECT draw, district, CAST(SUM(pop) AS DOUBLE) AS x FROM asg JOIN units USING (unit_id) GROUP BY 1, 2) SELECT draw, district, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rank FROM v")
def large_average_ranks(e):
    own = tally.tally(e.assignments, e.map.units, x="pop").select("draw", "district", F.col("x").cast("double").alias("x"))
    return estimates.average_ranks(own, "x").select("draw", "district", "rank")




@large(", p AS (SELECT draw, district, CAST(SUM(pop) AS DOUBLE) AS a, CAST(SUM(grp) AS DOUBLE) AS b FROM asg JOIN units USING (unit_id) GROUP BY 1, 2), m AS (SELECT draw * 100 + district AS id, a, b FROM p), o AS (SELECT *, MIN(b) OVER (ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM m) SELECT id, a, b FROM o WHERE low IS NULL OR b < low")
def large_frontier(e):
    """Districts of the large grid that no other beats both in population and in the group's."""
    both = tally.tally(e.assignments, e.map.units, a="pop", b="grp").select((F.col("draw") * 100 + F.col("district")).alias("id"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    return labels.not_dominated(both, "id", ["a", "b"])


@query("SELECT a.unit_id AS src, b.unit_id AS dst FROM units a JOIN units b ON ABS(a.gx - b.gx) + ABS(a.gy - b.gy) = 1")
def map_of_outlines(e):
    """A map's graph from its units' outlines."""
    return model.build_map(e.map.units, ndists=5, corners=_tiles(e)).edges
