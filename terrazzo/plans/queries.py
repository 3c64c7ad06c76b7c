"""Registered queries over the nation grid, with the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import estimates
from ..operators import graph, labels, overlap, penalties, tally
from ..sources import nation_grid as grid
from . import enumeration, model, sampling, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the ensemble under its name; ``sql`` follows the grid's definitions."""

    def add(fn: Callable[[model.Ensemble], DataFrame]):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(grid.nation_plans(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = grid.SQL + sql
        return fn

    return add


def _r(c: str, name: str | None = None):
    return F.round(F.col(c).cast("double"), 6).alias(name or c)


@query("SELECT draw, district, ROUND(CAST(grp AS DOUBLE) / NULLIF(pop, 0), 6) AS share FROM tally")
def group_share(e):
    return tally.group_share(e.assignments, e.map.units, "grp").select("draw", "district", _r("share"))


@query("SELECT draw, district, CAST(pop AS BIGINT) AS total_pop FROM tally")
def district_population(e):
    return e.stats.select("draw", "district", "total_pop")


@query("SELECT draw, ROUND(MAX(ABS(pop / ((SELECT CAST(SUM(pop) AS DOUBLE) FROM units) / 5) - 1)), 6) AS parity FROM tally GROUP BY draw")
def parity(e):
    return tally.parity(e.assignments, e.map.units).select("draw", _r("parity"))


@query(", dev AS (SELECT draw, district, ABS(pop / ((SELECT CAST(SUM(pop) AS DOUBLE) FROM units) / 5) - 1) AS dev FROM tally) SELECT draw, district, ROUND(dev, 6) AS dev, ROUND(MAX(dev) OVER (PARTITION BY draw), 6) AS parity FROM dev")
def parity_by_district(e):
    return tally.parity_by_district(e.assignments, e.map.units).select("draw", "district", _r("dev"), _r("parity"))


_PIECES = ", pieces AS (SELECT draw, county, COUNT(DISTINCT district) AS n FROM asg JOIN units USING (unit_id) GROUP BY 1, 2) "


@query(_PIECES + "SELECT draw, COUNT(*) FILTER (WHERE n > 1) AS splits, COUNT(*) FILTER (WHERE n > 2) AS multisplits, CAST(SUM(n - 1) AS BIGINT) AS total_splits FROM pieces GROUP BY 1")
def county_splits(e):
    return tally.county_splits(e.assignments, e.map.units)


@query(_PIECES + "SELECT draw, unit_id, n > 1 AS is_split FROM asg JOIN units USING (unit_id) JOIN pieces USING (draw, county)")
def split_flags(e):
    return tally.split_flags(e.assignments, e.map.units)


@query("SELECT draw, district, COUNT(DISTINCT county) AS n_counties FROM asg JOIN units USING (unit_id) GROUP BY 1, 2")
def district_counties(e):
    return tally.district_counties(e.assignments, e.map.units)


@query(", whole AS (SELECT CAST(SUM(pop) AS DOUBLE) AS t, SUM(grp) / CAST(SUM(pop) AS DOUBLE) AS p FROM units) SELECT draw, ROUND(SUM(pop * ABS(COALESCE(CAST(grp AS DOUBLE) / NULLIF(pop, 0), 0) - p)) / (2 * MIN(t) * MIN(p) * (1 - MIN(p))), 6) AS segregation FROM tally, whole GROUP BY draw")
def segregation(e):
    return tally.segregation(e.assignments, e.map.units, "grp").select("draw", _r("segregation"))


_VOTES = ", votes_by AS (SELECT draw, district, CAST(dvote AS DOUBLE) AS d, CAST(rvote AS DOUBLE) AS r, dvote / CAST(dvote + rvote AS DOUBLE) AS v FROM tally) "


@query(_VOTES + "SELECT draw, district, ROUND(v, 6) AS dvs FROM votes_by")
def vote_shares(e):
    return tally.vote_shares(e.assignments, e.map.units).select("draw", "district", _r("dvs"))


@query(_VOTES + "SELECT draw, ROUND(AVG(ABS(v - 0.5)) * (1 + ABS(AVG(CASE WHEN v > 0.5 THEN 1 ELSE 0 END) - 0.5)), 6) AS competitiveness FROM votes_by GROUP BY draw")
def competitiveness(e):
    return tally.competitiveness(tally.vote_shares(e.assignments, e.map.units)).select("draw", _r("competitiveness"))


@query(
    _VOTES
    + """, m AS (SELECT *, AVG(v) OVER (PARTITION BY draw) AS mean FROM votes_by)
SELECT draw, CAST(SUM(CASE WHEN v > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS seats, ROUND(SUM(d) / SUM(d + r), 6) AS dvs,
  ROUND((SUM(CASE WHEN v > 0.5 THEN r ELSE r - (d + r) / 2 END) - SUM(CASE WHEN v > 0.5 THEN d - (d + r) / 2 ELSE d END)) / SUM(d + r), 6) + 0.0 AS eff_gap,
  ROUND(AVG(CASE WHEN v > 0.5 THEN 1.0 ELSE 0.0 END) - 0.5 - 2 * (AVG(v) - 0.5), 6) + 0.0 AS eff_gap_equal,
  ROUND(AVG(v) - MEDIAN(v), 6) + 0.0 AS mean_median,
  ROUND(AVG(CASE WHEN v + 0.5 - mean > 0.5 THEN 1.0 ELSE 0.0 END) - 0.5, 6) + 0.0 AS bias
FROM m GROUP BY draw"""
)
def partisan_measures(e):
    found = tally.partisan(tally.vote_shares(e.assignments, e.map.units))
    return found.select("draw", F.col("seats").cast("long").alias("seats"), _r("dvs"), *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in ("eff_gap", "eff_gap_equal", "mean_median", "bias")])


_CUT = ", cut AS (SELECT a.draw, e.src, e.dst, a.district AS a, b.district AS b FROM edges e JOIN asg a ON a.unit_id = e.src JOIN asg b ON b.unit_id = e.dst AND b.draw = a.draw WHERE e.src < e.dst AND a.district <> b.district) "


@query(_CUT + "SELECT draw, COUNT(*) AS removed, ROUND(1 - COUNT(*) / 40.0, 6) AS frac_kept FROM cut GROUP BY draw")
def edges_removed(e):
    return graph.edges_removed(e.map.edges, e.assignments).select("draw", "removed", _r("frac_kept"))


@query(_CUT + "SELECT draw, LEAST(a, b) AS a, GREATEST(a, b) AS b, COUNT(*) AS n_edges FROM cut GROUP BY 1, 2, 3")
def district_graph(e):
    return graph.district_graph(e.map.edges, e.assignments)


@query(_CUT + "SELECT draw, src AS unit_id FROM cut UNION SELECT draw, dst FROM cut")
def boundary_units(e):
    return graph.boundary_units(e.map.edges, e.assignments)


@query(
    """, roots AS (
  WITH RECURSIVE reach(draw, district, root, unit_id) AS (
    SELECT draw, district, unit_id, unit_id FROM asg
    UNION
    SELECT r.draw, r.district, r.root, a.unit_id FROM reach r JOIN edges e ON e.src = r.unit_id
    JOIN asg a ON a.draw = r.draw AND a.unit_id = e.dst AND a.district = r.district
  ) SELECT draw, district, unit_id, MIN(root) AS root FROM reach GROUP BY 1, 2, 3
) SELECT draw, district, COUNT(DISTINCT root) AS n_pieces FROM roots GROUP BY 1, 2"""
)
def district_pieces(e):
    return graph.pieces(e.map.edges, e.assignments)


@query("SELECT e.src, e.dst, ROUND(AVG(CASE WHEN a.district = b.district THEN 1.0 ELSE 0.0 END), 6) AS weight FROM edges e JOIN asg a ON a.unit_id = e.src JOIN asg b ON b.unit_id = e.dst AND b.draw = a.draw WHERE e.src < e.dst GROUP BY 1, 2")
def edge_weights(e):
    return graph.together_on_edges(e.map.edges, e.assignments).select("src", "dst", _r("weight"))


@query("SELECT u.county, w.county AS neighbour, e.src, e.dst FROM edges e JOIN units u ON u.unit_id = e.src JOIN units w ON w.unit_id = e.dst WHERE u.county <> w.county")
def county_multigraph(e):
    return graph.county_multigraph(e.map.edges, e.map.units)


@query("SELECT DISTINCT CAST(u.existing - 1 AS INT) AS src, CAST(w.existing - 1 AS INT) AS dst FROM edges e JOIN units u ON u.unit_id = e.src JOIN units w ON w.unit_id = e.dst WHERE u.existing <> w.existing")
def merged_edges(e):
    return e.map.summarise(["existing"]).edges.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@query("SELECT existing, CAST(SUM(gx) AS BIGINT) AS gx, CAST(SUM(gy) AS BIGINT) AS gy, CAST(SUM(county) AS BIGINT) AS county, CAST(SUM(pop) AS BIGINT) AS pop, CAST(SUM(grp) AS BIGINT) AS grp, CAST(SUM(dvote) AS BIGINT) AS dvote, CAST(SUM(rvote) AS BIGINT) AS rvote FROM units GROUP BY existing")
def merged_units(e):
    return graph.merge_units(e.map.units, ["existing"])


@query(", ids AS (SELECT unit_id, CAST(ROW_NUMBER() OVER (ORDER BY unit_id) - 1 AS INT) AS k FROM units WHERE gx <= 2) SELECT a.k AS src, b.k AS dst FROM edges JOIN ids a ON a.unit_id = src JOIN ids b ON b.unit_id = dst")
def filtered_edges(e):
    return e.map.filter(F.col("gx") <= 2).edges


@query("SELECT a.unit_id AS unit_i, b.unit_id AS unit_j, ROUND(COUNT(*) / 50.0, 6) AS p FROM asg a JOIN asg b ON a.draw = b.draw AND a.district = b.district AND a.unit_id < b.unit_id GROUP BY 1, 2")
def cooccurrence(e):
    return overlap.cooccurrence(e.assignments).select("unit_i", "unit_j", _r("p"))


_JOINT = ", joint AS (SELECT a.draw, u.existing AS ref, a.district, SUM(u.pop) AS p FROM asg a JOIN units u USING (unit_id) GROUP BY 1, 2, 3) "


@query(_JOINT + "SELECT draw, ref, district, CAST(p AS BIGINT) AS p FROM joint")
def joint_population(e):
    return overlap.joint_population(e.assignments, e.map.existing_plan(), e.map.units)


@query(_JOINT + ", t AS (SELECT *, SUM(p) OVER (PARTITION BY draw, ref) AS pr, SUM(p) OVER (PARTITION BY draw, district) AS pd FROM joint) SELECT draw, ROUND(SUM(CASE WHEN p >= 1 THEN -CAST(p AS DOUBLE) * (2 * LN(p) - LN(pr) - LN(pd)) END) / SUM(p), 6) + 0.0 AS vi FROM t GROUP BY draw")
def information_to_existing(e):
    return overlap.information_to(e.assignments, e.map.existing_plan(), e.map.units).select("draw", (F.round("vi", 6) + 0.0).alias("vi"))


@query("SELECT a.draw AS i, b.draw AS j, CAST(SUM(CASE WHEN a.district <> b.district THEN 1 ELSE 0 END) AS BIGINT) AS hamming, CAST(SUM(ABS(a.district - b.district)) AS BIGINT) AS manhattan, ROUND(SQRT(CAST(SUM((a.district - b.district) * (a.district - b.district)) AS DOUBLE)), 6) AS euclidean FROM asg a JOIN asg b ON a.unit_id = b.unit_id AND a.draw < b.draw GROUP BY 1, 2")
def plan_distances(e):
    return overlap.distances(e.assignments, e.map.units).select("i", "j", "hamming", "manhattan", _r("euclidean"))


@query(", jt AS (SELECT a.draw AS i, b.draw AS j, a.district AS x, b.district AS y, CAST(SUM(u.pop) AS DOUBLE) AS p FROM asg a JOIN asg b ON a.unit_id = b.unit_id AND a.draw < b.draw JOIN units u ON u.unit_id = a.unit_id GROUP BY 1, 2, 3, 4), w AS (SELECT *, SUM(p) OVER (PARTITION BY i, j, x) AS px, SUM(p) OVER (PARTITION BY i, j, y) AS py FROM jt), v AS (SELECT i, j, SUM(CASE WHEN p >= 1 THEN -p * (2 * LN(p) - LN(px) - LN(py)) END) / SUM(p) AS vi FROM w GROUP BY 1, 2) SELECT i, j, ROUND(CASE WHEN ABS(vi) <= 1e-9 THEN 0.0 ELSE vi / 2 END, 6) AS diversity FROM v")
def plan_diversity(e):
    return overlap.diversity(e.assignments, e.map.units).select("i", "j", _r("diversity"))


_SHARES = ", shares AS (SELECT draw, district, CAST(grp AS DOUBLE) / pop AS s FROM tally), proj AS (SELECT draw, unit_id, s FROM asg JOIN shares USING (draw, district)) "


@query(_SHARES + "SELECT unit_id, ROUND(AVG(s), 6) AS value FROM proj GROUP BY 1")
def projective_average(e):
    return overlap.projective_average(e.assignments, tally.group_share(e.assignments, e.map.units, "grp"), "share").select("unit_id", _r("value"))


@query(_SHARES + ", base AS (SELECT unit_id, AVG(s) AS m, STDDEV_POP(s) AS sd FROM proj WHERE draw <> 1 GROUP BY 1) SELECT unit_id, ROUND((s - m) / sd, 6) + 0.0 AS contrast FROM proj JOIN base USING (unit_id) WHERE draw = 1")
def projective_contrast(e):
    found = overlap.projective_contrast(e.assignments, tally.group_share(e.assignments, e.map.units, "grp"), "share", 1, norm=True)
    return found.select("unit_id", (F.round("contrast", 6) + 0.0).alias("contrast"))


@query("SELECT old.existing AS old, a.district AS new, ROUND(SUM(pop) / SUM(SUM(pop)) OVER (PARTITION BY old.existing), 6) AS overlap FROM units old JOIN asg a ON a.unit_id = old.unit_id AND a.draw = 1 GROUP BY 1, 2")
def population_overlap(e):
    return overlap.population_overlap(e.map.existing_plan(), e.assignments.filter("draw = 1"), e.map.units).select("old", "new", _r("overlap"))


@query("SELECT draw, ROUND(AVG(CASE WHEN district = existing THEN 1.0 ELSE 0.0 END), 6) AS unchanged FROM asg JOIN units USING (unit_id) GROUP BY 1")
def share_unchanged(e):
    return overlap.share_unchanged(e.assignments, e.map.existing_plan()).select("draw", _r("unchanged"))


@query(", f AS (SELECT draw, district, MIN(unit_id) AS f FROM asg GROUP BY 1, 2), l AS (SELECT draw, district, CAST(ROW_NUMBER() OVER (PARTITION BY draw ORDER BY f) AS INT) AS label FROM f) SELECT draw, unit_id, label AS district FROM asg JOIN l USING (draw, district)")
def reordered(e):
    return labels.by_first_appearance(e.assignments)


@query("SELECT draw, district, CAST(pop AS BIGINT) AS total_pop, CAST(ROW_NUMBER() OVER (PARTITION BY draw ORDER BY pop, district) AS INT) AS rank FROM tally")
def district_ranks(e):
    return labels.rank_districts(e.stats.select("draw", "district", "total_pop"), "total_pop")


@query(", r AS (SELECT draw, CAST(grp AS DOUBLE) / pop AS s, ROW_NUMBER() OVER (PARTITION BY draw ORDER BY CAST(grp AS DOUBLE) / pop DESC, district) AS k FROM tally) SELECT draw, ROUND(s, 6) AS value FROM r WHERE k = 2")
def second_largest_share(e):
    return labels.kth(tally.group_share(e.assignments, e.map.units, "grp"), "share", 2).select("draw", _r("value"))


@query(", dev AS (SELECT draw, MAX(ABS(pop / ((SELECT CAST(SUM(pop) AS DOUBLE) FROM units) / 5) - 1)) AS parity FROM tally GROUP BY draw)" + _CUT + ", s AS (SELECT draw, ROUND(parity, 9) AS parity, n FROM dev JOIN (SELECT draw, COUNT(*) AS n FROM cut GROUP BY 1) USING (draw)) SELECT a.draw, ROUND(a.parity, 6) AS parity, a.n AS removed FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.draw <> a.draw AND b.parity <= a.parity AND b.n <= a.n AND (b.parity < a.parity OR b.n < a.n OR b.draw < a.draw))")
def pareto_draws(e):
    both = tally.parity(e.assignments, e.map.units).withColumn("parity", F.round("parity", 9)).join(graph.edges_removed(e.map.edges, e.assignments), "draw").select("draw", "parity", "removed")
    return labels.not_dominated(both, "draw", ["parity", "removed"]).select("draw", _r("parity"), "removed")


@query("SELECT draw, ROUND(SUM(POWER(pop / ((SELECT CAST(SUM(pop) AS DOUBLE) FROM units) / 5) - 1, 2) * 2 + (GREATEST(0.55 - CAST(grp AS DOUBLE) / pop, 0)) ** 0.5), 6) AS penalty FROM tally GROUP BY draw")
def constraint_penalties(e):
    both = [penalties.pop_dev(2.0, e.map.target), penalties.grp_hinge(1.0, "grp")]
    return penalties.evaluate(e.assignments, e.map.units, both).select("draw", _r("penalty"))


@query(_CUT + ", k AS (SELECT draw, 1 - COUNT(*) / 40.0 AS kept FROM cut GROUP BY 1), d AS (SELECT draw, MAX(ABS(pop / ((SELECT CAST(SUM(pop) AS DOUBLE) FROM units) / 5) - 1)) AS dev FROM tally GROUP BY 1) SELECT draw, ROUND(kept * 2 - dev, 6) AS score FROM k JOIN d USING (draw)")
def scorer_algebra(e):
    score = penalties.score_frac_kept(e.map.edges) * 2 - penalties.score_pop_dev(e.map.units)
    return score.of(e.assignments).select("draw", _r("score"))


@query("SELECT draw, district, CAST(LEAST(MAX(gx) - MIN(gx) + 1, MAX(gy) - MIN(gy) + 1) AS DOUBLE) / GREATEST(MAX(gx) - MIN(gx) + 1, MAX(gy) - MIN(gy) + 1) AS length_width FROM asg JOIN units USING (unit_id) GROUP BY 1, 2")
def length_width(e):
    return tally.length_width(e.assignments, e.map.units)


_PERIMS = ", sides AS (SELECT dst AS to_id, src AS from_id, 1.0::DOUBLE AS edge FROM edges UNION ALL SELECT unit_id, -1, CAST((gx = 0)::INT + (gx = 4)::INT + (gy = 0)::INT + (gy = 4)::INT AS DOUBLE) FROM units WHERE gx IN (0, 4) OR gy IN (0, 4)) "


def _perimeters(e: model.Ensemble) -> DataFrame:
    outer = sum((F.col(c) == v).cast("int") for c in ("gx", "gy") for v in (0, 4))
    border = e.map.units.select(F.col("unit_id").alias("to_id"), F.lit(-1).alias("from_id"), outer.cast("double").alias("edge")).filter("edge > 0")
    return e.map.edges.select(F.col("dst").alias("to_id"), F.col("src").alias("from_id"), F.lit(1.0).alias("edge")).union(border)


@query(_PERIMS + ", p AS (SELECT t.draw, t.district, SUM(edge) AS p FROM sides JOIN asg t ON t.unit_id = to_id LEFT JOIN asg f ON f.unit_id = from_id AND f.draw = t.draw WHERE from_id = -1 OR f.district <> t.district GROUP BY 1, 2), a AS (SELECT draw, district, COUNT(*) AS a FROM asg GROUP BY 1, 2) SELECT draw, district, ROUND(4 * 3.14159265 * a / (p * p), 6) AS polsby FROM p JOIN a USING (draw, district)")
def polsby_popper(e):
    units = e.map.units.withColumn("area", F.lit(1.0))
    return tally.polsby_popper(e.assignments, units, _perimeters(e)).select("draw", "district", _r("polsby"))


@query("SELECT a.draw, a.district, ROUND(CAST(SUM(((u.gx - w.gx) ** 2 + (u.gy - w.gy) ** 2) * u.pop * w.pop) AS DOUBLE), 6) AS spread FROM asg a JOIN asg b ON a.draw = b.draw AND a.district = b.district AND a.unit_id < b.unit_id JOIN units u ON u.unit_id = a.unit_id JOIN units w ON w.unit_id = b.unit_id GROUP BY 1, 2")
def population_spread(e):
    return tally.squared_spread(e.assignments, e.map.units).select("draw", "district", _r("spread"))


@query(", t AS (SELECT draw, CAST(MAX(pop) AS DOUBLE) AS wgt FROM tally GROUP BY 1), q AS (SELECT QUANTILE_CONT(wgt, 1 - 1 / SQRT(50.0)) AS top FROM t) SELECT draw, ROUND(LEAST(wgt, top), 6) AS wgt FROM t, q")
def truncated_weights(e):
    weights = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("wgt"))
    return estimates.truncated(weights).select("draw", _r("wgt"))


@query(", c AS (SELECT draw, CASE WHEN draw <= 25 THEN 1 ELSE 2 END AS chain, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), m AS (SELECT chain, AVG(x) AS m FROM c GROUP BY 1) SELECT ROUND(AVG(m), 6) AS estimate, ROUND(STDDEV_SAMP(m) / SQRT(COUNT(*)), 6) AS se FROM m")
def interval_by_runs(e):
    draws = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x")).withColumn("chain", F.when(F.col("draw") <= 25, 1).otherwise(2))
    return estimates.interval_by_runs(draws, "x").select(_r("estimate"), _r("se"))


@query(", c AS (SELECT draw, CASE WHEN draw <= 25 THEN 1 ELSE 2 END AS chain, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), b AS (SELECT chain, draw, x - AVG(x) OVER (PARTITION BY chain) AS x FROM c), s AS (SELECT chain, SUM(x * x) AS s FROM b GROUP BY 1) SELECT a.chain, CAST(z.draw - a.draw AS INT) AS lag, ROUND(SUM(a.x * z.x) / MIN(s.s), 6) + 0.0 AS acf FROM b a JOIN b z ON a.chain = z.chain AND z.draw - a.draw BETWEEN 0 AND 3 JOIN s ON s.chain = a.chain GROUP BY 1, 2")
def autocorrelation(e):
    draws = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x")).withColumn("chain", F.when(F.col("draw") <= 25, 1).otherwise(2))
    return estimates.autocorrelation(draws, "x", 3).select("chain", "lag", (F.round("acf", 6) + 0.0).alias("acf"))


@query()
def rank_rhat(e):
    draws = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x")).withColumn("chain", F.when(F.col("draw") <= 25, 1).otherwise(2))
    return estimates.rhat(draws, "x").select(F.round("rhat", 5).alias("rhat"))


@query()
def matched_labels(e):
    return labels.match_to(e.assignments, e.map.existing_plan(), e.map.units, e.map.ndists)


@query(
    """, inner AS (SELECT a.draw, a.district, e.src, e.dst, ROW_NUMBER() OVER (PARTITION BY a.draw, a.district ORDER BY e.src, e.dst) AS k
  FROM edges e JOIN asg a ON a.unit_id = e.src JOIN asg b ON b.unit_id = e.dst AND b.draw = a.draw AND b.district = a.district WHERE e.src < e.dst
), four AS (SELECT p.draw, p.district, LIST_UNIQUE([p.src, p.dst, q.src, q.dst, r.src, r.dst, s.src, s.dst]) AS n
  FROM inner p JOIN inner q ON (p.draw, p.district) = (q.draw, q.district) AND p.k < q.k JOIN inner r ON (q.draw, q.district) = (r.draw, r.district) AND q.k < r.k JOIN inner s ON (r.draw, r.district) = (s.draw, s.district) AND r.k < s.k
) SELECT d.draw, d.district, ROUND(LN(NULLIF(COALESCE(t.n, 0), 0)), 6) + 0.0 AS log_trees FROM (SELECT DISTINCT draw, district FROM asg) d
LEFT JOIN (SELECT draw, district, COUNT(*) AS n FROM four WHERE n = 5 GROUP BY 1, 2) t USING (draw, district)""".replace("inner", "own")
)
def log_spanning_trees(e):
    # in the SQL: four grid edges over five units are a tree, as a cycle of four touches only four
    return graph.log_trees(e.map.edges, e.assignments).select("draw", "district", (F.round("log_trees", 6) + 0.0).alias("log_trees"))


@query()
def district_colours(e):
    return graph.colours(e.map.edges, e.assignments)


@query()
def district_cores(e):
    return graph.cores(e.map.edges, e.assignments)


@query(", p AS (SELECT draw, CAST(MAX(pop) AS DOUBLE) AS x FROM tally GROUP BY 1), m AS (SELECT MIN(x) AS a, MAX(x) AS b FROM p) SELECT CAST(LEAST(FLOOR((x - a) / ((b - a) / 8)), 7) AS INT) AS bin, ROUND(COUNT(*) / 50.0, 6) AS share FROM p, m GROUP BY 1")
def histogram(e):
    draws = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x"))
    return estimates.histogram(draws, "x", 8).select("bin", _r("share"))


@query("SELECT draw, STRING_AGG(CAST(district AS VARCHAR), ',' ORDER BY unit_id) AS plan FROM asg GROUP BY 1")
def plan_arrays(e):
    return e.matrix().select("draw", F.array_join(F.col("plan").cast("array<string>"), ",").alias("plan"))


@query("SELECT unit_id, district FROM asg WHERE draw = 50")
def last_plan(e):
    return e.last()


@query("SELECT draw, unit_id, district FROM asg WHERE draw > 10 AND (draw - 11) % 4 = 0")
def thinned(e):
    return e.thin(10, 4).assignments


@query("SELECT draw, unit_id, district FROM asg WHERE draw IN (SELECT draw FROM tally WHERE pop > 330)")
def filtered_draws(e):
    return e.filter(F.col("total_pop") > 330).assignments


@query("SELECT 0 AS draw, CAST(existing AS INT) AS district, CAST(SUM(pop) AS BIGINT) AS total_pop FROM units GROUP BY existing UNION ALL SELECT draw, district, CAST(pop AS BIGINT) FROM tally")
def with_reference(e):
    return model.add_reference(e, e.map.existing_plan(), "existing").stats.select("draw", "district", "total_pop")


@query("SELECT draw, unit_id, district FROM asg UNION ALL SELECT draw + 50, unit_id, district FROM asg")
def bound_ensembles(e):
    return model.bind(e, e).assignments



def _checked(m: model.PlanMap, plans: DataFrame) -> DataFrame:
    """How many plans there are, how many have connected districts, and how many lie within bounds."""
    asg = plans.select("draw", F.posexplode("plan").alias("unit_id", "district"))
    whole = graph.pieces(m.edges, asg).groupBy("draw").agg(F.max("n_pieces").alias("most"), F.count(F.lit(1)).alias("k"))
    fits = tally.tally(asg, m.units, p=m.pop).groupBy("draw").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    return whole.join(fits, "draw").agg(
        F.count(F.lit(1)).alias("plans"),
        F.count_if((F.col("most") == 1) & (F.col("k") == m.ndists)).alias("connected"),
        F.count_if((F.col("low") >= m.bounds[0]) & (F.col("high") <= m.bounds[2])).alias("within_bounds"),
    )


def _sampled(sql: str):
    """Register a function of the map; samplers have no SQL form, so ``sql`` states what must hold of every plan."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(grid.nation_map(spark, sf_dir, 0.2))
        ORACLES[fn.__name__] = sql
        return fn

    return add


@_sampled("SELECT CAST(100 AS BIGINT) AS plans, CAST(100 AS BIGINT) AS connected, CAST(100 AS BIGINT) AS within_bounds")
def smc_plans(m):
    return _checked(m, sampling.smc(m, 100, seed=3))


def _existing(m: model.PlanMap, n: int) -> DataFrame:
    """``n`` chains that start at plans by sequential Monte Carlo."""
    return sampling.smc(m, n, seed=11).select(F.col("draw").alias("chain"), "plan")


def _numbered(found: DataFrame, nsims: int) -> DataFrame:
    return found.select(((F.col("chain") - 1) * nsims + F.col("draw")).alias("draw"), "plan")


@_sampled("SELECT CAST(80 AS BIGINT) AS plans, CAST(80 AS BIGINT) AS connected, CAST(80 AS BIGINT) AS within_bounds")
def mergesplit_chains(m):
    return _checked(m, _numbered(sampling.chains(m, _existing(m, 4), 60, seed=4, warmup=20, thin=2), 60))


@_sampled("SELECT CAST(120 AS BIGINT) AS plans, CAST(120 AS BIGINT) AS connected, CAST(120 AS BIGINT) AS within_bounds")
def flip_chains(m):
    return _checked(m, _numbered(sampling.chains(m, _existing(m, 4), 120, "flip", seed=5, thin=4), 120))


@_sampled("SELECT CAST(40 AS BIGINT) AS plans, CAST(40 AS BIGINT) AS connected, CAST(40 AS BIGINT) AS within_bounds")
def annealed_chains(m):
    even = m.target
    spread = lambda p: float(sum(abs(p_ - even) / even for p_ in _populations(p)))
    loads = {r["unit_id"]: r["pop"] for r in m.units.select("unit_id", "pop").collect()}  # one row a unit, as the graph

    def _populations(plan):
        total: dict[int, int] = {}
        for u, d in enumerate(plan):
            total[int(d)] = total.get(int(d), 0) + loads[u]
        return total.values()

    return _checked(m, _numbered(sampling.chains(m, _existing(m, 2), 200, "flip", seed=6, thin=10, energy=spread, beta=sampling.annealing(60, 100, 40)), 200))


@_sampled("SELECT TRUE AS never_worse, CAST(4 AS BIGINT) AS bursts")
def short_bursts(m):
    start = sampling.smc(m, 20, seed=12).filter("draw = 1").select("plan")
    found = sampling.short_bursts(m, start, penalties.score_frac_kept(m.edges).of, 4, seed=2)
    return found.select("burst", "score", F.max("score").over(_bursts()).alias("best")).agg(F.bool_and(F.col("score") >= F.col("best")).alias("never_worse"), F.count(F.lit(1)).alias("bursts"))


def _bursts():
    from pyspark.sql import Window as W

    return W.orderBy("burst").rowsBetween(W.unboundedPreceding, 0)  # a row a burst


@_sampled("SELECT CAST(12 AS BIGINT) AS plans, CAST(12 AS BIGINT) AS connected, CAST(12 AS BIGINT) AS within_bounds")
def seed_and_grow(m):
    return _checked(m, search.seed_and_grow(m, 12, seed=8))


def enumerated_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of the whole grid into five connected districts of five units."""
    m = grid.nation_map(spark, sf_dir)
    return enumeration.count_partitions(spark, m.edges, m.units.withColumn("one", F.lit(1)), 5, "one", 5, 5)


def enumerated_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of a 3 x 3 corner into three connected districts of three units."""
    m = grid.nation_map(spark, sf_dir).filter((F.col("gx") < 3) & (F.col("gy") < 3))
    return enumeration.count_partitions(spark, m.edges, m.units.withColumn("one", F.lit(1)), 3, "one", 3, 3)


QUERIES |= {"enumerated_grid": enumerated_grid, "enumerated_corner": enumerated_corner}
#: The number of ways to cut a 5 x 5 rook grid into five connected fives, a known count.
ORACLES["enumerated_grid"] = "SELECT CAST(4006 AS BIGINT) AS n"
_CELLS = range(9)
#: All labellings of nine cells; three cells are connected if they hold two edges or more; each partition has six labellings.
ORACLES["enumerated_corner"] = (
    "WITH l AS (SELECT range AS d FROM range(3)), p AS (SELECT "
    + ", ".join(f"l{i}.d AS c{i}" for i in _CELLS)
    + " FROM "
    + ", ".join(f"l AS l{i}" for i in _CELLS)
    + ") SELECT CAST(COUNT(*) // 6 AS BIGINT) AS n FROM p WHERE "
    + " AND ".join(
        "("
        + " + ".join(f"CAST(c{i} = {d} AS INT)" for i in _CELLS)
        + ") = 3 AND ("
        + " + ".join(f"CAST(c{a} = {d} AND c{b} = {d} AS INT)" for a in _CELLS for b in _CELLS if b == a + 3 or (b == a + 1 and b % 3))
        + ") >= 2"
        for d in range(3)
    )
)


@query(", e AS (SELECT src AS a, dst AS b, ROW_NUMBER() OVER (ORDER BY src, dst) AS pos FROM edges WHERE src < dst), v AS (SELECT v, MIN(pos) AS f, MAX(pos) AS l FROM (SELECT a AS v, pos FROM e UNION ALL SELECT b, pos FROM e) GROUP BY v) SELECT pos, (SELECT COUNT(*) FROM v WHERE f <= pos AND l > pos) AS frontier FROM e")
def frontier_sizes(e):
    listed = e.map.edges.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    order = listed.withColumn("pos", F.row_number().over(_edge_order()).cast("long"))
    return graph.frontier_sizes(order)


def _edge_order():
    from pyspark.sql import Window as W

    return W.orderBy("a", "b")  # the edges of one map


@query("SELECT unit_id, CAST(county AS VARCHAR) AS county FROM units")
def relabelled_counties(e):
    return graph.relabel_counties(e.map.edges, e.map.units)


@query("SELECT unit_id, CASE WHEN gy < 2 THEN CAST(existing - 1 AS INT) ELSE unit_id END AS frozen_with FROM units")
def frozen_groups(e):
    return graph.freeze(e.map.edges, e.map.existing_plan(), e.map.units.filter("gy < 2"))


@query(", d AS (SELECT draw, CAST(MAX(pop) AS DOUBLE) AS x, CAST(MIN(pop) AS DOUBLE) AS w FROM tally GROUP BY 1), m AS (SELECT SUM(w * x) / SUM(w) AS m, SUM(w) AS s FROM d) SELECT ROUND(MIN(m), 6) AS estimate, ROUND(SQRT(SUM(w * w * (x - m) * (x - m))) / MIN(s), 6) AS se FROM d, m")
def weighted_interval(e):
    draws = e.stats.groupBy("draw").agg(F.max("total_pop").cast("double").alias("x"), F.min("total_pop").cast("double").alias("wgt"))
    return estimates.weighted_interval(draws, "x").select(_r("estimate"), _r("se"))


@query("SELECT range / 1000 AS share, ROUND(SQRT(GREATEST(0.55 - range / 1000, 0)), 6) AS penalty FROM range(1001)")
def penalty_curve(e):
    curve = penalties.penalty_curve(lambda s: F.sqrt(F.greatest(0.55 - s, F.lit(0.0))), e.assignments.sparkSession)
    return curve.select("share", _r("penalty"))


@query("SELECT draw, COUNT(*) FILTER (WHERE CAST(grp AS DOUBLE) / pop > 0.2) AS n FROM tally GROUP BY draw")
def districts_over_share(e):
    shares = tally.group_share(e.assignments, e.map.units, "grp")
    return shares.groupBy("draw").agg(F.count_if(F.col("share") > 0.2).alias("n"))


@query(_SHARES + ", gap AS (SELECT draw, unit_id, ABS(ROUND(s - (SELECT AVG(q.s) FROM proj q WHERE q.unit_id = proj.unit_id AND q.draw <> 1), 12)) AS g FROM proj) SELECT a.unit_id, ROUND(AVG(CASE WHEN b.g >= a.g THEN 1.0 ELSE 0.0 END), 2) AS p FROM gap a JOIN gap b ON a.unit_id = b.unit_id WHERE a.draw = 1 GROUP BY 1")
def contrast_p_values(e):
    found = overlap.contrast_p_values(e.assignments, tally.group_share(e.assignments, e.map.units, "grp"), "share", 1)
    return found.select("unit_id", F.round("p", 2).alias("p"))


@query(_PIECES + ", touched AS (SELECT DISTINCT draw, district, county FROM asg JOIN units USING (unit_id)) SELECT draw, ROUND(SUM(CAST(n > 1 AS INT) + 0.5 * CAST(n > 2 AS INT) + 0.25 * (n - 1)), 6) AS penalty FROM touched JOIN pieces USING (draw, county) GROUP BY 1")
def split_penalties(e):
    every = [penalties.splits(1.0), penalties.splits(0.5, kind="multisplits"), penalties.splits(0.25, kind="total_splits")]
    return penalties.evaluate(e.assignments, e.map.units, every).select("draw", _r("penalty"))


@query(_CUT + ", w AS (SELECT CAST(SUM(pop) AS DOUBLE) AS t, SUM(grp) / CAST(SUM(pop) AS DOUBLE) AS p FROM units), v AS (SELECT draw, pop * ABS(CAST(grp AS DOUBLE) / pop - p) / (2 * t * p * (1 - p)) + ABS(dvote / CAST(dvote + rvote AS DOUBLE) - 0.5) AS x FROM tally, w), c AS (SELECT draw, COUNT(*) AS n FROM cut GROUP BY 1) SELECT draw, ROUND(SUM(x) + MIN(n), 6) AS penalty FROM v JOIN c USING (draw) GROUP BY draw")
def mixed_penalties(e):
    every = [penalties.segregation(1.0, "grp"), penalties.compet(1.0, "dvote", "rvote"), penalties.edges_removed(1.0, e.map.edges)]
    return penalties.evaluate(e.assignments, e.map.units, every).select("draw", _r("penalty"))


@query(_JOINT + ", f AS (SELECT draw, district, CAST(p AS DOUBLE) / SUM(p) OVER (PARTITION BY draw, district) AS f FROM joint) SELECT draw, ROUND(SUM(-f * LN(f)) / 5 / LN(5), 6) + 0.0 AS penalty FROM f GROUP BY draw")
def status_quo_penalty(e):
    found = penalties.evaluate(e.assignments, e.map.units, [penalties.status_quo(1.0, e.map.existing_plan(), 5)])
    return found.select("draw", (F.round("penalty", 6) + 0.0).alias("penalty"))


@query("SELECT draw, ROUND(CAST(SUM(GREATEST(n - 1, 0)) AS DOUBLE), 6) AS penalty FROM (SELECT draw, district, COUNT(*) FILTER (WHERE unit_id IN (1, 7, 8, 20)) AS n FROM asg GROUP BY 1, 2) GROUP BY draw")
def incumbency_penalty(e):
    seats = e.map.units.filter(F.col("unit_id").isin(1, 7, 8, 20))
    return penalties.evaluate(e.assignments, e.map.units, [penalties.incumbency(1.0, seats)]).select("draw", _r("penalty"))
