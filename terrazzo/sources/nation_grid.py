"""A map and an ensemble derived from the sample tables: 25 nations on a 5 x 5 grid.

``SQL`` is the same derivation for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Ensemble, PlanMap, ensemble

SIDE, DRAWS = 5, 50

SQL = """WITH people AS (
  SELECT c_nationkey AS k, COUNT(*) AS pop, COUNT(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS grp FROM customer GROUP BY 1
), votes AS (
  SELECT c_nationkey AS k, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS dvote, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS rvote
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
), units AS (
  SELECT CAST(n_nationkey AS INT) AS unit_id, CAST(n_nationkey % 5 AS INT) AS gx, CAST(n_nationkey // 5 AS INT) AS gy,
         CAST(n_regionkey + 1 AS INT) AS existing, CAST(n_nationkey // 5 + 1 AS INT) AS county,
         COALESCE(pop, 0) AS pop, COALESCE(grp, 0) AS grp, COALESCE(dvote, 0) AS dvote, COALESCE(rvote, 0) AS rvote
  FROM nation LEFT JOIN people ON people.k = n_nationkey LEFT JOIN votes ON votes.k = n_nationkey
), edges AS (
  SELECT a.unit_id AS src, b.unit_id AS dst FROM units a JOIN units b ON ABS(a.gx - b.gx) + ABS(a.gy - b.gy) = 1
), asg AS (
  SELECT CAST(d.range AS INT) AS draw, unit_id,
    CAST(((CASE WHEN d.range <= 25 THEN gy * 5 + CASE WHEN gy % 2 = 0 THEN gx ELSE 4 - gx END
                ELSE gx * 5 + CASE WHEN gx % 2 = 0 THEN gy ELSE 4 - gy END END + d.range) % 25) // 5 + 1 AS INT) AS district
  FROM units CROSS JOIN range(1, 51) d
), tally AS (
  SELECT draw, district, SUM(pop) AS pop, SUM(grp) AS grp, SUM(dvote) AS dvote, SUM(rvote) AS rvote
  FROM asg JOIN units USING (unit_id) GROUP BY 1, 2
)
"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer = read("customer")
    people = customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("pop"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("grp"))
    votes = read("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("dvote"), F.count_if(F.col("o_orderstatus") == "O").alias("rvote"))
    nation = read("nation").select(F.col("n_nationkey").cast("int").alias("unit_id"), (F.col("n_regionkey") + 1).cast("int").alias("existing"), F.col("n_nationkey").alias("k"))
    whole = nation.join(people, "k", "left").join(votes, "k", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pop", "grp", "dvote", "rvote")]
    gx, gy = F.col("unit_id") % SIDE, F.floor(F.col("unit_id") / SIDE).cast("int")
    return whole.select("unit_id", gx.alias("gx"), gy.alias("gy"), "existing", (gy + 1).alias("county"), *zero)


def grid_edges(places: DataFrame) -> DataFrame:
    """Rook neighbours by four shifted equi-joins (no range join)."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s")
    moved = places.select(F.col("unit_id").alias("src"), "gx", "gy", steps).select("src", (F.col("gx") + F.col("s.a")).alias("gx"), (F.col("gy") + F.col("s.b")).alias("gy"))
    return moved.join(places.select(F.col("unit_id").alias("dst"), "gx", "gy"), ["gx", "gy"]).select("src", "dst")


def snakes(places: DataFrame, draws: int = DRAWS) -> DataFrame:
    """Row snakes for the first half of the draws, column snakes for the rest, shifted by the draw."""
    cells = SIDE * SIDE
    a = F.when(F.col("draw") <= draws // 2, F.col("gy")).otherwise(F.col("gx"))
    b = F.when(F.col("draw") <= draws // 2, F.col("gx")).otherwise(F.col("gy"))
    along = a * SIDE + F.when(a % 2 == 0, b).otherwise(SIDE - 1 - b)
    each = places.select("unit_id", "gx", "gy", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return each.select("draw", "unit_id", (F.floor((along + F.col("draw")) % cells / SIDE) + 1).cast("int").alias("district"))


def nation_map(spark: SparkSession, sf_dir: str, tol: float = 0.1) -> PlanMap:
    # 25 rows that every operator joins: computed once per query
    own = units(spark, sf_dir).cache()
    total = own.agg(F.sum("pop").alias("p")).first()["p"]
    target = total / SIDE
    return PlanMap(own, grid_edges(own), SIDE, (target * (1 - tol), target, target * (1 + tol)), "pop", "existing")


def nation_plans(spark: SparkSession, sf_dir: str) -> Ensemble:
    own = nation_map(spark, sf_dir)
    return ensemble(snakes(own.units), own, algorithm="snakes")
