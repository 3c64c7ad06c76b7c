"""Text files of an external enumerator: edge lists, weights, listed partitions; checkpoints of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str) -> None:
    """One line ``k l`` an edge, numbered from 1, k < l, without copies."""
    edges.filter("src < dst").select("src", "dst").distinct().select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value")).write.mode("overwrite").text(path)


def write_weights(units: DataFrame, path: str, pop: str = "pop") -> None:
    """One file with one line: the units' populations in order. A map is one line, so one task writes it."""
    line = units.agg(F.array_sort(F.collect_list(F.struct("unit_id", F.col(pop).cast("long").alias("p")))).alias("u"))
    line.select(F.array_join(F.transform("u", lambda x: x["p"].cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def read_partitions(spark: SparkSession, path: str, skip: int = 0, n_max: int = -1) -> DataFrame:
    """draw, plan: one partition a line, labels from 0 separated by blanks; labels come out from 1.

    Lines are numbered by file and place in it. Counts by split give the offsets, so that
    numbering needs no single task.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("part", F.shiftright("at", 33))
    counts = lines.groupBy("part", "file").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    # one row a split of the files
    before = counts.select("part", "file", "low", (F.sum("n").over(W.orderBy("file", "low")) - F.col("n")).alias("before"))
    own = lines.join(F.broadcast(before), ["part", "file"]).withColumn("k", F.row_number().over(W.partitionBy("part", "file").orderBy("at")) + F.col("before"))
    kept = own.filter(F.col("k") > skip)
    if n_max >= 0:
        kept = kept.filter(F.col("k") <= skip + n_max)
    labels = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int") + 1)
    return kept.select((F.col("k") - skip).cast("int").alias("draw"), labels.alias("plan"))


def combine_checkpoints(spark: SparkSession, folder: str, thin: int = 1, chain: str = "chain", step: str = "t") -> DataFrame:
    """Chains that left Parquet parts under ``folder``, every ``thin``-th step, numbered anew in order."""
    whole = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    kept = whole.filter(F.col(step) % thin == 0)
    return kept.withColumn("draw", F.row_number().over(W.partitionBy(chain).orderBy(step)))


#: Edges (both directions) of a map that is ordered for enumeration.
MOST_EDGES = 100_000


def low_frontier_order(edges: DataFrame) -> DataFrame:
    """pos, a, b: edges of one map in an order with a small frontier.

    Vertices are taken by breadth from the least one; of the next candidates that which closes
    most edges comes first. An edge follows as soon as its later end is taken. The map's edges
    are one graph, as small as a sampler's.
    """
    near: dict[int, set[int]] = {}
    rows_ = edges.limit(MOST_EDGES + 1).collect()
    if len(rows_) > MOST_EDGES:
        raise ValueError(f"a map of more than {MOST_EDGES} edges")
    for r in rows_:
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    done: dict[int, int] = {}
    front: set[int] = set()
    rows = []
    while len(done) < len(near):
        pool = front or {min(set(near) - done.keys())}
        v = min(pool, key=lambda x: (len(near[x] - done.keys()), -len(near[x] & done.keys()), min((done[w] for w in near[x] & done.keys()), default=0), x))
        rows += [(min(v, w), max(v, w)) for w in sorted(near[v] & done.keys(), key=done.__getitem__)]
        done[v] = len(done)
        front = (front | near[v]) - done.keys()
    return edges.sparkSession.createDataFrame([(k + 1, a, b) for k, (a, b) in enumerate(rows)], "pos long, a int, b int")
