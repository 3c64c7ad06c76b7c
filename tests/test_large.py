"""What keeps work on large maps whole: estimates, joins and passes over assignment rows."""

import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions import estimates
from terrazzo.llm import columns, suffix_dedup
from terrazzo.operators import compare, graph, labels, overlap, spectral, tally
from terrazzo.plans import search
from terrazzo.sources import customer_grid

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_assignments_are_estimated_with_all_their_rows(spark):
    e = customer_grid.customer_plans(spark, SF)
    size = int(str(e.assignments._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= e.assignments.count() * 16  # a long and two ints; else Spark broadcasts them


@pytest.mark.parametrize("draws", [(1, 2), (31, 32, 33, 400)])
def test_cut_edges_are_those_of_each_draw(spark, draws):
    r = np.random.default_rng(3)
    at = {(d, u): int(r.integers(1, 4)) for d in draws for u in range(9) if (d, u) != (2, 4)}
    asg = spark.createDataFrame([(d, u, k) for (d, u), k in at.items()], "draw int, unit_id int, district int")
    edges = [(u, v) for u in range(9) for v in (u + 1, u + 3) if v < 9]
    found = graph.cut_edges(spark.createDataFrame(edges, "src int, dst int"), asg)
    assert found.schema["draw"].dataType == asg.schema["draw"].dataType
    plain = {(d, u, v, at[d, u], at[d, v]) for d in draws for u, v in edges if at.get((d, u), 0) and at.get((d, v), 0) and at[d, u] != at[d, v]}
    assert sorted(map(tuple, found.collect())) == sorted(plain)
    e = customer_grid.customer_plans(spark, SF)
    assert "hashpartitioning(draw" not in _plan(graph.cut_edges(e.map.edges, e.assignments))  # no row a draw is shuffled


def test_projection_does_not_shuffle_the_rows_of_units(spark):
    e = customer_grid.customer_plans(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(overlap.projective_average(e.assignments, tally.group_share(e.assignments, e.map.units, "grp"), "share"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tallies_of_large_maps_neither_sort_nor_shuffle_assignments(spark):
    e = customer_grid.customer_plans(spark, SF)
    large = e.map.units.crossJoin(spark.range(1 << 20).limit(1).select())  # one row, which Catalyst takes for many
    wide = large.crossJoin(spark.range(1 << 24).filter("id = 0").select())
    found = tally.tally(e.assignments, wide, x="pop")
    plan = _plan(found)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin [unit_id" not in plan
    assert found.agg(F.sum("x")).first()[0] == 100 * e.map.units.agg(F.sum("pop")).first()[0]


def _told(spark, rows, schema):
    """Rows that count how often they are computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return spark.createDataFrame(rows, schema).mapInPandas(count, schema), seen


def test_ranks_compute_their_rows_once(spark):
    draws, seen = _told(spark, [(k, float(k % 5)) for k in range(40)], "draw int, x double")
    found = {r.draw: r["rank"] for r in estimates.average_ranks(draws, "x").collect()}
    assert seen.value == 40 and found == {k: 8 * (k % 5) + 4.5 for k in range(40)}


def test_frontiers_compute_their_rows_once(spark):
    rows = [(k, float(k), float(abs(k - 20))) for k in range(40)]
    scores, seen = _told(spark, rows, "draw int, a double, b double")
    found = sorted(r.draw for r in labels.not_dominated(scores, "draw", ["a", "b"]).collect())
    assert seen.value == 40 and found == list(range(21))


def test_nodes_bring_what_their_operator_asks_for(spark):
    r = np.random.default_rng(4)
    a = r.normal(size=(10, 10))
    a = a + a.T
    nodes = spark.createDataFrame([("", i, [float(x) for x in a[i]]) for i in range(10)], "grp string, node long, row array<double>")

    def apply(v):
        whole = v.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "x"))), lambda p: p["x"]).alias("all"))
        own = F.aggregate(F.zip_with("row", "all", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return v.join(F.broadcast(whole), "grp").select(*v.columns, own.alias("w"))

    found = spectral.leading(nodes, apply).collect()
    value, vector = np.linalg.eigh(a)
    own = [x["value"] for x in sorted(found, key=lambda x: x["node"])]
    assert found[0]["eigenvalue"] == pytest.approx(value[-1], abs=1e-6) and abs(vector[:, -1] @ own) == pytest.approx(1, abs=1e-6)


def test_sets_of_many_districts_are_compared_alike(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(d, u, int(r.integers(1, 4))) for d in range(6) for u in range(7)]
    asg = spark.createDataFrame(rows, "draw int, unit_id int, district int")
    told = lambda: sorted((x.split, x.unit_id, round(x.value, 6), round(x.separation, 6)) for x in compare.compare_sets(asg.filter("draw < 3"), asg.filter("draw >= 3"), 3).collect())
    few = told()
    monkeypatch.setattr(compare, "ROWS", 0)
    assert told() == few


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_reweighted_draws_come_as_often_as_they_weigh(spark, seed):
    energy = {d: 1 + (d * 7 % 11) / 300 for d in range(1, 51)}
    draws = spark.createDataFrame([(d,) for d in energy], "draw int")
    found = search.reweighted(draws, spark.createDataFrame(list(energy.items()), "draw int, energy double"), 8.0, 400, seed=seed).collect()
    assert sorted(r.pick for r in found) == list(range(1, 401))
    w = np.exp([8 * x for x in energy.values()])
    for d, share in zip(energy, w / w.sum()):
        assert abs(sum(r.draw == d for r in found) - 400 * share) < 1
    # the gain that is expected is a tenth of the spread: single draws by chance miss it often
    assert np.mean([energy[r.draw] for r in found]) > np.mean(list(energy.values()))
    early = [sum(r.draw <= 25 for r in found if r.pick <= k) / k for k in (20, 100)]
    assert all(abs(x - 0.5) < 0.12 for x in early)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_nearly_equal_weights_still_tell(spark, seed):
    """Shares of 8 picks, more or less by 0.1 at most: draw by draw all would be rounded to 8, the heavier half together gets its own."""
    r = np.random.default_rng(3)
    energy = {d: 1 + float(r.normal(0, 0.0008)) for d in range(1, 51)}
    draws = spark.createDataFrame([(d,) for d in energy], "draw int")
    found = search.reweighted(draws, spark.createDataFrame(list(energy.items()), "draw int, energy double"), 8.0, 400, seed=seed).collect()
    assert sorted(r.pick for r in found) == list(range(1, 401))
    order = sorted(energy, key=lambda d: (-energy[d], d))
    w = np.exp([8 * energy[d] for d in order])
    for k, share in enumerate(np.cumsum(w / w.sum()), 1):
        assert abs(sum(r.draw in order[:k] for r in found) - 400 * share) < 1
    gain = np.mean([energy[r.draw] for r in found]) - np.mean(list(energy.values()))
    assert gain > 1e-9


def test_surroundings_take_little_more_memory_than_they_are(spark):
    r = np.random.default_rng(1)
    data, place, n = r.integers(1, 255, 2_000_000, dtype=np.uint8), r.integers(100, 1_999_900, 60_000), r.integers(0, 101, 60_000)
    tracemalloc.start()
    right, left = (suffix_dedup.surroundings(data, place, steps, n) for steps in (np.arange(100), -1 - np.arange(68)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * (right.nbytes + left.nbytes) + 24e6  # whole grids of places would take 8 times the bytes
    for k in (0, 1, 59_999):
        assert right[k].tolist() == [int(data[place[k] + i]) if i < n[k] else 0 for i in range(100)]
        assert left[k].tolist() == [int(data[place[k] - 1 - i]) if i < n[k] else 0 for i in range(68)]


def test_workers_give_back_what_a_task_has_freed(spark):
    """2,000 blocks of 100 KB, of which a task keeps the last, which would keep the memory of all."""

    def held() -> int:
        return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) >> 10

    def run(texts):
        import sys

        blocks = [np.ones(100_000, np.uint8) for _ in range(2_000)]
        sys.kept, peak = blocks[-1], held()
        return [[os.getpid()] * len(texts), [peak] * len(texts)]

    def told(batches):
        for b in batches:
            time.sleep(0.5)  # so that no worker takes two tasks
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held()])], names=["pid", "mb"])

    fields = T.StructType([T.StructField("pid", T.LongType()), T.StructField("mb", T.LongType())])
    first = columns.annotate(spark.range(1).selectExpr("cast(id as string) AS t").coalesce(1), run, ["t"], fields).collect()[0]
    later = {r.pid: r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(told, fields).collect()}
    assert first.pid in later and later[first.pid] < first.mb - 150


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_units_of_one_plan_are_compared_once(spark, chunk):
    """Sixty units of four plans, one without its district in a draw; the tasks meet classes, and all pairs of units come back."""
    plan = {0: (1, 1, 1, 2, 1), 1: (1, 1, 1, 2, 2), 2: (1, 1, 1, None, 1), 3: (2, 2, 2, 1, 2)}
    at = {u: plan[u * 7 % 13 % 4] for u in range(60)} | {60: (3, 3, 3, 3, 3)}
    asg = spark.createDataFrame([(d, u, k) for u, own in at.items() for d, k in enumerate(own, 1) if k], "draw int, unit_id long, district int")
    found = overlap.cooccurrence(asg, least=0.6, tile=2, chunk=chunk)
    plain = {(u, v): n / 5 for u in at for v in at if u < v and (n := sum(x == y and x is not None for x, y in zip(at[u], at[v]))) >= 3}
    rows = found.collect()
    assert len(rows) == len(plain) and {(r.unit_i, r.unit_j): r.p for r in rows} == plain
    assert found.schema["unit_i"].dataType == asg.schema["unit_id"].dataType


def test_equal_plans_cost_no_products(spark, monkeypatch):
    """Sixty-four units of one plan are one class: a single task of one class, whatever the tile."""
    asg = spark.createDataFrame([(d, u, 1) for u in range(64) for d in range(3)], "draw int, unit_id int, district int")
    written = []
    keep = overlap.shared_table
    monkeypatch.setattr(overlap, "shared_table", lambda df: written.append(keep(df)) or written[-1])
    assert overlap.cooccurrence(asg, tile=2).count() == 64 * 63 // 2
    assert [t.count() for t in written if "rows" in t.columns] == [1]


@pytest.mark.parametrize("kinds", [1, 6])
def test_units_of_one_plan_go_through_rounds_as_one(spark, monkeypatch, kinds):
    """Forty units of six plans are seven nodes; of one plan, the largest eigenvalue is of vectors that tell them apart."""
    r = np.random.default_rng(5)
    plan = r.integers(1, 4, (kinds, 9))
    at = np.array([plan[u * 7 % 13 % kinds] for u in range(40)])
    asg = spark.createDataFrame([(d, u, int(at[u, d])) for u in range(40) for d in range(9)], "draw int, unit_id int, district int")
    written = []
    keep = spectral.shared_table
    monkeypatch.setattr(spectral, "shared_table", lambda df: written.append(keep(df)) or written[-1])
    found = compare.compare_sets(asg.filter("draw < 2"), asg.filter("draw >= 2"), 3).collect()
    assert {t.count() for t in written} == {kinds + 1}
    smooth = lambda x: ((x[:, None] == x[None]).sum(2) + 1 / 3) / (x.shape[1] + 1)
    gap = smooth(at[:, :2]) - smooth(at[:, 2:])
    np.fill_diagonal(gap, 0)
    values, vectors = np.linalg.eigh(gap)
    for split, value, vector in ((1, values[-1], vectors[:, -1]), (2, -values[0], vectors[:, 0])):
        own = sorted((x.unit_id, x.value) for x in found if x.split == split)
        assert {round(x.separation, 6) for x in found if x.split == split} == {round(value, 6)}
        x = np.array([v for _, v in own])
        assert [u for u, _ in own] == list(range(40)) and x @ x == pytest.approx(1, abs=1e-6) and x[np.abs(x).argmax()] > 0
        assert gap @ x == pytest.approx((value if split == 1 else -value) * x, abs=1e-5)
        if kinds > 1:
            assert abs(x @ vector) == pytest.approx(1, abs=1e-5)


def test_classes_are_found_without_rows_of_all_units(spark, monkeypatch):
    """Of sixty-four units with one plan, only the first one's rows and a number of all are written; chunks come to the tasks without a shuffle of units."""
    asg = spark.createDataFrame([(d, u, 1) for u in range(64) for d in range(3)], "draw int, unit_id int, district int")
    written = []
    keep = overlap.shared_table
    monkeypatch.setattr(overlap, "shared_table", lambda df: written.append(keep(df)) or written[-1])
    found = overlap.cooccurrence(asg, chunk=7)
    assert [t.count() for t in written if "district" in t.columns] == [3]
    assert max(t.count() for t in written if "unit_id" in t.columns and "district" not in t.columns) == 64
    spread = _plan(found).split("REPARTITION_BY_NUM")
    assert "units" in spread[0] and "units" not in spread[1].split("Scan parquet")[0]
    assert sorted((r.unit_i, r.unit_j, r.p) for r in found.collect()) == [(u, v, 1.0) for u in range(64) for v in range(u + 1, 64)]
