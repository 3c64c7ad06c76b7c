"""Samplers with counties and penalties, tempering, growth, files and comparisons against small truths."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import estimates
from terrazzo.operators import compare, graph, labels, nearest, penalties
from terrazzo.plans import enumeration, model, sampling, search
from terrazzo.sources import enumeration_files

from .test_plans import EIGHT, _map, _square


def _with_county(m, counties):
    county = m.units.sparkSession.createDataFrame(list(enumerate(counties)), "unit_id int, county string")
    return m.join(county, "unit_id")


def test_trees_in_two_levels_are_even_and_counted(spark):
    m = _with_county(_map(spark, _square(3), [1] * 9, 3, 0.1), "aabaabccc")
    g = sampling.graph_of(m, "county")
    inside, seen = np.ones(9, bool), Counter()
    for k in range(3000):
        order, parent = sampling.spanning_tree(g, inside, sampling.random_for(2, k))
        assert sorted(order.tolist()) == list(range(9))
        seen[frozenset(frozenset((v, int(p))) for v, p in enumerate(parent) if p >= 0)] += 1
    n = round(np.exp(sampling.log_trees(g, inside)))
    assert len(seen) == n and max(seen.values()) < 3000 / n + 6 * (3000 / n) ** 0.5
    for tree in seen:  # no more edges between counties than a tree of counties has
        assert sum(len({g.county[v] for v in e}) == 2 for e in tree) == 2


def test_cuts_split_few_counties(spark):
    m = _with_county(_map(spark, _square(4), [1] * 16, 4, 0.3), "aabbaabbccddccdd")
    plans = [list(r.plan) for r in sampling.smc(m, 30, seed=3, counties="county").collect()]
    for p in plans:
        assert sum(len({d for d, c in zip(p, "aabbaabbccddccdd") if c == k}) > 1 for k in "abcd") <= 3


def test_penalties_of_one_district_are_those_of_the_ensemble(spark):
    units = spark.createDataFrame([(v, 10 + v, v % 4, 5 + v, 20 - v, "ab"[v % 2], 1.0, v // 3) for v in range(9)], "unit_id int, pop long, grp long, dvote long, rvote long, county string, area double, gy int")
    m = model.PlanMap(units, _map(spark, _square(3), [1] * 9, 3, 0.1).edges, 3, (0.0, 42.0, 99.0))
    plan = [1, 1, 2, 1, 2, 2, 3, 3, 3]
    asg = spark.createDataFrame([(1, v, d) for v, d in enumerate(plan)], "draw int, unit_id int, district int")
    every = [penalties.pop_dev(2.0, 42.0), penalties.grp_pow(1.0, "grp"), penalties.grp_hinge(3.0, "grp", targets=(0.2, 0.4)), penalties.grp_inv_hinge(1.0, "grp", targets=(0.05,)), penalties.compet(1.0, "dvote", "rvote"), penalties.segregation(1.0, "grp"), penalties.splits(1.0), penalties.splits(1.0, kind="total_splits"), penalties.edges_removed(0.5, m.edges)]
    borders = spark.createDataFrame([(w, v, 1.0) for v, own in enumerate(_square(3)) for w in own] + [(-1, v, float(4 - len(own))) for v, own in enumerate(_square(3))], "from_id int, to_id int, edge double")
    existing = spark.createDataFrame([(v, v % 3 + 1) for v in range(9)], "unit_id int, district int")
    every += [penalties.status_quo(2.0, existing, 3), penalties.incumbency(1.0, spark.createDataFrame([(0,), (1,), (4,), (3,)], "unit_id int")), penalties.polsby(1.0, borders), penalties.spread(0.01, x="grp", y="gy"), penalties.log_st(1.0, m.edges), penalties.log_st(1.0, m.edges, "county"), penalties.qps(1.0, "grp", 3)]
    local = sampling.kernel(m, sampling.graph_of(m), every)
    whole = sum(local(np.array(plan), d) for d in (1, 2, 3))
    assert whole == pytest.approx(penalties.evaluate(asg, units, every).first()["penalty"])
    with pytest.raises(ValueError):
        sampling.kernel(m, sampling.graph_of(m), [penalties.custom("own", 1.0, lambda a, u: a)])


def test_generations_reach_all_plans(spark):
    m = _map(spark, EIGHT, [1] * 8, 4, 0.05)
    run = sampling.smc_run(m, 60, seed=2)
    found = labels.by_first_appearance(model.from_arrays(run.plans.drop("chain"), m).assignments)
    plans = found.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("unit_id", "district"))).alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in plans) == 60 and len(plans) == 5
    steps = run.steps.collect()
    assert [r.step for r in steps] == [1, 2, 3] and all(0 < r.accept_rate <= 1 and 1 <= r.n_eff <= 60.0001 for r in steps)


def test_impossible_bounds_are_told(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_TRIES", 30)
    m = _map(spark, _square(2), [1, 1, 1, 5], 2, 0.01)
    with pytest.raises(Exception, match="bounds may be too tight"):
        sampling.smc(m, 4, seed=1).collect()


def test_component_flips_visit_all_plans_evenly(spark):
    m = _map(spark, _square(3), [1] * 9, 2, 0.2)  # districts of four and five
    g = sampling.graph_of(m)
    plan, seen = np.array([1, 1, 1, 1, 2, 2, 2, 2, 2]), Counter()
    for t in range(24_000):
        plan = sampling.flip_components(g, plan, 1.0, None, sampling.random_for(4, t), eprob=0.3)
        seen[tuple((plan == plan[0]).tolist())] += 1
    every = {tuple((np.array(r.plan) == r.plan[0]).tolist()) for k in ((4, 5),) for r in enumeration.list_partitions(spark, m.edges, m.units, 2, "pop", *k).collect()}
    assert set(seen) <= every and len(seen) == len(every)
    share = np.array(list(seen.values())) / 24_000
    assert share.max() < 3 / len(every) and share.min() > 0.3 / len(every)


def test_partitions_are_listed_and_sampled(spark):
    m = _map(spark, _square(3), [1] * 9, 3, 0.01)
    every = {tuple(r.plan) for r in enumeration.list_partitions(spark, m.edges, m.units, 3, "pop", 2, 4).collect()}
    g = sampling.graph_of(m)
    for p in every:
        assert all(2 <= p.count(d) <= 4 and sampling.connected(g, np.array(p) == d) for d in (1, 2, 3))
    assert len(every) == enumeration.count_partitions(spark, m.edges, m.units, 3, "pop", 2, 4).first()["n"]
    some = Counter(tuple(r.plan) for r in enumeration.sample_partitions(spark, m.edges, m.units, 3, "pop", 2, 4, 2000, seed=6).collect())
    assert sum(some.values()) == 2000 and set(some) <= every and len(some) > 0.95 * len(every)


def test_ladders_run_from_nothing_to_all():
    steps = search.ladder(5)
    assert steps[0] == pytest.approx(0) and steps[-1] == pytest.approx(1) and steps == sorted(steps)


def test_reweighting_undoes_energies(spark):
    draws = spark.createDataFrame([(k,) for k in range(1, 31)], "draw int")
    energies = spark.createDataFrame([(k, float(k % 3)) for k in range(1, 31)], "draw int, energy double")
    found = search.reweighted(draws, energies, 1.0, 4000, seed=5).collect()
    assert len(found) == 4000
    share = Counter(r.draw % 3 for r in found)
    w = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert all(abs(share[k] / 4000 - w[k]) < 0.04 for k in range(3))


def test_linkage_joins_by_the_farthest():
    x = np.array([0.0, 1.0, 1.5, 9.0, 10.0])
    merges = compare.complete_linkage(np.abs(x[:, None] - x[None, :]))
    assert [(round(h, 6)) for _, _, h in merges] == [0.5, 1.0, 1.5, 10.0]


def test_classes_are_named_from_the_top(spark):
    at = {1: 0.0, 2: 0.1, 3: 5.0, 4: 5.2, 5: 20.0}
    pairs = spark.createDataFrame([(i, j, abs(at[i] - at[j])) for i in at for j in at if i < j], "i int, j int, vi double")
    found = {r.draw: r.label for r in compare.classify(pairs, 3).collect()}
    assert found == {1: "I.A", 2: "I.A", 3: "I.B", 4: "I.B", 5: "II"}
    flat = compare.plane(pairs).collect()
    apart = {r.draw: r.x for r in flat}
    assert abs(abs(apart[1] - apart[5]) - 20.0) < 1e-6 and all(abs(r.y) < 1e-4 for r in flat)


def test_corners_are_no_neighbours(spark):
    ring = lambda u, x, y: [(u, 0, k, x + a, y + b) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    squares = spark.createDataFrame(ring(0, 0, 0) + ring(1, 1, 0) + ring(2, 1, 1), "unit_id int, ring int, pos int, x int, y int")
    assert {tuple(r) for r in nearest.adjacency_of_outlines(squares).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_partitions_of_several_files_keep_their_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k} {i} 0\n" for i in range(4)))
    found = enumeration_files.read_partitions(spark, f"file://{tmp_path}", skip=2, n_max=7).orderBy("draw").collect()
    assert [list(r.plan) for r in found] == [[k + 1, i + 1, 1] for k in range(3) for i in range(4)][2:9]
    assert [r.draw for r in found] == list(range(1, 8))


def test_orders_keep_frontiers_short(spark):
    edges = _map(spark, _square(6), [1] * 36, 3, 0.1).edges
    order = enumeration_files.low_frontier_order(edges)
    assert order.count() == 60 and graph.frontier_sizes(order).agg(F.max("frontier")).first()[0] <= 8


def test_maps_tell_what_is_wrong(spark):
    m = _map(spark, _square(2), [1, 2, 3, 4], 2, 0.5)
    assert m.problems() == []
    bad = model.PlanMap(m.units.withColumn("pop", F.col("pop").cast("string")), m.edges.filter("src < dst"), 2, (5.0, 4.0, 3.0))
    assert len(bad.problems()) == 3
    own = m.subset(F.col("unit_id") < 2, 1)
    assert own.ndists == 1 and own.target == 3 and own.pop_tol == pytest.approx(0.5)
    assert [r.unit_id for r in m.take(3, 1).units.orderBy("unit_id").collect()] == [0, 1]


def test_growth_gives_every_draw(spark):
    m = _map(spark, _square(4), [1] * 16, 4, 0.3).mutate(gx=F.col("unit_id") % 4, gy=F.floor(F.col("unit_id") / 4))
    g = sampling.graph_of(m)
    for found in (search.seed_and_grow(m, 6, seed=2), search.compact_seed_and_grow(m, 6, seed=2)):
        rows = found.collect()
        assert sorted(r.draw for r in rows) == list(range(1, 7))
        for r in rows:
            p = np.array(r.plan)
            assert all(g.bounds[0] <= (p == d).sum() <= g.bounds[2] and sampling.connected(g, p == d) for d in range(1, 5))


def test_flags_of_a_run(spark):
    steps = spark.createDataFrame([(1, 1, 3, 90.0, 0.5, 1.0, 70, 100), (1, 2, 3, 3.0, 0.5, 1.0, 70, 100)], sampling.STEPS)
    assert [r.bottleneck for r in estimates.step_flags(steps).orderBy("step").collect()] == [False, True]


def test_tempered_runs_reach_the_same_plans_alike(spark):
    m = _map(spark, EIGHT, [1] * 8, 4, 0.05)
    begun = sampling.smc_run(m, 200, seed=2, steps=1, pop_temper=0.1).plans
    assert all(set(r.plan) == {0, 1} for r in begun.collect())
    found = labels.by_first_appearance(model.from_arrays(sampling.smc(m, 200, seed=3, start=begun.select("draw", "plan"), pop_temper=0.1), m).assignments)
    by = found.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("unit_id", "district"))).alias("p")).groupBy("p").count().collect()
    assert len(by) == 5 and all(abs(r["count"] / 200 - 0.2) < 0.17 for r in by)
    with pytest.raises(ValueError):
        sampling.smc_run(m, 10, start=begun.select("draw", "plan"))


def test_inputs_of_chains_are_checked(spark):
    m = _map(spark, _square(2), [1] * 4, 2, 0.5)
    starts, betas = search.flip_inputs(m, n=2, betas=4)
    assert starts.count() == 2 and len(betas) == 4
    with pytest.raises(ValueError):
        search.flip_inputs(m, spark.createDataFrame([(1, [1, 2, 2, 1])], "draw int, plan array<int>"))


def test_long_runs_of_equal_values_widen_intervals(spark):
    r = np.random.default_rng(3)
    free, x = r.standard_normal(400), 0.0
    slow = []
    for e in free:
        x = 0.9 * x + e
        slow.append(x)
    se = []
    for v in (free, slow):
        v = (np.array(v) - np.mean(v)) / np.std(v)
        draws = spark.createDataFrame([(1, k, float(y)) for k, y in enumerate(v)], "chain int, draw int, x double")
        se.append(estimates.interval_of_chains(draws, "x", 20).first()["se"])
    assert se[0] == pytest.approx(0.05, rel=0.4) and se[1] > 2.5 * se[0]


def test_tiles_of_plans_give_the_distances_of_joins(spark, monkeypatch):
    from terrazzo.operators import overlap

    r = np.random.default_rng(5)
    units = spark.createDataFrame([(v, int(p)) for v, p in enumerate(r.integers(0, 9, 20))], "unit_id int, pop long")
    asg = spark.createDataFrame([(d, v, int(x)) for d in range(1, 15) for v, x in enumerate(r.integers(1, 4, 20))], "draw int, unit_id int, district int")
    rows = lambda df: sorted((x.i, x.j, x.hamming, x.manhattan, round(x.euclidean, 9), round(x.vi, 9)) for x in df.collect())
    plain = rows(overlap._distances_by_joins(asg, units, "pop"))
    assert len(plain) == 14 * 13 / 2 and rows(overlap.distances(asg, units)) == plain
    monkeypatch.setattr(overlap, "BLOCK", 3)
    assert rows(overlap.distances(asg, units)) == plain
