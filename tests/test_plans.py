"""Maps, ensembles and samplers against small truths."""

from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import estimates
from terrazzo.operators import graph, labels, overlap, penalties, tally
from terrazzo.plans import enumeration, model, sampling
from terrazzo.sources import nation_grid as grid


def _map(spark, near, pop, k, tol):
    units = spark.createDataFrame([(i, p) for i, p in enumerate(pop)], "unit_id int, pop long")
    edges = spark.createDataFrame([(a, b) for a, x in enumerate(near) for b in x], "src int, dst int")
    target = sum(pop) / k
    return model.PlanMap(units, edges, k, (target * (1 - tol), target, target * (1 + tol)))


EIGHT = [[1, 2], [0, 3], [0, 3, 4], [1, 2, 5], [2, 5, 6], [3, 4, 7], [4, 7], [5, 6]]


def _square(n):
    return [[w for w in (v - n, v + n, v - 1 if v % n else -1, v + 1 if v % n < n - 1 else -1) if 0 <= w < n * n] for v in range(n * n)]


def _plans(spark, rows):
    return spark.createDataFrame(rows, "draw int, plan array<int>")


@pytest.mark.parametrize("near,k,size,n", [(_square(2), 2, 2, 2), (_square(3), 3, 3, 10), (_square(4), 4, 4, 117), (EIGHT, 4, 2, 5)])
def test_counts_of_equal_partitions(spark, near, k, size, n):
    m = _map(spark, near, [1] * len(near), k, 0.01)
    assert enumeration.count_partitions(spark, m.edges, m.units, k, "pop", size, size).first()["n"] == n


def test_counts_with_weights_are_brute_force(spark):
    near, pop = [[1, 4], [0, 2, 4], [1, 3, 4], [2, 4], [0, 1, 2, 3]], [2, 1, 1, 1, 1]
    m = _map(spark, near, pop, 2, 0.5)
    found = enumeration.count_partitions(spark, m.edges, m.units, 2, "pop", 2, 4).first()["n"]
    g = sampling.graph_of(m)
    plain = sum(all(sampling.connected(g, np.array(p) == d) and 2 <= sum(x for x, y in zip(pop, p) if y == d) <= 4 for d in (0, 1)) for p in product((0, 1), repeat=5) if p[0] == 0)
    assert found == plain == 6


def test_smc_reaches_the_five_plans_alike(spark):
    m = _map(spark, EIGHT, [1] * 8, 4, 0.05)
    found = labels.by_first_appearance(model.from_arrays(sampling.smc(m, 300, seed=2), m).assignments)
    by = found.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("unit_id", "district"))).alias("p")).groupBy("p").count().collect()
    assert len(by) == 5 and sum(r["count"] for r in by) == 300
    assert all(abs(r["count"] / 300 - 0.2) < 4 * (0.16 / 300) ** 0.5 + 0.03 for r in by)


def test_samples_do_not_depend_on_partitions(spark):
    m = _map(spark, _square(3), [1] * 9, 3, 0.01)
    one = {r.draw: list(r.plan) for r in sampling.smc(m, 12, seed=5).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert one == {r.draw: list(r.plan) for r in sampling.smc(m, 12, seed=5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_spanning_trees_are_counted_and_even(spark):
    m = _map(spark, _square(2), [1] * 4, 2, 0.1)
    asg = spark.createDataFrame([(1, v, 1) for v in range(4)], "draw int, unit_id int, district int")
    assert graph.log_trees(m.edges, asg).first()["log_trees"] == pytest.approx(np.log(4))
    g, seen = sampling.graph_of(m), {}
    for k in range(2000):
        _, parent = sampling.spanning_tree(g, np.ones(4, bool), sampling.random_for(1, k))
        tree = frozenset(frozenset((v, int(p))) for v, p in enumerate(parent) if p >= 0)
        seen[tree] = seen.get(tree, 0) + 1
    assert len(seen) == 4 and all(400 < n < 600 for n in seen.values())


def test_assignment_is_the_cheapest():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            cost = r.integers(0, 20, (n, n)).astype(float)
            found = labels.assign(cost)
            assert sorted(found) == list(range(n))
            assert cost[np.arange(n), found].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_dominance_keeps_the_first_of_equals(spark):
    scores = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 1), (4, 1, -1)], "draw int, a int, b int")
    assert sorted(r.draw for r in labels.not_dominated(scores, "draw", ["a", "b"]).collect()) == [1, 4]


def test_reduced_graph(spark):
    m = _map(spark, [[1, 2], [0, 2], [0, 1, 3], [2]], [1, 2, 3, 4], 2, 0.5)
    kept = m.filter(F.col("unit_id") != 1)
    assert {tuple(r) for r in kept.edges.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert kept.bounds == m.bounds and m.with_pop_tol(0.05).pop_tol == pytest.approx(0.05)


def test_roles_are_inferred_and_guarded(spark):
    units = spark.createDataFrame([(0, 5, 1), (1, 5, 2)], "unit_id int, population long, plan int")
    m = model.build_map(units, spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int"), existing="plan")
    assert (m.pop, m.ndists, m.target) == ("population", 2, 5)
    with pytest.raises(ValueError):
        m.select("unit_id")
    with pytest.raises(ValueError):
        model.build_map(units.drop("population"), units, 2)


def test_freeze_joins_connected_frozen_units(spark):
    m = _map(spark, _square(3), [1] * 9, 3, 0.1)
    plan = spark.createDataFrame([(v, v % 3 + 1) for v in range(9)], "unit_id int, district int")
    frozen = spark.createDataFrame([(0,), (3,), (8,)], "unit_id int")
    found = {r.unit_id: r.frozen_with for r in graph.freeze(m.edges, plan, frozen).collect()}
    assert found == {0: 0, 3: 0, 8: 8, **{v: v for v in (1, 2, 4, 5, 6, 7)}}


def test_ensembles_bind_and_take_references(spark):
    e = grid.nation_plans(spark, "/root/testdata/sf0.001")
    assert e.is_valid()
    both = model.bind(e, e)
    assert both.draws.count() == 100 and both.draws.select("chain").distinct().count() == 2
    more = model.add_reference(e, e.map.existing_plan(), "existing")
    assert more.n_references() == 1 and more.sampled().draws.count() == 50
    with pytest.raises(ValueError):
        model.add_reference(more, e.map.existing_plan(), "existing")


def test_rhat_of_like_and_unlike_chains(spark):
    r = np.random.default_rng(0)
    like = [(c, k, float(r.standard_normal())) for c in (1, 2) for k in range(300)]
    apart = [(c, k, x + 5 * c) for c, k, x in like]
    near, far = (estimates.rhat(spark.createDataFrame(d, "chain int, draw int, x double"), "x").first()["rhat"] for d in (like, apart))
    assert near < 1.02 and far > 1.3


def test_hinges_pick_the_nearest_target(spark):
    units = spark.createDataFrame([(0, 30, 100), (1, 80, 100)], "unit_id int, grp long, pop long")
    asg = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "draw int, unit_id int, district int")
    hinge = penalties.grp_hinge(1.0, "grp", targets=(0.4, 0.9)).of(asg, units).orderBy("district").collect()
    assert [r.penalty for r in hinge] == pytest.approx([0.1**0.5, 0.1**0.5])
    inverse = penalties.grp_inv_hinge(1.0, "grp", targets=(0.2,)).of(asg, units).orderBy("district").collect()
    assert [r.penalty for r in inverse] == pytest.approx([0.1**0.5, 0.6**0.5])
    assert tally.target_share(0.5, 40, 100, 4, 1) == pytest.approx((40 - 12.5) / 75)
    assert overlap.share_unchanged(asg, asg.select("unit_id", "district")).first()["unchanged"] == 1.0
