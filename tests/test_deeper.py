"""Eigenvectors, resampling, intervals, discoveries, outlines, radii, trees, cores, numbered partitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import estimates
from terrazzo.operators import compare, graph, labels, nearest, overlap, resample, shapes, spectral
from terrazzo.plans import enumeration, model, sampling, search

from .test_plans import EIGHT, _map, _square


def test_leading_eigenvectors_are_those_of_the_matrix(spark):
    r = np.random.default_rng(4)
    a = r.normal(size=(2, 14, 14))
    a = a + a.transpose(0, 2, 1)
    entries = spark.createDataFrame([("ab"[g], i, j, float(a[g, i, j])) for g in (0, 1) for i in range(14) for j in range(14)], "grp string, node long, other long, a double")
    apply = lambda v: entries.join(v, ["grp", "node"]).groupBy("grp", F.col("other").alias("node")).agg(F.sum(F.col("a") * F.col("x")).alias("w"))
    found = spectral.leading(entries.select("grp", "node").distinct(), apply, high=2, low=1).collect()
    for g in (0, 1):
        value, vector = np.linalg.eigh(a[g])
        for place, k in ((1, 13), (2, 12), (-1, 0)):
            own = sorted((x for x in found if x["grp"] == "ab"[g] and x["place"] == place), key=lambda x: x["node"])
            assert own[0]["eigenvalue"] == pytest.approx(value[k], abs=1e-6)
            assert abs(sum(x["value"] * y for x, y in zip(own, vector[:, k]))) == pytest.approx(1, abs=1e-6)
            assert max(own, key=lambda x: abs(x["value"]))["value"] > 0


def test_sets_are_compared_as_by_the_dense_matrix(spark):
    r = np.random.default_rng(8)
    plans = r.integers(1, 4, (20, 12))
    rows = [(d + 1, u, int(x)) for d, p in enumerate(plans) for u, x in enumerate(p)]
    asg = spark.createDataFrame(rows, "draw int, unit_id int, district int")
    parts = []
    for own in (plans[:8], plans[8:]):
        p = ((own[:, :, None] == own[:, None, :]).sum(0) + 1 / 3) / (len(own) + 1)
        np.fill_diagonal(p, 1)
        parts.append(p)
    value, vector = np.linalg.eigh(parts[0] - parts[1])
    found = compare.compare_sets(asg.filter("draw <= 8"), asg.filter("draw > 8"), 3).collect()
    for split, k, sign in ((1, 11, 1), (2, 0, -1)):
        own = sorted((x for x in found if x["split"] == split), key=lambda x: x["unit_id"])
        assert own[0]["separation"] == pytest.approx(sign * value[k], abs=1e-6)
        assert abs(sum(x["value"] * y for x, y in zip(own, vector[:, k]))) == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("tile", [512, 5])
def test_cooccurrence_is_that_of_pairs(spark, tile):
    r = random.Random(1)
    rows = [(d, u, r.randint(1, 3)) for d in (2, 5, 9, 11) for u in range(17) if (d, u) != (5, 3)]
    found = {(x.unit_i, x.unit_j): x.p for x in overlap.cooccurrence(spark.createDataFrame(rows, "draw int, unit_id int, district int"), tile=tile).collect()}
    at = {(d, u): k for d, u, k in rows}
    plain = {(i, j): sum(at.get((d, i), -1) == at.get((d, j), -2) for d in (2, 5, 9, 11)) / 4 for i in range(17) for j in range(i + 1, 17)}
    assert found == {k: p for k, p in plain.items() if p}
    some = overlap.cooccurrence(spark.createDataFrame(rows, "draw int, unit_id int, district int"), least=0.5, tile=tile)
    assert {(x.unit_i, x.unit_j) for x in some.collect()} == {k for k, p in plain.items() if p >= 0.5}


@pytest.mark.parametrize("stretch", [1_000, 3])
def test_low_variance_counts_are_rounded_shares(spark, stretch, monkeypatch):
    monkeypatch.setattr(resample, "STRETCH", stretch)
    r = random.Random(6)
    w = [r.choice([0.0, 0.2, 1.0, 30.0]) * r.random() for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(w)), "id long, w double").repartition(5)
    for offset in (0.0, 0.31, 0.999):
        drawn = resample.cumulative(rows, stretch=stretch).withColumn("pick", F.explode(resample.picks(100, F.lit(offset)))).collect()
        assert sorted(x.pick for x in drawn) == list(range(100))
        count = Counter(x.id for x in drawn)
        assert all(math.floor(100 * x / sum(w)) <= count[k] <= math.ceil(100 * x / sum(w)) + 1e-9 for k, x in enumerate(w))
    assert resample.low_variance(rows, 7, 0.5).count() == 7


def test_same_draws_for_any_stretch_and_round(spark, monkeypatch):
    m = _map(spark, EIGHT, [1] * 8, 4, 0.05)
    one = sampling.smc(m, 40, seed=5).collect()
    whole = resample.cumulative
    monkeypatch.setattr(sampling, "cumulative", lambda rows, **_: whole(rows, stretch=1_000))
    # rounds of three attempts instead of enough for most particles
    monkeypatch.setattr(sampling, "_generation", lambda *a, own=sampling._generation: own(*a[:10], 3, *a[11:]))
    assert sorted(map(tuple, one)) == sorted(map(tuple, sampling.smc(m, 40, seed=5).collect()))


def test_tempering_changes_the_way_but_not_the_weights_left(spark):
    m = _map(spark, _square(3), [1, 2, 1, 1, 2, 1, 1, 1, 2], 3, 0.3)
    plain, held = (sampling.smc_run(m, 60, seed=4, pop_temper=t, resample=False, seq_alpha=1.0) for t in (0.0, 0.2))
    a, b = ({r.draw: (list(r.plan), r.wgt) for r in run.plans.collect()} for run in (plain, held))
    assert a != b
    g = sampling.graph_of(m)
    assert sampling._temper(g, np.array([1, 1, 0, 0, 0, 0, 0, 0, 0]), 1, 0.5) == pytest.approx(0.5 * math.log(1e-12 + 0.25))


def test_the_last_step_of_a_partial_run_counts_in_full(spark):
    m = _map(spark, EIGHT, [1] * 8, 4, 0.05)
    run = sampling.smc_run(m, 50, seed=3, steps=1, resample=False, seq_alpha=0.3)
    g = sampling.graph_of(m)
    found = [(sampling._increment(g, np.array(r.plan), 1, 1.0, None), r.wgt) for r in run.plans.collect()]
    least = min(x for x, _ in found)
    assert all(w == pytest.approx(math.exp(least - x)) for x, w in found)


def test_ancestors_are_carried(spark):
    m = _map(spark, EIGHT, [1] * 8, 4, 0.05)
    run = sampling.smc_run(m, 30, seed=3, resample=False)
    assert sampling.lags_of(4) == [1, 2, 3]
    by = {(r.lag, r.draw): r.ancestor for r in run.ancestors.collect()}
    assert len(by) == 90 and all(by[3, d] == d - 1 for d in range(1, 31))
    # draws of one ancestor at a later step have one at earlier steps
    for late, early in ((3, 2), (2, 1)):
        told = {}
        assert all(told.setdefault(by[late, d], by[early, d]) == by[early, d] for d in range(1, 31))


def test_student_quantiles():
    assert [estimates.student_quantile(0.95, df) for df in (1, 4, 49)] == pytest.approx([6.313751515, 2.131846786, 1.676550893], abs=1e-6)
    assert estimates.student_quantile(0.025, 9) == pytest.approx(-2.262157163, abs=1e-6)


def test_intervals_need_draws(spark):
    with pytest.raises(ValueError):
        estimates.interval_by_lags(spark.createDataFrame([], "draw int, x double"), spark.createDataFrame([], "draw int, lag int, ancestor long"), "x")
    with pytest.raises(ValueError):
        estimates.interval_of_runs(spark.createDataFrame([(1, 1, 2.0)], "chain int, draw int, x double"), "x")


def test_curves_are_monotone_and_meet_their_knots(spark):
    r = random.Random(2)
    for _ in range(5):
        x = sorted(r.sample(range(100), 7))
        y = sorted(r.choice([0.0, 0.1, r.random()]) for _ in x)
        m = estimates.monotone_curve(x, y)
        at = [x[0] + (x[-1] - x[0]) * k / 200 for k in range(201)]
        found = [v.q for v in spark.createDataFrame([(float(v),) for v in [*at, *x]], "v double").select("v", estimates.curve_value(F.col("v"), x, y, m).alias("q")).collect()]
        assert all(b >= a - 1e-12 for a, b in zip(found[:201], found[1:201]))
        assert found[201:] == pytest.approx(y)
    assert estimates.monotone_curve([1.0], [0.3]) == [0.0]


def test_ranks_of_clustered_values(spark):
    r = random.Random(3)
    x = [r.choice([1e12, -5.0, r.random() * 1e-9, r.gauss(0, 1)]) for _ in range(400)]
    found = estimates.average_ranks(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").collect()
    order = sorted(x)
    assert all(v.rank == (order.index(v.x) + len(x) - order[::-1].index(v.x) + 1) / 2 for v in found)


def _corners(spark, rings):
    return spark.createDataFrame([(u, k, i, float(x), float(y)) for u, own in rings.items() for k, ring in enumerate(own) for i, (x, y) in enumerate(ring)], "unit_id int, ring int, pos int, x double, y double")


def test_sides_shared_in_part_make_neighbours(spark):
    rings = {
        0: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]],  # a hole
        1: [[(4, 4), (6, 4), (6, 6), (4, 6)]],  # an island in it
        2: [[(10, 0), (15, 0), (15, 4), (10, 4)]],  # two short sides beside a long one
        3: [[(10, 4), (15, 4), (15, 10), (10, 10)]],
        4: [[(15, 10), (20, 10), (20, 15), (15, 15)]],  # a corner alone
        5: [[(0, 10), (0, 20), (10, 20)]],  # a slanting side from corner to corner
        6: [[(0, 10), (5, 15), (5, 10)]],  # half of that slant
        7: [[(19, 14), (25, 14), (25, 20), (19, 20)]],  # lies over 4 in part
        8: [[(100, 100), (101, 100), (101, 101)]],  # alone
    }
    found = {tuple(r) for r in nearest.adjacency_of_outlines(_corners(spark, rings)).collect()}
    pairs = {(0, 1), (0, 2), (0, 3), (2, 3), (5, 6), (0, 6), (4, 7)}
    assert found == pairs | {(b, a) for a, b in pairs}


def test_outlines_of_odd_numbers(spark):
    # thirds and tenths: sides that meet up to rounding, along slants and straight lines
    def turned(x, y):
        return 0.1 + x * math.cos(0.7) - y * math.sin(0.7), 0.3 + x * math.sin(0.7) + y * math.cos(0.7)

    rings = {8 * j + i: [[turned((i + a) / 3, (j + b) / 10) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]] for j in range(8) for i in range(8)}
    found = {tuple(r) for r in nearest.adjacency_of_outlines(_corners(spark, rings)).collect()}
    assert found == {(8 * j + i, 8 * b + a) for j in range(8) for i in range(8) for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < 8 and 0 <= b < 8}


def test_no_outlines(spark):
    assert nearest.adjacency_of_outlines(_corners(spark, {})).collect() == []


def test_radii_of_a_circle_are_even(spark):
    ring = [(3 + math.cos(2 * math.pi * k / 64), 5 + math.sin(2 * math.pi * k / 64)) for k in range(64)]
    asg = spark.createDataFrame([(1, 0, 1)], "draw int, unit_id int, district int")
    assert shapes.boyce_clark(asg, _corners(spark, {0: [ring]})).first()["boyce_clark"] == pytest.approx(1)
    assert shapes.boyce_clark(asg, _corners(spark, {0: [ring[::-1]]})).first()["boyce_clark"] == pytest.approx(1)


def test_radii_of_a_square_and_of_a_bent_district(spark):
    r = [1 / max(abs(math.cos(k * math.pi / 8)), abs(math.sin(k * math.pi / 8))) for k in range(16)]
    even = 1 - sum(abs(x / sum(r) * 100 - 6.25) for x in r) / 200
    square = lambda x, y: [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]]
    # a frame of eight squares around a hole: its centre lies outside it
    places = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rings = {k: square(*p) for k, p in enumerate(places)} | {9: square(7, 7)}
    asg = spark.createDataFrame([*[(1, k, 1) for k in range(8)], (1, 9, 2)], "draw int, unit_id int, district int")
    found = {r_["district"]: r_["boyce_clark"] for r_ in shapes.boyce_clark(asg, _corners(spark, rings)).collect()}
    assert found[2] == pytest.approx(even)
    # from the middle of the nearest square (the first of those beside the hole) to the frame's walls
    cx, cy = min(((math.hypot(x - 1, y - 1), k, x, y) for k, (x, y) in enumerate(places)))[2:]
    cx, cy, walls = cx + 0.5, cy + 0.5, []
    for k in range(16):
        dx, dy = math.cos(k * math.pi / 8), math.sin(k * math.pi / 8)
        walls.append(min(((3 - cx) / dx if dx > 0 else -cx / dx) if abs(dx) > 1e-9 else 1e9, ((3 - cy) / dy if dy > 0 else -cy / dy) if abs(dy) > 1e-9 else 1e9))
    assert found[1] == pytest.approx(1 - sum(abs(x / sum(walls) * 100 - 6.25) for x in walls) / 200)


def _dense_trees(pairs, n):
    lap = np.zeros((n, n))
    for a, b in pairs:
        if a != b:
            lap[[a, b], [a, b]] += 1
            lap[[a, b], [b, a]] -= 1
    return round(np.linalg.det(lap[1:, 1:])) if n > 1 else 1


def test_trees_are_counted_as_by_the_determinant():
    r = random.Random(9)
    for _ in range(150):
        n = r.randint(1, 9)
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 3 * n))]
        plain, found = _dense_trees(pairs, n), graph.log_tree_count(pairs, n)
        assert (found is None) == (plain == 0) and (found is None or found == pytest.approx(math.log(plain)))


def test_trees_of_a_long_grid_need_little_memory():
    side = 60  # 3,600 vertices: a dense matrix would hold 13 million numbers
    pairs = [(y * side + x, y * side + x + 1) for y in range(side) for x in range(side - 1)] + [(y * side + x, (y + 1) * side + x) for y in range(side - 1) for x in range(side)]
    k = np.arange(side)
    eigen = 4 - 2 * np.cos(np.pi * k / side)[:, None] - 2 * np.cos(np.pi * k / side)[None, :]
    plain = np.log(eigen.ravel()[1:]).sum() - 2 * math.log(side)
    assert graph.log_tree_count(pairs, side * side) == pytest.approx(plain, rel=1e-9)


def test_two_level_trees_are_the_products_of_their_parts(spark):
    r = random.Random(12)
    near = _square(4)
    edges = _map(spark, near, [1] * 16, 2, 0.5).edges
    county = [r.choice("abc") for _ in range(16)]
    units = spark.createDataFrame(list(enumerate(county)), "unit_id int, county string")
    plan = [1] * 16
    found = graph.log_trees(edges, spark.createDataFrame([(1, v, d) for v, d in enumerate(plan)], "draw int, unit_id int, district int"), units, "county").first()["log_trees"]
    part = {}
    for v in range(16):
        if v not in part:
            stack = [v]
            part[v] = v
            while stack:
                for w in near[stack.pop()]:
                    if w not in part and county[w] == county[v]:
                        part[w] = v
                        stack.append(w)
    names = sorted(set(part.values()))
    total = _dense_trees([(names.index(part[a]), names.index(part[b])) for a in range(16) for b in near[a] if a < b], len(names))
    for k in names:
        own = [v for v in range(16) if part[v] == k]
        total *= _dense_trees([(own.index(a), own.index(b)) for a in own for b in near[a] if a < b and part[b] == k], len(own))
    assert found == pytest.approx(math.log(total))


def test_split_districts_have_no_tree(spark):
    edges = _map(spark, _square(2), [1] * 4, 2, 0.5).edges
    asg = spark.createDataFrame([(1, 0, 1), (1, 3, 1), (1, 1, 2), (2, 0, 1), (2, 1, 1)], "draw int, unit_id int, district int")
    assert {(r.draw, r.district): r.log_trees for r in graph.log_trees(edges, asg).collect()} == {(1, 1): None, (1, 2): 0.0, (2, 1): 0.0}


def test_cores_near_one_district(spark):
    edges = _map(spark, _square(4), [1] * 16, 4, 0.5).edges
    asg = spark.createDataFrame([(1, v, 1 + v // 4) for v in range(16)], "draw int, unit_id int, district int")
    found = {r.unit_id: r.core for r in graph.cores(edges, asg, 1, focus=1).collect()}
    # rows 1 and 2 touch the first row's district; rows 3 and 4 are cores as a whole
    assert len({found[v] for v in range(8)}) == 8
    assert len({found[v] for v in range(8, 12)}) == len({found[v] for v in range(12, 16)}) == 1
    assert len(set(found.values())) == 10
    everywhere = {r.unit_id: r.core for r in graph.cores(edges, asg, 2).collect()}
    assert len(set(everywhere.values())) == 16


@pytest.mark.parametrize("near,k,low,high", [(_square(3), 3, 2, 4), (EIGHT, 3, 1, 5)])
def test_partitions_are_found_by_number(spark, near, k, low, high):
    m = _map(spark, near, [1] * len(near), k, 0.9)
    dag = enumeration.PartitionDag(spark, m.edges, m.units, k, "pop", low, high)
    every = {r.draw: tuple(r.plan) for r in dag.slice(0, dag.count).collect()}
    assert len(every) == len(set(every.values())) == dag.count == enumeration.count_partitions(spark, m.edges, m.units, k, "pop", low, high).first()["n"]
    assert {r.draw: tuple(r.plan) for r in dag.slice(dag.count - 3, 9).collect()} == {d: every[d] for d in range(dag.count - 3, dag.count)}
    relabelled = spark.createDataFrame([(d, [k + 1 - x for x in p]) for d, p in every.items()], "draw long, plan array<int>")
    assert {r.draw: int(r["rank"]) for r in dag.rank(relabelled).collect()} == {d: d for d in every}
    assert dag.rank(spark.createDataFrame([(1, [1] * len(near))], "draw long, plan array<int>")).count() == 0
    assert dag.at(spark.createDataFrame([(1, dag.count)], "draw long, rank long")).count() == 0


def test_there_may_be_no_partition(spark):
    m = _map(spark, _square(2), [1] * 4, 2, 0.1)
    dag = enumeration.PartitionDag(spark, m.edges, m.units, 2, "pop", 3, 3)
    assert dag.count == 0 and dag.slice(0, 5).count() == 0
    with pytest.raises(ValueError):
        dag.sample(3)


def test_flows_are_the_cheapest(spark):
    # 100, 200 and 330 people on a triangle: the two lighter districts take from the third
    assert search.cheapest_flow([-110.0, -10.0, 120.0], [(0, 1), (0, 2), (1, 2)], 0.2) == pytest.approx([0, -110, -10])
    # a path of eleven edges costs more than moving saves
    path = [(k, k + 1) for k in range(11)]
    assert search.cheapest_flow([5.0, *[0.0] * 10, -5.0], path, 0.2) == [0.0] * 11
    assert search.cheapest_flow([5.0, *[0.0] * 8, -5.0], path[:9], 0.2) == pytest.approx([5.0] * 9)
    r = random.Random(7)
    for _ in range(40):
        n = r.randint(2, 4)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.7]
        pops = [r.randint(0, 8) * n for _ in range(n)]
        gaps = [p - sum(pops) / n for p in pops]
        flow = search.cheapest_flow(gaps, pairs, 0.5)
        left = list(gaps)
        for (a, b), x in zip(pairs, flow):
            left[a] -= x
            left[b] += x
        cost = sum(map(abs, left)) + 0.5 * sum(map(abs, flow))
        # by duality: potentials in halves from -1 to 1, half a unit apart at most along edges
        dual = max(sum(k * g for k, g in zip(own, gaps)) / 2 for own in np.ndindex(*[5] * n) for own in [[k - 2 for k in own]] if all(abs(own[a] - own[b]) <= 1 for a, b in pairs))
        assert cost == pytest.approx(dual)


def test_moves_keep_to_counties_and_whole_people(spark):
    m = _map(spark, _square(2), [10, 5, 5, 1], 4, 0.9)
    m = model.PlanMap(m.units.withColumn("county", F.when(F.col("unit_id") < 2, "x").otherwise("y")), m.edges, 4, m.bounds)
    asg = spark.createDataFrame([(1, v, v + 1) for v in range(4)], "draw int, unit_id int, district int")
    free = {(r.a, r.b) for r in search.least_moves(asg, m).collect()}
    held = search.least_moves(asg, m, county="county").collect()
    assert len(free) > 1 and {tuple(sorted((r.a, r.b))) for r in held} <= {(1, 2), (3, 4)}
    assert all(r.move == round(r.move) > 0 for r in held)


def test_summaries_warn(spark):
    steps = spark.createDataFrame([(1, 1, 3, 90.0, 0.5, 1.0, 70, 100), (2, 1, 3, 3.0, 0.5, 1.0, 70, 100)], sampling.STEPS)
    stats = spark.createDataFrame([(c, d, float(d % 5 + 9 * (c == 2)), 1.0) for c in (1, 2) for d in range(1, 21)], "chain int, draw int, x double, same double")
    pairs = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.2)], "i int, j int, diversity double")
    found = {(r.part, r.chain, r.item): r for r in estimates.run_summary(steps, stats, ["x", "same"], pairs).collect()}
    assert not found["split", 1, "n_eff"].warn and found["split", 2, "n_eff"].warn
    assert found["split", 2, "survivors"].value == 0.7
    assert found["diversity", None, "mean"].warn and found["rhat", None, "x"].warn
    assert ("rhat", None, "same") not in found


def test_shares_are_told_from_numbers(spark):
    units = spark.createDataFrame([(0, "k", 10, 0.5, 2.0, "a"), (1, "k", 30, 0.1, 0.5, "b")], "unit_id int, key string, pop long, share double, rate double, name string")
    assert graph.share_columns(units) == ["share"]
    r = graph.merge_units(units, ["key"]).first()
    assert (r["share"], r["rate"], r["name"], r["pop"]) == (pytest.approx(0.2), 2.5, "a~b", 40)


def test_bound_ensembles_add_their_effective_sizes(spark):
    m = _map(spark, _square(2), [1] * 4, 2, 0.1)
    asg = spark.createDataFrame([(1, v, 1 + v // 2) for v in range(4)], "draw int, unit_id int, district int")
    one, two = (model.ensemble(asg, m, n_eff=n) for n in (3.5, 4.0))
    assert model.bind(one, two).info["n_eff"] == 7.5
    assert "n_eff" not in model.bind(model.ensemble(asg, m), two).info


@pytest.mark.parametrize("n", [1, 2, 3])
def test_frontiers_are_those_of_all_pairs(spark, n):
    r = random.Random(n)
    rows = [(k, *[float(r.randrange(9)) for _ in range(n)]) for k in range(300)]
    columns = ["a", "b", "c"][:n]
    found = labels.not_dominated(spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in columns)).repartition(5), "id", columns).collect()

    def beats(x, y):
        return all(p <= q for p, q in zip(x[1:], y[1:])) and (x[1:] != y[1:] or x[0] < y[0])

    assert sorted(x["id"] for x in found) == [y[0] for y in rows if not any(beats(x, y) for x in rows)]
    assert labels.not_dominated(spark.createDataFrame([], "id int, " + ", ".join(f"{c} double" for c in columns)), "id", columns).collect() == []


def test_maps_are_built_from_outlines(spark):
    rings = {k: [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]] for k, (x, y) in enumerate(((0, 0), (1, 0), (1.5, 1)))}
    units = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "unit_id int, pop long")
    assert {tuple(r) for r in model.build_map(units, ndists=1, corners=_corners(spark, rings)).edges.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}
    with pytest.raises(ValueError, match="edges or corners"):
        model.build_map(units, ndists=1)
    with pytest.raises(TypeError, match="edges must be DataFrame, not list"):
        model.build_map(units, [(0, 1)], 1)


def test_reports_weigh_penalties(spark):
    from terrazzo.operators import penalties

    m = _map(spark, _square(3), [1] * 9, 3, 0.7)
    starts = spark.createDataFrame([(1, [1, 1, 1, 2, 2, 2, 3, 3, 3])], "chain int, plan array<int>")
    found = search.parameter_report(m, starts, 24, {"pop_dev": [0.0, 60.0]}, seed=4, penalties=[penalties.pop_dev(1.0, 3.0)]).collect()
    parity = {w: np.mean([r.median_parity for r in found if r.pop_dev == w]) for w in (0.0, 60.0)}
    assert len(found) == 8 and parity[60.0] < parity[0.0]
    with pytest.raises(ValueError, match="unknown"):
        search.parameter_report(m, starts, 4, {"speed": [1]})
