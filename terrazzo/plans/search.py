"""Search and tempering over plans: seeded growth, tempered chains, parameter grids, least moves."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, resample, tally
from ..operators.penalties import Penalty
from ..sources.shared import shared_table
from .model import PlanMap
from .sampling import Graph, chains, connected, flip, graph_of, random_for, smc


# growth


def _moved(g: Graph, plan: np.ndarray, rng: np.random.Generator, moves: int, pick: Callable) -> np.ndarray | None:
    """``plan`` after units went from the largest district to lighter neighbours until bounds hold; None if they never do."""
    low, _, high = g.bounds
    for _ in range(moves):
        size = np.bincount(plan, g.pop, g.ndists + 1)[1:]
        if size.min() >= low and size.max() <= high:
            return plan
        step = pick(g, plan, size, rng)
        if step is None:
            return None
        v, to = step
        if (plan == plan[v]).sum() > 1:
            new = plan.copy()
            new[v] = to
            if connected(g, new == plan[v]):
                plan = new
    return None


def _random_move(g: Graph, plan: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[int, int]:
    big = int(size.argmax()) + 1
    edge = [v for v in np.flatnonzero(plan == big) if (plan[g.near[v]] != big).any()]
    v = int(edge[rng.integers(len(edge))])
    to = np.unique(plan[g.near[v]])
    to = to[to != big]
    return v, int(to[np.argmin(size[to - 1])])


def _random_merge(g: Graph, own: np.ndarray, rng: np.random.Generator, places: np.ndarray | None) -> None:
    """Join a random cluster to a random neighbour, or to that with the nearest centroid where there are places."""
    v = int(rng.integers(len(own)))
    mine = own == own[v]
    others = np.unique(np.concatenate([own[g.near[u]] for u in np.flatnonzero(mine)]))
    others = others[others != own[v]]
    if not len(others):
        return
    if places is None:
        to = others[rng.integers(len(others))]
    else:
        at = places[mine].mean(0)
        to = min(others, key=lambda k: (float(((places[own == k].mean(0) - at) ** 2).sum()), int(k)))
    own[mine] = to


def _compact_move(places: np.ndarray):
    """Of the pair of neighbours furthest apart in population, the unit that gains most by going to the lighter side."""

    def pick(g: Graph, plan: np.ndarray, size: np.ndarray, rng: np.random.Generator):
        centre = np.array([places[plan == d].mean(0) for d in range(1, g.ndists + 1)])
        options = {(int(plan[v]), int(plan[w])) for v in range(len(plan)) for w in g.near[v] if size[plan[v] - 1] > size[plan[w] - 1]}
        if not options:
            return None
        a, b = max(options, key=lambda p: (size[p[0] - 1] - size[p[1] - 1], -p[0], -p[1]))
        edge = [v for v in np.flatnonzero(plan == a) if (plan[g.near[v]] == b).any()]
        gain = [np.hypot(*(places[v] - centre[a - 1])) - np.hypot(*(places[v] - centre[b - 1])) + 1e-6 * rng.random() for v in edge]
        # mostly the best unit; now and then another, so that a unit that must stay does not block
        return int(edge[int(np.argmax(gain))] if rng.random() < 0.7 else edge[rng.integers(len(edge))]), b

    return pick


def _grown(m: PlanMap, n: int, seed: int, moves: int, places: list[str] | None, tries: int) -> DataFrame:
    g = graph_of(m)
    at = np.array([[float(r[c]) for c in places] for r in m.units.select("unit_id", *places).orderBy("unit_id").collect()]) if places else None
    sent = m.units.sparkSession.sparkContext.broadcast((g, at))

    def grow(batches):
        graph_, at_ = sent.value
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                for a in range(tries):
                    rng = random_for(seed, 31, i, a)
                    own = np.arange(len(graph_.pop))
                    while len(np.unique(own)) > graph_.ndists:
                        _random_merge(graph_, own, rng, at_)
                    plan = _moved(graph_, np.unique(own, return_inverse=True)[1] + 1, rng, moves, _random_move if at_ is None else _compact_move(at_))
                    if plan is not None:
                        out.append((int(i) + 1, plan.tolist()))
                        break
                else:
                    raise ValueError(f"draw {int(i) + 1} found no plan within bounds in {tries} tries")
            yield pd.DataFrame(out, columns=["draw", "plan"])

    return m.units.sparkSession.range(n).mapInPandas(grow, "draw int, plan array<int>")


def seed_and_grow(m: PlanMap, n: int, seed: int = 1, max_moves: int = 5_000, tries: int = 200) -> DataFrame:
    """draw, plan: merge random neighbouring clusters down to the districts, then move units out of the largest until bounds hold.

    A draw that does not get there begins anew, so there are ``n`` draws or an error.
    """
    return _grown(m, n, seed, max_moves, None, tries)


def compact_seed_and_grow(m: PlanMap, n: int, places: tuple[str, str] = ("gx", "gy"), seed: int = 1, max_moves: int = 2_000, tries: int = 200) -> DataFrame:
    """The same, with clusters merging with the nearest neighbour by centroid and moves that keep districts compact."""
    return _grown(m, n, seed, max_moves, list(places), tries)


def random_subgraph(m: PlanMap, n: int, seed: int = 1) -> PlanMap:
    """A connected map of ``n`` units that grows from a random one, each time by one of the frontier."""
    g, rng = graph_of(m), random_for(seed, 41)
    if n > len(g.pop):
        raise ValueError("fewer units than asked for")
    inside = {int(rng.integers(len(g.pop)))}
    while len(inside) < n:
        front = sorted({int(w) for v in inside for w in g.near[v]} - inside)
        if not front:
            raise ValueError("the component has fewer units than asked for")
        inside.add(front[int(rng.integers(len(front)))])
    return m.take(*sorted(inside))


def flip_inputs(m: PlanMap, plans: DataFrame | None = None, n: int = 1, betas: int = 10, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """What chains need: starts (chain, plan) whose districts are connected and as many as the map's, and a ladder.

    Without ``plans`` (draw, plan) the starts are drawn by sequential Monte Carlo.
    """
    if found := m.problems():
        raise ValueError("; ".join(found))
    if plans is None:
        return smc(m, n, seed=seed).select(F.col("draw").alias("chain"), "plan"), ladder(betas)
    asg = plans.select("draw", F.posexplode("plan").alias("unit_id", "district"))
    by = graph.pieces(m.edges, asg).groupBy("draw").agg(F.max("n_pieces").alias("most"), F.count(F.lit(1)).alias("k"))
    if odd := by.filter((F.col("most") > 1) | (F.col("k") != m.ndists)).limit(1).collect():
        raise ValueError(f"plan {odd[0]['draw']} is not {m.ndists} connected districts")
    return plans.select(F.col("draw").alias("chain"), "plan"), ladder(betas)


# tempering


def ladder(n: int) -> list[float]:
    """Temperatures from 0 to 1: (0.1^((i - 1) / (n - 1)) - 0.1) / 0.9, in rising order."""
    return [(0.1 ** (i / (n - 1)) - 0.1) / 0.9 for i in range(n - 1, -1, -1)]


def tempered(m: PlanMap, starts: DataFrame, nsims: int, energy: Callable[[np.ndarray], float], betas: list[float], weights: list[float] | None = None, adjacent: bool = True, seed: int = 1, per_round: int = 200) -> DataFrame:
    """chain, draw, plan, beta: flips whose temperature is a state of the chain.

    After every flip a neighbouring temperature (or any, unless ``adjacent``) is proposed and
    taken by the ratio of exp(-beta * energy) times the temperatures' weights.
    """
    spark, g = m.units.sparkSession, graph_of(m)
    log_w = np.log(weights or [1.0] * len(betas))
    sent = spark.sparkContext.broadcast(g)
    state, kept = starts.select("chain", F.lit(0).alias("t"), "plan", F.lit(len(betas) - 1).alias("level")), None

    def near(k: int) -> list[int]:
        return [j for j in ((k - 1, k + 1) if adjacent else range(len(betas))) if 0 <= j < len(betas) and j != k]

    for start in range(0, nsims, per_round):

        def advance(batches, start=start):
            for pdf in batches:
                out = []
                for c, p, level in zip(pdf["chain"], pdf["plan"], pdf["level"]):
                    plan, k = np.asarray(p), int(level)
                    for t in range(start + 1, min(start + per_round, nsims) + 1):
                        rng = random_for(seed, 51, c, t)
                        plan = flip(sent.value, plan, betas[k], energy, rng)
                        ways = near(k)
                        if ways:
                            j = ways[int(rng.integers(len(ways)))]
                            log = (betas[k] - betas[j]) * energy(plan) + log_w[j] - log_w[k] + np.log(len(ways)) - np.log(len(near(j)))
                            if np.log(rng.random()) <= log:
                                k = j
                        out.append((c, t, plan.tolist(), k))
                yield pd.DataFrame(out, columns=["chain", "t", "plan", "level"])

        last = min(start + per_round, nsims)
        done = shared_table(state.repartition("chain").mapInPandas(advance, "chain int, t int, plan array<int>, level int"))
        state = done.filter(F.col("t") == last)
        kept = done if kept is None else kept.union(done)
    values = F.array(*[F.lit(float(b)) for b in betas])
    return kept.select("chain", F.col("t").alias("draw"), "plan", F.element_at(values, F.col("level") + 1).alias("beta"))


def parallel_tempering(m: PlanMap, starts: DataFrame, nsims: int, energy: Callable[[np.ndarray], float], betas: list[float], every: int = 50, seed: int = 1) -> DataFrame:
    """chain, draw, plan, beta: one chain a temperature; every ``every`` steps neighbours may swap temperatures.

    Chains are rows and a round is a Spark job; swaps need the chains' energies alone, one
    number each, which the driver holds as it holds the temperatures.
    """
    spark, g = m.units.sparkSession, graph_of(m)
    sent = spark.sparkContext.broadcast(g)
    ids = [r["chain"] for r in starts.select("chain").orderBy("chain").collect()]
    if len(ids) != len(betas):
        raise ValueError("as many chains as temperatures")
    beta = dict(zip(ids, betas))
    state, kept = starts.select("chain", "plan"), None
    for start in range(0, nsims, every):
        now = dict(beta)

        def advance(batches, start=start, now=now):
            for pdf in batches:
                out = []
                for c, p in zip(pdf["chain"], pdf["plan"]):
                    plan = np.asarray(p)
                    for t in range(start + 1, min(start + every, nsims) + 1):
                        plan = flip(sent.value, plan, now[c], energy, random_for(seed, 61, c, t))
                        out.append((c, t, plan.tolist(), now[c], float(energy(plan))))
                yield pd.DataFrame(out, columns=["chain", "t", "plan", "beta", "energy"])

        last = min(start + every, nsims)
        done = shared_table(state.repartition("chain").mapInPandas(advance, "chain int, t int, plan array<int>, beta double, energy double"))
        state = done.filter(F.col("t") == last).select("chain", "plan")
        kept = done if kept is None else kept.union(done)
        e = {r["chain"]: r["energy"] for r in done.filter(F.col("t") == last).select("chain", "energy").collect()}
        rng, order = random_for(seed, 62, start), sorted(ids, key=beta.__getitem__)
        for k in range((start // every) % 2, len(order) - 1, 2):
            a, b = order[k], order[k + 1]
            if np.log(rng.random()) <= (beta[a] - beta[b]) * (e[a] - e[b]):
                beta[a], beta[b] = beta[b], beta[a]
    return kept.select("chain", F.col("t").alias("draw"), "plan", "beta")


def reweighted(draws: DataFrame, energies: DataFrame, beta: float, n: int, seed: int = 1) -> DataFrame:
    """draw, pick: ``n`` draws with replacement, weighted by exp(beta * energy), which undoes the target's exp(-beta * energy).

    Picks are of low variance: each draw comes ``n`` times its share of the weight, rounded up
    or down, and so do the k heaviest draws together, for every k. So what picks tell of the target
    is not left to chance, even where weights are nearly equal and rounding outweighs them draw by
    draw. Any run of consecutive pick numbers is spread evenly over the draws.
    """
    w = draws.select("draw").join(energies.select("draw", "energy"), "draw")
    top = w.agg(F.max(F.col("energy") * beta).alias("m")).first()["m"]
    w = w.select(F.col("draw").cast("long").alias("id"), F.exp(F.col("energy") * beta - top).alias("w"))
    w = resample.numbered(w, F.col("w").desc(), F.col("id"))
    drawn = resample.low_variance(w, n, float(np.random.default_rng(seed).random()), key="at", name="place")
    # pick k lies at place k * step, with a step near the golden section of n and prime to it
    step = next(k for k in range(max(1, round(n * 0.618)), n + 2) if math.gcd(k, n) == 1)
    pick = F.pmod(F.col("place") * pow(step, -1, n), F.lit(n)) + 1
    return drawn.select(F.col("id").cast(draws.schema["draw"].dataType).alias("draw"), pick.cast("int").alias("pick"))


# bursts with several scores


def frontier_bursts(m: PlanMap, start: DataFrame, scores: Callable[[DataFrame], DataFrame], columns: list[str], bursts: int, burst_size: int | Callable[[int], int] = 10, seed: int = 1, width: int = 4) -> DataFrame:
    """plan and scores of the plans that no other met plan beats in all scores at once (larger is better).

    ``scores`` maps assignments (draw, unit_id, district) to draw and ``columns``; a function of
    the burst's number may give its size. Each burst starts from plans of the frontier so far.
    """
    from ..operators import labels

    spark = m.units.sparkSession
    front = shared_table(start.select("plan").join(scores(start.select(F.lit(1).alias("draw"), F.posexplode("plan").alias("unit_id", "district"))).drop("draw")))
    for b in range(bursts):
        size = burst_size(b) if callable(burst_size) else burst_size
        own = front.select("plan").withColumn("o", F.xxhash64(F.lit(seed * 1_000 + b), F.array_join(F.col("plan").cast("array<string>"), ","))).orderBy("o").limit(width)
        runs = shared_table(own.select(F.row_number().over(W.orderBy("o")).alias("chain"), "plan"))  # ``width`` rows at most
        drawn = chains(m, runs, size, seed=seed * 1_000 + b).select((F.col("chain") * 1_000_000 + F.col("draw")).alias("draw"), "plan")
        drawn = shared_table(drawn)
        scored = drawn.join(scores(drawn.select("draw", F.posexplode("plan").alias("unit_id", "district"))), "draw").select("plan", *columns)
        every = shared_table(front.select("plan", *columns).union(scored).distinct().withColumn("draw", F.monotonically_increasing_id()))
        low = every.select("draw", *[(-F.col(c)).alias(c) for c in columns])
        front = shared_table(every.join(labels.not_dominated(low, "draw", columns).select("draw"), "draw").select("plan", *columns))
    return front


# parameters and parity


def parameter_report(m: PlanMap, starts: DataFrame, nsims: int, grid: dict[str, list], seed: int = 1, pop: str | None = None, penalties: list[Penalty] | None = None) -> DataFrame:
    """A row for each combination of ``grid`` and quartile of steps: median parity, acceptance.

    Keys of ``grid`` are eprob, lam, pop_tol, or the name of one of ``penalties``, whose
    strength it gives. Each combination is a run of chains (rows of its jobs); their draws are
    measured together.
    """
    spark, pop = m.units.sparkSession, pop or m.pop
    names, named = list(grid), {p.name for p in penalties or []}
    if unknown := set(names) - {"eprob", "lam", "pop_tol"} - named:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    parts = []
    for k, values in enumerate(product(*grid.values())):
        own = dict(zip(names, values))
        on = m.with_pop_tol(own.pop("pop_tol")) if "pop_tol" in own else m
        weighed = [replace(p, strength=own.pop(p.name)) if p.name in own else p for p in penalties or []]
        run = chains(on, starts, nsims, "components", seed=seed + k, accepted=True, penalty=weighed or None, **own)
        parts.append(run.select(F.lit(k).alias("combination"), *[F.lit(v).alias(n) for n, v in zip(names, values)], (F.col("chain") * 1_000_000 + F.col("draw")).alias("draw"), "chain", "plan", "moved"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    whole = shared_table(whole.withColumn("key", F.xxhash64("combination", "draw")))
    spread = tally.parity(whole.select(F.col("key").alias("draw"), F.posexplode("plan").alias("unit_id", "district")), m.units, pop)
    told = whole.join(spread.withColumnRenamed("draw", "key"), "key")
    told = told.withColumn("quartile", F.ntile(4).over(W.partitionBy("combination", "chain").orderBy("draw")))
    return told.groupBy("combination", *names, "quartile").agg(F.percentile("parity", 0.5).alias("median_parity"), F.avg(F.col("moved").cast("int")).alias("acceptance"))


def cheapest_flow(excess: list[float], pairs: list[tuple[int, int]], penalty: float) -> list[float]:
    """Flows along ``pairs`` (a to b) with the least sum of what is left of every excess, plus ``penalty`` a unit and edge.

    Flow is sent from excess to want along the cheapest path left, going back on earlier flow
    where that saves, as long as a unit saves more (2) than its path costs.
    """
    left, flow = list(excess), [0.0] * len(pairs)
    small_, n = 1e-9 * max(map(abs, excess), default=0.0), len(excess)
    while True:
        cost = [0.0 if x > small_ else np.inf for x in left]
        came: list[tuple[int, int, int] | None] = [None] * n
        for _ in range(n):  # shortest paths; going back on flow has negative cost, but no cycle has
            moved = False
            for e, (a, b) in enumerate(pairs):
                for x, y, way in ((a, b, 1), (b, a, -1)):
                    step = -penalty if flow[e] * way < -small_ else penalty
                    if cost[x] + step < cost[y] - 1e-12:
                        cost[y], came[y], moved = cost[x] + step, (x, e, way), True
            if not moved:
                break
        ends = [d for d in range(n) if left[d] < -small_ and cost[d] < 2 - 1e-12]
        if not ends:
            return flow
        end = min(ends, key=lambda d: (cost[d], d))
        path, at = [], end
        while came[at] is not None:
            at, e, way = came[at]
            path.append((e, way))
        room = min(left[at], -left[end], *[abs(flow[e]) for e, way in path if flow[e] * way < -small_], np.inf)
        for e, way in path:
            flow[e] += way * room
        left[at], left[end] = left[at] - room, left[end] + room


def least_moves(assignments: DataFrame, m: PlanMap, penalty: float = 0.2, county: str | None = None, whole: bool = True) -> DataFrame:
    """draw, a, b, move: people to move from district a to its neighbour b, so that all come near the mean with few moved.

    For each draw, the sum over districts of what is left between population and mean, plus
    ``penalty`` times the people moved, is least. With ``county`` only districts that share one
    exchange people. Moves are whole people unless ``whole`` is false. A draw's districts and
    their borders meet in a task; units don't.
    """
    mean = F.avg("p").over(W.partitionBy("draw"))
    pops = tally.tally(assignments, m.units, p=m.pop).select("draw", "district", (F.col("p") - mean).alias("gap"))
    pairs = graph.district_graph(m.edges, assignments).select("draw", "a", "b")
    if county is not None:
        own = assignments.join(m.units.select("unit_id", F.col(county).alias("c")), "unit_id").select("draw", "district", "c").distinct()
        a, b = (own.select("draw", F.col("district").alias(x), "c") for x in "ab")
        pairs = pairs.join(a.join(b, ["draw", "c"]).filter("a < b").select("draw", "a", "b").distinct(), ["draw", "a", "b"], "left_semi")
    listed = pops.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("district", "gap"))).alias("gaps")).join(pairs.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs")), "draw")

    def solve(batches):
        for pdf in batches:
            out = []
            for draw, gaps, pairs_ in zip(pdf["draw"], pdf["gaps"], pdf["pairs"]):
                at = {g["district"]: k for k, g in enumerate(gaps)}
                ends = [(p["a"], p["b"]) for p in pairs_]
                for (a, b), x in zip(ends, cheapest_flow([float(g["gap"]) for g in gaps], [(at[a], at[b]) for a, b in ends], penalty)):
                    x = float(round(x)) if whole else x
                    if x:
                        out.append((draw, a, b, x) if x > 0 else (draw, b, a, -x))
            yield pd.DataFrame(out, columns=["draw", "a", "b", "move"])

    return listed.mapInPandas(solve, "draw int, a int, b int, move double")
