"""Sampling of plans: sequential Monte Carlo and Markov chains, as rounds of Spark jobs.

Particles and chains are rows. A round draws candidates by low-variance resampling of the
parents, cuts a random spanning tree in each (a small numpy helper) and keeps the first that is
valid. Generations are tables in the shared folder. Random numbers depend on (seed, row, round)
alone, so results don't change with the partitioning or when a task runs again.

With counties a tree is drawn in two levels (within each connected part of a county, then
between the parts), so that a cut splits one county at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import log_tree_count
from ..operators.resample import cumulative, low_variance, picks
from ..operators.sizes import small
from ..sources.shared import shared_table
from .model import PlanMap

#: Units of a map that may be sent to every task; redraws of a particle.
MOST_UNITS, MOST_TRIES = 200_000, 20_000


@dataclass(frozen=True)
class Graph:
    near: list[np.ndarray]
    pop: np.ndarray
    bounds: tuple[float, float, float]
    ndists: int
    county: np.ndarray | None = None


def graph_of(m: PlanMap, counties: str | None = None) -> Graph:
    """The map's graph for the tasks; refused beyond ``MOST_UNITS`` (edges are bounded with the units, as maps are planar)."""
    rows = m.units.select("unit_id", m.pop, *([counties] if counties else [])).orderBy("unit_id").limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError(f"a map of more than {MOST_UNITS} units")
    near: list[list[int]] = [[] for _ in rows]
    for r in m.edges.collect():
        near[r["src"]].append(r["dst"])
    county = np.unique([str(r[counties]) for r in rows], return_inverse=True)[1] if counties else None
    return Graph([np.array(sorted(x), np.int64) for x in near], np.array([r[m.pop] for r in rows], float), m.bounds, m.ndists, county)


def random_for(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([abs(int(k)) for k in key])))


def _walked(nodes: list[int], ways: dict[int, list], to, root: int, rng: np.random.Generator) -> dict[int, object]:
    """The exit of each node of a uniform spanning tree but the root's, by loop-erased walks."""
    done, exits = {root}, {}
    for start in (nodes[i] for i in rng.permutation(len(nodes))):
        v = start
        while v not in done:  # the last exit of each node is the loop-erased path
            own = ways[v]
            exits[v] = own[int(rng.random() * len(own))]
            v = to(exits[v])
        v = start
        while v not in done:
            done.add(v)
            v = to(exits[v])
    return exits


def county_parts(g: Graph, inside: np.ndarray) -> np.ndarray:
    """Number of each inside unit's connected part of its county; -1 elsewhere."""
    part = np.full(len(inside), -1)
    n = 0
    for v in np.flatnonzero(inside).tolist():
        if part[v] < 0:
            part[v], stack = n, [v]
            while stack:
                x = stack.pop()
                for w in g.near[x].tolist():
                    if inside[w] and part[w] < 0 and g.county[w] == g.county[v]:
                        part[w] = n
                        stack.append(w)
            n += 1
    return part


def spanning_tree(g: Graph, inside: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A uniform spanning tree of the units inside (with counties, uniform at both levels): order from the root, and parents."""
    units = np.flatnonzero(inside).tolist()
    near = {v: [w for w in g.near[v].tolist() if inside[w]] for v in units}
    root = units[int(rng.integers(len(units)))]
    links: dict[int, list[int]] = {v: [] for v in units}
    if g.county is None:
        edges = _walked(units, near, lambda w: w, root, rng).items()
    else:
        part = county_parts(g, inside)
        of = part.tolist()
        members: dict[int, list[int]] = {}
        for v in units:
            members.setdefault(of[v], []).append(v)
        crossing = {k: [(v, w) for v in own for w in near[v] if of[w] != k] for k, own in members.items()}
        edges = list(_walked(list(members), crossing, lambda e: of[e[1]], of[root], rng).values())
        for k, own in members.items():
            within = {v: [w for w in near[v] if of[w] == k] for v in own}
            edges += _walked(own, within, lambda w: w, own[int(rng.integers(len(own)))], rng).items()
    for v, w in edges:
        links[v].append(w)
        links[w].append(v)
    parent, order, stack = np.full(len(inside), -1), [], [root]
    while stack:
        v = stack.pop()
        order.append(v)
        for w in links[v]:
            if w != parent[v]:
                parent[w] = v
                stack.append(w)
    return np.array(order), parent


def below(g: Graph, order: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Population below each unit of a tree."""
    total = g.pop.copy()
    for v in order[:0:-1]:
        total[parent[v]] += total[v]
    return total


def _under(order: np.ndarray, parent: np.ndarray, top: int) -> np.ndarray:
    member = np.zeros(len(parent), bool)
    member[top] = True
    for v in order:
        if parent[v] >= 0 and v != order[0] and member[parent[v]]:
            member[v] = True
    return member


def connected(g: Graph, inside: np.ndarray) -> bool:
    units = np.flatnonzero(inside)
    if not len(units):
        return False
    seen, stack = {int(units[0])}, [int(units[0])]
    while stack:
        for w in g.near[stack.pop()]:
            if inside[w] and int(w) not in seen:
                seen.add(int(w))
                stack.append(int(w))
    return len(seen) == len(units)


def _kirchhoff(pairs: list[tuple[int, int]], n: int) -> float:
    """Log number of spanning trees; edges come from both of their ends."""
    return log_tree_count([(a, b) for a, b in pairs if a < b], n) or 0.0


def log_trees(g: Graph, inside: np.ndarray) -> float:
    """Log number of spanning trees of the units inside; with counties, of trees in two levels."""
    part = np.zeros(len(inside), np.int64) - ~inside if g.county is None else county_parts(g, inside)
    part = np.where(inside, part, -1)
    index = np.full(len(inside), -1)
    total, between = 0.0, []
    for k in range(int(part.max()) + 1):
        own = np.flatnonzero(part == k)
        index[own] = np.arange(len(own))
        total += _kirchhoff([(index[v], index[w]) for v in own for w in g.near[v] if part[w] == k], len(own))
        between += [(k, part[w]) for v in own for w in g.near[v] if part[w] >= 0 and part[w] != k]
    return total + _kirchhoff(between, int(part.max()) + 1)


def boundary(g: Graph, plan: np.ndarray, a: int, b: int) -> int:
    return sum(int((plan[g.near[v]] == b).sum()) for v in np.flatnonzero(plan == a))


def _cuts(g: Graph, order: np.ndarray, parent: np.ndarray, inside: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a tree by the unit below: both sides' populations, and whether one side is a district and the other fits."""
    low, _, high = g.bounds
    under, tops = below(g, order, parent), order[1:]
    sizes = np.stack([under[tops], g.pop[inside].sum() - under[tops]])
    fits = (sizes >= low) & (sizes <= high) & (sizes[::-1] >= least) & (sizes[::-1] <= most)
    return tops, sizes, fits


def split(g: Graph, plan: np.ndarray, label: int, k: int, rng: np.random.Generator) -> tuple[np.ndarray | None, int]:
    """A district cut off the unassigned units at one of the k best edges of a random tree, and how many edges would do."""
    target, more = g.bounds[1], g.ndists - label
    rest = plan == 0
    order, parent = spanning_tree(g, rest, rng)
    tops, sizes, fits = _cuts(g, order, parent, rest, g.bounds[0] * more, g.bounds[2] * more)
    valid = int(fits.any(0).sum())
    gap = np.abs(sizes - target)
    pick = np.argsort(gap.min(0), kind="stable")[: min(k, len(tops))]
    if not len(tops) or rng.random() * k >= len(pick):
        return None, valid
    at = int(pick[rng.integers(len(pick))])
    side = int(gap[1, at] < gap[0, at])
    if not fits[side, at]:
        return None, valid
    member = _under(order, parent, int(tops[at]))
    out = plan.copy()
    out[(member if side == 0 else rest & ~member)] = label
    return out, valid


def _enough(counts: np.ndarray, thresh: float) -> int:
    """The least k that covers all valid edges of a share ``thresh`` of the trees, and one more."""
    return int(np.quantile(counts, thresh, method="higher")) + 1 if len(counts) else 1


def _best_k(spark: SparkSession, g: Graph, seed: int, trials: int = 100, thresh: float = 0.99) -> int:
    """How many of a tree's best edges to cut among, from trial trees of the whole map."""
    sent = spark.sparkContext.broadcast(g)

    def count(batches):
        graph = sent.value
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                inside = np.ones(len(graph.pop), bool)
                order, parent = spanning_tree(graph, inside, random_for(seed, i, 999))
                out.append(int(_cuts(graph, order, parent, inside, 0, np.inf)[2].any(0).sum()))
            yield pd.DataFrame({"n": out})

    return _enough(np.array([r["n"] for r in spark.range(trials).mapInPandas(count, "n int").collect()]), thresh)


def kernel(m: PlanMap, g: Graph, penalty) -> Callable[[np.ndarray, int], float] | None:
    """``penalty`` (None, a function of plan and label, or a list of ``Penalty``) as a function for the tasks."""
    if penalty is None or callable(penalty):
        return penalty
    names = sorted({c for p in penalty for c in p.needs})
    rows = m.units.select("unit_id", *names).orderBy("unit_id").collect()  # as many as the graph has
    columns = {c: np.array([r[c] for r in rows]) for c in names}
    for p in penalty:
        columns |= p.given() if p.given else {}
    parts = [(p.strength, p.local) for p in penalty]
    if missing := [p.name for p in penalty if p.local is None]:
        raise ValueError(f"no form for single districts: {missing}")
    return lambda plan, d: float(sum(x * fn(columns, plan == d, plan, g) for x, fn in parts))


def _increment(g: Graph, new: np.ndarray, label: int, compactness: float, penalty) -> float:
    """What a new district adds to a particle's log weight."""
    last = label == g.ndists - 1
    # the chance of this cut, and of this district having been the one drawn last
    more = np.log(boundary(g, new, 0, label))
    drawn = {int(x) for v in np.flatnonzero(new == 0) for x in new[g.near[v]]} - {0}
    more += np.log(len(drawn))
    if compactness != 1:
        more += (1 - compactness) * (log_trees(g, new == label) + (log_trees(g, new == 0) if last else 0.0))
    if penalty is not None:
        more += penalty(new, label) + (penalty(np.where(new == 0, label + 1, new), label + 1) if last else 0.0)
    return float(more)


def _temper(g: Graph, new: np.ndarray, label: int, pop_temper: float) -> float:
    """What population tempering adds: a new district near the target makes a particle likelier until the end."""
    off = abs(g.pop[new == label].sum() - g.bounds[1]) / g.bounds[1]
    return float(pop_temper * np.sqrt(g.ndists - 2) * np.log(1e-12 + off)) if pop_temper else 0.0


@dataclass(frozen=True)
class Run:
    """What sampling gave: plans (chain, draw, plan, wgt), how each step of a chain went, and the
    ancestors of draws: chain, draw, lag (a step) and the particle of that step it stems from."""

    plans: DataFrame
    steps: DataFrame
    ancestors: DataFrame


STEPS = "chain int, step int, k int, n_eff double, accept_rate double, sd_lp double, unique_parents long, n long"
PARTICLE = "id long, parent long, tries long, valid int, plan array<int>, lp double, temper double, ancestors array<long>"


def lags_of(ndists: int) -> list[int]:
    """Steps whose particles are remembered as ancestors: few, and early ones."""
    return [1 + x for x in sorted({round((ndists - 1) ** 0.8 * x**0.9) for x in (0, 0.7 / 3, 1.4 / 3, 0.7)})]


def _shuffled(m: int, rng: np.random.Generator) -> tuple[int, int]:
    """a and b of a permutation x -> (a * x + b) mod m."""
    a = int(rng.integers(1, m)) if m > 1 else 1
    while math.gcd(a, m) > 1:
        a = a % m + 1
    return a, int(rng.integers(m))


def _candidates(parents: DataFrame, found: DataFrame | None, n: int, first: int, tries: int, seed: int, label: int) -> DataFrame:
    """``tries`` candidates for each particle that has none: a parent in proportion to its weight, drawn anew each time.

    An attempt draws n parents by one low-variance resample, and deals them to the particles in
    an order of its own, so that who failed draws again from all parents.
    """
    dealt = []
    for t in range(first, first + tries):
        rng = random_for(seed, 20_000 + label, t)
        a, b = _shuffled(n, rng)
        dealt.append((t, a, b, rng.random()))
    attempts = parents.sparkSession.createDataFrame(dealt, "attempt long, a long, b long, offset double")
    drawn = parents.crossJoin(F.broadcast(attempts)).withColumn("pick", F.explode(picks(n, F.col("offset"))))
    slot = F.pmod(F.col("a") * F.col("pick") + F.col("b"), F.lit(n))
    drawn = drawn.select(slot.alias("id"), "attempt", F.col("id").alias("parent"), "plan", "lp", "temper", "ancestors")
    return drawn if found is None else drawn.join(small(found.select("id")), "id", "left_anti")


def _generation(spark, sent, parents: DataFrame, n: int, label: int, k: int, seed: int, compactness: float, penalty, pop_temper: float, tries: int, at: Column, adapt_k: float) -> tuple[DataFrame, dict]:
    """The next particles, each of which redraws its parent until a cut is valid, and how it went.

    Candidates meet by particle, in the order of attempts, and a task stops at the first valid
    one. Particles without any go to a further round, with more attempts.
    """

    def cut(batches):
        g, done = sent.value, None
        for pdf in batches:
            out = []
            for i, a, q, p, lp, temper, ancestors in zip(*(pdf[c] for c in ("id", "attempt", "parent", "plan", "lp", "temper", "ancestors")), strict=True):
                if i == done:
                    continue
                new, valid = split(g, np.asarray(p), label, k, random_for(seed, label, i, a))
                if new is not None:
                    done, more = i, _temper(g, new, label, pop_temper)
                    out.append((i, q, a + 1, valid, new.tolist(), lp + _increment(g, new, label, compactness, penalty) + more, temper + more, ancestors))
            yield pd.DataFrame(out, columns=["id", "parent", "tries", "valid", "plan", "lp", "temper", "ancestors"])

    m, first, found = n, 0, None
    while True:
        # enough tasks for the cores, and not too many particles in one
        parts = max(1, min(-(-m // 8), max(spark.sparkContext.defaultParallelism, -(-m // 5_000))))
        drawn = _candidates(parents, found, n, first, tries, seed, label).repartition(parts, "id").sortWithinPartitions("id", "attempt")
        won = shared_table(drawn.mapInPandas(cut, PARTICLE))
        found = won if found is None else found.union(won)
        told = found.agg(F.count(F.lit(1)).alias("count"), F.min(at).alias("least"), (F.count(F.lit(1)) / F.sum("tries")).alias("accept_rate"), F.stddev_pop("lp").alias("sd_lp"), F.percentile("valid", adapt_k).alias("valid")).first().asDict()
        m = n - told["count"]
        if not m:
            return found, told
        first += tries
        if first > MOST_TRIES:
            raise ValueError("no valid split found: the bounds may be too tight")
        tries = min(2 * tries, 64)


def smc_run(m: PlanMap, nsims: int, seed: int = 1, compactness: float = 1.0, seq_alpha: float = 0.5, penalty=None, resample: bool = True, counties: str | None = None, runs: int = 1, truncate: Callable[[DataFrame], DataFrame] | None = None, adapt_k: float = 0.99, steps: int | None = None, pop_temper: float = 0.0, final_infl: float = 1.0, start: DataFrame | None = None) -> Run:
    """Sequential Monte Carlo: ``runs`` independent chains of ``nsims`` draws.

    Every step splits one district off each particle; an attempt that fails redraws its
    parent. ``penalty`` adds Gibbs terms for each new district (a list of ``Penalty`` or a
    function of plan and label). ``truncate`` maps the last weights (draw, wgt) before
    resampling, which has low variance. ``steps`` below the number of districts less one leaves
    partial plans, whose units without a district have label 0, and ``start`` (draw from 1 to
    ``nsims``, plan) takes such plans up again. Weights count in full at the run's last step,
    whose bounds are widened by ``final_infl``; before it, a share ``seq_alpha`` is resampled at
    each step. ``pop_temper`` changes how likely particles with districts near the target are on
    the way (``_temper``); the weights given back are
    free of it. The number of edges to cut among adapts to the valid edges of a share
    ``adapt_k`` of the trees met in the step before.

    Particles are rows of tables in the shared folder; the same seed gives the same draws
    whatever their number of partitions.
    """
    spark = m.units.sparkSession
    g = graph_of(m, counties)
    local = kernel(m, g, penalty)
    sent = spark.sparkContext.broadcast(g)
    first_k = _best_k(spark, g, seed, thresh=adapt_k)
    drawn = 0
    if start is not None:
        found = start.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("plan")).alias("d")).first()
        if found["n"] != nsims:
            raise ValueError(f"{nsims} plans are needed to start from, not {found['n']}")
        drawn = found["d"]
    upto = g.ndists - 1 if steps is None else min(drawn + steps, g.ndists - 1)
    low, target, high = g.bounds
    wide = spark.sparkContext.broadcast(replace(g, bounds=(target - (target - low) * final_infl, target, target + (high - target) * final_infl))) if final_infl != 1 else sent
    lags = lags_of(g.ndists)
    begun = start.select((F.col("draw") - 1).cast("long").alias("id"), "plan") if start is not None else spark.range(nsims).withColumn("plan", F.array_repeat(F.lit(0), len(g.pop)))
    small_plans = nsims * len(g.pop) <= 1_000_000
    whole, origins, told = None, None, None
    for chain in range(1, runs + 1):
        own, k, tries = seed + 7_919 * (chain - 1), first_k, 24 if small_plans else 8
        parents = cumulative(begun.select("id", "plan", F.lit(0.0).alias("lp"), F.lit(0.0).alias("temper"), F.array_repeat(F.col("id"), len(lags)).alias("ancestors"), F.lit(1.0).alias("w")), n=nsims)
        for label in range(drawn + 1, upto + 1):
            final = label == upto
            at = F.col("lp") - F.col("temper") if final else seq_alpha * F.col("lp")
            found, r = _generation(spark, wide if final else sent, parents, nsims, label, k, own, compactness, local, pop_temper, tries, at, adapt_k)
            stems = F.array(*[F.col("id") if label <= lag else F.col("ancestors")[j] for j, lag in enumerate(lags)])
            w = F.exp(F.lit(r["least"]) - at)
            left = found.select("id", "plan", "lp" if final else (F.col("lp") * (1 - seq_alpha)).alias("lp"), "temper", stems.alias("ancestors"), w.alias("w"))
            parents = left if final else cumulative(left, n=nsims)
            spread = found.agg((F.sum(w) ** 2 / F.sum(w * w)).alias("n_eff"), F.countDistinct("parent").alias("unique_parents"))
            step = spread.select(F.lit(chain).alias("chain"), F.lit(label).alias("step"), F.lit(k).alias("k"), "n_eff", F.lit(r["accept_rate"]).alias("accept_rate"), F.lit(r["sd_lp"]).alias("sd_lp"), "unique_parents", F.lit(nsims).cast("long").alias("n"))
            told = step if told is None else told.union(step)
            # enough attempts for most particles; how many make a round changes no draw
            k, tries = int(np.ceil(r["valid"])) + 1, int(min(max(np.ceil((6 if small_plans else 2) / r["accept_rate"]), 4), 64))
        rest = F.transform("plan", lambda d: F.when(d == 0, g.ndists).otherwise(d)) if upto == g.ndists - 1 else F.col("plan")
        done = parents.select("id", rest.alias("plan"), "w", "ancestors")
        if truncate is not None:
            cut = truncate(done.select((F.col("id") + 1).alias("draw"), F.col("w").alias("wgt")))
            done = done.drop("w").join(cut.select((F.col("draw") - 1).alias("id"), F.col("wgt").alias("w")), "id")
        if resample:
            done = low_variance(done, nsims, random_for(own, 10_000).random(), keys_below=nsims).select(F.col("pick").alias("id"), "plan", F.lit(1.0).alias("w"), "ancestors")
        done = done.select(F.lit(chain).alias("chain"), (F.col("id") + 1 + (chain - 1) * nsims).cast("int").alias("draw"), "plan", F.col("w").alias("wgt"), "ancestors")
        stem = done.select("chain", "draw", F.explode(F.arrays_zip(F.array(*map(F.lit, lags)).alias("lag"), F.col("ancestors").alias("ancestor"))).alias("s")).select("chain", "draw", "s.lag", "s.ancestor")
        whole = done if whole is None else whole.union(done)
        origins = stem if origins is None else origins.union(stem)
    return Run(whole.drop("ancestors"), told if told is not None else spark.createDataFrame([], STEPS), origins)


def smc(m: PlanMap, nsims: int, seed: int = 1, compactness: float = 1.0, seq_alpha: float = 0.5, penalty=None, resample: bool = True, counties: str | None = None, **more) -> DataFrame:
    """draw, plan, wgt of ``smc_run``."""
    return smc_run(m, nsims, seed, compactness, seq_alpha, penalty, resample, counties, **more).plans.drop("chain")


def recombine(g: Graph, plan: np.ndarray, k: int, compactness: float, penalty, rng: np.random.Generator) -> np.ndarray:
    """One merge-split step: redraw the border of two neighbouring districts, then accept or stay."""
    low, target, high = g.bounds

    def pairs(p: np.ndarray) -> dict[int, set[int]]:
        out: dict[int, set[int]] = {d: set() for d in range(1, g.ndists + 1)}
        for v, ways in enumerate(g.near):
            out[int(p[v])] |= {int(x) for x in p[ways]} - {int(p[v])}
        return out

    near = pairs(plan)
    a = int(rng.integers(1, g.ndists + 1))
    if not near[a]:
        return plan
    b = sorted(near[a])[int(rng.integers(len(near[a])))]
    both = (plan == a) | (plan == b)
    order, parent = spanning_tree(g, both, rng)
    under, total = below(g, order, parent), g.pop[both].sum()
    tops = order[1:]
    gap = np.minimum(np.abs(under[tops] - target), np.abs(total - under[tops] - target))
    pick = np.argsort(gap, kind="stable")[: min(k, len(tops))]
    if rng.random() * k >= len(pick):
        return plan
    top = int(tops[pick[rng.integers(len(pick))]])
    if not (low <= under[top] <= high and low <= total - under[top] <= high):
        return plan
    member = _under(order, parent, top)
    new = plan.copy()
    first, second = (a, b) if rng.random() < 0.5 else (b, a)
    new[member], new[both & ~member] = first, second
    far = pairs(new)
    log = np.log(boundary(g, plan, a, b)) - np.log(boundary(g, new, a, b))
    log += np.log(1 / len(far[a]) + 1 / len(far[b])) - np.log(1 / len(near[a]) + 1 / len(near[b]))
    if compactness != 1:
        log += (1 - compactness) * sum(log_trees(g, plan == d) - log_trees(g, new == d) for d in (a, b))
    if penalty is not None:
        log += sum(penalty(plan, d) - penalty(new, d) for d in (a, b))
    return new if np.log(rng.random()) <= log else plan


def flip(g: Graph, plan: np.ndarray, beta: float, energy, rng: np.random.Generator) -> np.ndarray:
    """One boundary flip that keeps bounds and contiguity, accepted by exp(-beta * change of energy)."""
    edge = [v for v, ways in enumerate(g.near) if (plan[ways] != plan[v]).any()]
    v = edge[int(rng.integers(len(edge)))]
    to = sorted({int(x) for x in plan[g.near[v]]} - {int(plan[v])})
    new = plan.copy()
    new[v] = to[int(rng.integers(len(to)))]
    for d in (int(plan[v]), int(new[v])):
        inside = new == d
        if not (g.bounds[0] <= g.pop[inside].sum() <= g.bounds[2] and connected(g, inside)):
            return plan
    back = [w for w, ways in enumerate(g.near) if (new[ways] != new[w]).any()]
    ways_back = len({int(x) for x in new[g.near[v]]} - {int(new[v])})
    log = np.log(len(edge) * len(to)) - np.log(len(back) * ways_back)
    if energy is not None:
        log -= beta * (energy(new) - energy(plan))
    return new if np.log(rng.random()) <= log else plan


def flip_components(g: Graph, plan: np.ndarray, beta: float, energy, rng: np.random.Generator, eprob: float = 0.05, lam: float = 0.0) -> np.ndarray:
    """One Swendsen-Wang step: edges within districts stay with chance ``eprob``; some boundary components move.

    1 + Poisson(``lam``) components that don't touch each other go to a neighbouring district
    each. The step is refused if bounds or contiguity break; else it is accepted by the ratio
    of boundary components, of the edges that had to be off, and of the energies.
    """
    n = len(plan)
    label = np.arange(n)

    def top(v: int) -> int:
        while label[v] != v:
            label[v] = label[label[v]]
            v = int(label[v])
        return v

    for v in range(n):
        for w in g.near[v].tolist():
            if v < w and plan[v] == plan[w] and rng.random() < eprob:
                label[top(v)] = top(w)
    root = np.array([top(v) for v in range(n)])
    edge = lambda p: sorted({int(root[v]) for v in range(n) if (p[g.near[v]] != p[v]).any()})
    border, want = edge(plan), 1 + int(rng.poisson(lam))
    taken: list[int] = []
    touched: set[int] = set()
    for c in (border[i] for i in rng.permutation(len(border))):
        if len(taken) == want:
            break
        around = {int(root[w]) for v in np.flatnonzero(root == c) for w in g.near[v]}
        if not around & set(taken) and c not in touched:
            taken.append(c)
            touched |= around
    if len(taken) < want:
        return plan
    new, log = plan.copy(), 0.0
    for c in taken:
        inside = root == c
        was = int(plan[c])
        beside = [int(plan[w]) for v in np.flatnonzero(inside) for w in g.near[v] if not inside[w]]
        to = sorted(set(beside) - {was})
        own = to[int(rng.integers(len(to)))]
        new[inside] = own
        # chances that the component's outer edges are off: before to its old, after to its new district
        log += (beside.count(own) - beside.count(was)) * np.log1p(-eprob)
        log += np.log(len(to)) - np.log(max(1, len(set(beside) - {own})))
    for d in {int(plan[c]) for c in taken} | {int(new[c]) for c in taken}:
        inside = new == d
        if not (g.bounds[0] <= g.pop[inside].sum() <= g.bounds[2] and connected(g, inside)):
            return plan
    log += want * (np.log(len(border)) - np.log(len(edge(new))))
    if energy is not None:
        log -= beta * (energy(new) - energy(plan))
    return new if np.log(rng.random()) <= log else plan


def chains(m: PlanMap, starts: DataFrame, nsims: int, step: str = "mergesplit", seed: int = 1, warmup: int = 0, thin: int = 1, compactness: float = 1.0, penalty=None, energy=None, beta=lambda t: 1.0, per_round: int = 200, counties: str | None = None, k: int | None = None, accepted: bool = False, eprob: float = 0.05, lam: float = 0.0) -> DataFrame:
    """Markov chains from ``starts`` (chain, plan): chain, draw, plan; with ``accepted``, also whether the step moved.

    Chains are rows; a round advances each by ``per_round`` steps and leaves a table, so a
    lost executor costs one round. ``beta`` of the step number gives tempering schedules.
    """
    spark = m.units.sparkSession
    g = graph_of(m, counties)
    k = k or (_best_k(spark, g, seed) if step == "mergesplit" else 0)
    local = kernel(m, g, penalty)
    if energy is None and step == "flip" and local is not None:
        energy = lambda plan: sum(local(plan, d) for d in range(1, g.ndists + 1))
    sent = spark.sparkContext.broadcast(g)
    state, kept = starts.select("chain", F.lit(0).alias("t"), "plan"), None
    for start in range(0, nsims, per_round):

        def advance(batches, start=start):
            graph = sent.value
            for pdf in batches:
                out = []
                for c, p in zip(pdf["chain"], pdf["plan"]):
                    plan = np.asarray(p)
                    for t in range(start + 1, min(start + per_round, nsims) + 1):
                        rng = random_for(seed, 7, c, t)
                        was = plan
                        if step == "mergesplit":
                            plan = recombine(graph, plan, k, compactness, local, rng)
                        elif step == "components":
                            plan = flip_components(graph, plan, beta(t), energy, rng, eprob, lam)
                        else:
                            plan = flip(graph, plan, beta(t), energy, rng)
                        if t > warmup and (t - warmup - 1) % thin == 0 or t in (start + per_round, nsims):
                            out.append((c, t, plan.tolist(), plan is not was))
                yield pd.DataFrame(out, columns=["chain", "t", "plan", "moved"])

        last = min(start + per_round, nsims)
        done = shared_table(state.repartition("chain").mapInPandas(advance, "chain int, t int, plan array<int>, moved boolean"))
        state = done.filter(F.col("t") == last)
        kept = done if kept is None else kept.union(done)
    return kept.filter((F.col("t") > warmup) & ((F.col("t") - warmup - 1) % thin == 0)).select("chain", F.col("t").alias("draw"), "plan", *(["moved"] if accepted else []))


def acceptance(moves: DataFrame) -> DataFrame:
    """Share of steps that moved, by chain (of ``chains`` with ``accepted``)."""
    return moves.groupBy("chain").agg(F.avg(F.col("moved").cast("int")).alias("rate"))


def annealing(hot: int, cooling: int, cold: int):
    """beta by step: 0 while hot, rising in proportion while cooling, then 1."""
    del cold
    return lambda t: 0.0 if t <= hot else min(1.0, (t - hot) / cooling)


def short_bursts(m: PlanMap, start: DataFrame, score, bursts: int, burst_size: int = 10, maximize: bool = True, seed: int = 1, width: int = 4) -> DataFrame:
    """burst, score, plan: each burst runs ``width`` short chains from the best plan so far and keeps the best.

    ``score`` maps assignments (draw, unit_id, district) to (draw, score).
    """
    best = start.select("plan")
    rows = None
    order = F.col("score").desc() if maximize else F.col("score").asc()
    for b in range(bursts):
        runs = m.units.sparkSession.range(width).select((F.col("id") + 1).cast("int").alias("chain")).crossJoin(F.broadcast(best))
        drawn = chains(m, runs, burst_size, seed=seed * 1_000 + b).select((F.col("chain") * 1_000_000 + F.col("draw")).alias("draw"), "plan")
        every = shared_table(drawn.union(best.select(F.lit(0).alias("draw"), "plan")))
        scored = score(every.select("draw", F.posexplode("plan").alias("unit_id", "district")))
        top = shared_table(every.join(scored, "draw").orderBy(order, "draw").limit(1).select(F.lit(b + 1).alias("burst"), "score", "plan"))
        best = top.select("plan")
        rows = top if rows is None else rows.union(top)
    return rows
