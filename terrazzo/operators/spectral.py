"""Leading eigenvectors of symmetric operators that are never formed as matrices.

A vector is a table with a row a node; the operator is a function from such a table to another,
made of joins and keyed sums. Lanczos rounds keep the vectors so far as an array in each node's
row, orthogonal to one another; the driver holds the few inner products of a round. Several
independent operators (keyed by ``grp``) go through the same rounds. Each round is one table in
the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from .sizes import small

ROUNDS, ENOUGH = 80, 1e-8


class _Group:
    """The tridiagonal form of one group's operator so far."""

    def __init__(self) -> None:
        self.alpha: list[float] = []
        self.beta: list[float] = []
        self.done = False

    def extremes(self, high: int, low: int) -> list[tuple[float, np.ndarray]]:
        n = len(self.alpha)
        t = np.diag(self.alpha) + np.diag(self.beta[: n - 1], 1) + np.diag(self.beta[: n - 1], -1)
        value, vector = np.linalg.eigh(t)
        at = [n - 1 - k for k in range(min(high, n))] + list(range(min(low, n)))
        return [(float(value[k]), vector[:, k]) for k in at]

    def add(self, alpha: float, beta: float, high: int, low: int) -> None:
        self.alpha.append(alpha)
        self.beta.append(beta)
        told = self.extremes(high, low)
        scale = max(max(abs(x) for x in self.alpha + self.beta), 1e-300)
        self.done = beta <= 1e-7 * scale or (len(self.alpha) > high + low and all(beta * abs(v[-1]) <= ENOUGH * scale for _, v in told))


def _dot(q: Column, h: Column) -> Column:
    return F.aggregate(F.zip_with(q, h, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def _of_group(values: dict[str, list[float]]) -> Column:
    """The array of a row's group, as a literal: a table would be a job and a join a round."""
    return F.coalesce(*[F.when(F.col("grp") == F.lit(g), F.expr(f"array({', '.join(f'{x!r}D' for x in map(float, own))})")) for g, own in values.items()])


def _products(own: DataFrame, k: int) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """By group: products of w, and of the last vector, with all vectors, and of w with itself.

    Tasks add up their rows; the driver adds a row a group and task.
    """

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for g, rows in pdf.groupby("grp"):
                q, w = np.stack(rows["q"].to_numpy()), rows["w"].to_numpy()
                sums[g] = sums.get(g, 0.0) + np.concatenate([w @ q, q[:, -1] @ q, [w @ w]])
        if sums:
            yield pd.DataFrame({"grp": list(sums), "s": list(sums.values())})

    out: dict[str, np.ndarray] = {}
    for r in own.select("grp", "q", "w").mapInPandas(add, "grp string, s array<double>").collect():
        out[r["grp"]] = out.get(r["grp"], 0.0) + np.array(r["s"])
    return {g: (s[:k], s[k : 2 * k], float(s[-1])) for g, s in out.items()}


def leading(nodes: DataFrame, apply: Callable[[DataFrame], DataFrame], high: int = 1, low: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """grp, place, eigenvalue, node, value: unit eigenvectors of the ``high`` largest and ``low`` smallest eigenvalues.

    ``nodes`` has (grp string, node long); ``apply`` maps (grp, node, x) to (grp, node, w), nodes
    without a row being 0. Further columns of ``nodes`` go along with their node: then ``apply``
    gets whole rows with x and adds w to them, and no round joins nodes. Places count from 1 at the largest, and from -1 at the smallest.
    The entry of largest size is positive (ties, to nine digits: the first node).
    """
    spark = nodes.sparkSession
    start = (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) + 1).cast("double") / (1 << 20) - 0.4
    further = [c for c in nodes.columns if c not in ("grp", "node")]
    first = shared_table(nodes.select("grp", "node", start.alias("x"), *further))
    size = {r["grp"]: r for r in first.groupBy("grp").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    if not size:
        return spark.createDataFrame([], "grp string, place int, eigenvalue double, node long, value double")
    groups = {g: _Group() for g in size}
    scale = F.get(_of_group({g: [r["s"]] for g, r in size.items()}), F.lit(0))
    now = first.select("grp", "node", F.array(F.col("x") / scale).alias("q"), *further)
    grams = {g: np.zeros((0, 0)) for g in size}
    for k in range(1, rounds + 1):
        last_of = F.element_at("q", -1).alias("x")
        if further:
            applied = apply(now.select("*", last_of))
        else:
            applied = now.join(apply(now.select("grp", "node", last_of)), ["grp", "node"], "left")
        own = shared_table(applied.select("grp", "node", "q", F.coalesce("w", F.lit(0.0)).alias("w"), *further))
        told = {}
        for g, (h, last, square) in _products(own, k).items():
            gram = grams[g] = np.block([[grams[g], last[:-1, None]], [last[None, :]]])
            # what rounding leaves along the earlier vectors goes in a second step, told by their products
            c = h + (h - gram @ h)
            beta = float(np.sqrt(max(square - 2 * c @ h + c @ gram @ c, 0.0)))
            if not groups[g].done:
                groups[g].add(float(c[-1]), beta, high, low)
                groups[g].done |= k >= size[g]["n"]
            told[g] = [*c, 0.0 if groups[g].done or not beta else 1 / beta]
        if all(g.done for g in groups.values()) or k == rounds:
            break
        back, scale = _of_group({g: h[:k] for g, h in told.items()}), F.get(_of_group({g: h[k:] for g, h in told.items()}), F.lit(0))
        now = own.select("grp", "node", F.concat("q", F.array((F.col("w") - _dot(F.col("q"), back)) * scale)).alias("q"), *further)
    mixes = []
    for g, own_group in groups.items():
        for at, (value, mix) in enumerate(own_group.extremes(high, low)):
            place = at + 1 if at < min(high, len(own_group.alpha)) else min(high, len(own_group.alpha)) - at - 1
            mixes.append((g, place, value, [float(x) for x in mix] + [0.0] * (k - len(mix))))
    mixed = own.join(small(spark.createDataFrame(mixes, "grp string, place int, eigenvalue double, mix array<double>")), "grp").select("grp", "place", "eigenvalue", "node", _dot(F.col("q"), F.col("mix")).alias("value"))
    sign = F.max_by(F.signum("value"), F.struct(F.round(F.abs("value"), 9), -F.col("node")))
    turned = mixed.groupBy("grp", "place").agg(sign.alias("sign"))
    return mixed.join(small(turned), ["grp", "place"]).select("grp", "place", "eigenvalue", "node", (F.col("value") * F.when(F.col("sign") < 0, -1.0).otherwise(1.0)).alias("value"))
