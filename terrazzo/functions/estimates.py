"""Estimates over weighted draws and chains: truncation, intervals, R-hat, diagnostics."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizes import small
from ..sources.shared import shared_table


def truncated(draws: DataFrame, column: str = "wgt") -> DataFrame:
    """Weights cut at their quantile 1 - n^(-1/2)."""
    n = draws.count()
    if not n:
        return draws
    top = draws.agg(F.percentile(column, 1 - n**-0.5).alias("top"))
    return draws.crossJoin(F.broadcast(top)).withColumn(column, F.least(column, "top")).drop("top")


def effective_size(draws: DataFrame, column: str = "wgt") -> DataFrame:
    return draws.agg((F.pow(F.sum(column), 2) / F.sum(F.col(column) * F.col(column))).alias("n_eff"))


def weighted_interval(draws: DataFrame, column: str, weight: str = "wgt", conf: float = 0.99) -> DataFrame:
    """Weighted mean and normal interval of an importance sample."""
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    own = draws.agg(F.sum(F.col(weight) * F.col(column)).alias("a"), F.sum(weight).alias("b"), F.sum(F.col(weight) ** 2 * F.col(column) ** 2).alias("c"), F.sum(F.col(weight) ** 2 * F.col(column)).alias("d"), F.sum(F.col(weight) ** 2).alias("e"))
    mean = F.col("a") / F.col("b")
    sd = F.sqrt(F.greatest(F.col("c") - 2 * mean * F.col("d") + mean * mean * F.col("e"), F.lit(0.0))) / F.col("b")
    return own.select(mean.alias("estimate"), sd.alias("se"), (mean - z * sd).alias("low"), (mean + z * sd).alias("high"))


def interval_by_runs(draws: DataFrame, column: str, conf: float = 0.9) -> DataFrame:
    """Mean over runs and normal interval from the spread of run means."""
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    runs = draws.groupBy("chain").agg(F.avg(column).alias("m"))
    se = F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))
    return runs.agg(F.avg("m").alias("estimate"), se.alias("se")).select("estimate", "se", (F.col("estimate") - z * F.col("se")).alias("low"), (F.col("estimate") + z * F.col("se")).alias("high"))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda x: None if pd.isna(x) else inverse(min(max(x, 1e-12), 1 - 1e-12)))


def average_ranks(draws: DataFrame, column: str) -> DataFrame:
    """Ranks of values, ties shared: the distinct values are ranked, not the rows.

    Distinct values are sorted into ranges of about equal counts, whose splitters Spark samples;
    rows of the ranges before (a row a range) and ranks within a range add up. However skewed
    or clustered the values are, no range holds more than its share of distinct ones.
    """
    # written once: a range sort reads its input twice (once for a sample), and ranks join it again
    draws = shared_table(draws)
    values = draws.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # written once, so that ranges stay as they are
    dealt = shared_table(values.repartitionByRange(column).select(column, "n", F.spark_partition_id().alias("_range")))
    sums = dealt.groupBy("_range").agg(F.sum("n").alias("s")).select("_range", (F.sum("s").over(W.orderBy("_range")) - F.col("s")).alias("_before"))
    within = F.sum("n").over(W.partitionBy("_range").orderBy(column)) - F.col("n")
    ranks = dealt.withColumn("_within", within).join(small(sums), "_range")
    return draws.join(ranks.select(column, (F.col("_before") + F.col("_within") + (F.col("n") + 1) / 2).alias("rank")), column)


def _scale_reduction(draws: DataFrame, column: str) -> DataFrame:
    by = draws.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v"))
    n = F.avg("n")
    return by.agg(F.sqrt((n * F.var_samp("m") / F.avg("v") + n - 1) / n).alias("rhat"))


def rhat(draws: DataFrame, column: str) -> DataFrame:
    """Rank-normalised R-hat (chain, column): the larger of bulk and folded."""
    total = draws.count()
    middle = draws.agg(F.percentile(column, 0.5).alias("mid"))
    folded = draws.crossJoin(F.broadcast(middle)).withColumn(column, F.abs(F.col(column) - F.col("mid"))).drop("mid")
    parts = [_scale_reduction(average_ranks(d, column).withColumn("z", normal_quantile(F.col("rank") / (total + 1))), "z") for d in (draws, folded)]
    return parts[0].union(parts[1]).agg(F.max("rhat").alias("rhat"))


def autocorrelation(draws: DataFrame, column: str, lags: int) -> DataFrame:
    """Autocorrelation of each chain up to ``lags``, by lagged equi-joins."""
    base = draws.select("chain", "draw", (F.col(column) - F.avg(column).over(W.partitionBy("chain"))).alias("x"))
    scale = base.groupBy("chain").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    ahead = base.select("chain", F.col("x").alias("y"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda k: F.struct((F.col("draw") - k).alias("draw"), k.alias("lag")))).alias("t")).select("chain", "y", "t.draw", "t.lag")
    return base.join(ahead, ["chain", "draw"]).groupBy("chain", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("c")).join(scale, "chain").select("chain", "lag", F.try_divide("c", "s").alias("acf"))


def histogram(draws: DataFrame, column: str, bins: int) -> DataFrame:
    """Share of draws in even bins between the least and the largest value."""
    ends = draws.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(F.lit(1)).alias("n"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(column) - F.col("a"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return draws.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg((F.count(F.lit(1)) / F.max("n")).alias("share"))


def split_chains(draws: DataFrame) -> DataFrame:
    """Each chain as two: its first and its second half (a middle draw goes to the first)."""
    place, n = F.row_number().over(W.partitionBy("chain").orderBy("draw")), F.count(F.lit(1)).over(W.partitionBy("chain"))
    return draws.withColumn("chain", F.when(place <= (n + 1) / 2, F.col("chain") * 2 - 1).otherwise(F.col("chain") * 2))


def interval_by_ancestors(draws: DataFrame, column: str, ancestor: str = "ancestor", conf: float = 0.9) -> DataFrame:
    """Mean of one run and its error from residuals summed by ancestor: draws of one ancestor are not independent."""
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    whole = draws.agg(F.avg(column).alias("estimate"), F.count(F.lit(1)).alias("n"))
    sums = draws.crossJoin(F.broadcast(whole)).groupBy(ancestor).agg(F.sum(F.col(column) - F.col("estimate")).alias("r"), F.max("estimate").alias("estimate"), F.max("n").alias("n"))
    own = sums.agg(F.max("estimate").alias("estimate"), (F.sqrt(F.sum(F.col("r") ** 2)) / F.max("n")).alias("se"))
    return own.select("estimate", "se", (F.col("estimate") - z * F.col("se")).alias("low"), (F.col("estimate") + z * F.col("se")).alias("high"))


def diversity_flags(pairs: DataFrame) -> DataFrame:
    """low, high, mean, is_low: the middle 80 % of plan diversity; low if the mean is 0.35 or less or over 10 % are 0.25 or less."""
    told = pairs.agg(F.percentile("diversity", 0.1).alias("low"), F.percentile("diversity", 0.9).alias("high"), F.avg("diversity").alias("mean"), F.avg((F.col("diversity") <= 0.25).cast("int")).alias("few"))
    return told.select("low", "high", "mean", ((F.col("mean") <= 0.35) | (F.col("few") > 0.1)).alias("is_low"))


def step_flags(steps: DataFrame) -> DataFrame:
    """Steps of a sampler's run with ``bottleneck``: fewer effective or surviving particles than 5 % of n, or than the lesser of 40 % of n and 100."""
    least = F.greatest(0.05 * F.col("n"), F.least(0.4 * F.col("n"), F.lit(100.0)))
    return steps.withColumn("bottleneck", F.least(F.col("n_eff"), F.col("unique_parents").cast("double")) < least)


def rhats(stats: DataFrame, columns: list[str], split: bool = False) -> DataFrame:
    """column, rhat: of each statistic (chain, draw, columns)."""
    own = split_chains(stats) if split else stats
    parts = [rhat(own.select("chain", "draw", c), c).select(F.lit(c).alias("column"), "rhat") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def false_discovery(p_values: DataFrame, key: str, p: str = "p") -> DataFrame:
    """key, p, q: positive false discovery rates, with the share of true nulls from p-values above one half.

    q of a p-value is the least of share * n * p' / #(p <= p') over p' at or above it.
    """
    whole = p_values.agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.avg((F.col(p) > 0.5).cast("double")) / 0.5).alias("nulls"))
    values = p_values.groupBy(p).agg(F.count(F.lit(1)).alias("c"))
    # distinct p-values are at most the draws plus one
    upto = values.withColumn("k", F.sum("c").over(W.orderBy(p)))
    rate = upto.crossJoin(F.broadcast(whole)).withColumn("r", F.least(F.lit(1.0), F.col("nulls") * F.col("n") * F.col(p) / F.col("k")))
    q = rate.select(p, F.min("r").over(W.orderBy(p).rowsBetween(W.currentRow, W.unboundedFollowing)).alias("q"))
    return p_values.join(q, p).select(key, p, "q")


def interval_of_chains(draws: DataFrame, column: str, lags: int, conf: float = 0.9) -> DataFrame:
    """Mean over Markov chains and its error from each chain's long-run variance.

    The variance of a chain's mean is its own times 1 + 2 sum (1 - k / (lags + 1)) acf(k), over n.
    """
    z = NormalDist().inv_cdf(0.5 + conf / 2)
    acf = autocorrelation(draws, column, lags).filter("lag > 0").groupBy("chain").agg(F.sum((1 - F.col("lag") / (lags + 1)) * F.col("acf")).alias("s"))
    by = draws.groupBy("chain").agg(F.avg(column).alias("m"), F.var_pop(column).alias("v"), F.count(F.lit(1)).alias("n")).join(acf, "chain", "left")
    own = by.select("m", "n", (F.col("v") * F.greatest(1 + 2 * F.coalesce("s", F.lit(0.0)), F.lit(0.0)) / F.col("n")).alias("e"))
    whole = own.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("estimate"), (F.sqrt(F.sum(F.col("e") * F.col("n") * F.col("n"))) / F.sum("n")).alias("se"))
    return whole.select("estimate", "se", (F.col("estimate") - z * F.col("se")).alias("low"), (F.col("estimate") + z * F.col("se")).alias("high"))


def student_quantile(p: float, df: float) -> float:
    """Quantile of Student's t distribution: its density integrated by Simpson's rule, and bisection."""
    if p < 0.5:
        return -student_quantile(1 - p, df)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(t: float, n: int = 2_000) -> float:
        h = t / n
        f = [(1 + (k * h) ** 2 / df) ** (-(df + 1) / 2) for k in range(n + 1)]
        return 0.5 + scale * h / 3 * (f[0] + f[-1] + 4 * sum(f[1::2]) + 2 * sum(f[2:-1:2]))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def _interval(estimate: float, se: float, n: int, conf: float, spark) -> DataFrame:
    t = student_quantile(0.5 + conf / 2, n - 1) if n > 1 else float("nan")
    return spark.createDataFrame([(estimate, se, estimate - t * se, estimate + t * se)], "estimate double, se double, low double, high double")


def interval_by_lags(draws: DataFrame, ancestors: DataFrame, column: str, conf: float = 0.9) -> DataFrame:
    """Interval of one run of sequential Monte Carlo: estimate, se, low, high.

    ``draws`` has (draw, column), ``ancestors`` (draw, lag, ancestor) as ``sampling.smc_run``
    returns them. Draws of one ancestor are not independent: at each lag residuals are summed by
    ancestor, and the error is the root of the mean over draws of their ancestor's squared sum,
    over n. The 75th percentile over lags counts.
    """
    whole = draws.agg(F.avg(column).alias("estimate"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        raise ValueError("no draws")
    residual = draws.select("draw", (F.col(column) - whole["estimate"]).alias("r"))
    sums = ancestors.join(residual, "draw").groupBy("lag", "ancestor").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("c"))
    errors = sums.groupBy("lag").agg((F.sqrt(F.sum(F.col("c") * F.col("s") * F.col("s"))) / whole["n"]).alias("e"))
    return _interval(whole["estimate"], errors.agg(F.percentile("e", 0.75).alias("e")).first()["e"], whole["n"], conf, draws.sparkSession)


def interval_of_runs(draws: DataFrame, column: str, conf: float = 0.9, by_chain: bool = False) -> DataFrame:
    """Interval of several runs: the spread of their means over the root of one less than the runs (of one run, if ``by_chain``)."""
    whole = draws.agg(F.avg(column).alias("estimate"), F.count(F.lit(1)).alias("n")).first()
    spread = draws.groupBy("chain").agg(F.avg(column).alias("m")).agg(F.stddev_samp("m").alias("s"), F.count(F.lit(1)).alias("k")).first()
    if spread["k"] < 2:
        raise ValueError("one run has no spread: see interval_by_lags")
    se = spread["s"] if by_chain else spread["s"] / math.sqrt(spread["k"] - 1)
    return _interval(whole["estimate"], se, whole["n"], conf, draws.sparkSession)


def monotone_curve(x: list[float], y: list[float]) -> list[float]:
    """Slopes at the knots of a monotone piecewise cubic: means of the secants beside a knot, held back where a piece would turn."""
    secants = [(y[k + 1] - y[k]) / (x[k + 1] - x[k]) for k in range(len(x) - 1)]
    if not secants:
        return [0.0] * len(x)
    m = [secants[0], *[(a + b) / 2 for a, b in zip(secants, secants[1:])], secants[-1]]
    for k, s in enumerate(secants):
        if s == 0:
            m[k] = m[k + 1] = 0.0
            continue
        a, b = m[k] / s, m[k + 1] / s
        over = 2 * a + b - 3
        if over > 0 and a + 2 * b - 3 > 0 and a * (over + a + 2 * b - 3) < over * over:
            m[k], m[k + 1] = (3 * s / math.hypot(a, b) * v for v in (a, b))
    return m


def curve_value(at: Column, x: list[float], y: list[float], m: list[float]) -> Column:
    """The curve through the knots, at values between the first and the last."""
    out = F.lit(float(y[-1]))
    for k in reversed(range(len(x) - 1)):
        h = x[k + 1] - x[k]
        t = (at - x[k]) / h
        up = t * t * (3 - 2 * t)
        piece = y[k] * (1 - up) + y[k + 1] * up + h * m[k] * t * (t - 1) * (t - 1) + h * m[k + 1] * t * t * (t - 1)
        out = F.when(at <= x[k + 1], piece).otherwise(out)
    return out


def rank_discoveries(draw_ranks: DataFrame, p_counts: DataFrame, n: int, key: str, knots: int = 15) -> DataFrame:
    """key, p, q: false discovery rates of p-values against the ranks of all draws.

    ``p_counts`` has (key, c): p is (c + 1) / n, c being the draws that depart as far as the
    compared plan. ``draw_ranks`` has (key, rank): how many draws depart no farther than a draw,
    which is what p-values look like where nothing is to be found. The share of true nulls is
    estimated at p above one half. Rates are taken at quantiles of p, made monotone from above,
    and a monotone curve through them gives q. Counts are compared as integers. The driver
    sees the knots alone.
    """
    c = F.col("c") + 1
    at = p_counts.agg(F.count(F.lit(1)).alias("m"), *[F.expr(f"percentile_disc({k / (knots - 1)}) WITHIN GROUP (ORDER BY c)").alias(f"k{k}") for k in range(knots)]).first()
    if not at["m"]:
        return p_counts.select(key, F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    ends = sorted({int(at[f"k{k}"]) + 1 for k in range(knots)})
    upto = p_counts.agg(F.count_if(2 * c <= n).alias("half"), *[F.count_if(c <= e).alias(f"e{e}") for e in ends]).first()
    null = draw_ranks.agg(F.count_if(2 * F.col("rank") <= n).alias("half"), *[F.count_if(F.col("rank") <= e).alias(f"e{e}") for e in ends]).first()
    rest = at["m"] - null["half"] / n
    share = min(1.0, (at["m"] - upto["half"]) / rest) if rest > 0 else 1.0
    rates = [share * null[f"e{e}"] / n / upto[f"e{e}"] for e in ends]
    for k in reversed(range(len(rates) - 1)):
        rates[k] = min(rates[k], rates[k + 1])
    x = [e / n for e in ends]
    p = c / F.lit(float(n))
    return p_counts.select(key, p.alias("p"), curve_value(p, x, rates, monotone_curve(x, rates)).alias("q"))


def run_summary(steps: DataFrame, stats: DataFrame, columns: list[str], pairs: DataFrame) -> DataFrame:
    """One table on a run of several chains: part, chain, step, item, value, warn.

    ``steps`` as ``sampling.smc_run`` returns them, ``stats`` (chain, draw, columns), ``pairs``
    (diversity). Parts: ``split`` (effective and surviving particles as shares, acceptance,
    spread of log weights, k; warned of where a step is a bottleneck), ``diversity`` (middle
    80 %, mean; warned of if low) and ``rhat`` (warned of from 1.05 on; columns without spread
    in some chain are left out).
    """
    told = {"n_eff": F.col("n_eff") / F.col("n"), "survivors": F.col("unique_parents") / F.col("n"), "accept_rate": F.col("accept_rate"), "sd_lp": F.col("sd_lp"), "k": F.col("k").cast("double")}
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("item"), c.alias("value")) for n, c in told.items()])).alias("x")
    split = step_flags(steps).select(F.lit("split").alias("part"), "chain", "step", items, F.col("bottleneck").alias("warn")).select("part", "chain", "step", "x.item", "x.value", "warn")
    none = F.lit(None).cast("int")
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("low", "high", "mean")])).alias("x")
    spread = diversity_flags(pairs).select(F.lit("diversity"), none, none, ends, F.col("is_low").alias("warn")).select("diversity", none, none, "x.item", "x.value", "warn")
    alike = stats.groupBy("chain").agg(*[F.countDistinct(c).alias(c) for c in columns]).agg(*[F.min(c).alias(c) for c in columns]).first()
    kept = [c for c in columns if (alike[c] or 0) > 1]
    out = split.union(spread)
    if kept and stats.select("chain").distinct().count() > 1:
        out = out.union(rhats(stats, kept).select(F.lit("rhat"), none, none, "column", "rhat", F.col("rhat") >= 1.05))
    return out
