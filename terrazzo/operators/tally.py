"""Per-district statistics: tallies, shares, parity, splits, segregation, votes, compactness.

All take assignments (draw, unit_id, district) and units; units are joined once and sums are
combined before the shuffle. Quotients with a zero denominator are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sizes import by_key, small

BY = ["draw", "district"]
#: Fixed value: the constant of circular compactness scores.
PI = 3.14159265


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def placed(assignments: DataFrame, units: DataFrame, *columns: str) -> DataFrame:
    return assignments.join(by_key(units.select("unit_id", *dict.fromkeys(columns))), "unit_id")


def tally(assignments: DataFrame, units: DataFrame, **sums: str | Column) -> DataFrame:
    """Sums over the units of each district: ``tally(asg, units, people="pop")``."""
    return assignments.join(by_key(units), "unit_id").groupBy(*BY).agg(*[F.sum(_col(x)).alias(n) for n, x in sums.items()])


def share(top: str | Column, bottom: str | Column) -> Column:
    return F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))


def group_share(assignments: DataFrame, units: DataFrame, group: str, total: str = "pop", name: str = "share") -> DataFrame:
    both = tally(assignments, units, top=group, bottom=total)
    return both.select(*BY, share("top", "bottom").alias(name))


def parity(assignments: DataFrame, units: DataFrame, pop: str = "pop") -> DataFrame:
    """The largest deviation from equal population, by draw."""
    by = tally(assignments, units, p=pop)
    mean = by.groupBy("draw").agg(F.sum("p").alias("t"), F.count(F.lit(1)).alias("n"), F.max("p").alias("high"), F.min("p").alias("low"))
    ideal = F.col("t").cast("double") / F.col("n")
    return mean.select("draw", F.greatest(F.col("high") / ideal - 1, 1 - F.col("low") / ideal).alias("parity"))


def parity_by_district(assignments: DataFrame, units: DataFrame, pop: str = "pop") -> DataFrame:
    """Each district's own deviation and the draw's largest, beside every district."""
    every = W.partitionBy("draw")
    by = tally(assignments, units, p=pop).withColumn("dev", F.abs(F.col("p") / (F.sum("p").over(every).cast("double") / F.count("p").over(every)) - 1))
    return by.select(*BY, "dev", F.max("dev").over(every).alias("parity"))


def county_pieces(assignments: DataFrame, units: DataFrame, county: str = "county") -> DataFrame:
    """Districts of each county, by draw."""
    return placed(assignments, units, county).groupBy("draw", county).agg(F.countDistinct("district").alias("n"))


def county_splits(assignments: DataFrame, units: DataFrame, county: str = "county") -> DataFrame:
    """Counties split at all, split more than once, and districts in excess of one a county."""
    return county_pieces(assignments, units, county).groupBy("draw").agg(F.count_if(F.col("n") > 1).alias("splits"), F.count_if(F.col("n") > 2).alias("multisplits"), F.sum(F.col("n") - 1).alias("total_splits"))


def split_flags(assignments: DataFrame, units: DataFrame, county: str = "county") -> DataFrame:
    """Unit by unit: is its county split?"""
    pieces = county_pieces(assignments, units, county).select("draw", county, (F.col("n") > 1).alias("is_split"))
    return placed(assignments, units, county).join(pieces, ["draw", county]).select("draw", "unit_id", "is_split")


def district_counties(assignments: DataFrame, units: DataFrame, county: str = "county") -> DataFrame:
    return placed(assignments, units, county).groupBy(*BY).agg(F.countDistinct(county).alias("n_counties"))


def segregation(assignments: DataFrame, units: DataFrame, group: str, total: str = "pop") -> DataFrame:
    """Dissimilarity of districts: sum of pop |share - P| over 2 T P (1 - P)."""
    by = tally(assignments, units, g=group, t=total)
    every = W.partitionBy("draw")
    whole = by.withColumn("people", F.sum("t").over(every).cast("double")).withColumn("overall", F.sum("g").over(every) / F.col("people"))
    term = F.col("t") * F.abs(F.coalesce(share("g", "t"), F.lit(0.0)) - F.col("overall"))
    p = F.first("overall")
    return whole.groupBy("draw").agg(F.try_divide(F.sum(term), 2 * F.first("people") * p * (1 - p)).alias("segregation"))


def vote_shares(assignments: DataFrame, units: DataFrame, dvote: str = "dvote", rvote: str = "rvote") -> DataFrame:
    """Two-party votes and the share of the first party, by district."""
    both = tally(assignments, units, d=dvote, r=rvote)
    return both.select(*BY, "d", "r", share("d", F.col("d") + F.col("r")).alias("dvs"))


def competitiveness(shares: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Talismanic score from mean distance to one half and from the seat share's distance."""
    by = shares.groupBy("draw").agg(F.avg(F.abs(F.col("dvs") - 0.5)).alias("tp"), F.abs(F.avg((F.col("dvs") > 0.5).cast("int")) - 0.5).alias("te"))
    return by.select("draw", (F.col("tp") * (1 + alpha * F.col("te")) * beta).alias("competitiveness"))


def partisan(shares: DataFrame, tau: float = 1.0, bias_at: float = 0.5, respond_at: float = 0.5, width: float = 0.01) -> DataFrame:
    """Published partisan measures of each draw (seats by uniform swing where votes move).

    seats, dvs, eff_gap, eff_gap_equal, tau_gap, mean_median, bias, declination,
    responsiveness, lopsided. ``ranked_marginal`` compares draws with one another.
    """
    won, v = F.col("dvs") > 0.5, F.col("dvs")
    total = F.col("d") + F.col("r")
    waste_d = F.when(won, F.col("d") - total / 2).otherwise(F.col("d"))
    waste_r = F.when(won, F.col("r")).otherwise(F.col("r") - total / 2)
    gap = 2 * v - 1
    bent = F.when(gap >= 0, F.pow(F.abs(gap), F.lit(tau + 1))).otherwise(-F.pow(F.abs(gap), F.lit(tau + 1)))
    by = shares.groupBy("draw").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(won.cast("int")).alias("seats"),
        (F.sum("d") / F.sum(total)).alias("statewide"),
        ((F.sum(waste_r) - F.sum(waste_d)) / F.sum(total)).alias("eff_gap"),
        (F.avg(won.cast("double")) - 0.5 - 2 * (F.avg(v) - 0.5)).alias("eff_gap_equal"),
        (2 * F.avg(bent + 0.5 - won.cast("double"))).alias("tau_gap"),
        (F.avg(v) - F.percentile(v, 0.5)).alias("mean_median"),
        F.avg(v).alias("mean_dvs"),
        F.collect_list(v).alias("all"),
        F.avg(F.when(won, v)).alias("mean_won"),
        F.avg(F.when(~won, v)).alias("mean_lost"),
    )
    seats_at = lambda to: F.size(F.filter("all", lambda x: x + (F.lit(to) - F.col("mean_dvs")) > 0.5)) / F.col("n")
    lost = F.col("n") - F.col("seats")
    up, down = F.atan((2 * F.col("mean_won") - 1) / (F.col("seats") / F.col("n"))), F.atan((1 - 2 * F.col("mean_lost")) / (lost / F.col("n")))
    return by.select(
        "draw", "seats", F.col("statewide").alias("dvs"), "eff_gap", "eff_gap_equal", "tau_gap", "mean_median",
        (seats_at(bias_at) - 0.5).alias("bias"),
        F.when((F.col("seats") > 0) & (lost > 0), 2 / F.pi() * (up - down)).alias("declination"),
        ((seats_at(respond_at + width) - seats_at(respond_at - width)) / (2 * width)).alias("responsiveness"),
        (F.col("mean_won") - (1 - F.col("mean_lost"))).alias("lopsided"),
    )


def ranked_marginal(shares: DataFrame) -> DataFrame:
    """draw, ranked_marginal: distance of a draw's sorted vote shares from the mean of all draws at each rank."""
    place = F.row_number().over(W.partitionBy("draw").orderBy("dvs", "district"))
    ranked = shares.select("draw", "dvs", place.alias("place"))
    mean = ranked.groupBy("place").agg(F.avg("dvs").alias("mean"))  # a row a district
    return ranked.join(F.broadcast(mean), "place").groupBy("draw").agg(F.sqrt(F.sum(F.pow(F.col("dvs") - F.col("mean"), 2))).alias("ranked_marginal"))


def extremes(stats: DataFrame, column: str) -> DataFrame:
    """draw, low, high of a statistic over the districts."""
    return stats.groupBy("draw").agg(F.min(column).alias("low"), F.max(column).alias("high"))


def outlines(assignments: DataFrame, perimeters: DataFrame) -> DataFrame:
    """District outline lengths from unit borders (from_id, to_id, edge); -1 is the outside.

    A border counts for ``to_id`` where the other side is outside or in another district.
    """
    to = assignments.select("draw", F.col("unit_id").alias("to_id"), "district")
    other = assignments.select("draw", F.col("unit_id").alias("from_id"), F.col("district").alias("beside"))
    met = to.join(small(perimeters), "to_id").join(other, ["draw", "from_id"], "left")
    return met.filter((F.col("from_id") == -1) | (F.col("beside") != F.col("district"))).groupBy(*BY).agg(F.sum("edge").alias("perimeter"))


def polsby_popper(assignments: DataFrame, units: DataFrame, perimeters: DataFrame, area: str = "area") -> DataFrame:
    both = tally(assignments, units, a=area).join(outlines(assignments, perimeters), BY)
    return both.select(*BY, (4 * PI * F.col("a") / F.pow("perimeter", 2)).alias("polsby"), (F.col("perimeter") / (2 * F.sqrt(PI * F.col("a")))).alias("schwartzberg"))


def squared_spread(assignments: DataFrame, units: DataFrame, x: str = "gx", y: str = "gy", pop: str = "pop", denominator: float = 1.0) -> DataFrame:
    """Sum over pairs in a district of squared distance times both populations.

    From moments (W, Wx, Wy, Wxx + Wyy), so no pair of units is formed.
    """
    w = F.col(pop).cast("double")
    m = tally(assignments, units, w=w, wx=w * F.col(x), wy=w * F.col(y), ww=w * (F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    return m.select(*BY, ((F.col("w") * F.col("ww") - F.col("wx") ** 2 - F.col("wy") ** 2) / denominator).alias("spread"))


def length_width(assignments: DataFrame, units: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """Shorter over longer side of the bounding box of unit squares."""
    box = placed(assignments, units, x, y).groupBy(*BY).agg((F.max(x) - F.min(x) + 1).alias("a"), (F.max(y) - F.min(y) + 1).alias("b"))
    return box.select(*BY, (F.least("a", "b") / F.greatest("a", "b")).alias("length_width"))


def target_share(least: float, group: float, total: float, ndists: int, majority: int) -> float:
    """Group share left for the other districts once ``majority`` districts have ``least``."""
    return (group - majority * least * total / ndists) / ((ndists - majority) * total / ndists)
