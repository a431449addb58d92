"""Summaries of groups: fits by moments, robust ratios, votes, paired members, halving, validity of graphs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, below, above): the median and its distances to the 10 and 90 % points."""
    q = df.groupBy(group).agg(F.percentile(F.col(value), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    at = lambda i: F.get("q", F.lit(i))
    return q.select(group, at(1).alias("median"), (at(1) - at(0)).alias("below"), (at(2) - at(1)).alias("above"))


def lognormal_fit(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mu, sigma) of the logs of the positive values."""
    logs = df.where(F.col(value) > 0).select(group, F.ln(value).alias("v"))
    return logs.groupBy(group).agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"))


def negative_binomial_fit(df: DataFrame, group: str, count: str) -> DataFrame:
    """(group, mean, dispersion) by moments; dispersion 0 where the variance does not exceed the mean."""
    m = df.groupBy(group).agg(F.avg(count).alias("mean"), F.var_pop(count).alias("v"))
    return m.select(group, "mean", F.coalesce(F.greatest(F.lit(0.0), F.try_divide(F.col("v") - F.col("mean"), F.col("mean") * F.col("mean"))), F.lit(0.0)).alias("dispersion"))


def chi_square(df: DataFrame, observed: str, expected: str, least: float = 5) -> DataFrame:
    """One row (statistic, cells) over the cells that expect at least ``least``."""
    d = F.col(observed) - F.col(expected)
    return df.where(F.col(expected) >= least).agg(F.sum(d * d / F.col(expected)).alias("statistic"), F.count(F.lit(1)).alias("cells"))


def median_of_ratios(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, ratio): the median of a / b where b is positive."""
    return df.where(F.col(b) > 0).groupBy(group).agg(F.percentile(F.col(a) / F.col(b), F.lit(0.5)).alias("ratio"))


def without_outliers(df: DataFrame, group: str, value: str, k: float) -> DataFrame:
    """(group, total, kept): sums over rows within k median absolute deviations of the group's median."""
    median = df.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    gaps = df.join(median, group).withColumn("gap", F.abs(F.col(value) - F.col("m")))
    mad = gaps.groupBy(group).agg(F.percentile("gap", F.lit(0.5)).alias("mad"))
    return gaps.join(mad, group).where(F.col("gap") <= k * F.col("mad")).groupBy(group).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("kept"))


def fold_change(df: DataFrame, gene: str, count: str, treated: Column) -> DataFrame:
    """(gene, total, log2fc): log2 ratio of counts per million between treated and other rows; 10 where either is 0."""
    sums = df.groupBy(gene).agg(F.sum(F.when(treated, F.col(count)).otherwise(0)).alias("t"), F.sum(F.when(~treated, F.col(count)).otherwise(0)).alias("u"))
    whole = sums.agg(F.sum("t").alias("tt"), F.sum("u").alias("uu"))
    both = sums.join(whole, how="cross")  # the totals are one row
    fc = F.when((F.col("t") == 0) | (F.col("u") == 0), F.lit(10.0)).otherwise(F.log2((F.col("t") * 1e6 / F.col("tt")) / (F.col("u") * 1e6 / F.col("uu"))))
    return both.select(gene, (F.col("t") + F.col("u")).alias("total"), fc.alias("log2fc"))


def balanced_group(df: DataFrame, group: str, share: str, slack: float = 0.05) -> DataFrame:
    """(group, deviation) of the group with the least sum of max(|share - 1/2| - slack, 0); ties to the smaller group."""
    sums = df.groupBy(group).agg(F.sum(F.greatest(F.abs(F.col(share) - 0.5) - slack, F.lit(0.0))).alias("deviation"))
    return sums.agg(F.min(F.struct("deviation", group)).alias("b")).select(f"b.{group}", "b.deviation")


def phase_vote(df: DataFrame, at: str, share: str, near: float) -> DataFrame:
    """(at, phase): the majority of shares above one half, those near it abstaining; ties are 1 and no vote is 0."""
    side = F.when(F.abs(F.col(share) - 0.5) >= near, F.when(F.col(share) > 0.5, 1.0).otherwise(0.0))
    return df.groupBy(at).agg(F.coalesce(F.when(F.avg(side) >= 0.5, 1).otherwise(0), F.lit(0)).cast("long").alias("phase"))


def members_everywhere(df: DataFrame, member: str, level: str) -> DataFrame:
    """Members seen at every level that there is."""
    n = df.agg(F.count_distinct(level).alias("n"))
    held = df.groupBy(member).agg(F.count_distinct(level).alias("k"))
    return held.join(n, how="cross").where("k = n").select(member)  # the count is one row


def halved(df: DataFrame, group: str, name: str, gap: str, tolerance: float) -> DataFrame:
    """Rows that go on to the next round: the best third of a group, and those within tolerance of its best."""
    w = Window.partitionBy(group)
    at = F.row_number().over(w.orderBy(gap, name))
    kept = (at <= F.ceil(F.count(F.lit(1)).over(w) / 3)) | (F.col(gap) <= F.min(gap).over(w) + tolerance)
    return df.withColumn("__kept", kept).where("__kept").drop("__kept")


def mass(df: DataFrame, group: str, count: str, top: int) -> DataFrame:
    """(group, k, p): the mass of counts, those at or above ``top`` pooled."""
    k = df.groupBy(group, F.least(F.col(count), F.lit(top)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return k.select(group, "k", (F.col("n") / F.sum("n").over(Window.partitionBy(group))).alias("p"))


def digitised(df: DataFrame, value: str, classes: int, name: str) -> DataFrame:
    """Quantile classes from 0: how many inner quantile edges are at most the value."""
    edges = df.agg(F.percentile(F.col(value), F.array(*(F.lit(i / classes) for i in range(1, classes)))).alias("__edges"))
    return df.join(edges, how="cross").withColumn(name, F.size(F.filter("__edges", lambda e: e <= F.col(value))).cast("long")).drop("__edges")  # the edges are one row


def prefix_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n): how many rows have both coordinates at most these, for every pair of values in the table.

    A running sum along each axis of the table of distinct positions.
    """
    held = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    xs, ys = df.select(x).distinct(), df.select(y).distinct()
    full = xs.join(ys, how="cross").join(held, [x, y], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a grid of positions, not of rows
    along = full.withColumn("n", F.sum("n").over(Window.partitionBy(x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)))
    return along.withColumn("n", F.sum("n").over(Window.partitionBy(y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))


def refines(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    """(fine, inside): whether each fine segment lies in one coarse one."""
    return df.groupBy(fine).agg((F.count_distinct(coarse) == 1).alias("inside"))


def row_normalised(edges: DataFrame, src: str, dst: str, w: str) -> DataFrame:
    """Edges whose weights are scaled so that every row sums to the median row sum."""
    sums = edges.groupBy(src).agg(F.sum(w).alias("__s"))
    middle = sums.agg(F.percentile("__s", F.lit(0.5)).alias("__m"))
    return edges.join(sums, src).join(middle, how="cross").select(src, dst, (F.col(w) * F.col("__m") / F.col("__s")).alias(w))  # the median is one row


def reciprocity(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """One row (edges, loops, reciprocal): counts of edges, self loops and edges whose reverse is there."""
    back = edges.select(F.col(src).alias(dst), F.col(dst).alias(src)).withColumn("__back", F.lit(1)).distinct()
    marked = edges.join(back, [src, dst], "left")
    return marked.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col(src) == F.col(dst)).alias("loops"), F.count_if(F.col("__back").isNotNull()).alias("reciprocal"))


def debiased(df: DataFrame, group: str, mu: str, weight: str, name: str = "rdr") -> DataFrame:
    """mu over its weighted mean in the group."""
    w = Window.partitionBy(group)
    return df.withColumn(name, F.col(mu) / (F.sum(F.col(mu) * F.col(weight)).over(w) / F.sum(weight).over(w)))


def altered_share(df: DataFrame, start: str, end: str, altered: Column) -> DataFrame:
    """One row (share): the altered length of the pieces over their whole length."""
    length = F.col(end) - F.col(start)
    return df.agg(F.try_divide(F.sum(F.when(altered, length).otherwise(0)).cast("double"), F.sum(length)).alias("share"))


def logistic_fit(df: DataFrame, x: str, y: str, rounds: int = 12) -> tuple[float, float] | None:
    """(intercept, slope) by iteratively reweighted least squares; None where the classes separate or one is absent."""
    import math

    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col(x))))
        # one pass for five sums
        s = df.select(F.col(x).cast("double").alias("x"), p.alias("p"), F.col(y).cast("double").alias("y")).agg(
            F.sum(F.col("p") * (1 - F.col("p"))).alias("w"), F.sum(F.col("p") * (1 - F.col("p")) * F.col("x")).alias("wx"), F.sum(F.col("p") * (1 - F.col("p")) * F.col("x") * F.col("x")).alias("wxx"), F.sum(F.col("y") - F.col("p")).alias("r"), F.sum((F.col("y") - F.col("p")) * F.col("x")).alias("rx")
        ).first()
        if s["w"] is None:
            return None
        det = s["w"] * s["wxx"] - s["wx"] * s["wx"]
        if not math.isfinite(det) or abs(det) < 1e-12:
            return None
        a += (s["wxx"] * s["r"] - s["wx"] * s["rx"]) / det
        b += (s["w"] * s["rx"] - s["wx"] * s["r"]) / det
        if abs(a) > 1e6 or abs(b) > 1e6:
            return None
    return a, b
