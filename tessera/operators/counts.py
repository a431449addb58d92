"""Sparse count tables: filters, pseudobulk, baselines, label floors and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import numbered


def ratio(a: Column, n: Column, fill: float) -> Column:
    """a / n, or ``fill`` where n is 0 or NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), n.cast("double")), F.lit(fill))


def pseudobulk(df: DataFrame, group: str, at: str, *values: str) -> DataFrame:
    """Sums of ``values`` over each (group, at); absent pairs stay absent, as zeros of a sparse table."""
    return df.groupBy(group, at).agg(*(F.sum(v).alias(v) for v in values))


def baseline(df: DataFrame, gene: str, spot: str, count: str, normal: Column, least: int = 0) -> DataFrame:
    """(gene, spot, base): the normal spots' share of each gene times each spot's total over scored genes.

    Genes below ``least`` counts in normal spots have share 0 and are left out
    of the totals.  Only pairs that the table holds are returned, so the outer
    product is never formed.
    """
    own = df.groupBy(gene).agg(F.sum(F.when(normal, F.col(count)).otherwise(0)).alias("own"))
    own = own.where((F.col("own") >= least) & (F.col("own") > 0))
    scored = df.join(own, gene)
    whole = own.agg(F.sum("own").alias("whole"))  # one row
    shares = own.join(F.broadcast(whole), how="cross").select(gene, (F.col("own") / F.col("whole")).alias("lam"))
    totals = scored.groupBy(spot).agg(F.sum(count).alias("total"))
    pairs = scored.select(gene, spot).distinct()
    return pairs.join(shares, gene).join(totals, spot).select(gene, spot, (F.col("lam") * F.col("total")).alias("base"))


def keep_expressed(df: DataFrame, gene: str, spot: str, count: str, share: float) -> DataFrame:
    """Rows of genes with a positive count in at least ``share`` of all spots."""
    n = df.select(spot).distinct().count()
    held = df.where(F.col(count) > 0).groupBy(gene).agg(F.count_distinct(spot).alias("held")).where(F.col("held") >= share * n)
    return df.join(held.select(gene), gene, "left_semi")


def damp_outliers(df: DataFrame, key: str, total: str, quantile: float, share: float) -> DataFrame:
    """Adds ``damped``: totals at or above the quantile scaled so that together they are ``share`` of the rest, cut to whole counts."""
    cut = df.agg(F.percentile(F.col(total), F.lit(quantile)).alias("cut"))
    marked = df.join(cut, how="cross").withColumn("out", F.col(total) >= F.col("cut"))  # the cut is one row
    sums = marked.agg(F.sum(F.when(F.col("out"), F.col(total))).alias("high"), F.sum(F.when(~F.col("out"), F.col(total))).alias("rest"))
    scaled = (F.col(total) * (share * F.col("rest") / F.col("high"))).cast("long")
    return marked.join(sums, how="cross").select(key, total, F.when(F.col("out"), scaled).otherwise(F.col(total)).alias("damped"))


def floor_labels(df: DataFrame, label: str, weight: str, least_rows: int, least_weight: float) -> DataFrame:
    """(label, merged): labels under either floor join the surviving label of most weight; survivors are renumbered densely.

    Where none survives the result is empty.
    """
    sums = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    ok = (F.col("n") >= least_rows) & (F.col("w") >= least_weight)
    kept = numbered(sums.where(ok), label, name="merged")
    most = kept.agg(F.max_by("merged", F.struct(F.col("w"), -F.col("merged"))).alias("most"))
    rest = sums.where(~ok).join(most, how="cross").where("most IS NOT NULL").select(label, F.col("most").alias("merged"))
    return kept.select(label, "merged").unionByName(rest).select(label, F.col("merged").cast("long").alias("merged"))


def reindex_labels(df: DataFrame, label: str, anchor: Column) -> DataFrame:
    """(label, n, code): the anchor is 0, the rest follow by rising count, ties by label."""
    sums = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return numbered(sums.withColumn("__other", F.when(anchor, 0).otherwise(1)), "__other", "n", label, name="code").select(label, "n", "code")


def enumerate_repeats(df: DataFrame, *key: str, order: str) -> DataFrame:
    """Adds ``enum``: 0 for the first row of a key in ``order``, then 1, 2, ..."""
    return df.withColumn("enum", (F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).cast("long"))


def distinct_codes(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, code, n): each distinct tuple once, numbered in order, with its multiplicity."""
    once = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return numbered(once, *columns, name="code").select(*columns, "code", "n")


def log_sum_exp(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, lse): stable against large values, by the group's maximum; both passes sum inside the tasks first."""
    most = df.groupBy(group).agg(F.max(value).alias("m"))
    shifted = df.select(group, F.col(value).alias("v")).join(most, group)
    return shifted.groupBy(group).agg((F.max("m") + F.ln(F.sum(F.exp(F.col("v") - F.col("m"))))).alias("lse"))


def cluster_bootstrap(df: DataFrame, member: str, value: str, draws: int, weight) -> DataFrame:
    """One row (low, high): 2.5 and 97.5 % of the ratio of sums over resamples.

    ``weight(member, draw)`` says how often a draw takes a member; its rows
    enter together.  Sums by member come first, so a draw costs one row each.
    """
    sums = df.groupBy(member).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    drawn = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", weight(F.col(member), F.col("draw")))
    rates = drawn.groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("c"))).alias("rate"))
    return rates.agg(F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high"))
