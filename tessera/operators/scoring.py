"""Scores of labellings against planted truth: contingency, adjusted Rand, copy classes, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copy pairs travel as one code, a * 1000 + b.
CODE = 1000


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): how many rows have each pair of labels; rows with a NULL label are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(counts: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """One row (n, ari) from a contingency table; 1 where both labellings are trivial alike."""
    pairs = lambda x: x * (x - 1) / 2.0
    total = lambda key: counts.groupBy(key).agg(F.sum(n).alias("k")).agg(F.sum(pairs(F.col("k"))).alias(f"s_{key}"))
    whole = counts.agg(F.sum(n).alias("n"), F.sum(pairs(F.col(n))).alias("s_ab"))
    row = whole.join(total(a), how="cross").join(total(b), how="cross")  # three frames of one row each
    s_a, s_b = F.col(f"s_{a}"), F.col(f"s_{b}")
    expected = F.try_divide(s_a * s_b, pairs(F.col("n")))
    ari = F.try_divide(F.col("s_ab") - expected, (s_a + s_b) / 2 - expected)
    return row.select("n", F.when((s_a + s_b) / 2 == expected, F.lit(1.0)).otherwise(ari).alias("ari"))


def minor(code: Column) -> Column:
    return F.least(F.call_function("div", code, F.lit(CODE)), code % CODE)


def major(code: Column) -> Column:
    return F.greatest(F.call_function("div", code, F.lit(CODE)), code % CODE)


def swapped(code: Column) -> Column:
    """(A, B) as (B, A)."""
    return code % CODE * CODE + F.call_function("div", code, F.lit(CODE))


def phase_free(code: Column) -> Column:
    """(A, B) and (B, A) coded alike, the smaller first."""
    return minor(code) * CODE + major(code)


def copy_class(code: Column) -> Column:
    """loh, balanced_gain, unbalanced_gain or neutral; NULL for none of them."""
    gain = minor(code) + major(code) > 2
    return (
        F.when(minor(code) == 0, "loh")
        .when(gain & (minor(code) == major(code)), "balanced_gain")
        .when(gain, "unbalanced_gain")
        .when(code == CODE + 1, "neutral")
    )


def exact_by_class(df: DataFrame, planted: str, fitted: str) -> DataFrame:
    """(class, exact, either_phase, n) for each class that is planted."""
    p, f = F.col(planted), F.col(fitted)
    share = lambda hit: F.avg(F.when(hit, 1.0).otherwise(0.0))
    classed = df.select(copy_class(p).alias("class"), (p == f).alias("same"), (p == swapped(f)).alias("flipped")).where("class IS NOT NULL")
    return classed.groupBy("class").agg(share(F.col("same")).alias("exact"), share(F.col("same") | F.col("flipped")).alias("either_phase"), F.count(F.lit(1)).alias("n"))


def confusion(counts: DataFrame, planted: str, fitted: str, n: str = "n", digits: int = 4) -> DataFrame:
    """(planted, fitted, share): a contingency table with each planted row's shares adding to 1."""
    row = Window.partitionBy(planted)
    return counts.select(planted, fitted, F.round(F.col(n) / F.sum(n).over(row), digits).alias("share"))


def named_clones(df: DataFrame, clone: str, at: str, state: str) -> DataFrame:
    """(clone, merged): clones with equal profiles take the least id among them."""
    profile = df.groupBy(clone).agg(F.sort_array(F.collect_list(F.struct(at, state))).alias("profile"))
    return profile.select(clone, F.min(clone).over(Window.partitionBy("profile")).alias("merged"))


def total_variation(model: DataFrame, observed: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Half the absolute difference of two mass functions; a value that one lacks has no mass there."""
    both = model.select(key, F.col(p).alias("p1")).join(observed.select(key, F.col(p).alias("p2")), key, "full")
    return both.agg((F.sum(F.abs(F.coalesce("p1", F.lit(0.0)) - F.coalesce("p2", F.lit(0.0)))) / 2).alias("tv"))
