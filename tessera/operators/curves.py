"""Rates against a scale, with bands by resampling members: all groups and all resamples in the same passes.

Rows are (group, member, x, y, n): n items of a member with outcome y between 0
and 1.  A resample weights a member's rows by how often it was drawn, so its
items enter together; no row is copied for that.  The driver holds a pair of
coefficients for each group and resample.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.summaries import members_everywhere
from tessera.staging import stage

#: The shares between which a band lies, and what keeps a Newton step's matrix regular.
BAND, RIDGE = (0.025, 0.975), 1e-9

Weight = Callable[[Column, Column], Column]


def poisson(u: Column, most: int = 8) -> Column:
    """How often a member is drawn, from a number even on [0, 1): Poisson's law of mean one."""
    out, mass, total = F.lit(most), math.exp(-1), 0.0
    edges = []
    for k in range(most):
        total += mass
        edges.append((k, total))
        mass /= k + 1
    for k, edge in reversed(edges):
        out = F.when(u < edge, F.lit(k)).otherwise(out)
    return out


def by_hash(seed: int = 0) -> Weight:
    """Draws of members by a seeded hash: the same for all groups, so their curves are paired."""
    return lambda member, draw: poisson(F.pmod(F.xxhash64(F.lit(seed), member, draw), F.lit(1 << 30)) / float(1 << 30))


def resampled(rows: DataFrame, draws: int, weight: Weight) -> DataFrame:
    """``rows`` once for each draw from -1 with its weight ``w``; -1 is all members once, and rows of weight 0 are left out."""
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))
    return each.withColumn("w", F.when(F.col("draw") < 0, F.lit(1)).otherwise(weight(F.col("member"), F.col("draw"))).cast("double")).where("w > 0")


def _whole(rows: DataFrame) -> DataFrame:
    kept = rows.where("`group` IS NOT NULL AND member IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND n > 0")
    return kept.groupBy("group", "member", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.sum("n").cast("double").alias("n"))


def rates(rows: DataFrame, edges: list[float], draws: int, weight: Weight) -> DataFrame:
    """(group, bin, centre, rate, low, high, n): the mean outcome in each bin of x, [edge, next edge), with its band.

    Empty bins have NULLs and 0.  Rows with a NULL take no part.
    """
    cuts = F.array(*map(F.lit, edges))
    held = _whole(rows).withColumn("bin", F.size(F.filter(cuts, lambda e: e <= F.col("x"))) - 1).where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    sums = stage(held.groupBy("group", "member", "bin").agg(F.sum(F.col("y") * F.col("n")).alias("s"), F.sum("n").alias("c")), "rates")
    each = resampled(sums, draws, weight).groupBy("group", "bin", "draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("rate"), F.sum("c").alias("c"))
    drawn = F.when(F.col("draw") >= 0, F.col("rate"))
    found = each.groupBy("group", "bin").agg(F.max(F.when(F.col("draw") < 0, F.col("rate"))).alias("rate"), *(F.percentile(drawn, F.lit(q)).alias(name) for q, name in zip(BAND, ("low", "high"))), F.max(F.when(F.col("draw") < 0, F.col("c"))).cast("long").alias("n"))
    bins = F.array(*(F.struct(F.lit(i).alias("bin"), F.lit((a + b) / 2).alias("centre")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))))
    every = rows.where("`group` IS NOT NULL").select("group").distinct().select("group", F.explode(bins).alias("b")).select("group", "b.bin", "b.centre")
    return every.join(found, ["group", "bin"], "left").select("group", "bin", "centre", "rate", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def fits(rows: DataFrame, draws: int, weight: Weight, rounds: int = 50, tolerance: float = 1e-8) -> dict[tuple, tuple[float, float] | None]:
    """(intercept, slope) of the logistic fit of y on x for each (group, draw), by Newton steps; all take a step in one pass.

    None where no or one row is drawn, the outcome does not vary, or the
    fit runs away.
    """
    held = stage(_whole(rows), "curve")
    spark = rows.sparkSession
    kind = dict(held.dtypes)["group"]
    start = resampled(held, draws, weight).groupBy("group", "draw").agg(F.count(F.lit(1)).alias("k"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    out: dict[tuple, tuple[float, float] | None] = {(g, d): None for g in {r["group"] for r in start} for d in range(-1, draws)}
    open_ = {(r["group"], r["draw"]): (0.0, 0.0) for r in start if r["k"] >= 2 and r["lo"] < r["hi"]}
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(*key, *ab) for key, ab in open_.items()], f"`group` {kind}, draw int, a double, b double")
        met = resampled(held, draws, weight).join(F.broadcast(now), ["group", "draw"])  # a row for each group and resample
        p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        met = met.withColumn("p", p).withColumn("m", F.col("w") * F.col("n"))
        v, r, x = F.col("m") * F.col("p") * (1 - F.col("p")), F.col("m") * (F.col("y") - F.col("p")), F.col("x")
        sums = met.groupBy("group", "draw").agg(F.sum(v).alias("h"), F.sum(v * x).alias("hx"), F.sum(v * x * x).alias("hxx"), F.sum(r).alias("r"), F.sum(r * x).alias("rx")).collect()
        following = {}
        for s in sums:
            key, a, b = (s["group"], s["draw"]), *open_[s["group"], s["draw"]]
            h, hxx = s["h"] + RIDGE, s["hxx"] + RIDGE
            det = h * hxx - s["hx"] ** 2
            if not det:
                out[key] = None
                continue
            da, db = (hxx * s["r"] - s["hx"] * s["rx"]) / det, (h * s["rx"] - s["hx"] * s["r"]) / det
            fine = math.isfinite(a + da) and abs(b + db) <= 1e3
            out[key] = (a + da, b + db) if fine else None
            if fine and max(abs(da), abs(db)) >= tolerance:
                following[key] = out[key]
        open_ = following
    return out


def _drawn(spark, found: dict[tuple, tuple[float, float] | None], kind: str) -> DataFrame:
    return spark.createDataFrame([(*key, *(ab or (None, None))) for key, ab in found.items()], f"`group` {kind}, draw int, a double, b double")


def crossings(spark, found: dict[tuple, tuple[float, float] | None], kind: str = "string") -> DataFrame:
    """(group, crossing, low, high, draws): where each fit reads one half, its band over the resamples that rise, and how many do."""
    at = F.when(F.col("b") > 0, -F.col("a") / F.col("b"))
    drawn = F.when(F.col("draw") >= 0, F.col("at"))
    each = _drawn(spark, found, kind).withColumn("at", at)
    return each.groupBy("group").agg(F.max(F.when(F.col("draw") < 0, F.col("at"))).alias("crossing"), *(F.percentile(drawn, F.lit(q)).alias(n) for q, n in zip(BAND, ("low", "high"))), F.count(drawn).alias("draws"))


def bands(spark, found: dict[tuple, tuple[float, float] | None], lo: float, hi: float, points: int = 101, kind: str = "string") -> DataFrame:
    """(group, x, fitted, low, high): the fitted curve at even points and its band over the resamples that have a fit."""
    grid = F.array(*(F.lit(lo + (hi - lo) * i / max(1, points - 1)) for i in range(points)))
    each = _drawn(spark, found, kind).withColumn("x", F.explode(grid)).withColumn("y", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x")))))
    drawn = F.when(F.col("draw") >= 0, F.col("y"))
    return each.groupBy("group", "x").agg(F.max(F.when(F.col("draw") < 0, F.col("y"))).alias("fitted"), *(F.percentile(drawn, F.lit(q)).alias(n) for q, n in zip(BAND, ("low", "high"))))


def paired(rows: DataFrame) -> DataFrame:
    """The rows of members that every group has, so that groups are compared on the same ones."""
    return rows.join(members_everywhere(rows, "member", "group"), "member", "left_semi").select(*rows.columns)


def rounded_counts(segments: DataFrame) -> DataFrame:
    """(group, member, x, y, n) of segments (group, member, reads, y): x is log10 of the reads to two digits, and equal rows are one with their number; segments without reads are left out."""
    kept = segments.where("reads > 0").withColumn("x", F.round(F.log10("reads"), 2))
    return kept.groupBy("group", "member", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, edges: list[float], draws: int, weight: Weight | None = None, pair: bool = True) -> tuple[DataFrame, DataFrame]:
    """((group, bin, centre, rate, low, high, n), (group, crossing, low, high, draws, members, items)) of all groups, on the members that all have if ``pair``."""
    weight = weight or by_hash()
    held = stage(paired(rows) if pair else rows, "paired")
    found = fits(held, draws, weight)
    sizes = held.groupBy("group").agg(F.count_distinct("member").alias("members"), F.sum("n").cast("long").alias("items"))
    kind = dict(rows.dtypes)["group"]
    return rates(held, edges, draws, weight), sizes.join(crossings(rows.sparkSession, found, kind), "group", "left")

