"""Planted instances: spots on a lattice, clones with copy profiles, counts by a seeded law.

Every draw is a hash of the seed and the row's keys, so an instance does not
depend on partitions, and any part of it can be made again alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the seed and the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def hex_array(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """(spot, row, col) of a hexagonal array: odd rows are shifted by half a step, in doubled columns."""
    at = F.col("id")
    r = F.call_function("div", at, F.lit(columns))
    return spark.range(rows * columns).select(at.alias("spot"), r.alias("row"), (2 * (at % columns) + r % 2).alias("col"))


def square_array(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    at = F.col("id")
    return spark.range(rows * columns).select(at.alias("spot"), F.call_function("div", at, F.lit(columns)).alias("row"), (at % columns).alias("col"))


def bands(spots: DataFrame, clones: int, rows: int) -> DataFrame:
    """(spot, label): clones in horizontal bands of equal height."""
    return spots.select("spot", F.call_function("div", F.col("row") * clones, F.lit(rows)).alias("label"))


def copy_path(spark: SparkSession, clones: int, bins: int, states: int, run: int, seed: int) -> DataFrame:
    """(label, bin, state): stretches of ``run`` bins in one state; clone 0 is in state 0 throughout."""
    each = spark.range(clones).select(F.col("id").alias("label"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    stretch = F.call_function("div", F.col("bin"), F.lit(run))
    drawn = F.floor(uniform(seed, F.col("label"), stretch) * states).cast("int")
    return each.select("label", "bin", F.when(F.col("label") == 0, 0).otherwise(drawn).alias("state"))


def draw_counts(labels: DataFrame, path: DataFrame, states: list[tuple[float, float]], depth: float, reads: float, seed: int) -> DataFrame:
    """(spot, bin, k, base, a, n): counts about depth * mu and reads of haplotype A about n * share, rounded and not negative.

    ``states`` are (log mu, share); a spot's depth varies by a factor of its own.
    """
    table = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(p)).alias("p")) for m, p in states))
    rows = labels.join(path, "label").withColumn("s", F.get(table, F.col("state")))
    own = F.exp(0.3 * normal(seed, F.col("spot")))
    keys = (F.col("spot"), F.col("bin"))
    mean = depth * own * F.exp("s.m")
    n = F.greatest(F.lit(0.0), F.round(reads + F.sqrt(F.lit(reads)) * normal(seed + 4, *keys)))
    share = F.col("s.p")
    a = F.least(n, F.greatest(F.lit(0.0), F.round(n * share + F.sqrt(n * share * (1 - share)) * normal(seed + 6, *keys))))
    k = F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * normal(seed + 2, *keys)))
    return rows.select("spot", "bin", k.cast("long").alias("k"), (depth * own).alias("base"), a.cast("long").alias("a"), n.cast("long").alias("n"))


def switched(snps: DataFrame, contig: str, order: str, p_switch: str, seed: int) -> DataFrame:
    """Adds ``phase``: the parity of the switches drawn so far on the contig."""
    from tessera.operators.ordered import parity

    return parity(snps, contig, [order], uniform(seed, F.col(contig), F.col(order)) < F.col(p_switch), "phase")


def bootstrap_weight(member: Column, draw: Column, seed: int) -> Column:
    """How often a draw takes a member: Poisson of mean 1 by its quantiles, which resampling tends to."""
    u, out, p, total = uniform(seed, member, draw), F.lit(0), math.exp(-1), 0.0
    for k in range(9):
        total += p
        out = out + F.when(u > total, 1).otherwise(0)
        p /= k + 1
    return out


def barcodes(spots: DataFrame, length: int, seed: int) -> DataFrame:
    """(spot, barcode): strings of A, C, G, T; the spot's own digits in base 4 come last, so that no two are alike."""
    drawn = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(F.lit("ACGT"), F.floor(F.pmod(F.xxhash64(F.lit(seed), F.col("spot"), i), F.lit(4))).cast("int") + 1, F.lit(1))), "")
    own = F.translate(F.conv(F.col("spot").cast("string"), 10, 4), "0123", "ACGT")
    return spots.select("spot", F.concat(F.substr(drawn, F.lit(1), F.greatest(F.lit(0), F.lit(length) - F.length(own))), own).alias("barcode"))
