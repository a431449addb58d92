"""Normal spots and what they say of genes and bins: candidates, differential expression, balance of alleles, local baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.likelihood import bb_log_pmf
from tessera.operators.ranking import numbered
from tessera.operators.summaries import balanced_group


def spread_of_logs(cells: DataFrame, spots: DataFrame, bins: int, spot: str = "spot", count: str = "umi") -> DataFrame:
    """(spot, spread): population standard deviation of log(1 + count) over all bins, to nine digits, so that equal counts tie; bins that the table lacks count 0."""
    logs = cells.groupBy(spot).agg(F.sum(F.log1p(count)).alias("s"), F.sum(F.log1p(count) * F.log1p(count)).alias("s2"))
    mean = F.coalesce("s", F.lit(0.0)) / bins
    return spots.select(spot).distinct().join(logs, spot, "left").select(spot, F.round(F.sqrt(F.greatest(F.lit(0.0), F.coalesce("s2", F.lit(0.0)) / bins - mean * mean)), 9).alias("spread"))


def by_balance(profiles: DataFrame, labels: DataFrame, spreads: DataFrame, slack: float = 0.05, start: int = 40) -> DataFrame:
    """(spot): spots of the most balanced clone whose spread is below the last percentile of a rising series.

    ``profiles`` is (clone, bin, baf).  Percentiles rise by tens from ``start``
    to 100.  A jump is meant to end the series, but it is sought against a
    threshold that starts, and stays, without bound, so the last step is always
    the one taken; ``start`` beyond it takes no part.
    """
    clone = balanced_group(profiles, "clone", "baf", slack).select("clone")  # one row
    own = labels.join(F.broadcast(clone), "clone", "left_semi").join(spreads, "spot")
    last = max(range(start, 101, 10)) / 100
    cut = own.agg(F.percentile("spread", F.lit(last)).alias("__cut"))  # one row
    return own.join(F.broadcast(cut), F.col("spread") < F.col("__cut")).select("spot")


def by_proportion(proportions: DataFrame, totals: DataFrame, needed: float) -> DataFrame:
    """(spot): spots whose tumour proportion is below the least of 0.05, 0.1 ... 0.55 at which they hold more than ``needed`` reads, and below 0.55 where they never do."""
    steps = [round(0.05 * i, 2) for i in range(1, 12)]
    met = proportions.join(totals, "spot")
    sums = met.agg(*(F.sum(F.when(F.col("proportion") < s, F.col("total"))).alias(f"s{i}") for i, s in enumerate(steps))).first()
    cut = next((s for i, s in enumerate(steps) if (sums[f"s{i}"] or 0) > needed), steps[-1])
    return met.where(F.col("proportion") < cut).select("spot")


def differential_genes(counts: DataFrame, groups: DataFrame, change: float, quantile: float) -> DataFrame:
    """(slice, gene, total, log2fc, flagged): genes of each slice that differ between its normal and other spots and are well covered.

    ``groups`` is (spot, slice, normal).  Counts are per million of each side;
    where either side has none the change is 10.  A gene is flagged when the
    change reaches ``change`` up or down and its reads in the slice reach that
    quantile of the slice's genes.
    """
    met = counts.join(groups, "spot")
    sums = met.groupBy("slice", "gene").agg(F.sum(F.when(F.col("normal"), F.col("n")).otherwise(0)).alias("u"), F.sum(F.when(F.col("normal"), 0).otherwise(F.col("n"))).alias("t"))
    whole = sums.groupBy("slice").agg(F.sum("u").alias("uu"), F.sum("t").alias("tt"), F.percentile(F.col("u") + F.col("t"), F.lit(quantile)).alias("cut"))
    fc = F.when((F.col("u") == 0) | (F.col("t") == 0), F.lit(10.0)).otherwise(F.log2((F.col("t") * 1e6 / F.col("tt")) / (F.col("u") * 1e6 / F.col("uu"))))
    found = sums.join(whole, "slice").select("slice", "gene", (F.col("u") + F.col("t")).alias("total"), fc.alias("log2fc"), "cut")
    return found.withColumn("flagged", (F.abs("log2fc") >= change) & (F.col("total") >= F.col("cut"))).drop("cut")


def without_flagged(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """``counts`` less the genes that any slice flags."""
    return counts.join(genes.where("flagged").select("gene").distinct(), "gene", "left_anti")


def two_clusters(totals: DataFrame, spot: str, features: list[str], seed: int = 1) -> DataFrame:
    """(spot, cluster): two clusters of spots on their first four principal components."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="__f"), PCA(k=min(4, len(features)), inputCol="__f", outputCol="__p"), KMeans(k=2, seed=seed, featuresCol="__p", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(totals).transform(totals).select(spot, "cluster")


def mass_and_cumulative(df: DataFrame, k: str, n: str, share: Column, tau: Column) -> DataFrame:
    """Adds ``mass`` and ``cumulative`` of the beta-binomial at k: of each distinct (k, n) once, by the shorter tail."""
    pairs = df.select(F.col(k).alias("k"), F.col(n).alias("n")).distinct().where("n IS NOT NULL")
    above = F.col("k") + 1 > F.col("n") - F.col("k")
    first = F.when(above, F.col("k") + 1).otherwise(F.lit(0))
    last = F.when(above, F.col("n")).otherwise(F.col("k"))
    terms = pairs.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array())))
    tails = terms.groupBy("k", "n").agg(F.sum(F.exp(bb_log_pmf(F.col("i"), F.col("n"), share, tau))).alias("tail"))
    known = pairs.join(tails, ["k", "n"], "left").withColumn("tail", F.coalesce("tail", F.lit(0.0)))
    inside = (F.col("k") >= 0) & (F.col("k") <= F.col("n"))
    mass = F.when(inside, F.exp(bb_log_pmf(F.col("k"), F.col("n"), share, tau))).otherwise(0.0)
    known = known.select(F.col("k").alias(k), F.col("n").alias(n), mass.alias("mass"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(above, 1 - F.col("tail")).otherwise(F.col("tail")))).alias("cumulative"))
    return df.join(known, [k, n], "left")


def unbalanced_bins(bins: DataFrame, tau: float, low: float, high: float, k: str = "b", n: str = "total") -> DataFrame:
    """``bins`` with ``removed``: the pooled allele count lies outside the two-sided interval of a balanced beta-binomial."""
    judged = mass_and_cumulative(bins, k, n, F.lit(0.5), F.lit(float(tau)))
    below = F.col("cumulative") < low if low > 0 else F.lit(False)
    above = F.greatest(F.lit(0.0), F.col("cumulative") - F.col("mass")) >= high if high < 1 else F.lit(False)
    return judged.withColumn("removed", below | above).drop("mass", "cumulative")


def kept_bins(judged: DataFrame, key: str = "bin") -> DataFrame:
    """(bin, code): the bins that stay, numbered anew in their order."""
    return numbered(judged.where(~F.col("removed")).select(key).distinct(), key, name="code")


def fit_concentration(bins: DataFrame, k: str = "b", n: str = "total", least: float = 30.0, most: float = 1e5, rounds: int = 40) -> float:
    """The concentration of a balanced beta-binomial of greatest likelihood, by golden section on its log."""
    import math

    codes = bins.groupBy(F.col(k).alias("k"), F.col(n).alias("n")).agg(F.count(F.lit(1)).alias("w"))

    def level(taus: list[float]) -> list[float]:
        # several points in one pass over the distinct counts
        row = codes.agg(*(F.sum(F.col("w") * bb_log_pmf(F.col("k"), F.col("n"), F.lit(0.5), F.lit(t))).alias(f"l{i}") for i, t in enumerate(taus))).first()
        return [row[f"l{i}"] or 0.0 for i in range(len(taus))]

    a, b = math.log(least), math.log(most)
    for _ in range(max(1, rounds // 8)):
        grid = [a + (b - a) * i / 8 for i in range(9)]
        got = level([math.exp(x) for x in grid])
        at = max(range(9), key=lambda i: got[i])
        a, b = grid[max(0, at - 1)], grid[min(8, at + 1)]
    return math.exp((a + b) / 2)


def local_normal(profiles: DataFrame, width: int, slack: float, margin: float) -> DataFrame:
    """(clone, bin, normal): clones that are locally balanced, by the deviation of their share over 2 * width + 1 bins.

    ``profiles`` is (clone, contig, bin, baf).  A clone is normal around a bin
    when its windowed deviation is within ``margin`` of the least of all clones there.
    """
    deviation = F.greatest(F.abs(F.col("baf") - 0.5) - slack, F.lit(0.0))
    frame = Window.partitionBy("clone", "contig").orderBy("bin").rowsBetween(-width, width)
    windowed = profiles.withColumn("local", F.avg(deviation).over(frame))
    least = windowed.groupBy("contig", "bin").agg(F.min("local").alias("least"))
    return windowed.join(least, ["contig", "bin"]).select("clone", "contig", "bin", (F.col("local") <= F.col("least") + margin).alias("normal"))


#: Shares of the pool at which the relaxation stops to compare, as running sums.
PERCENTILES = [0.4]
while PERCENTILES[-1] + 0.05 <= 0.95:
    PERCENTILES.append(PERCENTILES[-1] + 0.05)


def kept_of_pool(pool: Column, ratio: float = 1.1) -> Column:
    """How many of a pool of spreads (the anchor's, then the others' by size) stay: the first split whose parts differ by over ``ratio`` times what they spread within.

    Pools of up to three stay whole, and so does one without such a split.
    """
    n = F.size(pool)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    around = lambda xs, m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))

    def split(p: Column) -> Column:
        k = F.least(F.greatest(F.floor(p * n).cast("int"), F.lit(1)), n - 2) + 1
        low, high = F.slice(pool, F.lit(1), k), F.slice(pool, k + 1, n - k)
        whole, first, second = total(pool) / n, total(low) / k, total(high) / (n - k)
        within = around(low, first) + around(high, second)
        between = k * (first - whole) * (first - whole) + (n - k) * (second - whole) * (second - whole)
        return F.when((within > 1e-12) & (between > ratio * within), k)

    found = F.filter(F.transform(F.array(*map(F.lit, PERCENTILES)), split), lambda k: k.isNotNull())
    return F.when(n > 3, F.coalesce(F.get(found, F.lit(0)), n)).otherwise(n)


def local_mask(
    profiles: DataFrame, labels: DataFrame, cells: DataFrame, width: int, slack: float = 0.05, margin: float = 0.01, ratio: float = 1.1, amplitude: tuple[float, float] = (0.8, 1.25)
) -> DataFrame:
    """(clone, bin, normal): the clones whose spots are a bin's normal ones.

    ``profiles`` is (clone, bin, baf) with bins numbered through, ``labels``
    (spot, clone), ``cells`` (spot, bin, umi).  The clone that deviates least
    from balance over all bins, ties to the smaller, is the anchor and always
    normal.  Another is a candidate at a bin where, within ``width`` bins on
    either side, its deviation is within ``margin`` of the least of all clones
    and its share of reads, regressed on the anchor's through the origin with
    weights of one over the anchor's, has a slope within ``amplitude``.  Of the
    candidates those stay, by rising spread of their log reads, that
    ``kept_of_pool`` says.  Clones without spots are never normal; a NULL baf
    is balanced.  All tables here are clones times bins.
    """
    deviation = F.coalesce(F.greatest(F.abs(F.col("baf") - 0.5) - slack, F.lit(0.0)), F.lit(0.0))
    spots = labels.groupBy("clone").agg(F.count_distinct("spot").alias("spots"))
    reads = cells.join(labels, "spot").groupBy("clone", "bin").agg(F.sum("umi").cast("double").alias("x"))
    library = reads.groupBy("clone").agg(F.sum("x").alias("library"))
    grid = profiles.select("clone", "bin", deviation.alias("dev")).join(reads, ["clone", "bin"], "left").join(spots, "clone", "left").join(library, "clone", "left")
    x = F.coalesce("x", F.lit(0.0))
    held = grid.select("clone", "bin", "dev", F.coalesce("spots", F.lit(0)).alias("spots"), F.coalesce(F.try_divide(x, F.col("library")), F.lit(0.0)).alias("y"), F.coalesce(F.log1p(F.try_divide(x, F.col("spots"))), F.lit(0.0)).alias("log"))
    anchor = held.groupBy("clone").agg(F.sum("dev").alias("dev")).agg(F.min(F.struct("dev", "clone")).alias("a")).select(F.col("a.clone").alias("clone"))  # one row
    own = held.join(F.broadcast(anchor), "clone", "left_semi").select("bin", F.col("y").alias("__xa"), F.lit(True).alias("__met"))
    met = held.join(own, "bin", "left").join(F.broadcast(anchor.withColumnRenamed("clone", "__anchor")), how="cross").withColumn("__xa", F.coalesce("__xa", F.lit(0.0)))
    near = Window.partitionBy("clone").orderBy("bin").rangeBetween(-width, width)
    weight = 1 / (F.col("__xa") + 1e-8)
    seen = met.select(
        "clone", "bin", "spots", (F.col("clone") == F.col("__anchor")).alias("anchor"), F.avg("dev").over(near).alias("local"),
        F.sum(weight * F.col("__xa") * F.col("y")).over(near).alias("xy"), F.sum(weight * F.col("__xa") * F.col("__xa")).over(near).alias("xx"), F.stddev_pop("log").over(near).alias("spread"),
    )
    least = F.min(F.when(F.col("spots") > 0, F.col("local"))).over(Window.partitionBy("bin"))
    slope = F.when(F.col("xx") > 1e-12, F.col("xy") / F.col("xx")).otherwise(0.0)
    fits = (F.col("spots") > 0) & ~F.col("anchor") & (F.col("local") <= F.col("__least") + margin) & slope.between(*amplitude)
    judged = seen.withColumn("__least", least).withColumn("fits", F.coalesce(fits, F.lit(False)))
    pools = judged.groupBy("bin").agg(
        F.max(F.when(F.col("anchor"), F.col("spread"))).alias("__own"),
        F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("spread", "clone")))).alias("__fit"),
    )
    pool = F.concat(F.array(F.coalesce("__own", F.lit(0.0))), F.transform("__fit", lambda c: c["spread"]))
    chosen = pools.withColumn("__pool", pool).select("bin", F.transform(F.slice("__fit", F.lit(1), kept_of_pool(F.col("__pool"), ratio) - 1), lambda c: c["clone"]).alias("__clones"))
    return judged.join(chosen, "bin").select("clone", "bin", ((F.col("anchor") & (F.col("spots") > 0)) | F.array_contains("__clones", F.col("clone"))).alias("normal"))


def local_normal_baseline(cells: DataFrame, labels: DataFrame, profiles: DataFrame, width: int = 100, least: int = 0, proportions: DataFrame | None = None, needed: float = 0.0) -> DataFrame:
    """(bin, spot, base): the baseline from each bin's normal spots.

    Normal are the clones of ``local_mask``; with ``proportions`` (spot,
    proportion) they are instead the spots of ``by_proportion``, in every bin.
    """
    if proportions is None:
        return local_baseline(cells, labels, local_mask(profiles, labels, cells, width), least)
    totals = cells.groupBy("spot").agg(F.sum("umi").alias("total"))
    pure = by_proportion(proportions, totals, needed).withColumn("__pure", F.lit(True))
    own = cells.select("spot").distinct().join(pure, "spot", "left").select("spot", F.when(F.col("__pure"), 1).otherwise(0).alias("clone"))
    mask = cells.select("bin").distinct().withColumn("clone", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("normal", F.col("clone") == 1)
    return local_baseline(cells, own, mask, least)


def local_baseline(cells: DataFrame, labels: DataFrame, local: DataFrame, least: int = 0) -> DataFrame:
    """(bin, spot, base): each bin's share among its locally normal spots times the spot's total; bins below ``least`` are not scored."""
    own = cells.join(labels, "spot").join(local, ["clone", "bin"]).groupBy("bin").agg(F.sum(F.when(F.col("normal"), F.col("umi")).otherwise(0)).alias("own"))
    own = own.where((F.col("own") >= least) & (F.col("own") > 0))
    whole = own.agg(F.sum("own").alias("whole"))  # one row
    share = own.join(F.broadcast(whole), how="cross").select("bin", (F.col("own") / F.col("whole")).alias("lam"))
    scored = cells.join(share, "bin")
    totals = scored.groupBy("spot").agg(F.sum("umi").alias("total"))
    return scored.join(totals, "spot").select("bin", "spot", (F.col("lam") * F.col("total")).alias("base"))


def reference_reads(reads: DataFrame, normal: DataFrame, genes: DataFrame) -> DataFrame:
    """(spot, gene, n): the normal spots' reads by the genes of a reference, columns of one name summed; reads of other genes are left out."""
    own = reads.join(normal.select("spot").distinct(), "spot", "left_semi").join(genes.select("gene").distinct(), "gene", "left_semi")
    return own.groupBy("spot", "gene").agg(F.sum("n").alias("n"))


def gene_baseline(reads: DataFrame, normal: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, chrom, start, end, lambda): the share of the normal spots' reads on each reference gene that the assay measures.

    A gene is measured if any spot has a row of it; one that no normal spot
    expresses has 0.  Of genes that a reference lists more than once the first
    by chromosome and start counts.  Without any reads shares are NULL.
    """
    measured = reads.select("gene").distinct()
    first = genes.groupBy("gene").agg(F.min(F.struct("chrom", "start", "end")).alias("g")).join(measured, "gene", "left_semi").select("gene", "g.*")
    sums = reference_reads(reads, normal, genes).groupBy("gene").agg(F.sum("n").alias("__n"))
    held = first.join(sums, "gene", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    whole = held.agg(F.sum("__n").alias("__whole"))  # one row
    return held.join(F.broadcast(whole), how="cross").select("gene", "chrom", "start", "end", F.try_divide(F.col("__n").cast("double"), F.col("__whole")).alias("lambda"))
