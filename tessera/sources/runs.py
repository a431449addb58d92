"""Whole inputs and runs: the load of a sample with all its filters, simulated samples, proportions, staged results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import counts, filters, intervals
from tessera.sources.outputs import content_hash, long_profile


def clone_ranges(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """((chr, start, end, ...), missing) of a TSV; columns that should be there and are not are named, not refused."""
    rows = spark.read.csv(path, sep="\t", header=True)
    missing = [c for c in ("chr", "start", "end", *columns) if c not in rows.columns]
    kinds = {c: F.col(c).cast("long") for c in ("start", "end") if c in rows.columns}
    if "chr" in rows.columns:
        kinds["chr"] = F.regexp_replace("chr", "^chr", "")
    return rows.withColumns(kinds), missing


def tumour_proportions(spark: SparkSession, path: str, spots: DataFrame) -> DataFrame:
    """(spot, proportion) of a TSV whose first column names exactly the spots; NULL where it gives no number."""
    rows = spark.read.csv(path, sep="\t", header=True)
    found = rows.select(F.col(f"`{rows.columns[0]}`").alias("spot"), F.col("Tumor").try_cast("double").alias("proportion"))
    if not found.join(spots, "spot", "left_anti").isEmpty() or not spots.join(found, "spot", "left_anti").isEmpty():
        raise ValueError("the proportions are not of these spots")
    return found


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], on: bool = True) -> DataFrame:
    """The table under ``path``, made and written there first if it is not complete; ``on`` false makes it anew without a file."""
    if not on:
        return make()
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_staged(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet with its digest beside it; the digests come last, so that what lacks them is not complete."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    marks = [content_hash(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("name"), "rows", "hash") for name in tables]
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    out.write.mode("overwrite").parquet(f"{path}/_digests")


def read_staged(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One staged table, if its digest still holds."""
    mark = spark.read.parquet(f"{path}/_digests").where(F.col("name") == name).first()
    if mark is None:
        raise ValueError(f"{name} is not staged")
    df = spark.read.parquet(f"{path}/{name}")
    if content_hash(df).first()["hash"] != mark["hash"]:
        raise ValueError(f"{name} is not what was staged")
    return df


def simulated(spark: SparkSession, folder: str, clones: list[str]) -> tuple[DataFrame, DataFrame]:
    """((barcode, label), (chr, start, end, clone, a, b)) of a simulated sample's folder."""
    labels = spark.read.csv(f"{folder}/labels.tsv", sep="\t", header=True).select("barcode", F.col("label"))
    profile = spark.read.csv(f"{folder}/profile.tsv", sep="\t", header=True).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})
    return labels, long_profile(profile, ["chr", "start", "end"], clones)


def realization(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of a drawn sample, by name: those that are there of profile, tree, events, phase, sites and labels."""
    out = {}
    for name in ("profile", "tree", "events", "phase", "sites", "labels", "counts", "alleles", "spots"):
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def run_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A run's labels, copies and fit, staged or, failing that, from its TSV files."""
    try:
        return {n: read_staged(spark, folder, n) for n in ("labels", "copies", "fit")}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    tsv = lambda n: spark.read.csv(f"{folder}/{n}.tsv", sep="\t", header=True, inferSchema=True)
    return {"labels": tsv("clone_labels"), "copies": tsv("cnv_seglevel"), "fit": tsv("cnv_perstate")}


def loaded(
    reads: DataFrame,
    alleles: DataFrame,
    positions: DataFrame,
    least: float = 0,
    share: float = 0.0,
    denied: DataFrame | None = None,
    excluded: DataFrame | None = None,
    outliers: bool = False,
    quantile: float | None = None,
) -> dict[str, DataFrame]:
    """``counts, alleles, spots`` of a sample after the whole load.

    Spots are those with a position, gene reads and allele reads, and enough of
    both; genes are expressed in enough of them and not denied; sites
    (``contig_pos_...``) lie in no excluded range (chr, start, end).  Outlying
    genes count 0, or the largest are damped to a twentieth of the others.
    """
    kept = positions.select("spot").distinct().join(reads, "spot", "left_semi").join(alleles, "spot", "left_semi")
    reads, alleles = reads.join(kept, "spot", "left_semi"), alleles.join(kept, "spot", "left_semi")
    if least:
        kept = filters.covered_spots(reads, alleles, least)
        reads, alleles = reads.join(kept, "spot", "left_semi"), alleles.join(kept, "spot", "left_semi")
    if share:
        reads = counts.keep_expressed(reads, "gene", "spot", "n", share)
    if denied is not None:
        reads = reads.join(denied, "gene", "left_anti")
    if excluded is not None:
        parts = F.split("snp", "_")
        sites = alleles.select("snp").distinct().select("snp", F.get(parts, F.lit(0)).alias("chr"), F.get(parts, F.lit(1)).cast("long").alias("pos"))
        outside = intervals.outside(sites, excluded, "chr", "pos", "start", "end")
        alleles = alleles.join(outside.select("snp"), "snp", "left_semi")
    totals = reads.groupBy("gene").agg(F.sum("n").alias("total"))
    if outliers:
        reads = filters.dropped_counts(reads, filters.local_outliers(totals, "gene", "total"))
    elif quantile is not None:
        damped = counts.damp_outliers(totals, "gene", "total", quantile, 0.05)
        factor = damped.select("gene", F.try_divide(F.col("damped").cast("double"), F.col("total")).alias("__f"))
        reads = reads.join(factor, "gene").withColumn("n", F.floor(F.col("n") * F.coalesce("__f", F.lit(1.0)) + 1e-9).cast("long")).drop("__f")
    return {"counts": reads, "alleles": alleles, "spots": positions.join(kept, "spot", "left_semi")}


def write_sample(tables: dict[str, DataFrame], folder: str, by: dict[str, str] | None = None) -> None:
    """A sample's folder: each table as Parquet, parted by a column where ``by`` names one."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by[name]) if by and name in by else writer).parquet(f"{folder}/{name}")
