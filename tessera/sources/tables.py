"""Readers and writers of the pipeline's files as tables with declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranking import numbered

AUTOSOMES = [f"chr{i}" for i in range(1, 23)]


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated sheet with ``#`` comments and a header; the four required columns must be there."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    head = lines.first()
    if head is None:
        raise ValueError("the sample sheet is empty")
    names = head["value"].split()
    missing = {"bam", "sample_id", "spaceranger_dir", "snp_dir"} - set(names)
    if missing:
        raise ValueError(f"the sample sheet lacks {', '.join(sorted(missing))}")
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.col("value") != head["value"]).select(*(F.get(parts, i).alias(n) for i, n in enumerate(names)))


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, barcode, sample_id) of a headerless file, ``ord`` being the line's place in it; what follows the last underscore is the sample."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("within"))
    # within a block of the file ids follow the lines
    rows = numbered(lines, "file", "block", "within", name="ord").select("ord", F.col("value").alias("combined_barcode"))
    parts = F.split("combined_barcode", "_")
    sample = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    return rows.select("ord", "combined_barcode", F.get(parts, F.lit(0)).alias("barcode"), sample.alias("sample_id"))


def tissue_positions(spark: SparkSession, path: str, in_tissue: bool = True) -> DataFrame:
    """Spot positions from Parquet, or CSV with or without a header."""
    names = ["barcode", "in_tissue", "x", "y", "pixel_row", "pixel_col"]
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path).toDF(*names)
    else:
        raw = spark.read.csv(path).toDF(*names).where(F.col("in_tissue").try_cast("int").isNotNull())
    rows = raw.select("barcode", *(F.col(n).cast("string").try_cast("int").alias(n) for n in names[1:]))
    return rows.where("in_tissue = 1") if in_tissue else rows


def genes(spark: SparkSession, path: str) -> DataFrame:
    """Reference genes on the autosomes, with the chromosome as a number."""
    rows = spark.read.csv(path, sep="\t", header=True).where(F.col("chrom").isin(AUTOSOMES))
    return rows.select(F.col("name2").alias("gene"), F.substring("chrom", 4, 2).cast("int").alias("chr"), F.col("cdsStart").cast("long").alias("start"), F.col("cdsEnd").cast("long").alias("end"))


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, cm) of a genetic map on the autosomes."""
    rows = spark.read.csv(path, sep="\t", header=True).where(F.col("chrom").isin(AUTOSOMES))
    return rows.select(F.substring("chrom", 4, 2).cast("int").alias("chr"), F.col("pos").cast("long").alias("pos"), F.col("pos_cm").cast("double").alias("cm"))


def gene_denylist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path).select(F.col("_c0").alias("gene"))


def excluded_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end) of a headerless BED-like file; ``chr`` prefixes go, row by row."""
    rows = spark.read.csv(path, sep="\t", schema="chr string, start long, end long")
    return rows.withColumn("chr", F.regexp_replace("chr", "^chr", ""))


def clone_labels(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, label): ``normal`` is 0 and ``clone_k`` is k + 1."""
    rows = spark.read.csv(path, sep="\t", header=True)
    number = F.regexp_extract("labels", r"^clone_(\d+)$", 1)
    return rows.select("barcode", F.when(F.col("labels") == "normal", 0).otherwise(number.try_cast("int") + 1).alias("label"))


def strict_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A TSV of text whose header is exactly ``columns``; rows of another width fail."""
    head = spark.read.text(path).first()
    if head is None or head["value"].split("\t") != columns:
        raise ValueError(f"the header is not {columns}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """A folder of TSV parts, one for each partition."""
    df.write.option("sep", "\t").option("header", header).csv(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append metric lines; a tab or line break in a cell is refused."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    bad = df.where(F.exists(F.array(*texts), lambda x: x.rlike(r"[\t\r\n]"))) if texts else df.limit(0)
    if not bad.isEmpty():
        raise ValueError("a cell holds a tab or a line break")
    df.write.mode("append").parquet(path)
