"""Count matrices and other arrays from files: Matrix Market text, NumPy arrays and compressed sparse rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import barcodes
from tessera.staging import stage


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of coordinate Matrix Market files, from 0; comments and each file's line of sizes are passed over."""
    lines, first = _market_lines(spark, path)
    entries = lines.join(F.broadcast(first), ["file", "block", "id"], "left_anti")
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.get(parts, F.lit(i))
    return entries.select((number(0).cast("long") - 1).alias("row"), (number(1).cast("long") - 1).alias("col"), F.coalesce(number(2).try_cast("double"), F.lit(1.0)).alias("value"))


def _market_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, block, id, value), (file, block, id)): lines that are no comments, and the first such line of each file, which has its sizes."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    lines = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # ids rise along a block, whatever else its partition holds, so the least of a file is its first line; least numbers are hashed, so no task sorts its lines
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("id"))
    return lines, blocks.groupBy("file").agg(F.min(F.struct("block", "id")).alias("f")).select("file", "f.block", "f.id")


def write_matrix_market(cells: DataFrame, path: str, a_file: int = 1 << 20) -> None:
    """(row, col, value), counted from 0, as Matrix Market files of some ``a_file`` entries, each whole in its form and held by one task; at least one file."""
    cells = stage(cells.select("row", "col", "value"), "cells")
    line = F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("value").cast("string"))
    dealt = cells.repartition(max(1, -(-cells.count() // a_file)), "row", "col").select("row", "col", line.alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        rows, cols = (max((pc.max(b.column(i)).as_py() for b in held), default=-1) + 1 for i in (0, 1))
        head = ["%%MatrixMarket matrix coordinate real general", "% entries from 1", f"{rows} {cols} {sum(b.num_rows for b in held)}"]
        yield pa.RecordBatch.from_arrays([pa.array(head)], ["value"])
        yield from (pa.RecordBatch.from_arrays([b.column(2)], ["value"]) for b in held)

    dealt.mapInArrow(run, "value string").write.text(path)


def matrix_market_faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, cols, entries, found, beyond): files whose entries are not as many as their line of sizes says, or lie outside it."""
    lines, first = _market_lines(spark, path)
    part = lambda c, i: F.get(F.split(F.trim(c), r"\s+"), F.lit(i)).try_cast("long")
    own = lines.join(F.broadcast(first), ["file", "block", "id"])
    sizes = own.select("file", F.struct("block", "id").alias("__first"), part("value", 0).alias("rows"), part("value", 1).alias("cols"), part("value", 2).alias("entries"))
    met = lines.join(F.broadcast(sizes), "file")
    entry = F.struct("block", "id") != F.col("__first")
    outside = entry & ~F.coalesce(part("value", 0).between(1, F.col("rows")) & part("value", 1).between(1, F.col("cols")), F.lit(False))
    sums = met.groupBy("file", "rows", "cols", "entries").agg(F.count_if(entry).alias("found"), F.count_if(outside).alias("beyond"))
    return sums.where(~F.col("entries").eqNullSafe(F.col("found")) | (F.col("beyond") > 0))


def _of_files(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """Rows that ``read`` yields, in batches, of each file's bytes; a file is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from read(io.BytesIO(content.as_buffer()))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def npy(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """(at, value) of a one-dimensional NumPy array; objects are refused."""

    def read(file) -> Iterator[pa.RecordBatch]:
        values = np.load(file, allow_pickle=False)
        for lo in range(0, len(values), 100_000):
            part = values[lo : lo + 100_000]
            typed = pa.array([str(v) for v in part]) if kind == "string" else pa.array(part.astype({"long": np.int64, "double": float}[kind]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), typed], ["at", "value"])

    return _of_files(spark, path, read, f"at long, value {kind}")


def npz_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a matrix of compressed sparse rows, as saved with its data, indices and pointers; zeros that are stored are left out."""

    def read(file) -> Iterator[pa.RecordBatch]:
        with np.load(file, allow_pickle=False) as held:
            data, indices, pointers = held["data"], held["indices"], held["indptr"]
        row = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
        kept = np.flatnonzero(data)
        for lo in range(0, len(kept), 500_000):
            at = kept[lo : lo + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(row[at].astype(np.int64)), pa.array(indices[at].astype(np.int64)), pa.array(data[at].astype(float))], ["row", "col", "value"])

    return _of_files(spark, path, read, "row long, col long, value double")


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``rows`` with repeated names told apart: the first keeps its name, later ones get ``-1``, ``-2`` and so on."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return rows.withColumn("__nth", nth).withColumn(name, F.when(F.col("__nth") == 0, F.col(name)).otherwise(F.concat_ws("-", name, F.col("__nth").cast("string")))).drop("__nth")


def feature_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(spot, gene, n) of a folder with ``matrix.mtx``, ``barcodes.tsv`` and ``features.tsv`` (or their ``.gz``); rows are genes.

    Counts that are no numbers are 0 and left out; repeated gene names are told apart.
    """
    at = lambda name: f"{folder}/{name}*"
    cells = matrix_market(spark, at("matrix.mtx"))
    spots = barcodes(spark, at("barcodes.tsv")).select(F.col("ord").alias("col"), F.col("combined_barcode").alias("spot"))
    features = barcodes(spark, at("features.tsv")).select(F.col("ord").alias("row"), F.split("combined_barcode", "\t").alias("f"))
    genes = unique_names(features.select("row", F.coalesce(F.get("f", F.lit(1)), F.get("f", F.lit(0))).alias("gene")), "gene", "row")
    n = F.when(F.isnan("value"), 0).otherwise(F.col("value")).cast("long")
    return cells.join(spots, "col").join(genes, "row").select("spot", "gene", n.alias("n")).where("n <> 0")


def allele_counts(spark: SparkSession, folder: str, spots: DataFrame) -> DataFrame:
    """(spot, snp, a, b) of ``unique_snp_ids.npy`` and the two matrices of spots by sites; ``spots`` is (ord, spot)."""
    sites = npy(spark, f"{folder}/unique_snp_ids.npy").select(F.col("at").alias("col"), F.col("value").alias("snp"))
    zero = F.lit(0.0)
    a = npz_sparse(spark, f"{folder}/cell_snp_Aallele.npz").select("row", "col", F.col("value").alias("a"), zero.alias("b"))
    b = npz_sparse(spark, f"{folder}/cell_snp_Ballele.npz").select("row", "col", zero.alias("a"), F.col("value").alias("b"))
    both = a.unionByName(b).groupBy("row", "col").agg(F.sum("a").cast("long").alias("a"), F.sum("b").cast("long").alias("b"))
    return both.join(sites, "col").join(spots.select(F.col("ord").alias("row"), "spot"), "row").select("spot", "snp", "a", "b")
