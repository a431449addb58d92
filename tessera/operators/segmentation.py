"""Segmentations of a gene axis: labels that are contiguous and dense, and what can be done with them.

A segmentation is a table (contig, ord, segment): one row a gene in genomic
order, NULL where the gene is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import densified


def violations(labels: DataFrame, contig: str = "contig", order: str = "ord", label: str = "segment") -> DataFrame:
    """(label, contigs, rows, span): labels that lie in several contigs or leave gaps, and so are no segments.

    Dropped rows do not interrupt a segment, so places are counted among kept rows.
    """
    kept = labels.where(F.col(label).isNotNull()).withColumn("__at", F.row_number().over(Window.partitionBy(contig).orderBy(order)))
    shape = kept.groupBy(label).agg(F.count_distinct(contig).alias("contigs"), F.count(F.lit(1)).alias("rows"), (F.max("__at") - F.min("__at") + 1).cast("long").alias("span"))
    return shape.where("contigs > 1 OR span > rows")


def from_labels(rows: DataFrame, label: str, name: str = "segment") -> DataFrame:
    """``rows`` with labels numbered densely from 0 in their order; NULL and negative labels are dropped rows."""
    kept = F.when(F.col(label) >= 0, F.col(label))
    clean = rows.withColumn("__label", kept)
    codes = densified(clean, "__label", name)
    return clean.join(codes, "__label", "left").drop("__label")


def coarsened(labels: DataFrame, parents: DataFrame, label: str = "segment", parent: str = "parent") -> DataFrame:
    """``labels`` under each segment's parent; a segment without one, or with a negative one, is dropped."""
    known = parents.select(F.col(label), F.when(F.col(parent) >= 0, F.col(parent)).alias("__parent"))
    return labels.join(known, label, "left").drop(label).withColumnRenamed("__parent", label)


def selected(labels: DataFrame, keep: DataFrame, label: str = "segment") -> DataFrame:
    """``labels`` with only the segments of ``keep``, numbered anew in their order."""
    held = labels.join(keep.select(label).distinct().withColumn("__kept", F.lit(True)), label, "left")
    only = held.withColumn("__label", F.when(F.col("__kept"), F.col(label))).drop(label, "__kept")
    return from_labels(only, "__label", label).drop("__label")


def to_genes(labels: DataFrame, values: DataFrame, label: str, value: str, fill) -> DataFrame:
    """``labels`` with each segment's value; dropped genes and unknown segments have ``fill``."""
    return labels.join(values.select(label, value), label, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def over_segments(labels: DataFrame, label: str, value: str, reduce: Callable[[str], Column]) -> DataFrame:
    """(segment, value): any aggregate of a gene column over each segment."""
    return labels.where(F.col(label).isNotNull()).groupBy(label).agg(reduce(value).alias(value))


def contig_lengths(labels: DataFrame, contig: str = "contig", label: str = "segment") -> DataFrame:
    """(contig, segments): how many segments each contig has."""
    return labels.where(F.col(label).isNotNull()).groupBy(contig).agg(F.count_distinct(label).alias("segments"))


def stacked(values: DataFrame, clones: int, clone: str = "clone") -> DataFrame:
    """Each row once for every clone, as one long axis by clone and then by the table's own key."""
    return values.withColumn(clone, F.explode(F.sequence(F.lit(0), F.lit(clones - 1))))


def lineage(levels: dict[str, DataFrame], key: list[str], label: str = "segment") -> DataFrame:
    """One row a gene with its segment in each level, in the order the levels are given."""
    out = None
    for name, labels in levels.items():
        own = labels.select(*key, F.col(label).alias(name))
        out = own if out is None else out.join(own, key, "full")
    return out


def state_runs(path: DataFrame, clone: str, contig: str, order: str, state: str) -> DataFrame:
    """(clone, contig, run, state, first, last, n): runs of one state that end at contig edges."""
    along = Window.partitionBy(clone, contig).orderBy(order)
    opens = F.when(F.col(state).eqNullSafe(F.lag(state).over(along)) & (F.row_number().over(along) > 1), 0).otherwise(1)
    marked = path.select(clone, contig, F.col(order), state, opens.alias("__new"))
    numbered = marked.withColumn("run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(clone, contig, "run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def warped(points: DataFrame, knots: DataFrame, contig: str, at: str, name: str, back: bool = False) -> DataFrame:
    """``points`` on the piecewise linear map through the knots (contig, u, v), or on its inverse."""
    from tessera.operators.intervals import interpolate

    here, there = ("v", "u") if back else ("u", "v")
    return interpolate(points, knots.select(contig, F.col(here).alias("__knot"), F.col(there).alias(name)), contig, at, "__knot", name)


def split_ranges(ranges: DataFrame, start: str, end: str, longest: int) -> DataFrame:
    """Ranges in pieces of at most ``longest``, counted from each range's start, with the ``piece`` number."""
    n = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start)) / longest)).cast("int")
    cut = ranges.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    begin = F.col(start) + F.col("piece") * longest
    return cut.withColumns({"__from": begin, "__to": F.least(F.col(end), begin + longest)}).drop(start, end).withColumnsRenamed({"__from": start, "__to": end})


def collapsed(ranges: DataFrame, contig: str, start: str, end: str, *states: str) -> DataFrame:
    """Neighbouring ranges of equal states as one, in the order of their starts."""
    along = Window.partitionBy(contig).orderBy(start, end)
    same = F.lit(True)
    for s in states:
        same = same & F.col(s).eqNullSafe(F.lag(s).over(along))
    marked = ranges.withColumn("__new", F.when(same & (F.row_number().over(along) > 1), 0).otherwise(1))
    runs = marked.withColumn("__run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(contig, "__run", *states).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")
