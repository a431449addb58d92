"""Positions in a global order without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import stage


def numbered(df: DataFrame, *order: str, name: str = "at") -> DataFrame:
    """Adds each row's position from 0 in the order of the columns.

    Rows are dealt by range, once; each range is numbered on its own and starts
    after the exact count of those before it, one number a range.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append(f"({part}, {before}L)")
        before += counts[part]
    if not offsets:
        return df.limit(0).withColumn(name, F.lit(None).cast("long"))
    starts = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(offsets)} AS t(__part, __before)")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__before") + own).cast("long")).drop("__part", "__before")


def top_per_group(df: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each group."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__at", at).where(F.col("__at") <= k).drop("__at")


def first_rows(df: DataFrame, group: str, *order) -> DataFrame:
    """The first row of each group in an order."""
    return top_per_group(df, group, 1, *order)


def densified(df: DataFrame, label: str, name: str) -> DataFrame:
    """(label, name): distinct labels numbered from 0 in order."""
    return numbered(df.select(label).where(F.col(label).isNotNull()).distinct(), label, name=name)
