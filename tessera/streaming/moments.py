"""Running moments of results as they arrive, and a ledger that a stream appends to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moments(results: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, variance) of a stream or a table; the sample variance is 0 for one value.  NULLs are passed over."""
    seen = results.where(F.col(value).isNotNull()).groupBy(group)
    return seen.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))


def ledger_stream(results: DataFrame, path: str, checkpoint: str):
    """A query that appends each batch of a stream to the Parquet ledger under ``path``; its progress is kept under ``checkpoint``.

    A batch that is run again after a failure replaces its own rows, so that
    none is in the ledger twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
