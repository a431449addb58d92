"""The stream forms against the same rows as a table."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming.moments import ledger_stream, running_moments


def test_ledger_and_moments_of_a_stream(spark, tmp_path):
    rows = [("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None), ("a", 8.0)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "run string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger_stream(stream, str(tmp_path / "ledger"), str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    assert sorted(map(tuple, ledger.select("run", "v").collect()), key=str) == sorted(rows, key=str)
    assert ledger.select(F.count_distinct("batch")).first()[0] == 2
    running_moments(stream, "run", "v").writeStream.outputMode("complete").format("memory").queryName("moments").trigger(availableNow=True).start().awaitTermination()
    got = {r["run"]: (r["n"], r["mean"], r["variance"]) for r in spark.table("moments").collect()}
    assert got["a"] == pytest.approx((3, 4.0, 13.0)) and got["b"] == (1, 5.0, 0.0)
