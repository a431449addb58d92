"""Output tables of a run, and records of several tables under one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clone_label_table(spots: DataFrame, labels: DataFrame, tumour: DataFrame | None = None) -> DataFrame:
    """(barcode, sample_id, x, y, clone_label[, tumor_proportion]) in the order of sample, x and y."""
    rows = spots.join(labels, "barcode")
    if tumour is not None:
        rows = rows.join(tumour, "barcode", "left")
    names = ["barcode", "sample_id", "x", "y", "clone_label"] + (["tumor_proportion"] if tumour is not None else [])
    return rows.select(*names).orderBy("sample_id", "x", "y")


def wide(df: DataFrame, keys: list[str], clone: str, clones: list[int], values: list[str]) -> DataFrame:
    """One row a key, one column ``clone{c} {value}`` for each clone and value."""
    aggs = [F.first(v).alias(v) for v in values]
    spread = df.groupBy(*keys).pivot(clone, clones).agg(*aggs)
    name = lambda c, v: f"{c}_{v}" if len(values) > 1 else f"{c}"
    return spread.select(*keys, *(F.col(f"`{name(c, v)}`").alias(f"clone{c} {v}") for c in clones for v in values))


def segment_table(paths: DataFrame, states: DataFrame, clones: list[int], key: str = "bin") -> DataFrame:
    """One row a bin: every clone's state with all that the state table (state, ...) says of it."""
    values = [c for c in states.columns if c != "state"]
    return wide(paths.join(F.broadcast(states), "state"), [key], "clone", clones, ["state", *values])


def state_table(states: DataFrame, clones: list[int], values: list[str]) -> DataFrame:
    """One row a state that every clone has: its parameters and copies in each."""
    n = len(clones)
    held = states.where(F.col("clone").isin(clones)).groupBy("state").agg(F.count_distinct("clone").alias("__n")).where(F.col("__n") == n).select("state")
    return wide(states.join(held, "state"), ["state"], "clone", clones, values)


def gene_table(genes: DataFrame, copies: DataFrame, clones: list[int], key: str = "bin") -> DataFrame:
    """One row a gene that lies in a bin: every clone's copies there."""
    placed = genes.where(F.col(key).isNotNull()).select("gene", key).distinct()
    return wide(placed.join(copies, key), ["gene"], "clone", clones, ["A", "B"])


def ledger_markdown(ledger: DataFrame, metrics: list[str]) -> str:
    """The ledger's runs as a table in Markdown, one line each, ``—`` where a metric is missing; runs are some hundreds of lines."""
    rows = ledger.groupBy("run_id", "fixture").pivot("metric", metrics).agg(F.max("value")).orderBy("run_id", "fixture").collect()
    head = ["run_id", "fixture", *metrics]
    text = lambda x: "—" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(text(r[c]) for c in head) + " |" for r in rows)])


def append_run(run: DataFrame, metrics: DataFrame, path: str) -> None:
    """Append a run and its metrics to the ledger under ``path``; a run id that is there, or a metric without a run, is refused."""
    spark = run.sparkSession
    try:
        old = spark.read.parquet(f"{path}/runs").select("run_id")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = run.select("run_id").limit(0)
    if not run.join(old, "run_id", "left_semi").isEmpty():
        raise ValueError("the run is in the ledger")
    if not metrics.join(run.select("run_id"), "run_id", "left_anti").isEmpty():
        raise ValueError("a metric is of no run")
    metrics.write.mode("append").parquet(f"{path}/metrics")
    run.write.mode("append").parquet(f"{path}/runs")


def long_profile(df: DataFrame, keys: list[str], clones: list[str]) -> DataFrame:
    """(keys, clone, a, b) from columns ``{clone}_A_copy`` and ``{clone}_B_copy``."""
    parts = F.array(*(F.struct(F.lit(c).alias("clone"), F.col(f"`{c}_A_copy`").cast("int").alias("a"), F.col(f"`{c}_B_copy`").cast("int").alias("b")) for c in clones))
    return df.select(*keys, F.inline(parts))


def write_record(spark: SparkSession, tables: dict[str, DataFrame], meta: dict, path: str) -> None:
    """Each table as Parquet; the meta table last, so that a record without it is not complete."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.range(1).select(F.lit(json.dumps(meta, sort_keys=True)).alias("meta"), F.lit(json.dumps(sorted(tables))).alias("tables")).write.mode("overwrite").json(f"{path}/_meta.json")


def read_record(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    head = spark.read.schema("meta string, tables string").json(f"{path}/_meta.json").first()
    if head is None:
        raise ValueError(f"{path} is not complete")
    return {name: spark.read.parquet(f"{path}/{name}") for name in json.loads(head["tables"])}, json.loads(head["meta"])


def content_hash(df: DataFrame) -> DataFrame:
    """One row (rows, hash): a digest that does not depend on the order of rows or partitions."""
    texts = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))))
    each = df.select(F.conv(F.substring(F.sha2(texts, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return each.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.coalesce(F.sum("h"), F.lit(0)).cast("string"), 256).alias("hash"))


def latest_metrics(ledger: DataFrame, definitions: DataFrame) -> DataFrame:
    """(run_id, fixture, metric, value): each metric under its latest definition only."""
    newest = Window.partitionBy("metric").orderBy(F.desc("since"), F.desc("definition"))
    known = definitions.withColumn("__at", F.row_number().over(newest)).where(F.col("__at") == 1).select("metric", "definition")
    return ledger.join(known, ["metric", "definition"]).select("run_id", "fixture", "metric", F.col("value").try_cast("double").alias("value"))
