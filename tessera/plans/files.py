"""Queries that write a table in a file form and read it back, load a sample whole, or draw one and sum it up again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import simulate
from tessera.sources import arrays, outputs, runs, tables
from tessera.staging import scratch

from .registry import query, table


def _folder(spark, name: str) -> str:
    return scratch(spark, f"files-{name}")


@query("SELECT l_suppkey AS \"row\", l_partkey AS col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2")
def matrix_market_round_trip(spark, sf_dir):
    """Counts as Matrix Market text, entries numbered from 1, and back."""
    path = _folder(spark, "mtx")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), "l_quantity")
    # few cells repeat, so they are summed after their shuffle
    cells = lines.repartition("row", "col").groupBy("row", "col").agg(F.sum("l_quantity").cast("double").alias("value"))
    arrays.write_matrix_market(cells, path)
    return arrays.matrix_market(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tsv_round_trip(spark, sf_dir):
    path = _folder(spark, "tsv")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    tables.write_tsv(nations.select(*(F.col(c).cast("string") for c in nations.columns)).coalesce(1), path)
    back = tables.strict_tsv(spark, path, nations.columns)
    return back.select(*(F.col(c).cast(k).alias(c) for c, k in nations.dtypes))


@query("SELECT 'customer' AS name, count(*) AS rows_n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier")
def staged_round_trip(spark, sf_dir):
    """Two tables staged with their digests, read back only if these hold."""
    path = _folder(spark, "staged")
    runs.write_staged({n: table(spark, sf_dir, n) for n in ("customer", "supplier")}, path)
    one = lambda n, key: runs.read_staged(spark, path, n).agg(F.count(F.lit(1)).alias("rows_n"), F.sum(key).alias("keys")).select(F.lit(n).alias("name"), "rows_n", "keys")
    return one("customer", "c_custkey").unionByName(one("supplier", "s_suppkey"))


@query("SELECT r_regionkey, r_name FROM region")
def record_round_trip(spark, sf_dir):
    path = _folder(spark, "record")
    outputs.write_record(spark, {"region": table(spark, sf_dir, "region").select("r_regionkey", "r_name")}, {"made": "here"}, path)
    return outputs.read_record(spark, path)[0]["region"]


@query("""
WITH n AS (SELECT l_suppkey AS spot, l_partkey AS gene, CAST(l_quantity AS BIGINT) AS n FROM lineitem), a AS (SELECT l_suppkey AS spot, l_orderkey % 3 AS c, l_orderkey AS p, l_linenumber AS a, 1 AS b FROM lineitem),
s AS (SELECT s_suppkey AS spot FROM supplier WHERE s_nationkey < 20), k AS (SELECT spot FROM s WHERE spot IN (SELECT spot FROM n) AND spot IN (SELECT spot FROM a)),
u AS (SELECT spot FROM n JOIN k USING (spot) GROUP BY spot HAVING sum(n) >= 500), v AS (SELECT spot FROM a JOIN k USING (spot) GROUP BY spot HAVING sum(a + b) >= 500), f AS (SELECT spot FROM u JOIN v USING (spot)),
d AS (SELECT p_partkey AS gene FROM part WHERE p_size > 45), g AS (SELECT gene, sum(n) AS n FROM n JOIN f USING (spot) WHERE gene NOT IN (FROM d) GROUP BY gene),
x AS (SELECT count(*) AS m FROM a JOIN f USING (spot) WHERE NOT (c = 1 AND p >= 100 AND p < 700))
SELECT CAST(sum(n) AS BIGINT) AS umi, count(*) AS genes, (SELECT m FROM x) AS site_rows, (SELECT count(*) FROM f) AS spots FROM g
""")
def loaded_sample(spark, sf_dir):
    """The whole load with its spot, gene and range filters, summed up."""
    rows = table(spark, sf_dir, "lineitem")
    reads = rows.select(F.col("l_suppkey").alias("spot"), F.col("l_partkey").alias("gene"), F.col("l_quantity").cast("long").alias("n"))
    alleles = rows.select(F.col("l_suppkey").alias("spot"), F.concat_ws("_", (F.col("l_orderkey") % 3).cast("string"), F.col("l_orderkey").cast("string")).alias("snp"), F.col("l_linenumber").alias("a"), F.lit(1).alias("b"))
    positions = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("spot"))
    denied = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("gene"))
    excluded = spark.range(1).select(F.lit("1").alias("chr"), F.lit(100).cast("long").alias("start"), F.lit(700).cast("long").alias("end"))
    got = runs.loaded(reads, alleles, positions, least=500, denied=denied, excluded=excluded)
    genes = got["counts"].agg(F.sum("n").alias("umi"), F.count_distinct("gene").alias("genes"))
    # each side is one row
    sites, spots = got["alleles"].agg(F.count(F.lit(1)).alias("site_rows")), got["spots"].agg(F.count(F.lit(1)).alias("spots"))
    return genes.join(sites, how="cross").join(spots, how="cross")


@query("SELECT s_suppkey AS spot, CAST(20 + s_suppkey % 50 AS BIGINT) AS depth FROM supplier")
def drawn_depths(spark, sf_dir):
    """Dirichlet-multinomial counts of each spot, by gammas and by the urn, summed up to the depth they were drawn with."""
    spots = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot"), (F.col("s_suppkey") % 2).alias("label"), (20 + F.col("s_suppkey") % 50).alias("depth"))
    weights = {0: [5.0, 3.0, 1.0, 1.0], 1: [1.0, 1.0, 3.0, 5.0]}
    each = [simulate.dirichlet_multinomial(spots.where(F.col("spot") % 2 == k), weights, 30.0, seed=3, urn=bool(k)) for k in (0, 1)]
    return each[0].unionByName(each[1]).groupBy("spot").agg(F.sum("n").alias("depth"))


@query("SELECT l_partkey % 40 AS bin, l_suppkey AS spot, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS umi FROM lineitem GROUP BY 1, 2 HAVING sum(CAST(l_quantity AS BIGINT)) > 0")
def unsegmented_bins(spark, sf_dir):
    """Bins taken back to genes and binned again."""
    bins = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 40).alias("bin"), F.col("l_suppkey").alias("spot")).agg(F.sum(F.col("l_quantity").cast("long")).alias("umi"))
    return simulate.unsegmented(bins, 5, seed=1).groupBy("bin", "spot").agg(F.sum("n").alias("umi"))


@query("SELECT l_suppkey AS spot, l_orderkey AS snp, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def drawn_alleles(spark, sf_dir):
    """Beta-binomial reads of both alleles, flipped sites and all, add up to what was drawn for."""
    trials = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("spot"), F.col("l_orderkey").alias("snp")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    trials = trials.withColumns({"share": F.lit(0.3), "flipped": F.col("snp") % 2 == 0})
    return simulate.allele_reads(trials, 20.0, seed=2).select("spot", "snp", (F.col("a") + F.col("b")).alias("total"))


@query("""
WITH p AS (SELECT c_custkey AS id, c_custkey % 37 AS x, c_custkey // 37 AS y FROM customer), b AS (SELECT min(x) AS lo, max(x) AS hi FROM p)
SELECT id, CASE WHEN x >= 5 AND x < 12 AND y >= 1 AND y < 3 THEN 2 WHEN x >= 2 AND x < 20 AND y >= 0 AND y < 4 THEN 1 ELSE 0 END::BIGINT AS label, CAST(least(3, floor((x - lo) * 4.0 / (hi - lo))) AS BIGINT) AS band FROM p, b
""")
def layouts(spark, sf_dir):
    """Spots in two boxes, the later on top, and in bands."""
    key = F.col("c_custkey")
    spots = table(spark, sf_dir, "customer").select(key.alias("id"), (key % 37).alias("x"), F.call_function("div", key, F.lit(37)).alias("y"))
    box = lambda x0, x1, y0, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    placed = simulate.laid_out(spots, [box(2, 20, 0, 4), box(5, 12, 1, 3)])
    return simulate.banded_layout(placed.withColumnRenamed("label", "own"), 4).select("id", F.col("own").alias("label"), F.col("label").alias("band"))
