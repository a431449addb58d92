"""Queries of spatial operators: partitions, neighbour graphs, Potts energy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import cuts, spatial

from .registry import query, table

POINTS = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS BIGINT) AS label FROM embeddings)"
KNN = """
k AS (SELECT src, dst, rank, d2 FROM (
  SELECT a.id AS src, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
         row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rank
  FROM p a JOIN p b ON a.id <> b.id) WHERE rank <= 8)
"""
EDGES = "e AS (SELECT src, dst, count(*) / 2.0 AS w FROM (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k) GROUP BY 1, 2)"
FIELD = "f AS (SELECT id AS spot, c AS label, -abs(label - c) / 10.0 AS value FROM p, range(10) r(c))"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), F.col("label").cast("long").alias("label"))


def _graph(spark, sf_dir):
    near = spatial.nearest(_points(spark, sf_dir), "id", "x", "y", 8).select("src", "dst")
    both = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg((F.count(F.lit(1)) / 2).alias("w"))


def _field(spark, sf_dir):
    each = _points(spark, sf_dir).select(F.col("id").alias("spot"), "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("c"))
    return each.select("spot", F.col("c").alias("label"), (-F.abs(F.col("label") - F.col("c")) / 10.0).alias("value"))


def _labels(spark, sf_dir):
    return _points(spark, sf_dir).select(F.col("id").alias("spot"), (F.col("id") % 10).alias("label"))


@query(f"WITH {POINTS} SELECT id, CAST(floor((row_number() OVER (ORDER BY x, id) - 1) * 6 / count(*) OVER ()) AS BIGINT) AS band FROM p")
def equal_bands(spark, sf_dir):
    return spatial.equal_bands(_points(spark, sf_dir), "x", "id", 6).select("id", "band")


@query(f"""
WITH {POINTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT id, CAST(((x > x0 + (x1 - x0) * 1 / 3)::INT + (x > x0 + (x1 - x0) * 2 / 3)::INT) * 2 + (y > y0 + (y1 - y0) * 1 / 2)::INT AS BIGINT) AS cell FROM p, b
""")
def grid_partition(spark, sf_dir):
    return spatial.grid(_points(spark, sf_dir), "x", "y", 3, 2).select("id", "cell")


@query(f"WITH {POINTS}, {KNN} SELECT src, dst, rank, round(d2, 9) AS d2 FROM k")
def knn_graph(spark, sf_dir):
    return spatial.nearest(_points(spark, sf_dir), "id", "x", "y", 8).withColumn("d2", F.round("d2", 9))


@query("""
WITH p AS (SELECT c_custkey AS id, c_custkey // 50 AS r, c_custkey % 50 AS c FROM customer),
o(dr, dc) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
e AS (SELECT a.id AS src, b.id AS dst FROM p a JOIN o ON true JOIN p b ON b.r = a.r + dr AND b.c = a.c + dc),
d AS (SELECT src, count(*) AS d FROM e GROUP BY src)
SELECT e.src, e.dst, round((4.0 / d1.d + 4.0 / d2.d) / 2, 6) AS w FROM e JOIN d d1 ON d1.src = e.src JOIN d d2 ON d2.src = e.dst
""")
def lattice_edges(spark, sf_dir):
    spots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.call_function("div", F.col("c_custkey"), F.lit(50)).alias("r"), (F.col("c_custkey") % 50).alias("c"))
    return spatial.lattice_edges(spots, "id", "r", "c", [(0, 1), (0, -1), (1, 0), (-1, 0)]).withColumn("w", F.round("w", 6))


@query(f"""
WITH {POINTS}, {KNN}, {EDGES}, {FIELD},
l AS (SELECT id AS spot, id % 10 AS label FROM p),
o AS (SELECT sum(value) AS field FROM f JOIN l USING (spot, label)),
a AS (SELECT coalesce(sum(w), 0) / 2 AS aligned FROM e JOIN l a ON a.spot = src JOIN l b ON b.spot = dst WHERE a.label = b.label)
SELECT round(field, 4) AS field, round(aligned, 4) AS aligned, round(field + 1.5 * aligned, 4) AS total FROM o, a
""")
def potts_energy(spark, sf_dir):
    found = spatial.potts_energy(_field(spark, sf_dir), _graph(spark, sf_dir), _labels(spark, sf_dir), 1.5)
    return found.select(*(F.round(c, 4).alias(c) for c in found.columns))


@query(f"""
WITH {POINTS}, {KNN}, {EDGES}, {FIELD},
l AS (SELECT id AS spot, id % 10 AS label FROM p),
s AS (SELECT l.label AS u, f.label AS v, sum(value) AS s FROM l JOIN f USING (spot) GROUP BY 1, 2),
g AS (SELECT a.label AS u, b.label AS v, sum(w) AS g FROM e JOIN l a ON a.spot = src JOIN l b ON b.spot = dst WHERE a.label <> b.label GROUP BY 1, 2)
SELECT g.u, g.v, round(s.s - own.s + 1.5 * (g.g + coalesce(b.g, 0)) / 2, 4) AS gain
FROM g LEFT JOIN g b ON b.u = g.v AND b.v = g.u JOIN s ON s.u = g.u AND s.v = g.v JOIN s own ON own.u = g.u AND own.v = g.u
""")
def merge_gain(spark, sf_dir):
    return spatial.merge_gains(_field(spark, sf_dir), _graph(spark, sf_dir), _labels(spark, sf_dir), 1.5).withColumn("gain", F.round("gain", 4))


@query()
def icm_sweep(spark, sf_dir):
    return spatial.icm(_field(spark, sf_dir), _graph(spark, sf_dir), _labels(spark, sf_dir), 1.5, sweeps=1, colours=4)


#: Runs of fifty customers; an expansion along a run is a chain with two choices, whose optimum a recursion finds.
RUNS = "r AS (SELECT c_custkey AS spot, c_custkey // 50 AS run, c_custkey * 31 % 3 AS label, CAST(0.2 AS DOUBLE) + c_custkey % 7 / CAST(10 AS DOUBLE) AS w FROM customer)"
ONE = "x AS (SELECT r.*, (spot * 7919 + label * 104729) % 1009 / CAST(600 AS DOUBLE) AS keep, (spot * 7919 + 104729) % 1009 / CAST(600 AS DOUBLE) AS take, row_number() OVER (PARTITION BY run ORDER BY spot) AS rn, lag(spot) OVER (PARTITION BY run ORDER BY spot) AS before FROM r)"


@query(f"""
WITH RECURSIVE {RUNS}, {ONE},
f(run, rn, label, w, v0, v1, b0, b1) AS (
  SELECT run, rn, label, w, keep, take, 0, 0 FROM x WHERE rn = 1
  UNION ALL
  SELECT x.run, x.rn, x.label, x.w,
    greatest(v0 + CASE WHEN f.label = x.label THEN f.w ELSE 0 END, v1 + CASE WHEN x.label = 1 THEN f.w ELSE 0 END) + keep,
    greatest(v0 + CASE WHEN f.label = 1 THEN f.w ELSE 0 END, v1 + f.w) + take,
    CASE WHEN v0 + CASE WHEN f.label = x.label THEN f.w ELSE 0 END >= v1 + CASE WHEN x.label = 1 THEN f.w ELSE 0 END THEN 0 ELSE 1 END,
    CASE WHEN v0 + CASE WHEN f.label = 1 THEN f.w ELSE 0 END >= v1 + f.w THEN 0 ELSE 1 END
  FROM f JOIN x ON x.run = f.run AND x.rn = f.rn + 1),
g(run, rn, x, prev) AS (
  SELECT run, rn, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END, CASE WHEN v0 >= v1 THEN b0 ELSE b1 END FROM f WHERE (run, rn) IN (SELECT run, max(rn) FROM f GROUP BY run)
  UNION ALL
  SELECT f.run, f.rn, g.prev, CASE WHEN g.prev = 0 THEN f.b0 ELSE f.b1 END FROM g JOIN f ON f.run = g.run AND f.rn = g.rn - 1)
SELECT spot, CASE WHEN g.x = 1 THEN 1 ELSE label END AS label FROM g JOIN x USING (run, rn)
""")
def expansion_cut(spark, sf_dir):
    """The best expansion to label 1 of customers in runs, neighbours weighing what the earlier one says."""
    key = F.col("c_custkey")
    spots = table(spark, sf_dir, "customer").select(key.alias("spot"), F.call_function("div", key, F.lit(50)).alias("run"), (key * 31 % 3).alias("label"))
    # the next customer of the run, whichever key it has
    after = F.lead("spot").over(Window.partitionBy("run").orderBy("spot"))
    edges = spots.select(F.col("spot").alias("src"), after.alias("dst"), (0.2 + F.col("spot") % 7 / 10.0).alias("w")).where("dst IS NOT NULL")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    field = spots.select("spot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("label")).withColumn("value", (F.col("spot") * 7919 + F.col("label") * 104729) % 1009 / 600.0)
    return cuts.expansion(field, both, spots.select("spot", "label"), 1.0, 1)
