"""Queries of a run's scores: customers as spots, parts as segments, suppliers as planted rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audit, curves

from .registry import query, table

RUN = """
s AS (SELECT c_custkey AS spot, c_nationkey % 4 AS planted, CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 9 = 0 THEN 4 ELSE (c_nationkey + 1) % 4 END END AS fitted FROM customer),
g AS (SELECT p_partkey AS segment, p_partkey % 3 AS chrom, p_partkey * 10 AS lo, p_partkey * 10 + 9 AS hi, f AS clone, (p_size // 7 + greatest(f, 1)) % 3 AS a, (p_size // 9 + greatest(f, 1) * 2) % 3 AS b, (p_size + f) % 5 AS state FROM part, range(5) r(f)),
t AS (SELECT s_suppkey * 3 + c AS r, c AS chrom, s_suppkey * 180 AS lo, s_suppkey * 180 + 160 AS hi, k AS clone, (s_suppkey + k) % 3 AS a, (s_suppkey // 2 + k) % 3 AS b FROM supplier, range(3) x(c), range(4) y(k)),
"""
#: The fitted clone of each planted one: of all ways to pair four with five, the one that shares most spots.
MATCH = """
n AS (SELECT planted, fitted, count(*) AS n FROM s WHERE fitted IS NOT NULL GROUP BY 1, 2),
c AS (SELECT p, f, coalesce(n, 0) AS n FROM range(4) x(p), range(5) y(f) LEFT JOIN n ON planted = p AND fitted = f),
w AS (SELECT a.f AS f0, b.f AS f1, c.f AS f2, d.f AS f3 FROM c a, c b, c c, c d WHERE a.p = 0 AND b.p = 1 AND c.p = 2 AND d.p = 3 AND a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND b.f <> c.f AND b.f <> d.f AND c.f <> d.f ORDER BY a.n + b.n + c.n + d.n DESC LIMIT 1),
m(planted, fitted) AS (SELECT 0, f0 FROM w UNION ALL SELECT 1, f1 FROM w UNION ALL SELECT 2, f2 FROM w UNION ALL SELECT 3, f3 FROM w),
"""
BINS = """
v AS (SELECT g.segment, m.planted, m.fitted, t.a * 1000 + t.b AS t, g.a * 1000 + g.b AS ab, g.state, row_number() OVER (PARTITION BY g.segment, m.planted ORDER BY t.r DESC) AS nth
  FROM m JOIN g ON g.clone = m.fitted JOIN t ON t.clone = m.planted AND t.chrom = g.chrom AND (g.lo + g.hi) // 2 >= t.lo AND (g.lo + g.hi) // 2 < t.hi),
b AS (SELECT *, least(t // 1000, t % 1000) * 1000 + greatest(t // 1000, t % 1000) AS tf, least(ab // 1000, ab % 1000) * 1000 + greatest(ab // 1000, ab % 1000) AS af,
  CASE WHEN t // 1000 = 0 OR t % 1000 = 0 THEN 'loh' WHEN t = 1001 THEN 'neutral' WHEN t // 1000 = t % 1000 THEN 'balanced_gain' ELSE 'unbalanced_gain' END AS class FROM v WHERE nth = 1),
"""


def _tables(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    spots = table(spark, sf_dir, "customer").select(key.alias("spot"), (nation % 4).cast("long").alias("clone"), F.when(key % 9 == 0, 4).otherwise((nation + 1) % 4).cast("long").alias("own"))
    part, div = F.col("p_partkey"), lambda c, n: F.call_function("div", F.col(c), F.lit(n))
    up = F.greatest(F.col("f"), F.lit(1))
    segments = table(spark, sf_dir, "part").withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).select(
        part.alias("segment"), (part % 3).alias("chrom"), (part * 10).alias("start"), (part * 10 + 9).alias("end"), F.col("f").alias("clone"),
        ((div("p_size", 7) + up) % 3).alias("a"), ((div("p_size", 9) + up * 2) % 3).alias("b"), ((F.col("p_size") + F.col("f")) % 5).alias("state"),
    )
    row, three, four = F.col("s_suppkey"), F.array(*(F.lit(i).cast("long") for i in range(3))), F.array(*(F.lit(i).cast("long") for i in range(4)))
    profile = table(spark, sf_dir, "supplier").withColumn("chrom", F.explode(three)).withColumn("clone", F.explode(four)).select(
        (row * 3 + F.col("chrom")).alias("row"), "chrom", (row * 180).alias("start"), (row * 180 + 160).alias("end"), "clone", ((row + F.col("clone")) % 3).alias("a"), ((div("s_suppkey", 2) + F.col("clone")) % 3).alias("b")
    )
    return spots.select("spot", "clone"), spots.where("spot % 11 <> 0").select("spot", F.col("own").alias("clone")), segments, profile


def _ari_sql(name: str, source: str, left: str, right: str, where: str = "true", by_class: bool = False) -> str:
    """One metric's row."""
    return f"""
SELECT '{name}' AS metric, CASE WHEN {'k < 2' if by_class else 'false'} THEN NULL WHEN (sl + sr) / 2 = sl * sr / nullif(n * (n - 1) / 2.0, 0) THEN 1.0 ELSE (s - sl * sr / (n * (n - 1) / 2.0)) / ((sl + sr) / 2 - sl * sr / (n * (n - 1) / 2.0)) END AS value
FROM (SELECT sum(n) AS n, sum(n * (n - 1) / 2.0) AS s, count(DISTINCT l) AS k FROM (SELECT {left} AS l, {right} AS r, count(*) AS n FROM {source} WHERE {where} GROUP BY 1, 2)),
  (SELECT sum(n * (n - 1) / 2.0) AS sl FROM (SELECT {left}, count(*) AS n FROM {source} WHERE {where} GROUP BY 1)), (SELECT sum(n * (n - 1) / 2.0) AS sr FROM (SELECT {right}, count(*) AS n FROM {source} WHERE {where} GROUP BY 1))"""


def _score_sql() -> str:
    # equal profiles here are transitive, so the first named clone that agrees is the least one
    merged = """
y AS (SELECT x.clone AS f, z.clone AS z, avg(CASE WHEN x.a = z.a AND x.b = z.b THEN 1.0 ELSE 0.0 END) AS share FROM g x JOIN g z USING (segment) WHERE z.clone <= x.clone GROUP BY 1, 2),
h AS (SELECT f, min(z) FILTER (share >= 1) AS m100, min(z) FILTER (share >= 0.99) AS m099 FROM y GROUP BY f),
j AS (SELECT s.*, m100, m099 FROM s JOIN h ON f = fitted),"""
    rows = [_ari_sql("clone_ari", "j", "planted", "fitted"), _ari_sql("clone_ari_int_100", "j", "planted", "m100"), _ari_sql("clone_ari_int_099", "j", "planted", "m099")]
    rows += [_ari_sql("state_ari", "b", "t", "state"), _ari_sql("copy_ari", "b", "t", "ab"), _ari_sql("copy_ari_pf", "b", "tf", "af")]
    for c in audit.CLASSES:
        rows += [_ari_sql(f"copy_ari_{c}", "b", "t", "ab", f"class = '{c}'", True), _ari_sql(f"copy_ari_{c}_pf", "b", "tf", "af", f"class = '{c}'", True)]
    rows += [f"SELECT '{m}', {v} FROM j" for m, v in (("spots", "count(*)"), ("clones", "count(DISTINCT fitted)"), ("clones_int_100", "count(DISTINCT m100)"), ("clones_int_099", "count(DISTINCT m099)"), ("kept", "count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE)"))]
    rows.append("SELECT 'clone_bins', count(*) FROM b")
    for name, where in {"": "true", "_altered": "t <> 1001", "_neutral": "t = 1001"}.items() | {f"_{c}": f"class = '{c}'" for c in audit.CLASSES}.items():
        rows.append(f"SELECT 'exact{name}', avg(CASE WHEN t = ab THEN 1.0 ELSE 0.0 END) FROM b WHERE {where}")
        if name != "_neutral":
            rows.append(f"SELECT 'exact{name}_pf', avg(CASE WHEN tf = af THEN 1.0 ELSE 0.0 END) FROM b WHERE {where}")
    return f"WITH {RUN} {MATCH} {BINS} {merged} o AS ({' UNION ALL '.join(rows)}) SELECT metric, round(CAST(value AS DOUBLE), 9) AS value FROM o"


@query(_score_sql())
def run_scores(spark, sf_dir):
    """All scores of a run's labels and copies."""
    return audit.score_run(*_tables(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query(f"WITH {RUN} {MATCH} {BINS} k AS (SELECT t // 1000 || ',' || t % 1000 AS planted, CASE WHEN ab // 1000 + ab % 1000 <= 3 THEN ab // 1000 || ',' || ab % 1000 ELSE 'other' END AS decoded, count(*) AS n FROM b WHERE t // 1000 + t % 1000 <= 3 GROUP BY 1, 2) SELECT planted, decoded, round(n / CAST(sum(n) OVER (PARTITION BY planted) AS DOUBLE), 9) AS share FROM k")
def run_confusion(spark, sf_dir):
    """Planted against decoded copies, pairs beyond three in all as one."""
    planted, fitted, segments, profile = _tables(spark, sf_dir)
    return audit.copy_confusion(audit.clone_bins(audit.matched(audit.at_truth(planted, fitted)), segments, profile), 3, digits=9)


#: How often a member is drawn in a resample, from a number that both engines compute alike.
DRAWN = "(member * 7919 + draw * 104729 + member * draw * 31) % 10007 / CAST(10007 AS DOUBLE)"
CURVE = """
r AS (SELECT o_orderpriority AS g, o_custkey % 40 AS member, round(o_totalprice / 100000, 1) AS x, CASE WHEN o_totalprice + o_orderkey * 7919 % 200000 > 300000 THEN 1.0 ELSE 0.0 END AS y, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY ALL),
"""


def _poisson_sql() -> str:
    import math

    edges, total, mass = [], 0.0, math.exp(-1)
    for k in range(8):
        total += mass
        edges.append(f"WHEN {DRAWN} < {total!r} THEN {k}")
        mass /= k + 1
    return f"CASE {' '.join(edges)} ELSE 8 END"


def _curve_sql(draws: int = 40, rounds: int = 12) -> str:
    parts = [
        CURVE.strip().rstrip(","),
        f"e AS MATERIALIZED (SELECT * FROM (SELECT r.*, draw, CASE WHEN draw < 0 THEN 1 ELSE {_poisson_sql()} END * n AS m FROM r, range(-1, {draws}) d(draw)) WHERE m > 0)",
        "p0 AS (SELECT g, draw, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM e GROUP BY 1, 2)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"q{i} AS (SELECT e.*, 1 / (1 + exp(-(a + b * x))) AS p FROM e JOIN p{i - 1} USING (g, draw))")
        parts.append(f"s{i} AS (SELECT g, draw, sum(m * p * (1 - p)) + 1e-9 AS h, sum(m * p * (1 - p) * x) AS hx, sum(m * p * (1 - p) * x * x) + 1e-9 AS hxx, sum(m * (y - p)) AS r, sum(m * (y - p) * x) AS rx FROM q{i} GROUP BY 1, 2)")
        parts.append(f"p{i} AS MATERIALIZED (SELECT g, draw, a + (hxx * r - hx * rx) / (h * hxx - hx * hx) AS a, b + (h * rx - hx * r) / (h * hxx - hx * hx) AS b FROM s{i} JOIN p{i - 1} USING (g, draw))")
    parts.append(f"c AS (SELECT g, draw, CASE WHEN b > 0 THEN -a / b END AS half FROM p{rounds})")
    return f"""WITH {", ".join(parts)}
SELECT g AS "group", round(max(half) FILTER (draw < 0), 5) AS crossing, round(quantile_cont(half, 0.025) FILTER (draw >= 0), 5) AS low, round(quantile_cont(half, 0.975) FILTER (draw >= 0), 5) AS high, count(half) FILTER (draw >= 0) AS draws FROM c GROUP BY g"""


def _curve_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice IS NOT NULL")
    y = F.when(F.col("o_totalprice") + F.col("o_orderkey") * 7919 % 200000 > 300000, 1.0).otherwise(0.0)
    rows = orders.select(F.col("o_orderpriority").alias("group"), (F.col("o_custkey") % 40).alias("member"), F.round(F.col("o_totalprice") / 100000, 1).alias("x"), y.alias("y"))
    return rows.groupBy("group", "member", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _weight(member, draw):
    return curves.poisson((member * 7919 + draw * 104729 + member * draw * 31) % 10007 / 10007.0)


@query(_curve_sql())
def curve_crossings(spark, sf_dir):
    """Where the rate of dear orders reaches one half, by priority, with bands over 40 resamples of customers."""
    found = curves.fits(_curve_rows(spark, sf_dir), 40, _weight)
    got = curves.crossings(spark, found)
    return got.select("group", *(F.round(c, 5).alias(c) for c in ("crossing", "low", "high")), "draws")


@query(f"""
WITH {CURVE}
b AS (SELECT g, member, CAST(floor(x) AS INT) AS bin, sum(y * n) AS s, sum(n) AS c FROM r WHERE x >= 0 AND x < 6 GROUP BY ALL),
e AS (SELECT b.*, draw, CASE WHEN draw < 0 THEN 1 ELSE {_poisson_sql()} END AS w FROM b, range(-1, 40) d(draw)),
t AS (SELECT g, bin, draw, sum(w * s) / nullif(sum(w * c), 0) AS rate, sum(c) AS c FROM e GROUP BY 1, 2, 3),
f AS (SELECT g, bin, max(rate) FILTER (draw < 0) AS rate, quantile_cont(rate, 0.025) FILTER (draw >= 0) AS low, quantile_cont(rate, 0.975) FILTER (draw >= 0) AS high, CAST(max(c) FILTER (draw < 0) AS BIGINT) AS n FROM t GROUP BY 1, 2)
SELECT g AS "group", i.bin, i.bin + 0.5 AS centre, round(rate, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high, coalesce(n, 0) AS n FROM (SELECT DISTINCT g FROM r), range(6) i(bin) LEFT JOIN f USING (g, bin)
""".replace("FROM (SELECT DISTINCT g FROM r), range(6) i(bin) LEFT JOIN f USING (g, bin)", "FROM (SELECT g, CAST(range AS INT) AS bin FROM (SELECT DISTINCT g FROM r), range(6)) i LEFT JOIN f USING (g, bin)"))
def curve_rates(spark, sf_dir):
    """The rate of dear orders in bins of their price, by priority, with bands."""
    found = curves.rates(_curve_rows(spark, sf_dir), [float(i) for i in range(7)], 40, _weight)
    return found.select("group", "bin", "centre", *(F.round(c, 6).alias(c) for c in ("rate", "low", "high")), "n")
