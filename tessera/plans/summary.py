"""Queries of summaries, fits and validity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.likelihood import admixed_depth, admixed_share
from tessera.graph import components
from tessera.operators import copies, ranking, scoring, summaries

from .registry import query, table


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("SELECT o_orderpriority AS g, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.5) - quantile_cont(o_totalprice, 0.1), 4) AS below, round(quantile_cont(o_totalprice, 0.9) - quantile_cont(o_totalprice, 0.5), 4) AS above FROM orders GROUP BY 1")
def quantile_bars(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice")
    return _rounded(summaries.bars(orders, "g", "o_totalprice"), 4, "median", "below", "above")


@query("SELECT event_type AS g, round(avg(ln(value)), 6) AS mu, round(stddev_pop(ln(value)), 6) AS sigma FROM events WHERE value > 0 GROUP BY 1")
def lognormal_fit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), "value")
    return _rounded(summaries.lognormal_fit(events, "g", "value"), 6, "mu", "sigma")


@query("SELECT l_returnflag AS g, round(avg(l_quantity), 6) AS mean, round(greatest(0, (var_pop(l_quantity) - avg(l_quantity)) / (avg(l_quantity) * avg(l_quantity))), 6) AS dispersion FROM lineitem GROUP BY 1")
def negative_binomial_moments(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity")
    return _rounded(summaries.negative_binomial_fit(items, "g", "l_quantity"), 6, "mean", "dispersion")


@query("""
WITH c AS (SELECT lang, source, count(*) AS o FROM documents GROUP BY 1, 2),
e AS (SELECT o, sum(o) OVER (PARTITION BY lang) * sum(o) OVER (PARTITION BY source) / sum(o) OVER () AS e FROM c)
SELECT round(sum((o - e) * (o - e) / e), 6) AS statistic, count(*) AS cells FROM e WHERE e >= 2
""")
def chi_square(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("o"))
    total = c.agg(F.sum("o").alias("n"))
    both = c.join(total, how="cross").withColumn("e", F.sum("o").over(Window.partitionBy("lang")) * F.sum("o").over(Window.partitionBy("source")) / F.col("n"))  # the total is one row
    return _rounded(summaries.chi_square(both, "o", "e", 2), 6, "statistic")


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice / l_quantity, 0.5), 4) AS ratio FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def median_of_ratios(spark, sf_dir):
    return _rounded(summaries.median_of_ratios(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity"), "l_suppkey", "l_extendedprice", "l_quantity"), 4, "ratio")


@query("""
WITH m AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q, quantile_cont(l_quantity, 0.5) OVER (PARTITION BY l_suppkey) AS m FROM lineitem),
d AS (SELECT *, quantile_cont(abs(q - m), 0.5) OVER (PARTITION BY l_suppkey) AS mad FROM m)
SELECT l_suppkey, CAST(sum(q) AS BIGINT) AS total, count(*) AS kept FROM d WHERE abs(q - m) <= 1.5 * mad GROUP BY 1
""")
def mad_outliers(spark, sf_dir):
    return summaries.without_outliers(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q")), "l_suppkey", "q", 1.5)


@query("""
WITH s AS (SELECT l_partkey AS gene, CAST(sum(CASE WHEN l_suppkey % 3 = 0 THEN l_quantity ELSE 0 END) AS BIGINT) AS t, CAST(sum(CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity ELSE 0 END) AS BIGINT) AS u FROM lineitem GROUP BY 1)
SELECT gene, t + u AS total, round(CASE WHEN t = 0 OR u = 0 THEN 10.0 ELSE log2((t * 1e6 / (SELECT sum(t) FROM s)) / (u * 1e6 / (SELECT sum(u) FROM s))) END, 6) AS log2fc FROM s
""")
def fold_change(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_quantity").cast("long").alias("n"), "l_suppkey")
    return _rounded(summaries.fold_change(items, "gene", "n", F.col("l_suppkey") % 3 == 0), 6, "log2fc")


@query("""
WITH s AS (SELECT user_id % 12 AS clone, user_id, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY 1, 2),
d AS (SELECT clone, round(sum(greatest(abs(share - 0.5) - 0.05, 0)), 6) AS deviation FROM s GROUP BY clone)
SELECT clone, deviation FROM d ORDER BY deviation, clone LIMIT 1
""")
def normal_clone(spark, sf_dir):
    shares = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("clone"), "user_id").agg(F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("share"))
    return _rounded(summaries.balanced_group(shares, "clone", "share"), 6, "deviation")


@query("""
WITH s AS (SELECT user_id % 3 AS clone, user_id // 3 AS bin, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY 1, 2)
SELECT bin, CAST(coalesce(CASE WHEN avg(CASE WHEN abs(share - 0.5) >= 0.1 THEN CASE WHEN share > 0.5 THEN 1.0 ELSE 0.0 END END) >= 0.5 THEN 1 ELSE 0 END, 0) AS BIGINT) AS phase FROM s GROUP BY bin
""")
def phase_vote(spark, sf_dir):
    shares = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("clone"), F.call_function("div", F.col("user_id"), F.lit(3)).alias("bin")).agg(F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("share"))
    return summaries.phase_vote(shares, "bin", "share", 0.1)


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def members_everywhere(spark, sf_dir):
    return summaries.members_everywhere(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders)
SELECT o_orderkey FROM r WHERE nth <= ceil(n / 3) OR o_totalprice <= best + 1000
""")
def successive_halving(spark, sf_dir):
    return summaries.halved(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice", 1000.0).select("o_orderkey")


@query("""
WITH c AS (SELECT l_returnflag AS g, least(CAST(l_quantity AS BIGINT), 10) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT g, k, round(n / sum(n) OVER (PARTITION BY g), 9) AS p FROM c
""")
def observed_mass(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("long").alias("q"))
    return _rounded(summaries.mass(items, "g", "q", 10), 9, "p")


@query("""
WITH e AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM documents)
SELECT doc_id, (n_chars >= a)::BIGINT + (n_chars >= b)::BIGINT + (n_chars >= c)::BIGINT AS class FROM documents, e
""")
def grey_classes(spark, sf_dir):
    return summaries.digitised(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 4, "class").select("doc_id", "class")


@query("""
WITH g AS (SELECT x, y FROM (SELECT DISTINCT p_size % 10 AS x FROM part), (SELECT DISTINCT p_partkey % 10 AS y FROM part))
SELECT g.x, g.y, (SELECT count(*) FROM part WHERE p_size % 10 <= g.x AND p_partkey % 10 <= g.y) AS n FROM g
""")
def prefix_counts(spark, sf_dir):
    return summaries.prefix_counts(table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("x"), (F.col("p_partkey") % 10).alias("y")), "x", "y")


@query("SELECT c_custkey % 60 AS fine, count(DISTINCT CASE WHEN c_custkey % 60 < 30 THEN c_custkey % 6 ELSE c_nationkey END) = 1 AS inside FROM customer GROUP BY 1")
def refines(spark, sf_dir):
    fine = F.col("c_custkey") % 60
    rows = table(spark, sf_dir, "customer").select(fine.alias("fine"), F.when(fine < 30, F.col("c_custkey") % 6).otherwise(F.col("c_nationkey")).alias("coarse"))
    return summaries.refines(rows, "fine", "coarse")


@query("""
WITH e AS (SELECT l_suppkey AS src, l_partkey % 20 AS dst, CAST(sum(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
s AS (SELECT src, sum(w) AS s FROM e GROUP BY src), m AS (SELECT quantile_cont(s, 0.5) AS m FROM s)
SELECT src, dst, round(w * m / s, 6) AS w FROM e JOIN s USING (src), m
""")
def row_normalised(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 20).alias("dst")).agg(F.sum("l_quantity").alias("w"))
    return _rounded(summaries.row_normalised(edges, "src", "dst", "w"), 6, "w")


@query("""
WITH e AS (SELECT DISTINCT c_custkey % 40 AS src, (c_custkey * 7 + c_nationkey) % 40 AS dst FROM customer)
SELECT count(*) AS edges, count(*) FILTER (src = dst) AS loops, count(*) FILTER (EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)) AS reciprocal FROM e
""")
def graph_checks(spark, sf_dir):
    edges = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("src"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 40).alias("dst")).distinct()
    return summaries.reciprocity(edges, "src", "dst")


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice / (sum(l_extendedprice * l_quantity) OVER (PARTITION BY l_suppkey) / sum(l_quantity) OVER (PARTITION BY l_suppkey)), 6) AS rdr FROM lineitem
""")
def debiased_depth(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    return _rounded(summaries.debiased(items, "l_suppkey", "l_extendedprice", "l_quantity"), 6, "rdr").select("l_orderkey", "l_linenumber", "rdr")


@query("SELECT round(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS share FROM lineitem")
def altered_share(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.lit(0).cast("long").alias("s"), F.col("l_quantity").cast("long").alias("e"), "l_returnflag")
    return _rounded(summaries.altered_share(items, "s", "e", F.col("l_returnflag") != "N"), 9, "share")


@query("""
SELECT s_suppkey, a, b, round(p * (a + b) / 2 + 1 - p, 9) AS depth, round((p * a + 1 - p) / (p * (a + b) + 2 * (1 - p)), 9) AS share
FROM range(5) x(a), range(5) y(b), (SELECT s_suppkey, (s_suppkey % 20 + 1) / CAST(20 AS DOUBLE) AS p FROM supplier) WHERE a + b BETWEEN 1 AND 6
""")
def copy_lattice(spark, sf_dir):
    """Depth and share of every pair at each supplier's purity."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 20 + 1) / 20.0).alias("purity"))
    pairs = suppliers.join(F.broadcast(copies.lattice(spark, 6, 4)), how="cross")  # some twenty pairs
    a, b, p = F.col("a").cast("long"), F.col("b").cast("long"), F.col("purity")
    return pairs.select("s_suppkey", a.alias("a"), b.alias("b"), F.round(admixed_depth(a, b, p), 9).alias("depth"), F.round(admixed_share(a, b, p), 9).alias("share"))


@query("""
SELECT p_partkey, CASE WHEN least(c // 1000, c % 1000) = 0 THEN 'loh' WHEN c // 1000 + c % 1000 > 2 AND c // 1000 = c % 1000 THEN 'balanced_gain' WHEN c // 1000 + c % 1000 > 2 THEN 'unbalanced_gain' WHEN c = 1001 THEN 'neutral' END AS class,
       least(c // 1000, c % 1000) * 1000 + greatest(c // 1000, c % 1000) AS folded, (c % 1000) * 1000 + c // 1000 AS swapped
FROM (SELECT p_partkey, (p_size % 4) * 1000 + p_partkey % 4 AS c FROM part)
""")
def copy_classes(spark, sf_dir):
    c = F.col("p_size").cast("long") % 4 * 1000 + F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", scoring.copy_class(c).alias("class"), scoring.phase_free(c).alias("folded"), scoring.swapped(c).alias("swapped"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS nth FROM orders")
def global_rank(spark, sf_dir):
    return ranking.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", name="nth").select("o_orderkey", "nth")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth <= 3")
def top_per_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return ranking.top_per_group(items, "l_suppkey", 3, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders WHERE o_orderpriority IS NOT NULL
""")
def densified_labels(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(ranking.densified(orders, "o_orderpriority", "code"), "o_orderpriority").select("o_orderkey", "code")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, CASE WHEN c_custkey % 9 = 0 THEN c_custkey ELSE c_custkey - 1 END AS b FROM customer),
n AS (SELECT a AS node, CASE WHEN a % 9 = 0 THEN a ELSE a - a % 9 END AS root FROM e)
SELECT node, root FROM (SELECT DISTINCT node, root FROM n UNION SELECT root, root FROM n) WHERE node IN (SELECT a FROM e WHERE a <> b UNION SELECT b FROM e WHERE a <> b)
""")
def label_components(spark, sf_dir):
    key = F.col("c_custkey")
    edges = table(spark, sf_dir, "customer").select(key.alias("a"), F.when(key % 9 == 0, key).otherwise(key - 1).alias("b"))
    return components(edges)


def _logistic_sql(rounds=12):
    """Newton's steps unrolled, each from five sums over the distinct values."""
    parts = [
        "c AS MATERIALIZED (SELECT l_quantity / 10 AS x, CASE WHEN l_quantity + l_orderkey % 30 > 40 THEN 1.0 ELSE 0.0 END AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2)",
        "p0 AS MATERIALIZED (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)",
    ]
    for r in range(1, rounds + 1):
        parts.append(f"q{r} AS (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM c, p{r - 1})")
        parts.append(f"s{r} AS (SELECT sum(n * p * (1 - p)) AS w, sum(n * p * (1 - p) * x) AS wx, sum(n * p * (1 - p) * x * x) AS wxx, sum(n * (y - p)) AS r, sum(n * (y - p) * x) AS rx FROM q{r})")
        parts.append(f"p{r} AS MATERIALIZED (SELECT a + (wxx * r - wx * rx) / (w * wxx - wx * wx) AS a, b + (w * rx - wx * r) / (w * wxx - wx * wx) AS b FROM s{r}, p{r - 1})")
    return f"WITH {', '.join(parts)} SELECT round(a, 6) AS intercept, round(b, 6) AS slope, round(-a / b, 6) AS half FROM p{rounds}"


@query(_logistic_sql())
def logistic_half_point(spark, sf_dir):
    """Intercept, slope and half point of a rate against a scale."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("x"), F.when((F.col("l_quantity") + F.col("l_orderkey") % 30) > 40, 1).otherwise(0).alias("y"))
    found = summaries.logistic_fit(items, "x", "y")
    a, b = found or (float("nan"), float("nan"))
    return spark.range(1).select(F.round(F.lit(a), 6).alias("intercept"), F.round(F.lit(b), 6).alias("slope"), F.round(F.lit(-a / b if b else None).cast("double"), 6).alias("half"))
