"""Queries of scoring and count-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import counts, scoring

from .registry import query, table


@query("""
WITH c AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * (n - 1) / 2.0) AS ab FROM c),
a AS (SELECT sum(k * (k - 1) / 2.0) AS s FROM (SELECT sum(n) AS k FROM c GROUP BY lang)),
b AS (SELECT sum(k * (k - 1) / 2.0) AS s FROM (SELECT sum(n) AS k FROM c GROUP BY source))
SELECT t.n, round((ab - a.s * b.s / (t.n * (t.n - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (t.n * (t.n - 1) / 2.0)), 9) AS ari
FROM t, a, b
""")
def contingency_ari(spark, sf_dir):
    found = scoring.contingency(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source")
    return scoring.adjusted_rand(found, "lang", "source").select("n", F.round("ari", 9).alias("ari"))


@query("""
WITH c AS (SELECT event_type, user_id % 5 AS bucket, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, bucket, round(n / sum(n) OVER (PARTITION BY event_type), 4) AS share FROM c
""")
def confusion_rownorm(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("bucket"))
    return scoring.confusion(scoring.contingency(events, "event_type", "bucket"), "event_type", "bucket")


@query("""
WITH p AS (SELECT (p_size % 4) * 1000 + p_size % 3 AS t, CASE WHEN p_partkey % 5 = 0 THEN (p_size % 3) * 1000 + p_size % 4 WHEN p_partkey % 7 = 0 THEN 1001 ELSE (p_size % 4) * 1000 + p_size % 3 END AS f FROM part),
q AS (SELECT *, least(t // 1000, t % 1000) AS lo, greatest(t // 1000, t % 1000) AS hi FROM p),
r AS (SELECT *, CASE WHEN lo = 0 THEN 'loh' WHEN lo + hi > 2 AND lo = hi THEN 'balanced_gain' WHEN lo + hi > 2 THEN 'unbalanced_gain' WHEN t = 1001 THEN 'neutral' END AS class FROM q)
SELECT class, round(avg(CASE WHEN t = f THEN 1.0 ELSE 0.0 END), 6) AS exact,
       round(avg(CASE WHEN t = f OR t = (f % 1000) * 1000 + f // 1000 THEN 1.0 ELSE 0.0 END), 6) AS either_phase, count(*) AS n
FROM r WHERE class IS NOT NULL GROUP BY class
""")
def exact_by_class(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    planted = size % 4 * 1000 + size % 3
    fitted = F.when(key % 5 == 0, size % 3 * 1000 + size % 4).when(key % 7 == 0, F.lit(1001)).otherwise(planted)
    coded = table(spark, sf_dir, "part").select(planted.alias("t"), fitted.alias("f"))
    return scoring.exact_by_class(coded, "t", "f").select("class", F.round("exact", 6).alias("exact"), F.round("either_phase", 6).alias("either_phase"), "n")


@query("""
WITH e AS (SELECT user_id % 20 AS clone, event_type, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT clone, string_agg(event_type || ':' || (n > 100), ',' ORDER BY event_type) AS profile FROM e GROUP BY clone)
SELECT clone, min(clone) OVER (PARTITION BY profile) AS merged FROM p
""")
def merge_named_clones(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("clone"), "event_type").count()
    return scoring.named_clones(seen.withColumn("state", F.col("count") > 100), "clone", "event_type", "state")


@query("""
WITH a AS (SELECT l_linenumber AS k, count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_linenumber AS k, count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber < 6 GROUP BY 1)
SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS tv FROM a FULL JOIN b USING (k)
""")
def total_variation(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("k"))

    def mass(rows):
        sums = rows.groupBy("k").count()
        total = sums.agg(F.sum("count").alias("all"))
        return sums.join(total, how="cross").select("k", (F.col("count") / F.col("all")).alias("p"))  # the total is one row

    a, b = mass(items.where("l_returnflag = 'R'")), mass(items.where("l_returnflag = 'N' AND k < 6"))
    return scoring.total_variation(a, b, "k").select(F.round("tv", 6).alias("tv"))


@query("""
SELECT user_id % 10 AS clone, epoch_us(ts) // 3600000000 AS bin, round(sum(value), 4) AS value, count(*) AS reads FROM events GROUP BY 1, 2
""")
def pseudobulk_sum(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("clone"), F.call_function("div", F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(3600)).alias("bin"), "value", F.lit(1).alias("reads"))
    return counts.pseudobulk(events, "clone", "bin", "value", "reads").withColumn("value", F.round("value", 4))


@query("""
WITH x AS (SELECT l_partkey % 50 AS gene, l_suppkey AS spot, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
own AS (SELECT gene, sum(CASE WHEN spot % 4 = 0 THEN n ELSE 0 END) AS own FROM x GROUP BY gene HAVING own >= 100),
lam AS (SELECT gene, own / sum(own) OVER () AS lam FROM own),
tot AS (SELECT spot, sum(n) AS total FROM x JOIN own USING (gene) GROUP BY spot)
SELECT gene, spot, round(lam * total, 4) AS base FROM (SELECT DISTINCT gene, spot FROM x) JOIN lam USING (gene) JOIN tot USING (spot)
""")
def baseline_outer(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("gene"), F.col("l_suppkey").alias("spot"), F.col("l_quantity").cast("long").alias("n"))
    return counts.baseline(x, "gene", "spot", "n", F.col("spot") % 4 == 0, least=100).withColumn("base", F.round("base", 4))


@query("""
WITH s AS (SELECT c_nationkey, count(*) AS n, sum(c_custkey) AS w FROM customer GROUP BY 1),
k AS (SELECT c_nationkey, w, row_number() OVER (ORDER BY c_nationkey) - 1 AS merged FROM s WHERE n >= 55 AND w >= 30000),
m AS (SELECT merged FROM k ORDER BY w DESC, merged LIMIT 1)
SELECT c_nationkey, merged FROM k
UNION ALL SELECT c_nationkey, m.merged FROM s, m WHERE NOT (n >= 55 AND w >= 30000)
""")
def floor_merge(spark, sf_dir):
    return counts.floor_labels(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 55, 30000)


@query("""
WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)
SELECT c_mktsegment, n, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, n, c_mktsegment) - 1 AS code FROM s
""")
def reindex_labels(spark, sf_dir):
    return counts.reindex_labels(table(spark, sf_dir, "customer").select("c_mktsegment"), "c_mktsegment", F.col("c_mktsegment") == "BUILDING")


@query("""
WITH t AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1),
c AS (SELECT quantile_cont(total, 0.95) AS cut FROM t),
s AS (SELECT sum(CASE WHEN total >= cut THEN total END) AS high, sum(CASE WHEN total < cut THEN total END) AS rest FROM t, c)
SELECT l_partkey, total, CASE WHEN total >= cut THEN CAST(trunc(total * (0.05 * rest / high)) AS BIGINT) ELSE total END AS damped FROM t, c, s
""")
def quantile_filter(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("total"))
    return counts.damp_outliers(totals, "l_partkey", "total", 0.95, 0.05)


@query("""
WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS held FROM lineitem WHERE l_quantity > 0 GROUP BY 1),
n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)
SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM g, n WHERE held >= 0.25 * n) GROUP BY 1
""")
def expressed_filter(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return counts.keep_expressed(items, "l_partkey", "l_suppkey", "l_quantity", 0.25).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS enum FROM orders
""")
def dup_enum(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return counts.enumerate_repeats(orders, "o_custkey", "o_orderpriority", order="o_orderkey").select("o_orderkey", "enum")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
""")
def semi_align(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders, nations = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    return customers.join(orders, "c_custkey", "left_semi").join(nations, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def deny_anti(spark, sf_dir):
    deny = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(deny, "p_partkey", "left_anti")


@query("""
WITH c AS (SELECT l_quantity AS q, l_discount AS d, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT q, d, row_number() OVER (ORDER BY q, d) - 1 AS code, n FROM c
""")
def distinct_codes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return counts.distinct_codes(items, "q", "d")


@query("""
WITH m AS (SELECT user_id % 50 AS clone, value / 50 AS v, max(value / 50) OVER (PARTITION BY user_id % 50) AS m FROM events WHERE value IS NOT NULL)
SELECT clone, round(max(m) + ln(sum(exp(v - m))), 6) AS lse FROM m GROUP BY clone
""")
def logsumexp_shift(spark, sf_dir):
    values = table(spark, sf_dir, "events").where("value IS NOT NULL").select((F.col("user_id") % 50).alias("clone"), (F.col("value") / 50).alias("v"))
    return counts.log_sum_exp(values, "clone", "v").withColumn("lse", F.round("lse", 6))


@query("""
WITH s AS (SELECT o_custkey % 40 AS member, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS s, count(*) AS c FROM orders GROUP BY 1),
w AS (SELECT *, (member * 7919 + draw * 104729 + member * draw * 31) % 4 AS w FROM s, range(200) r(draw)),
r AS (SELECT draw, sum(w * s) / sum(w * c) AS rate FROM w GROUP BY draw)
SELECT round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high FROM r
""")
def cluster_bootstrap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("member"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("v"))
    weight = lambda m, d: (m * 7919 + d * 104729 + m * d * 31) % 4
    return counts.cluster_bootstrap(orders, "member", "v", 200, weight).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rank FROM orders WHERE o_totalprice IS NOT NULL")
def min_rank(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").where("o_totalprice IS NOT NULL")
    return orders.select("o_orderkey", F.rank().over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice")).cast("long").alias("rank"))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p
FROM orders GROUP BY 1
""")
def pivot_ledger(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.lower()) for c in "FOP"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth = 1
""")
def best_metric(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("""
SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
""")
def set_ops(spark, sf_dir):
    customers, suppliers, orders = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    c, s = customers.select(F.col("c_nationkey").alias("k")), suppliers.select(F.col("s_nationkey").alias("k"))
    ids, ordered = customers.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k"))
    rich = customers.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    sets = {"union": c.union(s).distinct(), "intersect": ordered.intersect(rich), "except": ids.subtract(ordered), "union_all": c.union(s)}
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n") for name, df in sets.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
