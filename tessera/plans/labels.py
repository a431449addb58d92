"""Queries of labels, neighbour graphs, decoding and clone merging, on tables of the same shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import copies, decode, filters, labelling, normal
from tessera.operators.ranking import numbered
from tessera.sources import outputs

from .registry import query, table

SPOTS = "p AS (SELECT c_custkey AS spot, c_nationkey % 2 AS slice, c_custkey % 37 AS x, c_custkey // 37 AS y, CAST(c_nationkey AS BIGINT) AS label FROM customer)"


def _spots(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("spot"), (F.col("c_nationkey") % 2).alias("slice"), (key % 37).alias("x"), F.call_function("div", key, F.lit(37)).alias("y"), F.col("c_nationkey").cast("long").alias("label"))


FIELD = "f AS (SELECT spot, slice, l AS label, -abs(label - l) / 7.0 + (spot * 31 + l * 17) % 11 / 20.0 AS value FROM p, range(25) r(l))"


def _field(spark, sf_dir):
    long = lambda n: F.lit(n).cast("long")
    each = _spots(spark, sf_dir).withColumn("l", F.explode(F.sequence(long(0), long(24))))
    return each.select("spot", "slice", F.col("l").alias("label"), (-F.abs(F.col("label") - F.col("l")) / 7.0 + (F.col("spot") * 31 + F.col("l") * 17) % 11 / 20.0).alias("value"))


@query(f"WITH {SPOTS} SELECT r.l AS label, round(count(spot) / (SELECT count(*) FROM p), 9) AS share FROM range(30) r(l) LEFT JOIN p ON p.label = r.l GROUP BY r.l")
def label_shares(spark, sf_dir):
    return labelling.label_shares(_spots(spark, sf_dir), n=30).select("label", F.round("share", 9).alias("share"))


@query(f"WITH {SPOTS} SELECT spot, label FROM p")
def label_members(spark, sf_dir):
    """Lists of spots by label, and back."""
    return labelling.from_members(labelling.members(_spots(spark, sf_dir))).select("spot", "label")


@query(f'WITH {SPOTS} SELECT count(DISTINCT label) AS labels, min(label) AS least, max(label) AS "most", min(label) = 0 AND max(label) = count(DISTINCT label) - 1 AS dense FROM p')
def label_faults(spark, sf_dir):
    return labelling.label_faults(_spots(spark, sf_dir))


@query(f"""
WITH {SPOTS}, {FIELD}
SELECT spot, label, round(value + CASE WHEN label % 3 = slice THEN ln(0.25) ELSE 0 END, 6) AS value, (spot + label) % 4 <> 0 AS allowed FROM f
""")
def folded_field(spark, sf_dir):
    field = _field(spark, sf_dir)
    prior = field.select("slice", "label").distinct().where("label % 3 = slice").withColumn("log_weight", F.ln(F.lit(0.25)))
    allowed = field.where((F.col("spot") + F.col("label")) % 4 != 0).select("spot", "label")
    out = labelling.folded(field, prior, allowed)
    with_prior = labelling.folded(field, prior).withColumnRenamed("value", "plain")
    met = out.join(with_prior.hint("merge"), ["spot", "slice", "label"])
    return met.select("spot", "label", F.round("plain", 6).alias("value"), (F.col("value") > float("-inf")).alias("allowed"))


@query(f"""
WITH {SPOTS}, b AS (SELECT slice, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, dense_rank() OVER (ORDER BY slice) - 1 AS code FROM p GROUP BY slice),
m AS (SELECT spot, code, greatest(0, least(2, ceil((x - x0) * 3.0 / (x1 - x0)) - 1)) AS i, greatest(0, least(1, ceil((y - y0) * 2.0 / (y1 - y0)) - 1)) AS j FROM p JOIN b USING (slice))
SELECT spot, CAST(code * 6 + i * 2 + j AS BIGINT) AS label FROM m
""")
def grid_starts(spark, sf_dir):
    return labelling.grid_starts(_spots(spark, sf_dir).drop("label"), 3, 2).select("spot", "label")


@query(f"""
WITH {SPOTS}, o(dx, dy) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
e AS (SELECT a.spot AS src, b.spot AS dst FROM p a JOIN o ON true JOIN p b ON b.slice = a.slice AND b.x = a.x + dx AND b.y = a.y + dy),
d AS (SELECT src, count(*) AS d FROM e GROUP BY src)
SELECT e.src, e.dst, round((4.0 / d1.d + 4.0 / d2.d) / 2, 6) AS w FROM e JOIN d d1 ON d1.src = e.src JOIN d d2 ON d2.src = e.dst
UNION ALL SELECT a.spot, b.spot, 0.5 FROM p a JOIN p b ON b.spot = a.spot + 1 WHERE a.slice <> b.slice
""")
def slices_graph(spark, sf_dir):
    spots = _spots(spark, sf_dir)
    after = spots.select((F.col("spot") - 1).alias("src"), F.col("spot").alias("dst"), F.col("slice").alias("s2"))
    across = spots.select(F.col("spot").alias("src"), "slice").join(after, "src").where("slice <> s2").select("src", "dst", F.lit(0.5).alias("w"))
    return labelling.slices_graph(spots, offsets=[(0, 1), (0, -1), (1, 0), (-1, 0)], across=across).withColumn("w", F.round("w", 6))


@query("""
WITH p AS (SELECT slice, s * dx AS x, t AS y FROM (
  SELECT c_nationkey % 3 AS slice, c_custkey % 37 AS s, c_custkey // 37 AS t, CASE WHEN c_nationkey % 3 = 1 THEN 5 ELSE 1 END AS dx, c_nationkey % 3 AS r FROM customer) WHERE r < 2
  UNION SELECT 2, 2 * (c_custkey % 37) + c_custkey // 37 % 2, c_custkey // 37 FROM customer WHERE c_nationkey % 3 = 2
  UNION SELECT 3, 5 * (c_custkey % 37), 5 * (c_custkey // 37) FROM customer),
a AS (SELECT DISTINCT p.slice FROM p JOIN p q ON q.slice = p.slice AND (q.x = p.x + 1 AND q.y = p.y OR q.x = p.x AND q.y = p.y + 1)),
d AS (SELECT DISTINCT p.slice FROM p JOIN p q ON q.slice = p.slice AND (q.x = p.x + 1 AND q.y = p.y + 1 OR q.x = p.x - 1 AND q.y = p.y + 1 OR q.x = p.x + 2 AND q.y = p.y))
SELECT DISTINCT slice, CASE WHEN slice IN (FROM a) THEN 'square' WHEN slice IN (FROM d) THEN 'triangular' ELSE 'none' END AS kind FROM p
""")
def lattice_kind(spark, sf_dir):
    """Four slices of customers on unlike lattices: unit steps, wide steps along x, offset rows, and spots too far apart."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey") % 3
    spots = table(spark, sf_dir, "customer").select(nation.alias("slice"), (key % 37).alias("s"), F.call_function("div", key, F.lit(37)).alias("t"))
    plain = spots.where("slice < 2").select("slice", (F.col("s") * F.when(F.col("slice") == 1, 5).otherwise(1)).alias("x"), F.col("t").alias("y"))
    offset = spots.where("slice = 2").select("slice", (2 * F.col("s") + F.col("t") % 2).alias("x"), F.col("t").alias("y"))
    sparse = spots.select(F.lit(3).alias("slice"), (5 * F.col("s")).alias("x"), (5 * F.col("t")).alias("y"))
    return labelling.lattice_kind(plain.union(offset).union(sparse))


@query("""
WITH e AS (SELECT o_custkey % 50 AS src, o_orderkey % 50 AS dst FROM orders), r AS (SELECT src, dst, count(*) AS k FROM e GROUP BY 1, 2),
b AS (SELECT count(*) AS n FROM e WHERE (dst, src) IN (SELECT src, dst FROM e)), t AS (SELECT count(*) AS n FROM e),
d AS (SELECT src FROM e GROUP BY src HAVING count(*) <> 30)
SELECT * FROM (SELECT 'loops' AS fault, count(*) AS n FROM e WHERE src = dst UNION ALL SELECT 'repeats', count(*) FROM r WHERE k > 1
  UNION ALL SELECT 'one way', CASE WHEN b.n < 0.6 * t.n THEN t.n - b.n ELSE 0 END FROM b, t UNION ALL SELECT 'degree', count(*) FROM d) WHERE n > 0
""")
def edge_faults(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 50).alias("dst"))
    return labelling.edge_faults(edges, degree=30)


@query(f"""
WITH {SPOTS}, o(dx, dy) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
e AS (SELECT a.spot AS src, b.spot AS dst, CASE WHEN a.spot % 50 = 0 THEN 3.0 ELSE 1.0 END AS w FROM p a JOIN o ON true JOIN p b ON b.slice = a.slice AND b.x = a.x + dx AND b.y = a.y + dy WHERE a.spot % 31 <> 0 OR dx >= 0),
d AS (SELECT src, count(*) AS d FROM e GROUP BY src), z AS (SELECT max(d) AS z FROM d)
SELECT * FROM (
  SELECT 'one way' AS fault, count(*) AS n FROM e LEFT JOIN (SELECT dst AS src, src AS dst, w AS back FROM e) USING (src, dst) WHERE back IS NULL OR back <> w
  UNION ALL SELECT 'weights', count(*) FROM e JOIN d s ON s.src = e.src LEFT JOIN d t ON t.src = e.dst, z WHERE abs(w - (z / CAST(s.d AS DOUBLE) + z / CAST(coalesce(t.d, 1) AS DOUBLE)) / 2) > 1e-9) WHERE n > 0
""")
def lattice_faults(spark, sf_dir):
    """A lattice with some edges left out and some of another weight."""
    spots = _spots(spark, sf_dir)
    steps = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    asked = spots.select(F.col("spot").alias("src"), "slice", "x", "y", F.explode(steps).alias("s")).where("src % 31 <> 0 OR s.dx >= 0")
    asked = asked.select("src", "slice", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    edges = asked.join(spots.select(F.col("spot").alias("dst"), "slice", "x", "y").hint("merge"), ["slice", "x", "y"])
    return labelling.lattice_faults(edges.select("src", "dst", F.when(F.col("src") % 50 == 0, 3.0).otherwise(1.0).alias("w")))


@query("SELECT src, dst, w FROM (SELECT o_custkey AS src, o_orderkey AS dst, o_totalprice AS w, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE w > 0 AND w >= 0.8 * m")
def aligned_spots(spark, sf_dir):
    weights = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("w"))
    return labelling.aligned_spots(weights, 0.8)


@query(f"""
WITH {SPOTS}, {FIELD}, e AS (SELECT a.spot AS src, b.spot AS dst, 1.0 + a.spot % 3 AS w FROM p a JOIN p b ON b.spot = a.spot + 1 UNION ALL SELECT b.spot, a.spot, 1.0 + a.spot % 3 FROM p a JOIN p b ON b.spot = a.spot + 1),
c AS (SELECT spot FROM p WHERE x < 5), n AS (SELECT label, sum(value) AS node FROM f JOIN c USING (spot) GROUP BY label),
i AS (SELECT coalesce(sum(w) / 2, 0) AS inside FROM e WHERE src IN (FROM c) AND dst IN (FROM c)),
o AS (SELECT p.label, sum(w) AS outer_w FROM e JOIN p ON p.spot = dst WHERE src IN (FROM c) AND dst NOT IN (FROM c) GROUP BY p.label)
SELECT label, round(node, 5) AS node, round(coalesce(outer_w, 0) + inside, 5) AS edge FROM n LEFT JOIN o USING (label), i
""")
def cluster_costs(spark, sf_dir):
    spots = _spots(spark, sf_dir)
    after = spots.select((F.col("spot") - 1).alias("src"), F.col("spot").alias("dst"))
    one = spots.select(F.col("spot").alias("src")).join(after, "src").withColumn("w", 1.0 + F.col("src") % 3)
    edges = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    found = labelling.cluster_costs(_field(spark, sf_dir).select("spot", "label", "value"), edges, spots.where("x < 5"), spots)
    return found.select("label", F.round("node", 5).alias("node"), F.round("edge", 5).alias("edge"))


STATES = """
x AS (SELECT p_partkey AS id, p_size / 15.0 AS depth, (p_partkey % 101) / 100.0 AS share, 0.02 + (p_partkey % 7) / 100.0 AS vd, 0.001 * (p_partkey % 3) AS vc, 0.005 + (p_partkey % 5) / 500.0 AS vs FROM part),
c AS (SELECT a, b, (a + b) / 2.0 AS d, b / CAST(a + b AS DOUBLE) AS s FROM range(6) r(a), range(6) q(b) WHERE a + b BETWEEN 1 AND 6),
m AS (SELECT id, a, b, ((depth - d) * (depth - d) * vs - 2 * (depth - d) * (share - s) * vc + (share - s) * (share - s) * vd) / (vd * vs - vc * vc) AS m FROM x, c)
"""


@query(f"""
WITH {STATES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, a + b, a) AS nth, count(*) FILTER (m <= -2 * ln(0.05)) OVER (PARTITION BY id) AS n_consistent FROM m)
SELECT id, a, b, round(m, 5) AS distance, n_consistent FROM r WHERE nth = 1
""")
def credible_pairs(spark, sf_dir):
    key = F.col("p_partkey")
    states = table(spark, sf_dir, "part").select(key.alias("id"), (F.col("p_size") / 15.0).alias("depth"), (key % 101 / 100.0).alias("share"), (0.02 + key % 7 / 100.0).alias("v_dd"), (0.001 * (key % 3)).alias("v_ds"), (0.005 + key % 5 / 500.0).alias("v_ss"))
    return decode.credible_pairs(states, "id").select("id", "a", "b", F.round("distance", 5).alias("distance"), F.size("consistent").cast("long").alias("n_consistent"))


@query("""
WITH x AS (SELECT p_partkey AS id, 1.0 + p_size AS a, 2.0 + p_partkey % 9 AS b FROM part)
SELECT id, round((b * b * 0.3 - 2 * a * b * 0.05 + a * a * 0.4) / power(a + b, 4), 10) AS variance FROM x WHERE b * b * 0.3 - 2 * a * b * 0.05 + a * a * 0.4 > 0
""")
def share_variance(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (1.0 + F.col("p_size")).alias("a"), (2.0 + F.col("p_partkey") % 9).alias("b"))
    v = decode.share_variance(F.col("a"), F.col("b"), F.lit(0.3), F.lit(0.05), F.lit(0.4))
    return x.select("id", F.round(v, 10).alias("variance")).where("variance IS NOT NULL")


SCORES = "x AS (SELECT user_id % 6 AS clone, event_id % 400 AS bin, CAST(min(event_id % 3) AS INT) AS state, round(avg(value), 3) AS v FROM events GROUP BY 1, 2), y AS (SELECT clone, bin, state, coalesce(v, 0) AS v FROM x), s AS (SELECT clone, bin, state, [v / 10, v / 20 - 1, 3 - v / 30] AS lls FROM y)"


def _scores(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 6).alias("clone"), (F.col("event_id") % 400).alias("bin")).agg(F.min(F.col("event_id") % 3).cast("int").alias("state"), F.coalesce(F.round(F.avg("value"), 3), F.lit(0.0)).alias("v"))
    return x.select("clone", "bin", "state", F.array(F.col("v") / 10, F.col("v") / 20 - 1, 3 - F.col("v") / 30).alias("lls"))


SWAPS = "t AS (SELECT a.clone AS c1, b.clone AS c2, a.state AS s1, b.state AS s2, avg(a.lls[a.state + 1] - a.lls[b.state + 1] + b.lls[b.state + 1] - b.lls[a.state + 1]) AS t, count(*) AS n FROM s a JOIN s b ON a.bin = b.bin AND a.clone < b.clone AND a.state <> b.state GROUP BY 1, 2, 3, 4)"


@query(f"WITH {SCORES}, {SWAPS} SELECT c1, c2, s1, s2, round(t, 5) AS t, n FROM t")
def swap_statistics(spark, sf_dir):
    return decode.swap_statistics(_scores(spark, sf_dir)).withColumn("t", F.round("t", 5))


@query(f"""
WITH {SCORES}, {SWAPS}, c AS (SELECT DISTINCT clone FROM s)
SELECT a.clone AS c1, b.clone AS c2 FROM c a JOIN c b ON a.clone < b.clone WHERE NOT EXISTS (SELECT 1 FROM t WHERE c1 = a.clone AND c2 = b.clone AND (n >= 10 AND t >= 2 OR n < 10 AND n * t >= 20))
""")
def mergeable_clones(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return decode.mergeable(decode.swap_statistics(scores), scores)


@query("""
WITH s AS (SELECT l_orderkey, max(CAST(l_quantity AS BIGINT)) % 3 AS a, max(CAST(l_quantity AS BIGINT)) % 4 % 3 AS b FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, l_partkey % 3 AS pa, l_partkey % 5 % 3 AS pb FROM lineitem)
SELECT l_orderkey, bool_and((pa > 0 OR a = 0) AND (pb > 0 OR b = 0)) AND bool_or(a <> pa OR b <> pb) AS admissible FROM s JOIN p USING (l_orderkey) GROUP BY 1
""")
def admissible_states(spark, sf_dir):
    """Each order's state over the pieces that its lines are."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    size, key = F.max(F.col("l_quantity").cast("long")), F.col("l_partkey")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pair(size % 3, size % 4 % 3).alias("state"), F.collect_set(pair(key % 3, key % 5 % 3)).alias("pieces"))
    return orders.select("l_orderkey", filters.admissible(F.col("state"), F.col("pieces")).alias("admissible"))


@query("""
SELECT p_partkey, a, b, (a + b) / 2.0 AS depth, b / CAST(a + b AS DOUBLE) AS share
FROM part JOIN (SELECT a, b FROM range(6) r(a), range(6) q(b) WHERE a + b BETWEEN 1 AND 6 AND a >= b) ON a + b = p_size % 7
""")
def unphased_lattice(spark, sf_dir):
    """The pairs that each part's total of copies allows."""
    pairs = copies.lattice(spark, 6, 5, phased=False).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    depth, share = copies.depth_and_share(F.col("a"), F.col("b"))
    met = table(spark, sf_dir, "part").join(F.broadcast(pairs), F.col("p_size") % 7 == F.col("a") + F.col("b"))  # some twenty pairs
    return met.select("p_partkey", "a", "b", depth.alias("depth"), share.alias("share"))


@query("""
WITH s AS (SELECT i AS state, CAST(0.1 AS DOUBLE) * i AS mu, CAST(0.2 AS DOUBLE) + CAST(0.05 AS DOUBLE) * i AS p, i % 3 AS a, i % 2 + 1 AS b FROM range(6) r(i)),
b AS (SELECT p_partkey % 4 AS clone, p_partkey // 4 AS bin, (p_partkey * 7 + p_size) % 6 AS state FROM part)
SELECT bin, max(CASE WHEN clone = 0 THEN a END) AS clone0_a, max(CASE WHEN clone = 0 THEN b.state END) AS clone0_state, max(CASE WHEN clone = 3 THEN s.b END) AS clone3_b, round(max(CASE WHEN clone = 1 THEN p END), 6) AS clone1_p
FROM b JOIN s USING (state) GROUP BY bin
""")
def segment_output(spark, sf_dir):
    """The segment table of a run: each bin with every clone's state, parameters and copies."""
    key = F.col("p_partkey")
    bins = table(spark, sf_dir, "part").select((key % 4).alias("clone"), F.call_function("div", key, F.lit(4)).alias("bin"), ((key * 7 + F.col("p_size")) % 6).alias("state"))
    states = spark.range(6).select(F.col("id").alias("state"), (F.col("id") * 0.1).alias("mu"), (0.2 + 0.05 * F.col("id")).alias("p"), (F.col("id") % 3).alias("a"), (F.col("id") % 2 + 1).alias("b"))
    wide = outputs.segment_table(bins, states, [0, 1, 2, 3])
    return wide.select("bin", F.col("`clone0 a`").alias("clone0_a"), F.col("`clone0 state`").alias("clone0_state"), F.col("`clone3 b`").alias("clone3_b"), F.round("`clone1 p`", 6).alias("clone1_p"))


@query("""
WITH x AS (SELECT l_returnflag AS cell, count(*) AS o FROM lineitem GROUP BY 1), t AS (SELECT sum(o) AS n, count(*) AS k FROM x)
SELECT round(sum((o - n / CAST(k AS DOUBLE)) * (o - n / CAST(k AS DOUBLE)) / (n / CAST(k AS DOUBLE))), 6) AS statistic, any_value(k) AS cells,
       round(exp(-sum((o - n / CAST(k AS DOUBLE)) * (o - n / CAST(k AS DOUBLE)) / (n / CAST(k AS DOUBLE))) / 2), 8) AS p FROM x, t
""")
def chi_square_p(spark, sf_dir):
    """Three cells have two degrees of freedom, for which the tail is an exponential."""
    from tessera.operators import summaries

    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("o"))
    total = cells.agg(F.sum("o").alias("n"), F.count(F.lit(1)).alias("k"))  # one row
    expected = cells.join(F.broadcast(total), how="cross").withColumn("e", F.col("n") / F.col("k"))
    found = summaries.chi_square(expected, "o", "e")
    return found.select(F.round("statistic", 6).alias("statistic"), "cells", F.round(special.chi_square_tail(F.col("statistic"), F.col("cells") - 1), 8).alias("p"))


@query(f"""
WITH {SPOTS}, {FIELD}, m AS (
  SELECT f.spot, any_value(p.label) AS planted, max(value) FILTER (f.label = p.label) - max(value) FILTER (f.label <> p.label) AS margin, arg_max(f.label, (value, -f.label)) AS best FROM f JOIN p USING (spot) GROUP BY f.spot),
n AS (SELECT planted, best, count(*) AS n FROM m GROUP BY 1, 2), a AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2.0) AS s FROM n),
l AS (SELECT sum(k * (k - 1) / 2.0) AS sl FROM (SELECT sum(n) AS k FROM n GROUP BY planted)), r AS (SELECT sum(k * (k - 1) / 2.0) AS sr FROM (SELECT sum(n) AS k FROM n GROUP BY best))
SELECT round(quantile_cont(margin, 0.5), 6) AS margin, round(quantile_cont(margin, 0.1), 6) AS q10, round(avg(CASE WHEN margin < 0 THEN 1.0 ELSE 0.0 END), 6) AS wrong,
  (SELECT round((s - sl * sr / (n * (n - 1) / 2.0)) / ((sl + sr) / 2 - sl * sr / (n * (n - 1) / 2.0)), 6) FROM a, l, r) AS ari FROM m
""")
def field_strength(spark, sf_dir):
    found = labelling.field_strength(_field(spark, sf_dir).select("spot", "label", "value"), _spots(spark, sf_dir).select("spot", "label"))
    return found.select(*(F.round(c, 6).alias(c) for c in ("margin", "q10", "wrong", "ari")))


@query("""
SELECT round(sum((b - n * p) * (b - n * p) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)), 8) AS rho
FROM (SELECT CAST(l_linenumber AS DOUBLE) AS b, CAST(l_quantity AS DOUBLE) AS n, CAST(0.1 AS DOUBLE) + l_partkey % 7 / CAST(10 AS DOUBLE) AS p FROM lineitem) WHERE n >= 2
""")
def share_overdispersion(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("b"), F.col("l_quantity").cast("double").alias("n"), (0.1 + F.col("l_partkey") % 7 / 10.0).alias("p"))
    return labelling.overdispersion(cells, "b", "n", "p").select(F.round("rho", 8).alias("rho"))


@query("""
WITH r AS (SELECT l_suppkey AS spot, l_partkey AS gene, CAST(l_quantity AS BIGINT) AS n FROM lineitem), g AS (SELECT p_partkey AS gene, p_size AS chrom, p_partkey * 10 AS s, p_partkey * 10 + p_size AS e FROM part WHERE p_size > 10),
k AS (SELECT s_suppkey AS spot FROM supplier WHERE s_nationkey < 8), m AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT gene, sum(n) AS n FROM r JOIN k USING (spot) GROUP BY gene) USING (gene) WHERE gene IN (SELECT gene FROM r))
SELECT gene, chrom, s AS start, e AS "end", round(CAST(n AS DOUBLE) / sum(n) OVER (), 9) AS lambda FROM m
""")
def gene_baseline(spark, sf_dir):
    """The share of some suppliers' items on each part."""
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("spot"), F.col("l_partkey").alias("gene"), F.col("l_quantity").cast("long").alias("n"))
    key = F.col("p_partkey")
    genes = table(spark, sf_dir, "part").where("p_size > 10").select(key.alias("gene"), F.col("p_size").alias("chrom"), (key * 10).alias("start"), (key * 10 + F.col("p_size")).alias("end"))
    spots = table(spark, sf_dir, "supplier").where("s_nationkey < 8").select(F.col("s_suppkey").alias("spot"))
    return normal.gene_baseline(reads, spots, genes).withColumn("lambda", F.round("lambda", 9))


@query("""
WITH v AS (SELECT p_partkey AS value, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part WHERE p_size < 30)
SELECT l_orderkey, l_linenumber, l_partkey AS value, place AS "at", place IS NOT NULL AS known FROM lineitem LEFT JOIN v ON value = l_partkey
""")
def vocabulary_positions(spark, sf_dir):
    """Where each line's part is among the small parts by price."""
    parts = table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("value"), "p_retailprice")
    known = numbered(parts, "p_retailprice", "value", name="at").select("value", "at")
    return filters.positions(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("value")), known, "value", "at")
