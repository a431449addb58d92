"""Queries of interval and ordered-sequence operators, on tables of the same shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import intervals, ordered

from .registry import query, table

DAY = 86_400


def _seconds(c):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _days(c):
    return F.call_function("div", _seconds(c), F.lit(DAY))


WINDOWS = """
w AS (SELECT o_orderkey AS id, o_orderkey % 3 AS chr, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS s, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 1 + o_custkey % 20 AS e FROM orders),
p AS (SELECT o_orderkey AS point, o_orderkey % 3 AS chr, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS day FROM orders)
"""


#: Points that come up to 3,000 days after their orders, so that many lie in no window.
LATER = "q AS (SELECT o_orderkey AS point, o_orderkey % 3 AS chr, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + o_custkey % 1000 * 3 AS day FROM orders)"


def _windows(spark, sf_dir, later=False):
    orders = table(spark, sf_dir, "orders")
    w = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("chr"), _days("o_orderdate").alias("s"), (_days("o_orderdate") + 1 + F.col("o_custkey") % 20).alias("e"))
    return orders.select(F.col("o_orderkey").alias("point"), (F.col("o_orderkey") % 3).alias("chr"), (_days("o_orderdate") + (F.col("o_custkey") % 1000 * 3 if later else 0)).alias("day")), w


@query(f"""
WITH {WINDOWS}
SELECT point, id FROM (SELECT point, id, row_number() OVER (PARTITION BY point ORDER BY s DESC, id DESC) AS nth FROM p JOIN w ON p.chr = w.chr AND day >= s AND day < e) WHERE nth = 1
""")
def point_in_interval(spark, sf_dir):
    points, ranges = _windows(spark, sf_dir)
    return intervals.nearest_start(points, ranges, "point", "chr", "day", "s", "e", "id")


@query(f"""
WITH {WINDOWS}, {LATER}
SELECT point, chr, day FROM q p WHERE NOT EXISTS (SELECT 1 FROM w WHERE p.chr = w.chr AND day >= s AND day < e)
""")
def range_anti(spark, sf_dir):
    points, ranges = _windows(spark, sf_dir, later=True)
    return intervals.outside(points, ranges, "chr", "day", "s", "e").select("point", "chr", "day")


@query(f"""
WITH {WINDOWS}, {LATER}
SELECT point, coalesce(max_by(id, id), -1) AS id FROM q p LEFT JOIN w ON p.chr = w.chr AND day >= s AND day < e GROUP BY point
""")
def last_event_wins(spark, sf_dir):
    points, ranges = _windows(spark, sf_dir, later=True)
    return intervals.last_event(points, ranges.withColumn("ord", F.col("id")), "point", "chr", "day", "s", "e", "ord", "id", -1)


LINES = "l AS (SELECT l_orderkey * 8 + l_linenumber AS item, l_suppkey AS chr, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_quantity >= 1)"


def _lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_quantity >= 1")
    return items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"), F.col("l_suppkey").alias("chr"), _days("l_shipdate").alias("s"), (_days("l_shipdate") + F.col("l_quantity").cast("long")).alias("e"))


@query(f"""
WITH {LINES}, m AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM l),
t AS (SELECT i AS tile, i * 30 AS ts, i * 30 + 30 AS te FROM range(0, 1000) r(i)),
o AS (SELECT rid, item, tile, least(e, te) - greatest(s, ts) AS overlap FROM m JOIN t ON s < te AND ts < e)
SELECT item, tile, overlap FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY overlap DESC, tile) AS nth FROM o) WHERE nth = 1
""")
def max_overlap_join(spark, sf_dir):
    tiles = spark.range(1000).select(F.col("id").alias("tile"), (F.col("id") * 30).alias("ts"), (F.col("id") * 30 + 30).alias("te"), F.lit(0).alias("chr"))
    items = _lines(spark, sf_dir).withColumn("chr", F.lit(0))
    return intervals.most_overlap(items, tiles, "item", "chr", "s", "e", "ts", "te", "tile", 30)


@query(f"""
WITH {LINES},
b AS (SELECT chr, s, e, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
g AS (SELECT chr, s, e, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS block FROM b)
SELECT chr, CAST(block AS BIGINT) AS block, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY chr, block
""")
def merge_intervals(spark, sf_dir):
    return intervals.merged(_lines(spark, sf_dir), "chr", "s", "e")


@query(f"""
WITH {LINES},
x AS (SELECT DISTINCT chr, unnest([s, e]) AS edge FROM l)
SELECT chr, edge AS s, after AS e FROM (SELECT chr, edge, lead(edge) OVER (PARTITION BY chr ORDER BY edge) AS after FROM x) WHERE after IS NOT NULL
""")
def elementary_segments(spark, sf_dir):
    return intervals.elementary(_lines(spark, sf_dir), "chr", "s", "e")


@query("""
WITH m AS (SELECT user_id % 7 AS chr, epoch_us(ts) // 1000000 // 86400 * 86400 AS pos, CAST(count(*) AS DOUBLE) AS cm FROM events GROUP BY 1, 2),
p AS (SELECT event_id, user_id % 7 AS chr, epoch_us(ts) // 1000000 + 40000 AS here FROM events),
b AS (SELECT p.*, m.pos AS p0, m.cm AS v0 FROM p ASOF LEFT JOIN m ON p.chr = m.chr AND p.here >= m.pos),
a AS (SELECT b.*, m.pos AS p1, m.cm AS v1 FROM b ASOF LEFT JOIN m ON b.chr = m.chr AND b.here < m.pos)
SELECT event_id, round(CASE WHEN p1 IS NULL THEN v0 ELSE coalesce(v0, 0) + (here - coalesce(p0, 0)) * (v1 - coalesce(v0, 0)) / (p1 - coalesce(p0, 0)) END, 8) AS cm FROM a
""")
def asof_interp(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    day = (_days("ts") * DAY).alias("pos")
    markers = events.groupBy((F.col("user_id") % 7).alias("chr"), day).agg(F.count(F.lit(1)).alias("cm"))
    points = events.select("event_id", (F.col("user_id") % 7).alias("chr"), (_seconds("ts") + 40000).alias("here"))
    return intervals.interpolate(points, markers, "chr", "here", "pos", "cm").select("event_id", F.round("cm", 8).alias("cm"))


@query("""
WITH o AS (SELECT user_id, event_type, ts, event_id, row_number() OVER w AS rn, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(rn) - 1 AS first, max(rn) - 1 AS last, count(*) AS n FROM r GROUP BY user_id, run, event_type
""")
def rle_runs(spark, sf_dir):
    return intervals.runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@query("""
WITH g AS (SELECT event_id, lead(epoch_us(ts) // 1000000) OVER w - epoch_us(ts) // 1000000 AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(greatest(coalesce((1 - exp(-2 * 1e-6 * d)) / 2, 0.001), 0.001), 6) AS p_switch FROM g
""")
def switch_prob(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", _seconds("ts").alias("at"))
    return ordered.switch_probability(events, "user_id", ["ts", "event_id"], "at", 1e-6, 0.001).select("event_id", F.round("p_switch", 6).alias("p_switch"))


ITEMS = "x AS (SELECT l_suppkey AS chr, l_orderkey AS k, l_linenumber AS l, l_quantity AS q, CAST(round(l_extendedprice) AS BIGINT) AS w, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, round(l_extendedprice)) AS rn FROM lineitem)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("q"), F.round("l_extendedprice").cast("long").alias("w"))


@query(f"""
WITH RECURSIVE {ITEMS},
f(chr, rn, total, bin, own) AS (
  SELECT chr, 0, CAST(0 AS DOUBLE), 0, 0 FROM (SELECT DISTINCT chr FROM x)
  UNION ALL
  SELECT f.chr, f.rn + 1, CASE WHEN total + q >= 120 THEN 0 ELSE total + q END, CASE WHEN total + q >= 120 THEN bin + 1 ELSE bin END, bin
  FROM f JOIN x ON x.chr = f.chr AND x.rn = f.rn + 1),
e AS (SELECT chr, max(bin) AS closed FROM f GROUP BY chr)
SELECT x.chr, x.k, x.l, x.q, CAST(least(own, greatest(0, closed - 1)) AS BIGINT) AS bin FROM f JOIN x USING (chr, rn) JOIN e USING (chr) WHERE rn > 0
""")
def greedy_pack(spark, sf_dir):
    return ordered.pack(_items(spark, sf_dir), "chr", ["k", "l"], "q", 120)


@query(f"""
WITH RECURSIVE {ITEMS},
f(chr, rn, q0, w0, bin, own) AS (
  SELECT chr, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0, 0 FROM (SELECT DISTINCT chr FROM x)
  UNION ALL
  SELECT f.chr, f.rn + 1, CASE WHEN q0 + q >= 100 AND w0 + w >= 150000 THEN 0 ELSE q0 + q END, CASE WHEN q0 + q >= 100 AND w0 + w >= 150000 THEN 0 ELSE w0 + w END,
         CASE WHEN q0 + q >= 100 AND w0 + w >= 150000 THEN bin + 1 ELSE bin END, bin
  FROM f JOIN x ON x.chr = f.chr AND x.rn = f.rn + 1),
e AS (SELECT chr, max(bin) AS closed FROM f GROUP BY chr)
SELECT x.chr, x.k, x.l, x.q, x.w, CAST(least(own, greatest(0, closed - 1)) AS BIGINT) AS segment FROM f JOIN x USING (chr, rn) JOIN e USING (chr) WHERE rn > 0
""")
def floored_merge(spark, sf_dir):
    return ordered.floored(_items(spark, sf_dir), "chr", ["k", "l"], "q", "w", 100, 150_000)


@query(f"""
WITH RECURSIVE {ITEMS},
f(chr, rn, since, last, piece) AS (
  SELECT chr, 0, 0, CAST(NULL AS DOUBLE), 0 FROM (SELECT DISTINCT chr FROM x)
  UNION ALL
  SELECT f.chr, f.rn + 1, CASE WHEN f.rn > since + 5 AND abs(q - last) >= 20 THEN f.rn ELSE since END, q,
         CASE WHEN f.rn > since + 5 AND abs(q - last) >= 20 THEN piece + 1 ELSE piece END
  FROM f JOIN x ON x.chr = f.chr AND x.rn = f.rn + 1)
SELECT x.chr, x.k, x.l, x.q, CAST(piece AS BIGINT) AS piece FROM f JOIN x USING (chr, rn) WHERE rn > 0
""")
def refined_cuts(spark, sf_dir):
    return ordered.cut_at_steps(_items(spark, sf_dir), "chr", ["k", "l"], "q", 20, 5)


@query("""
SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 2 AS BIGINT) AS phase FROM events
""")
def phase_parity(spark, sf_dir):
    return ordered.parity(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "phase")


@query(f"""
WITH {ITEMS}
SELECT chr, k, l, q, sum(q) OVER (PARTITION BY chr ORDER BY k, l, q ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS moving,
       sum(q) OVER (PARTITION BY chr ORDER BY k RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS ranged FROM x
""")
def moving_sum(spark, sf_dir):
    items = _items(spark, sf_dir).drop("w")
    return ordered.range_sum(ordered.moving_sum(items, "chr", ["k", "l", "q"], "q", 5), "chr", "k", "q", 50)


@query("""
WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
             first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM v)
SELECT event_id, coalesce(back, ahead) AS filled FROM b
""")
def ffill_bfill(spark, sf_dir):
    values = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return ordered.filled(values, "user_id", ["ts", "event_id"], "v").select("event_id", "filled")
