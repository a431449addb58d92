"""Queries from genes and sites to bins, of segmentations, loading filters and normal spots, on tables of the same shape.

Genes are parts (a stretch of a contig each), sites are orders, spots are
suppliers, and line items are the reads of both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bins, filters, normal, ordered, segmentation

from .registry import query, table

SPINE = """
g AS (SELECT p_partkey AS gene, p_partkey % 3 AS chr, p_partkey * 7 AS s, p_partkey * 7 + 1 + p_size AS e FROM part),
k AS (SELECT o_orderkey AS snp, o_orderkey % 3 AS chr, (o_orderkey * 5) % 14000 AS pos FROM orders),
n AS (SELECT l_suppkey AS spot, l_partkey AS gene, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
al AS (SELECT l_suppkey AS spot, l_orderkey AS snp, CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) % 5 AS b FROM lineitem),
c AS (SELECT snp, gene, row_number() OVER (PARTITION BY snp ORDER BY g.s DESC, gene DESC) AS nth FROM k JOIN g ON k.chr = g.chr AND pos >= g.s AND pos < g.e),
t AS (SELECT chr, s AS start, e AS "end", gene, CAST(NULL AS BIGINT) AS snp FROM g
      UNION ALL SELECT k.chr, pos, pos + 1, c.gene, k.snp FROM k JOIN c USING (snp) WHERE nth = 1)
"""


def _genes(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((key % 3).alias("chr"), (key * 7).alias("start"), (key * 7 + 1 + F.col("p_size")).cast("long").alias("end"), key.alias("gene"))


def _sites(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((key % 3).alias("chr"), (key * 5 % 14000).alias("pos"), key.alias("snp"))


def _reads(spark, sf_dir):
    rows, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    counts = rows.select(F.col("l_suppkey").alias("spot"), F.col("l_partkey").alias("gene"), q.alias("n"))
    return counts, rows.select(F.col("l_suppkey").alias("spot"), F.col("l_orderkey").alias("snp"), F.col("l_linenumber").cast("long").alias("a"), (q % 5).alias("b"))


def _table(spark, sf_dir):
    return bins.gene_site_table(_genes(spark, sf_dir), _sites(spark, sf_dir))


@query(f"""WITH {SPINE} SELECT chr, start, "end", gene, snp FROM t""")
def gene_site_table(spark, sf_dir):
    return _table(spark, sf_dir)


#: Overlapping genes as intervals, each row's interval, reads of sites by interval, and intervals packed to 200 reads.
BLOCKS = """
r AS (SELECT chr, s, e, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
i AS (SELECT chr, row_number() OVER (PARTITION BY chr ORDER BY s) AS rn, s AS opens FROM r WHERE before IS NULL OR s >= before),
rows AS (SELECT t.chr, t.start, t."end", t.gene, t.snp, i.rn FROM t ASOF JOIN i ON t.chr = i.chr AND t.start >= i.opens),
u AS (SELECT snp, sum(a + b) AS umi FROM al GROUP BY snp),
p AS (SELECT chr, rn, CAST(coalesce(sum(umi), 0) AS DOUBLE) AS q FROM rows LEFT JOIN u USING (snp) GROUP BY chr, rn),
f(chr, rn, total, bin, own) AS (
  SELECT DISTINCT chr, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 0, 0 FROM p
  UNION ALL
  SELECT f.chr, f.rn + 1, CASE WHEN total + q >= 200 THEN 0 ELSE total + q END, CASE WHEN total + q >= 200 THEN bin + 1 ELSE bin END, bin FROM f JOIN p ON p.chr = f.chr AND p.rn = f.rn + 1),
z AS (SELECT chr, max(bin) AS closed FROM f GROUP BY chr),
o AS (SELECT f.chr, rn, least(own, greatest(0, closed - 1)) AS own FROM f JOIN z USING (chr) WHERE rn > 0),
b AS (SELECT rows.chr, start, "end", gene, snp, dense_rank() OVER (ORDER BY rows.chr, own) - 1 AS block FROM rows JOIN o ON rows.chr = o.chr AND rows.rn = o.rn)
"""


def _blocks(spark, sf_dir):
    _, alleles = _reads(spark, sf_dir)
    umi = alleles.groupBy("snp").agg(F.sum(F.col("a") + F.col("b")).alias("umi"))
    return bins.initial_blocks(_table(spark, sf_dir), umi, 200)


@query(f"""WITH RECURSIVE {SPINE}, {BLOCKS} SELECT chr, start, "end", gene, snp, block FROM b""")
def initial_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(f"""
WITH RECURSIVE {SPINE}, {BLOCKS},
x AS (SELECT block, spot, n AS umi, 0 AS a, 0 AS total FROM (SELECT DISTINCT block, gene FROM b WHERE snp IS NULL) JOIN n USING (gene)
      UNION ALL SELECT block, spot, 0, a, a + b.b FROM (SELECT block, al.* FROM b JOIN al ON b.snp = al.snp) b)
SELECT block, spot, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(a) AS BIGINT) AS a, CAST(sum(total) AS BIGINT) AS total FROM x GROUP BY 1, 2
""")
def block_counts(spark, sf_dir):
    return bins.block_counts(_blocks(spark, sf_dir), *_reads(spark, sf_dir))


@query(f"""
WITH RECURSIVE {SPINE}, {BLOCKS},
h AS (SELECT b.*, block % 2 AS phase, block // 3 AS bin FROM b),
x AS (SELECT bin, spot, n AS umi, 0 AS a, 0 AS total FROM (SELECT DISTINCT bin, gene FROM h) JOIN n USING (gene)
      UNION ALL SELECT bin, spot, 0, CASE WHEN phase = 1 THEN a ELSE bb END, a + bb FROM (SELECT bin, phase, spot, a, al.b AS bb FROM h JOIN al ON h.snp = al.snp))
SELECT bin, spot, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(a) AS BIGINT) AS a, CAST(sum(total) AS BIGINT) AS total FROM x GROUP BY 1, 2
""")
def bin_counts(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    phase = blocks.select("block", (F.col("block") % 2).alias("phase"), F.call_function("div", F.col("block"), F.lit(3)).alias("bin")).distinct()
    return bins.block_counts(blocks, *_reads(spark, sf_dir), genes_of_sites=True, phase=phase).withColumnRenamed("block", "bin")


@query(f"""
WITH RECURSIVE {SPINE}, {BLOCKS},
x AS (SELECT block, spot, n AS umi, 0 AS total FROM (SELECT DISTINCT block, gene FROM b WHERE snp IS NULL) JOIN n USING (gene)
      UNION ALL SELECT b.block, spot, 0, a + al.b FROM b JOIN al ON b.snp = al.snp),
q AS (SELECT block, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(total) AS BIGINT) AS snp_umi, CAST(sum(CASE WHEN spot % 4 = 0 THEN umi ELSE 0 END) AS BIGINT) AS normal_umi FROM x GROUP BY 1)
SELECT block, min(chr) AS chr, min(start) AS start, max("end") AS "end", count(DISTINCT gene) AS n_genes, count(DISTINCT snp) AS n_snps,
       coalesce(any_value(umi), 0) AS umi, coalesce(any_value(snp_umi), 0) AS snp_umi, coalesce(any_value(normal_umi), 0) AS normal_umi
FROM b LEFT JOIN q USING (block) GROUP BY block
""")
def block_summary(spark, sf_dir):
    spots = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot")).where("spot % 4 = 0")
    return bins.block_summary(_blocks(spark, sf_dir), *_reads(spark, sf_dir), spots)


@query(f"""
WITH RECURSIVE {SPINE}, {BLOCKS}
SELECT block, min(chr) AS chr, min(start) AS start, max_by("end", start * 100000 + "end") AS "end", list_aggregate(list_sort(list_distinct(list(gene))), 'string_agg', ',') AS genes, count(DISTINCT snp) AS n_snps FROM b GROUP BY block
""")
def binned_table(spark, sf_dir):
    return bins.binned(_blocks(spark, sf_dir), "block").select("block", "chr", "start", "end", F.array_join(F.transform("genes", lambda x: x.cast("string")), ",").alias("genes"), "n_snps")


@query(f"""
WITH RECURSIVE {SPINE}, {BLOCKS} SELECT chr, start, gene, snp, CASE WHEN snp IS NOT NULL THEN block % 2 END AS phase FROM b
""")
def phased_rows(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return bins.phased_rows(blocks, blocks.select("block", (F.col("block") % 2).alias("phase")).distinct()).select("chr", "start", "gene", "snp", "phase")


SEGMENTS = "s AS (SELECT p_partkey AS ord, p_partkey % 3 AS contig, CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_partkey // 40 END AS label, p_size AS v FROM part)"


def _labels(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("ord"), (key % 3).alias("contig"), F.when(F.col("p_size") % 7 == 0, F.lit(-1)).otherwise(F.call_function("div", key, F.lit(40))).alias("label"), F.col("p_size").cast("long").alias("v"))


@query(f"WITH {SEGMENTS} SELECT ord, contig, CASE WHEN label >= 0 THEN dense_rank() OVER (ORDER BY CASE WHEN label >= 0 THEN label END NULLS LAST) - 1 END AS segment FROM s")
def segment_labels(spark, sf_dir):
    return segmentation.from_labels(_labels(spark, sf_dir), "label").select("ord", "contig", "segment")


@query(f"""
WITH {SEGMENTS}, d AS (SELECT *, label * 3 + contig AS g FROM s WHERE label >= 0), k AS (SELECT g, contig, row_number() OVER (PARTITION BY contig ORDER BY ord) AS pl FROM d)
SELECT g AS segment, count(DISTINCT contig) AS contigs, count(*) AS "rows", max(pl) - min(pl) + 1 AS span FROM k GROUP BY g HAVING count(DISTINCT contig) > 1 OR max(pl) - min(pl) + 1 > count(*)
UNION ALL SELECT label, count(DISTINCT contig), count(*), max(pl) - min(pl) + 1 FROM (SELECT label, contig, row_number() OVER (PARTITION BY contig ORDER BY ord) AS pl FROM s WHERE label >= 0) GROUP BY label HAVING count(DISTINCT contig) > 1 OR max(pl) - min(pl) + 1 > count(*)
""")
def segment_violations(spark, sf_dir):
    rows = _labels(spark, sf_dir).withColumn("segment", F.when(F.col("label") >= 0, F.col("label")))
    apart = rows.withColumn("segment", F.col("segment") * 3 + F.col("contig"))
    return segmentation.violations(apart).unionByName(segmentation.violations(rows))


@query(f"""
WITH {SEGMENTS}, c AS (SELECT ord, contig, v, CASE WHEN label >= 0 AND label % 5 <> 4 THEN label // 4 END AS seg FROM s),
k AS (SELECT *, CASE WHEN seg % 2 = 0 THEN seg END AS kept FROM c)
SELECT ord, CASE WHEN kept IS NOT NULL THEN dense_rank() OVER (ORDER BY kept NULLS LAST) - 1 END AS segment, CAST(CASE WHEN kept IS NULL THEN 0 ELSE sum(v) OVER (PARTITION BY kept) END AS BIGINT) AS total FROM k
""")
def coarse_selection(spark, sf_dir):
    """Coarsened, selected, aggregated over segments and carried back to genes."""
    rows = _labels(spark, sf_dir).withColumn("segment", F.when(F.col("label") >= 0, F.col("label")))
    parents = rows.where("segment IS NOT NULL").select("segment").distinct().withColumn("parent", F.when(F.col("segment") % 5 == 4, -1).otherwise(F.call_function("div", F.col("segment"), F.lit(4))))
    coarse = segmentation.coarsened(rows, parents)
    kept = segmentation.selected(coarse, coarse.where("segment % 2 = 0").select("segment"))
    sums = segmentation.over_segments(kept, "segment", "v", F.sum).withColumnRenamed("v", "total")
    return segmentation.to_genes(kept, sums, "segment", "total", 0).select("ord", "segment", "total")


@query(f"""
WITH {SEGMENTS}, l AS (SELECT contig, count(DISTINCT CASE WHEN label >= 0 THEN label END) AS n FROM s WHERE label >= 0 GROUP BY contig)
SELECT contig, clone, n AS segments FROM l, range(3) r(clone)
""")
def stacked_lengths(spark, sf_dir):
    rows = _labels(spark, sf_dir).withColumn("segment", F.when(F.col("label") >= 0, F.col("label")))
    return segmentation.stacked(segmentation.contig_lengths(rows), 3).withColumn("clone", F.col("clone").cast("long"))


@query(f"WITH {SEGMENTS} SELECT ord, CASE WHEN label >= 0 THEN label END AS fine, CASE WHEN label >= 0 THEN label // 4 END AS coarse FROM s")
def segment_lineage(spark, sf_dir):
    rows = _labels(spark, sf_dir).withColumn("segment", F.when(F.col("label") >= 0, F.col("label")))
    return segmentation.lineage({"fine": rows, "coarse": rows.withColumn("segment", F.call_function("div", F.col("segment"), F.lit(4)))}, ["ord"])


@query("""
WITH o AS (SELECT user_id % 10 AS clone, user_id % 4 AS contig, event_id AS place, event_type, row_number() OVER w AS rn, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id % 10, user_id % 4 ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY clone, contig ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT clone, contig, CAST(run AS BIGINT) AS run, event_type, min(place) AS first, max(place) AS last, count(*) AS n FROM r GROUP BY ALL
""")
def contig_runs(spark, sf_dir):
    path = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("clone"), (F.col("user_id") % 4).alias("contig"), F.col("event_id").alias("at"), "event_type")
    return segmentation.state_runs(path, "clone", "contig", "at", "event_type")


@query("""
WITH x AS (SELECT p_partkey % 3 AS chr, p_partkey * 50 AS s, p_partkey * 50 + 1 + p_size * 3 AS e, CAST(p_size // 20 AS BIGINT) AS state FROM part),
m AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY chr ORDER BY s, e)),
r AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m),
c AS (SELECT chr, state, min(s) AS s, max(e) AS e FROM r GROUP BY chr, run, state)
SELECT chr, state, piece, s + piece * 100 AS s, least(e, s + piece * 100 + 100) AS e FROM (SELECT *, unnest(range(0, CAST(greatest(1, ceil((e - s) / 100.0)) AS BIGINT))) AS piece FROM c)
""")
def collapsed_pieces(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    ranges = table(spark, sf_dir, "part").select((key % 3).alias("chr"), (key * 50).alias("s"), (key * 50 + 1 + size * 3).alias("e"), F.call_function("div", size, F.lit(20)).alias("state"))
    return segmentation.split_ranges(segmentation.collapsed(ranges, "chr", "s", "e", "state"), "s", "e", 100).withColumn("piece", F.col("piece").cast("long"))


@query("""
WITH x AS (SELECT p_partkey % 3 AS chr, p_partkey AS ord, p_partkey * 0.01 AS a, p_partkey * 0.01 + 0.005 AS b FROM part),
l AS (SELECT *, lead(a) OVER (PARTITION BY chr ORDER BY ord) - b AS gap FROM x)
SELECT ord, round(CASE WHEN gap IS NULL THEN ln(least(0.5, 1e-3 * exp(-1.0))) ELSE ln(least(0.5, greatest((1 - exp(-2 * 2.0 * gap)) / 2, 1e-3) * exp(-1.0))) END, 6) AS log_switch FROM l
""")
def site_switches(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select((key % 3).alias("chr"), key.alias("ord"), (key * 0.01).alias("a"), (key * 0.01 + 0.005).alias("b"))
    return bins.site_switches(rows, "chr", "ord", "a", "b", 2.0, 1.0, 1e-3).select("ord", F.round("log_switch", 6).alias("log_switch"))


@query("SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey), c_mktsegment) - 1 AS code FROM customer GROUP BY 1")
def first_seen_codes(spark, sf_dir):
    return filters.first_seen_codes(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey")


@query(f"""
WITH {SPINE} SELECT u.spot FROM (SELECT spot FROM n GROUP BY spot HAVING sum(n) >= 1000) u JOIN (SELECT spot FROM al GROUP BY spot HAVING sum(a + b) >= 1000) v USING (spot)
""")
def covered_spots(spark, sf_dir):
    return filters.covered_spots(*_reads(spark, sf_dir), 1000)


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#1') OR regexp_matches(p_brand, '5$') AS named, try_cast(substr(p_brand, 8) AS DOUBLE) IS NOT NULL AS numeric_tail FROM part")
def name_patterns(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", filters.named_like(F.col("p_brand"), ["^Brand#1", "5$"]).alias("named"), filters.is_numeric(F.substring("p_brand", 8, 1000)).alias("numeric_tail"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'Normal' ELSE 'Clone ' || repeat('X', CAST(n_nationkey // 10 AS INT)) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][CAST(n_nationkey % 10 AS INT) + 1] END AS name FROM nation
""")
def clone_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", filters.clone_name(F.concat(F.lit("clone "), F.col("n_nationkey").cast("string")), with_normal=True).alias("name"))


@query("SELECT o_orderkey FROM orders, (SELECT quantile_cont(o_totalprice, 0.75) AS cut FROM orders) WHERE o_totalprice >= cut")
def masked_top(spark, sf_dir):
    return filters.masked(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "top", reads="o_totalprice", top=0.25).select("o_orderkey")


@query("""
WITH c AS (SELECT l_returnflag AS r, l_linenumber AS k, count(*) AS v FROM lineitem GROUP BY 1, 2),
m AS (SELECT v, sum(v) OVER (PARTITION BY r) AS a, sum(v) OVER (PARTITION BY k) AS b, sum(v) OVER () AS t FROM c)
SELECT bool_and(abs(v - a * b / t) <= 1e-9 * greatest(1, abs(v))) AS exact, count(*) AS cells FROM m
""")
def rank_one(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("v"))
    return filters.rank_one(cells, "l_returnflag", "l_linenumber", "v")


@query("SELECT l_suppkey AS spot, count(*) FILTER (l_quantity > 10) AS n_depth, count(*) FILTER (l_linenumber > 2) AS n_share FROM lineitem GROUP BY 1")
def valid_bins(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("spot"), (F.col("l_quantity") - 10).alias("base"), (F.col("l_linenumber") - 2).alias("total"))
    return filters.valid_bins(cells)


@query("""
WITH a AS (SELECT c_custkey AS id, c_custkey % 97 AS x, c_custkey // 97 AS y FROM customer), b AS (SELECT s_suppkey AS other, s_suppkey * 3 % 97 + 0.25 AS x, s_suppkey // 3 + 0.5 AS y FROM supplier)
SELECT id, other, round(sqrt(d2), 6) AS distance FROM (SELECT id, other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), other) AS nth FROM a, b) WHERE nth = 1
""")
def nearest_row(spark, sf_dir):
    key, s = F.col("c_custkey"), F.col("s_suppkey")
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    first = table(spark, sf_dir, "customer").select(key.alias("id"), (key % 97).alias("x"), div(key, 97).alias("y"))
    second = table(spark, sf_dir, "supplier").select(s.alias("other"), (s * 3 % 97 + 0.25).alias("x"), (div(s, 3) + 0.5).alias("y"))
    return filters.nearest_row(first, second, "id", "other", 4.0).withColumn("distance", F.round("distance", 6))


@query("""
WITH x AS (SELECT l_suppkey % 2 AS slice, l_partkey % 40 AS gene, l_suppkey % 3 = 0 AS normal, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
s AS (SELECT slice, gene, sum(CASE WHEN normal THEN n ELSE 0 END) AS u, sum(CASE WHEN normal THEN 0 ELSE n END) AS t FROM x GROUP BY 1, 2),
w AS (SELECT slice, sum(u) AS uu, sum(t) AS tt, quantile_cont(u + t, 0.8) AS cut FROM s GROUP BY 1)
SELECT slice, gene, CAST(u + t AS BIGINT) AS total, round(CASE WHEN u = 0 OR t = 0 THEN 10 ELSE log2((t * 1e6 / tt) / (u * 1e6 / uu)) END, 6) AS log2fc,
       abs(CASE WHEN u = 0 OR t = 0 THEN 10 ELSE log2((t * 1e6 / tt) / (u * 1e6 / uu)) END) >= 0.05 AND u + t >= cut AS flagged FROM s JOIN w USING (slice)
""")
def differential_genes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    counts = rows.select(F.col("l_suppkey").alias("spot"), (F.col("l_partkey") % 40).alias("gene"), F.col("l_quantity").cast("long").alias("n"))
    groups = rows.select(F.col("l_suppkey").alias("spot")).distinct().select("spot", (F.col("spot") % 2).alias("slice"), (F.col("spot") % 3 == 0).alias("normal"))
    return normal.differential_genes(counts, groups, 0.05, 0.8).withColumn("log2fc", F.round("log2fc", 6))


@query("""
WITH b AS (SELECT p_partkey AS bin, CAST(p_size % 30 AS BIGINT) AS k, CAST(30 + p_partkey % 11 AS BIGINT) AS n FROM part),
d AS (SELECT DISTINCT k, n FROM b),
m AS (SELECT d.k, d.n, i, exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + lgamma(i + 15.0) + lgamma(n - i + 15.0) - lgamma(n + 30.0) - 2 * lgamma(15.0) + lgamma(30.0)) AS f FROM d, range(0, 41) r(i) WHERE i <= n),
c AS (SELECT k, n, sum(CASE WHEN i <= k THEN f ELSE 0 END) AS cdf, sum(CASE WHEN i = k THEN f ELSE 0 END) AS pmf FROM m GROUP BY 1, 2)
SELECT bin, cdf < 0.05 OR cdf - pmf >= 0.95 AS removed FROM b JOIN c USING (k, n)
""")
def unbalanced_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bin"), (F.col("p_size") % 30).cast("long").alias("b"), (30 + F.col("p_partkey") % 11).cast("long").alias("total"))
    return normal.unbalanced_bins(rows, 30.0, 0.05, 0.95).select("bin", "removed")


@query("""
WITH p AS (SELECT s_suppkey AS spot, (s_suppkey % 20) / 20.0 AS proportion FROM supplier), q AS (SELECT l_suppkey AS spot, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY 1),
m AS (SELECT * FROM p JOIN q USING (spot)), s AS (SELECT i, sum(total) AS s FROM m, range(1, 12) r(i) WHERE proportion < round(0.05 * i, 2) GROUP BY i),
c AS (SELECT coalesce(min(i), 11) AS i FROM s WHERE s > (SELECT sum(total) * 0.2 FROM q))
SELECT spot FROM m, c WHERE proportion < round(0.05 * i, 2)
""")
def normal_by_proportion(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot"), ((F.col("s_suppkey") % 20) / 20.0).alias("proportion"))
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("spot")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return normal.by_proportion(p, q, q.agg(F.sum("total") * 0.2).first()[0] or 0)


LOCAL = """
p AS (SELECT user_id % 5 AS clone, user_id % 3 AS contig, event_id // 20 AS bin, avg(value / 1000.0) AS baf FROM events GROUP BY 1, 2, 3),
w AS (SELECT clone, contig, bin, avg(greatest(abs(coalesce(baf, 0.5) - 0.5) - 0.05, 0)) OVER (PARTITION BY clone, contig ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM p)
"""


@query(f"WITH {LOCAL} SELECT clone, contig, bin, l <= min(l) OVER (PARTITION BY contig, bin) + 0.01 AS normal FROM w")
def local_normal(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("clone"), (F.col("user_id") % 3).alias("contig"), F.call_function("div", F.col("event_id"), F.lit(20)).alias("bin")).agg(F.coalesce(F.avg(F.col("value") / 1000.0), F.lit(0.5)).alias("baf"))
    return normal.local_normal(p, 2, 0.05, 0.01)


@query("""
WITH x AS (SELECT l_partkey % 50 AS bin, l_suppkey AS spot, CAST(l_quantity AS BIGINT) AS umi, l_suppkey % 4 AS clone FROM lineitem),
o AS (SELECT bin, sum(CASE WHEN (clone + bin) % 2 = 0 THEN umi ELSE 0 END) AS own FROM x GROUP BY bin HAVING sum(CASE WHEN (clone + bin) % 2 = 0 THEN umi ELSE 0 END) >= 50),
l AS (SELECT bin, own / sum(own) OVER () AS lam FROM o), t AS (SELECT spot, sum(umi) AS total FROM x JOIN l USING (bin) GROUP BY spot)
SELECT bin, spot, round(lam * total, 4) AS base FROM (SELECT bin, spot FROM x GROUP BY 1, 2) JOIN l USING (bin) JOIN t USING (spot)
""")
def local_baseline(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("bin"), F.col("l_suppkey").alias("spot")).agg(F.sum(F.col("l_quantity").cast("long")).alias("umi"))
    labels = x.select("spot").distinct().withColumn("clone", F.col("spot") % 4)
    local = x.select("bin").distinct().withColumn("clone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("normal", (F.col("clone") + F.col("bin")) % 2 == 0)
    return normal.local_baseline(x, labels, local, 50).withColumn("base", F.round("base", 4))


MASK = """
x AS (SELECT l_partkey % 60 AS bin, l_suppkey AS spot, l_suppkey % 6 AS clone, CAST(l_quantity AS BIGINT) AS umi, CAST(l_discount AS DOUBLE) AS d FROM lineitem),
p AS (SELECT clone, bin, avg(d) * 10 + clone * (bin // 15) % 4 * CAST(0.04 AS DOUBLE) AS baf FROM x GROUP BY 1, 2),
n AS (SELECT clone, count(DISTINCT spot) AS spots, CAST(sum(umi) AS DOUBLE) AS lib FROM x GROUP BY 1),
g AS (SELECT p.clone, p.bin, greatest(abs(baf - 0.5) - 0.05, 0) AS dev, sum(umi) / any_value(lib) AS y, ln(1 + sum(umi) / CAST(any_value(spots) AS DOUBLE)) AS lx FROM p JOIN x USING (clone, bin) JOIN n USING (clone) GROUP BY p.clone, p.bin, baf),
a AS (SELECT arg_min(clone, (dev, clone)) AS anchor FROM (SELECT clone, sum(dev) AS dev FROM g GROUP BY clone)),
m AS (SELECT g.*, coalesce(o.y, 0) AS xa, g.clone = anchor AS own FROM g JOIN a ON true LEFT JOIN g o ON o.bin = g.bin AND o.clone = anchor),
w AS (SELECT clone, bin, own, avg(dev) OVER z AS local, sum(xa * y / (xa + 1e-8)) OVER z AS xy, sum(xa * xa / (xa + 1e-8)) OVER z AS xx, stddev_pop(lx) OVER z AS sd FROM m WINDOW z AS (PARTITION BY clone ORDER BY bin RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
f AS (SELECT *, NOT own AND local <= min(local) OVER (PARTITION BY bin) + 0.01 AND xx > 1e-12 AND xy / xx BETWEEN 0.8 AND 1.25 AS fits FROM w),
l AS (SELECT bin, list_concat([coalesce(max(sd) FILTER (own), 0)], coalesce(list(sd ORDER BY sd, clone) FILTER (fits), [])) AS pool, coalesce(list(clone ORDER BY sd, clone) FILTER (fits), []) AS cs FROM f GROUP BY bin),
k AS (SELECT bin, cs, pool, len(pool) AS n, i, least(greatest(CAST(floor(p * len(pool)) AS BIGINT), 1), len(pool) - 2) + 1 AS k FROM l, (VALUES PERCENTILES) q(i, p) WHERE len(pool) > 3),
s AS (SELECT bin, i, k, n, list_sum(pool) / n AS mu, list_sum(pool[1:k]) / k AS m1, list_sum(pool[k + 1:n]) / (n - k) AS m2, pool FROM k),
t AS (SELECT bin, i, k, list_sum(list_transform(pool[1:k], lambda v: (v - m1) * (v - m1))) + list_sum(list_transform(pool[k + 1:n], lambda v: (v - m2) * (v - m2))) AS within, k * (m1 - mu) * (m1 - mu) + (n - k) * (m2 - mu) * (m2 - mu) AS between FROM s),
c AS (SELECT bin, arg_min(k, i) AS k FROM t WHERE within > 1e-12 AND between > 1.1 * within GROUP BY bin)
""".replace("PERCENTILES", ", ".join(f"({i}, CAST({p!r} AS DOUBLE))" for i, p in enumerate(normal.PERCENTILES))).replace("between", "apart")


@query(f"WITH {MASK} SELECT f.clone, f.bin, f.own OR list_contains(cs[1:coalesce(c.k, len(pool)) - 1], f.clone) AS normal FROM f JOIN l USING (bin) LEFT JOIN c USING (bin)")
def local_normal_mask(spark, sf_dir):
    """The clones of suppliers that are normal in each bin of parts."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("bin"), F.col("l_suppkey").alias("spot"), (F.col("l_suppkey") % 6).alias("clone"), F.col("l_quantity").cast("long").alias("umi"), "l_discount")
    step = F.col("clone") * F.call_function("div", F.col("bin"), F.lit(15)) % 4 * 0.04
    profiles = x.groupBy("clone", "bin").agg((F.avg(F.col("l_discount").cast("double")) * 10 + F.first(step)).alias("baf"))
    return normal.local_mask(profiles, x.select("spot", "clone").distinct(), x.groupBy("spot", "bin").agg(F.sum("umi").alias("umi")), 4)


@query("""
WITH x AS (SELECT p_partkey % 6 AS contig, p_partkey AS seg, CAST(p_size AS DOUBLE) AS len, CAST(p_retailprice AS DOUBLE) AS w FROM part)
SELECT seg FROM (SELECT *, count(*) OVER (PARTITION BY contig) AS n FROM x) WHERE (len < 10 OR w < 950) AND n > 1
""")
def short_segments(spark, sf_dir):
    x = table(spark, sf_dir, "part").select((F.col("p_partkey") % 6).alias("contig"), F.col("p_partkey").alias("seg"), F.col("p_size").alias("len"), F.col("p_retailprice").alias("w"))
    return bins.short_segments(x, "contig", "len", "w", 10, 950).select("seg")


@query("""
SELECT p_partkey, round(least(ln(0.5), ln(0.5 * (1 - exp(-2 * 0.1 * exp(-1.0) * p_size)))), 6) AS log_switch FROM part WHERE p_size > 0
""")
def composable_switch(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size > 0")
    return rows.select("p_partkey", F.round(ordered.composable_switch(F.col("p_size").cast("double"), 0.1, 1.0), 6).alias("log_switch"))
