"""Rules of loading, normal spots and graphs against brute force on small cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import simulate
from tessera.operators import filters, intervals, labelling, normal
from tessera.sources import arrays


def test_admissible_over_many_pieces(spark):
    every = list(itertools.product(range(3), repeat=2))
    rng = random.Random(1)
    rows = [(i, rng.choice(every), [rng.choice(every) for _ in range(rng.randrange(4))]) for i in range(300)] + [(300, (0, 2), [(0, 1), (1, 1)])]
    pair = "struct<a: long, b: long>"
    df = spark.createDataFrame(rows, f"id long, s {pair}, p array<{pair}>")
    got = {r["id"]: r["ok"] for r in df.select("id", filters.admissible(F.col("s"), F.col("p")).alias("ok")).collect()}
    for i, (a, b), pieces in rows:
        assert got[i] == (all((pa or not a) and (pb or not b) for pa, pb in pieces) and any((a, b) != x for x in pieces))
    assert got[300]


def test_proportion_keeps_the_last_step(spark):
    spots = spark.createDataFrame([(1, 0.5), (2, 0.54), (3, 0.56), (4, None)], "spot long, proportion double")
    totals = spark.createDataFrame([(i, 10) for i in (1, 2, 3, 4)], "spot long, total long")
    kept = lambda needed: sorted(r["spot"] for r in normal.by_proportion(spots, totals, needed).collect())
    assert kept(1000) == [1, 2] and kept(5) == [1, 2] and kept(19) == [1, 2]
    assert normal.by_proportion(spots.limit(0), totals, 1).collect() == []


def test_forbidden_labels_cost_more_than_any_gain(spark):
    inf = float("-inf")
    field = spark.createDataFrame([(1, 0, 5.0), (1, 1, inf), (2, 0, -3.0), (2, 1, 4.0), (3, 0, inf), (3, 1, 1.0)], "spot long, label long, value double")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 2.0)], "src long, dst long, w double")
    got = {(r["spot"], r["label"]): r["value"] for r in labelling.finite(field, edges, 0.5).collect()}
    assert got[1, 1] == pytest.approx(5.0 - 0.5 * 1.0 - 1) and got[3, 0] == pytest.approx(1.0 - 0.5 * 1.0 - 1) and got[2, 0] == -3.0
    with pytest.raises(Exception, match="spot 9"):
        labelling.finite(field.unionByName(spark.createDataFrame([(9, 0, inf), (9, 1, inf)], field.schema)), edges, 0.5).collect()


def test_lattice_faults(spark):
    spots = [(i, j) for i in range(4) for j in range(3)]
    degree = {s: sum((s[0] + dx, s[1] + dy) in spots for dx, dy in ((0, 1), (0, -1), (1, 0), (-1, 0))) for s in spots}
    rows = [(spots.index(s), spots.index(t), (4 / degree[s] + 4 / degree[t]) / 2) for s in spots for t in spots if abs(s[0] - t[0]) + abs(s[1] - t[1]) == 1]
    frame = lambda r: spark.createDataFrame(r, "src long, dst long, w double")
    faults = lambda r, z=4: {x["fault"]: x["n"] for x in labelling.lattice_faults(frame(r), z).collect()}
    assert faults(rows) == {} and faults([]) == {}
    assert faults([(a, b, 1.0) for a, b, _ in rows])["weights"] > 0
    assert faults([*rows, (0, 0, 1.0)])["loops"] == 1
    assert faults([*rows, rows[0]])["repeats"] == 1
    assert faults(rows[1:])["one way"] == 1


def test_most_overlap_keeps_rows_of_one_key(spark):
    items = spark.createDataFrame([(7, 0, 0, 10), (7, 0, 0, 10), (7, 0, 25, 90), (8, 0, 500, 501)], "item long, chr long, s long, e long")
    tiles = spark.createDataFrame([(i, 0, i * 30, i * 30 + 30) for i in range(5)], "tile long, chr long, ts long, te long")
    got = sorted(tuple(r) for r in intervals.most_overlap(items, tiles, "item", "chr", "s", "e", "ts", "te", "tile", 30).collect())
    assert got == [(7, 0, 10), (7, 0, 10), (7, 1, 30)]


def test_matrix_market_of_many_small_files(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"m{i}.mtx").write_text(f"%%MatrixMarket matrix coordinate integer general\n% file {i}\n\n9 9 2\n1 {i % 9 + 1} 3\n2 2 {i}\n")
    assert arrays.matrix_market(spark, f"{tmp_path}/*.mtx").count() == 80
    assert arrays.matrix_market_faults(spark, f"{tmp_path}/*.mtx").collect() == []
    (tmp_path / "m0.mtx").write_text("%%MatrixMarket\n2 2 3\n1 1 1\n3 1 1\n")
    assert [(r["entries"], r["found"], r["beyond"]) for r in arrays.matrix_market_faults(spark, f"{tmp_path}/*.mtx").collect()] == [(3, 2, 1)]


def _broadcasts(frame):
    """Broadcast exchanges of a plan as it ran."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_lattice_faults_of_odd_edges(spark):
    """Repeats, edges without an end, and weights that are NULL or unlike, with no table of edges or spots broadcast."""
    rows = [(1, 2, 1.0), (1, 2, 2.0), (2, 1, 1.0), (3, 4, None), (4, 3, 1.0), (5, 6, None), (6, 5, None), (None, 7, 1.0), (7, None, 1.0), (8, 8, 1.0), (None, None, 1.0)]
    found = labelling.lattice_faults(spark.createDataFrame(rows, "src long, dst long, w double"), 1)
    assert _broadcasts(found) == 0
    assert {r["fault"]: r["n"] for r in found.collect()} == {"loops": 1, "repeats": 1, "one way": 8, "weights": 3}


def test_folded_field_broadcasts_no_list_of_what_is_allowed(spark):
    field = spark.createDataFrame([(s, s % 2, k, float(s + k)) for s in range(6) for k in range(3)], "spot long, slice long, label long, value double")
    allowed = spark.createDataFrame([(0, 1), (0, 1), (3, 2)], "spot long, label long")
    out = labelling.folded(field, None, allowed)
    assert _broadcasts(out) == 0
    assert sorted((r["spot"], r["label"], r["value"]) for r in out.where("value > float('-inf')").collect()) == [(0, 1, 1.0), (3, 2, 5.0)]
    assert out.count() == 18


def test_field_strength_of_ties_and_nulls(spark):
    """Ties go to the smaller label, spots without a value for their own label have no margin, and no aggregate sorts the field."""
    rows = [(1, 0, 2.0), (1, 1, 2.0), (1, 2, 0.5), (2, 0, 1.0), (2, 1, 4.0), (3, 1, None), (3, 2, None), (4, 0, 9.0), (4, 2, 9.5)]
    field = spark.createDataFrame(rows, "spot long, label long, value double")
    planted = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1)], "spot long, label long")
    ran = []
    keep = labelling.stage
    try:
        labelling.stage = lambda df, name: ran.append(df) or keep(df, name)
        got = labelling.field_strength(field, planted).first()
    finally:
        labelling.stage = keep
    assert (got["margin"], got["q10"], got["wrong"]) == (1.5, pytest.approx(0.3), 0.0)
    assert {(r["planted"], r["best"], r["margin"]) for r in ran[0].collect()} == {(1, 0, 0.0), (1, 1, 3.0), (2, 1, None), (1, 2, None)}
    assert "SortAggregate" not in ran[0]._jdf.queryExecution().executedPlan().toString()


def test_matrix_market_files_of_few_entries(spark, tmp_path):
    """No file holds all entries, each is whole in its form, and an empty matrix has a file too."""
    cells = spark.range(500).select(F.col("id").alias("row"), (F.col("id") * 7 % 50).alias("col"), (F.col("id") / 4).alias("value"))
    arrays.write_matrix_market(cells, f"{tmp_path}/some", 50)
    assert arrays.matrix_market_faults(spark, f"{tmp_path}/some").collect() == []
    assert sorted(tuple(r) for r in arrays.matrix_market(spark, f"{tmp_path}/some").collect()) == sorted(tuple(r) for r in cells.collect())
    sizes = [int(p.read_text().splitlines()[2].split()[2]) for p in (tmp_path / "some").glob("part-*")]
    assert len(sizes) == 10 and sum(sizes) == 500 and max(sizes) < 150
    arrays.write_matrix_market(cells.limit(0), f"{tmp_path}/none", 50)
    assert arrays.matrix_market(spark, f"{tmp_path}/none").count() == 0


def test_allele_reads_side_by_side(spark, monkeypatch):
    """Draws follow the beta-binomial, do not depend on batches, and take no generator a row but for very many reads."""
    n, alpha, beta = np.full(40_000, 12), np.full(40_000, 2.0), np.full(40_000, 5.0)
    drawn = simulate.inverted(simulate.uniforms(3, np.arange(40_000), np.arange(40_000) % 7), n, alpha, beta)
    law = [math.comb(12, k) * math.exp(math.lgamma(k + 2) + math.lgamma(12 - k + 5) - math.lgamma(19) - math.lgamma(2) - math.lgamma(5) + math.lgamma(7)) for k in range(13)]
    assert np.abs(np.bincount(drawn, minlength=13) / 40_000 - law).max() < 0.01 and drawn.max() <= 12
    assert simulate.inverted(np.array([0.0, 0.999999, 0.5]), np.array([0, 3, 1]), np.full(3, 1e-9), np.full(3, 20.0)).tolist() == [0, 0, 0]
    assert len(simulate.inverted(np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))) == 0
    trials = spark.range(300).select((F.col("id") % 20).alias("spot"), F.col("id").alias("snp"), F.when(F.col("id") == 7, 5000).otherwise(F.col("id") % 9).alias("total"), F.lit(0.3).alias("share"), (F.col("id") % 2 == 0).alias("flipped"))
    one, many = (sorted(tuple(r) for r in simulate.allele_reads(trials.repartition(k), 20.0, 2).collect()) for k in (1, 9))
    assert one == many and all(a >= 0 and b >= 0 and a + b == (5000 if snp == 7 else snp % 9) for _, snp, a, b in one)
