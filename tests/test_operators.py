"""Operators against direct computations on small planted tables and edge cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.likelihood import bb_log_pmf, lgamma, nb_log_pmf
from tessera.graph import components
from tessera.operators import copies, counts, hmm, intervals, ordered, scoring, spatial
from tessera.sources import tables


def test_lgamma_matches_the_library(spark):
    xs = [1e-10, 1e-3, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12345.6, 1e7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("y")).collect()
    for r in got:
        assert r["y"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-12)


def test_mass_functions_add_to_one_and_guard(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("k"))
    nb = df.agg(F.sum(F.exp(nb_log_pmf(F.col("k"), F.lit(3.0), F.lit(0.2), F.lit(0.5))))).first()[0]
    bb = df.where("k <= 40").agg(F.sum(F.exp(bb_log_pmf(F.col("k"), F.lit(40.0), F.lit(0.3), F.lit(5.0))))).first()[0]
    assert nb == pytest.approx(1, abs=1e-6) and bb == pytest.approx(1, abs=1e-9)
    zero = df.limit(1).select(nb_log_pmf(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.1)).alias("a"), bb_log_pmf(F.lit(5.0), F.lit(3.0), F.lit(0.5), F.lit(1.0)).alias("b")).first()
    assert tuple(zero) == (0.0, 0.0)


def test_adjusted_rand_extremes(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a long, b long")
    assert scoring.adjusted_rand(scoring.contingency(same, "a", "b"), "a", "b").first()["ari"] == pytest.approx(1)
    one = spark.createDataFrame([(0, 0)] * 5, "a long, b long")
    assert scoring.adjusted_rand(scoring.contingency(one, "a", "b"), "a", "b").first()["ari"] == 1.0


def test_classes_and_phase(spark):
    codes = [1001, 2000, 2002, 2001, 1000, 0]
    df = spark.createDataFrame([(c,) for c in codes], "c long")
    got = [tuple(r) for r in df.select("c", scoring.copy_class(F.col("c")), scoring.swapped(F.col("c")), scoring.phase_free(F.col("c"))).collect()]
    assert got == [(1001, "neutral", 1001, 1001), (2000, "loh", 2, 2), (2002, "balanced_gain", 2002, 2002), (2001, "unbalanced_gain", 1002, 1002), (1000, "loh", 1, 1), (0, "loh", 0, 0)]


def test_pack_merges_a_short_tail(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 5.0, 3.0, 9.0, 1.0])] + [("b", 0, 1.0)], "g string, i long, v double")
    got = {(r["g"], r["i"]): r["bin"] for r in ordered.pack(df, "g", ["i"], "v", 10).collect()}
    assert [got["a", i] for i in range(5)] == [0, 0, 1, 1, 1] and got["b", 0] == 0


def test_intervals_edges(spark):
    points = spark.createDataFrame([(i, 1, i) for i in range(10)] + [(99, 2, 5)], "p long, chr long, x long")
    ranges = spark.createDataFrame([(1, 1, 2, 5), (2, 1, 4, 8), (3, 1, 4, 6)], "id long, chr long, s long, e long")
    got = dict(tuple(r) for r in intervals.nearest_start(points, ranges, "p", "chr", "x", "s", "e", "id").collect())
    assert got == {2: 1, 3: 1, 4: 3, 5: 3, 6: 2, 7: 2}
    kept = {r["p"] for r in intervals.outside(points, ranges, "chr", "x", "s", "e").collect()}
    assert kept == {0, 1, 8, 9, 99}


def test_interpolation_before_between_after(spark):
    points = spark.createDataFrame([(i, c, x) for i, (c, x) in enumerate([(1, 5), (1, 10), (1, 15), (1, 30), (2, 4)])], "i long, chr long, x long")
    markers = spark.createDataFrame([(1, 10, 1.0), (1, 20, 3.0)], "chr long, pos long, cm double")
    got = {r["i"]: r["cm"] for r in intervals.interpolate(points, markers, "chr", "x", "pos", "cm").collect()}
    assert got == {0: 0.5, 1: 1.0, 2: 2.0, 3: 3.0, 4: None}


def test_viterbi_against_all_paths(spark):
    rng = np.random.default_rng(0)
    e = np.log(rng.dirichlet([1, 1], 6))
    df = spark.createDataFrame([("u", i, float(a), float(b)) for i, (a, b) in enumerate(e)], "g string, i long, e0 double, e1 double")
    trans, start = hmm.transitions(2, 0.8), [math.log(0.5)] * 2
    score = lambda p: start[p[0]] + e[0][p[0]] + sum(trans[a][b] + e[t + 1][b] for t, (a, b) in enumerate(zip(p, p[1:])))
    paths = list(itertools.product((0, 1), repeat=6))
    got = [r["state"] for r in hmm.viterbi(df, "g", ["i"], ["e0", "e1"], trans, start).orderBy("i").collect()]
    assert tuple(got) == max(paths, key=score)
    total = math.log(sum(math.exp(score(p)) for p in paths))
    assert hmm.forward(df, "g", ["i"], ["e0", "e1"], trans, start).first()["log_likelihood"] == pytest.approx(total)
    p0 = sum(math.exp(score(p) - total) for p in paths if p[2] == 0)
    post = hmm.posteriors(df, "g", ["i"], ["e0", "e1"], trans, start).where("i = 2").first()
    assert post["posterior"][0] == pytest.approx(p0)


def test_phased_posteriors_fold_to_plain_states(spark):
    rng = np.random.default_rng(1)
    rows = [("u", i, *map(float, np.log(rng.dirichlet([1] * 4))), math.log(0.1)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i long, e0 double, e1 double, e2 double, e3 double, w double")
    got = hmm.posteriors(df, "g", ["i"], ["e0", "e1", "e2", "e3"], hmm.transitions(2, 0.9), [math.log(0.5)] * 2, switch="w").collect()
    assert all(sum(r["posterior"]) == pytest.approx(1) and r["state"] in (0, 1) for r in got)


def test_matching_and_ploidy_decode():
    assert copies.match_labels({(0, 1): 9, (0, 0): 1, (1, 0): 5, (1, 1): 8}) == {0: 1, 1: 0}
    states = [(1.0, 0.5, 50), (1.5, 2 / 3, 20), (0.5, 1.0, 10)]
    assert copies.decode_within_ploidy(states, 0) == [(1, 1), (2, 1), (1, 0)]


def test_icm_never_lowers_the_objective(spark):
    n = 30
    rng = np.random.default_rng(2)
    field = spark.createDataFrame([(s, k, float(rng.normal())) for s in range(n) for k in range(3)], "spot long, label long, value double")
    pairs = [(i, (i + 1) % n) for i in range(n)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src long, dst long, w double")
    labels = spark.createDataFrame([(s, s % 3) for s in range(n)], "spot long, label long")
    energy = lambda x: spatial.potts_energy(field, edges, x, 0.7).first()["total"]
    assert energy(spatial.icm(field, edges, labels, 0.7, sweeps=1, colours=3)) >= energy(labels)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 4), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (5, 4)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["root"] for r in components(chain).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_floor_labels_without_survivors(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "l long, w double")
    assert counts.floor_labels(df, "l", "w", 10, 0).count() == 0


def test_sources(spark, tmp_path):
    sheet = tmp_path / "sheet.tsv"
    sheet.write_text("# a comment\nbam sample_id spaceranger_dir snp_dir\nx.bam  s1 d1\tn1\n")
    assert [tuple(r) for r in tables.sample_sheet(spark, str(sheet)).collect()] == [("x.bam", "s1", "d1", "n1")]
    bad = tmp_path / "bad.tsv"
    bad.write_text("bam sample_id\nx s\n")
    with pytest.raises(ValueError):
        tables.sample_sheet(spark, str(bad))
    names = tmp_path / "barcodes.txt"
    names.write_text("ACGT-1_s1\nTTTT-1\n")
    assert [tuple(r)[1:] for r in tables.barcodes(spark, str(names)).orderBy("ord").collect()] == [("ACGT-1_s1", "ACGT-1", "s1"), ("TTTT-1", "TTTT-1", None)]
    spots = tmp_path / "spots.csv"
    spots.write_text("barcode,in_tissue,array_row,array_col,pxl_row,pxl_col\nA,1,0,0,5,6\nB,0,1,1,7,8\n")
    assert [r["barcode"] for r in tables.tissue_positions(spark, str(spots)).collect()] == ["A"]
    labels = tmp_path / "labels.tsv"
    labels.write_text("barcode\tlabels\nA\tnormal\nB\tclone_2\n")
    assert {tuple(r) for r in tables.clone_labels(spark, str(labels)).collect()} == {("A", 0), ("B", 3)}
    ledger = str(tmp_path / "ledger")
    tables.append_ledger(spark.createDataFrame([("r", "m")], "run string, metric string"), ledger)
    with pytest.raises(ValueError):
        tables.append_ledger(spark.createDataFrame([("r", "a\tb")], "run string, metric string"), ledger)
    assert spark.read.parquet(ledger).count() == 1
