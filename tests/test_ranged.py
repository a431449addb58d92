"""Arrays read by ranges, and sources, outputs and helpers that no query runs."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import generate
from tessera.operators import bins, filters, fitting, normal, segmentation
from tessera.sources import arrays, outputs, ranged, runs, tables


def sparse(path, dense, compressed):
    rows, cols = np.nonzero(dense)
    pointers = np.concatenate([[0], np.cumsum((dense != 0).sum(axis=1))])
    data = dense[rows, cols].astype(np.float32)
    # a stored zero
    (np.savez_compressed if compressed else np.savez)(path, data=np.append(data, 0), indices=np.append(cols, 0).astype(np.int32), indptr=np.append(pointers[:-1], pointers[-1] + 1).astype(np.int32), format=b"csr", shape=np.array(dense.shape))
    return {(int(r), int(c), float(dense[r, c])) for r, c in zip(rows, cols)}


def test_arrays_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranged, "BATCH", 7)
    names = np.array([f"chr1_{i}_é" for i in range(50)])
    np.save(tmp_path / "a.npy", names)
    np.save(tmp_path / "b.npy", np.arange(30) * 2)
    np.save(tmp_path / "empty.npy", np.zeros(0))
    got = ranged.npy(spark, f"{tmp_path}/a.npy", entries=8)
    assert got.rdd.getNumPartitions() == 7
    assert {r["at"]: r["value"] for r in got.collect()} == dict(enumerate(names.tolist())) == {r["at"]: r["value"] for r in arrays.npy(spark, f"{tmp_path}/a.npy").collect()}
    assert [r["value"] for r in ranged.npy(spark, f"{tmp_path}/b.npy", "long", 11).orderBy("at").collect()] == list(range(0, 60, 2))
    assert ranged.npy(spark, f"{tmp_path}/empty.npy", "double").collect() == []
    np.save(tmp_path / "square.npy", np.zeros((2, 2)))
    for bad in ("square.npy", "none.npy"):
        with pytest.raises(Exception):
            ranged.npy(spark, f"{tmp_path}/{bad}").collect()


@pytest.mark.parametrize("compressed", [False, True])
def test_sparse_rows_by_ranges(spark, tmp_path, compressed):
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 5, (20, 9)) * (rng.random((20, 9)) < 0.4)
    dense[3] = 0
    want = sparse(tmp_path / "m.npz", dense, compressed)
    got = ranged.npz_sparse(spark, f"{tmp_path}/m.npz", 13)
    assert got.rdd.getNumPartitions() > 3
    assert {tuple(r) for r in got.collect()} == want == {tuple(r) for r in arrays.npz_sparse(spark, f"{tmp_path}/m.npz").collect()}
    assert zipfile.is_zipfile(tmp_path / "m.npz")


def test_allele_counts(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 3, (4, 5)) for _ in range(2))
    sites = np.array([f"1_{i}_A_C" for i in range(5)])
    np.save(tmp_path / "unique_snp_ids.npy", sites)
    sparse(tmp_path / "cell_snp_Aallele.npz", a, True)
    sparse(tmp_path / "cell_snp_Ballele.npz", b, True)
    spots = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "ord long, spot string")
    want = {(f"s{i}", sites[j], int(a[i, j]), int(b[i, j])) for i in range(4) for j in range(5) if a[i, j] or b[i, j]}
    assert {tuple(r) for r in arrays.allele_counts(spark, str(tmp_path), spots).collect()} == want


def test_files_of_runs(spark, tmp_path):
    (tmp_path / "ranges.tsv").write_text("chr\tstart\tend\tx\nchr3\t5\t9\t1\n")
    rows, missing = runs.clone_ranges(spark, f"{tmp_path}/ranges.tsv", ("clone",))
    assert missing == ["clone"] and tuple(rows.first()) == ("3", 5, 9, "1")
    (tmp_path / "excluded.bed").write_text("chr1\t1\t5\n2\t3\t4\n")
    assert sorted(map(tuple, tables.excluded_ranges(spark, f"{tmp_path}/excluded.bed").collect())) == [("1", 1, 5), ("2", 3, 4)]
    (tmp_path / "deny.txt").write_text("G1\nG2\n")
    assert sorted(r["gene"] for r in tables.gene_denylist(spark, f"{tmp_path}/deny.txt").collect()) == ["G1", "G2"]
    (tmp_path / "map.tsv").write_text("chrom\tpos\tpos_cm\nchr2\t100\t0.5\nchrX\t1\t0.1\n")
    assert [tuple(r) for r in tables.genetic_map(spark, f"{tmp_path}/map.tsv").collect()] == [(2, 100, 0.5)]
    folder = tmp_path / "sim"
    folder.mkdir()
    (folder / "labels.tsv").write_text("barcode\tlabel\nb1\tclone_0\n")
    (folder / "profile.tsv").write_text("chr\tstart\tend\tn_A_copy\tn_B_copy\tc_A_copy\tc_B_copy\n1\t0\t9\t1\t1\t2\t0\n")
    labels, profile = runs.simulated(spark, str(folder), ["n", "c"])
    assert tuple(labels.first()) == ("b1", "clone_0")
    assert sorted(map(tuple, profile.collect())) == [("1", 0, 9, "c", 2, 0), ("1", 0, 9, "n", 1, 1)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "spot long, slice string")
    runs.write_sample({"spots": df, "events": df.select("spot")}, f"{tmp_path}/drawn", {"spots": "slice"})
    held = runs.realization(spark, f"{tmp_path}/drawn")
    assert set(held) == {"spots", "events"} and held["spots"].where("slice = 'b'").first()["spot"] == 2
    runs.write_staged({n: df for n in ("labels", "copies", "fit")}, f"{tmp_path}/run")
    assert {n: t.count() for n, t in runs.run_tables(spark, f"{tmp_path}/run").items()} == {"labels": 2, "copies": 2, "fit": 2}
    old = tmp_path / "old"
    old.mkdir()
    for n in ("clone_labels", "cnv_seglevel", "cnv_perstate"):
        (old / f"{n}.tsv").write_text("a\tb\n1\t2\n")
    assert tuple(runs.run_tables(spark, str(old))["fit"].first()) == (1, 2)


def test_output_tables(spark):
    spots = spark.createDataFrame([("b2", "s", 1, 2), ("b1", "s", 0, 5)], "barcode string, sample_id string, x long, y long")
    labels = spark.createDataFrame([("b1", 0), ("b2", 1)], "barcode string, clone_label long")
    tumour = spark.createDataFrame([("b1", 0.5)], "barcode string, tumor_proportion double")
    assert [tuple(r) for r in outputs.clone_label_table(spots, labels, tumour).collect()] == [("b1", "s", 0, 5, 0, 0.5), ("b2", "s", 1, 2, 1, None)]
    copies = spark.createDataFrame([(0, c, c, 1) for c in range(2)], "bin long, clone long, A long, B long")
    genes = spark.createDataFrame([("G", 0), ("H", None)], "gene string, bin long")
    assert outputs.gene_table(genes, copies, [0, 1]).first().asDict() == {"gene": "G", "clone0 A": 0, "clone0 B": 1, "clone1 A": 1, "clone1 B": 1}
    states = spark.createDataFrame([(s, c, 0.1 * s) for s in range(2) for c in range(2) if (s, c) != (1, 1)], "state long, clone long, mu double")
    assert [r["state"] for r in outputs.state_table(states, [0, 1], ["mu"]).collect()] == [0]
    ledger = spark.createDataFrame([("r", "f", "ari", 1, "0.5"), ("r", "f", "ari", 2, "0.7")], "run_id string, fixture string, metric string, definition long, value string")
    definitions = spark.createDataFrame([("ari", 1, "2024"), ("ari", 2, "2025")], "metric string, definition long, since string")
    assert [r["value"] for r in outputs.latest_metrics(ledger, definitions).collect()] == [0.7]


def test_helpers(spark):
    spots = spark.createDataFrame([(i, i % 3, i // 3) for i in range(9)], "spot long, x long, y long")
    inside, other = filters.window_crop(spots, "x", "y", (0, 1, 1, 2), spots.select("spot", F.lit(1).alias("v")))
    assert sorted(r["spot"] for r in inside.collect()) == [3, 4, 6, 7] == sorted(r["spot"] for r in other.collect())
    blocks = spark.createDataFrame([(i, 1 + i // 4, i * 10, i * 10 + 10, 1.0) for i in range(8)], "bin long, chr long, start long, end long, w double")
    merged = {r["bin"]: r["merged"] for r in bins.floor_bins(blocks, 20, 2, "w").collect()}
    assert len(set(merged.values())) == 4 and merged[0] == merged[1] != merged[2] and merged[3] != merged[4]
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 100.0)], "chr long, u double, v double")
    points = spark.createDataFrame([(1, 5.0)], "chr long, at double")
    there = segmentation.warped(points, knots, "chr", "at", "w")
    assert there.first()["w"] == 50.0 and segmentation.warped(there.select("chr", F.col("w").alias("at")), knots, "chr", "at", "back", back=True).first()["back"] == 5.0
    drawn = spark.range(4000).select(generate.bootstrap_weight(F.col("id"), F.lit(1), 7).alias("w")).agg(F.avg("w"), F.max("w")).first()
    assert abs(drawn[0] - 1) < 0.08 and drawn[1] >= 3
    snps = spark.createDataFrame([(1, i, 0.3) for i in range(400)], "chr long, pos long, p double")
    phases = [r["phase"] for r in generate.switched(snps, "chr", "pos", "p", 3).orderBy("pos").collect()]
    assert 60 < sum(a != b for a, b in zip(phases, phases[1:])) < 180
    counts = spark.createDataFrame([(1, "g", 2), (1, "h", 3)], "spot long, gene string, n long")
    assert [r["gene"] for r in normal.without_flagged(counts, spark.createDataFrame([("g", True), ("h", False)], "gene string, flagged boolean")).collect()] == ["h"]
    totals = spark.createDataFrame([(i, float(i % 2 * 50), float(i % 2 * 9 + i * 0.01)) for i in range(20)], "spot long, a double, b double")
    split = {r["spot"]: r["cluster"] for r in normal.two_clusters(totals, "spot", ["a", "b"]).collect()}
    assert len({split[i] for i in range(0, 20, 2)}) == 1 and split[0] != split[1]


def test_fitting_helpers(spark):
    cells = spark.createDataFrame([(c, i, int(50 * (1 + c)), 50.0, 10 + 5 * (i % 2), 30) for c in range(2) for i in range(20)], "clone long, bin long, umi long, base double, a long, total long")
    params = fitting.Params((0.0, 0.7), (0.1, 0.1), (0.5, 0.3), (30.0, 30.0))
    path = spark.createDataFrame([(c, i, c) for c in range(2) for i in range(20)], "clone long, bin long, state long")
    shifts = {r["clone"]: r["shift"] for r in fitting.baseline_shifts(cells, path, params, "clone", ["bin"]).collect()}
    assert shifts == pytest.approx({0: 0.0, 1: 0.7})
    start = fitting.spread_starts(cells, 3, seed=2)
    # each further state is a cell
    assert start.states == 3 and (start.log_mu[0], start.p[0]) == (0.0, 0.5)
    assert all(min(abs(m), abs(m - np.log(2))) < 1e-9 and min(abs(p - 10.5 / 31), abs(p - 15.5 / 31)) < 1e-9 for m, p in zip(start.log_mu[1:], start.p[1:]))
    profiles = spark.createDataFrame([(c, i, 0.8 if i < 5 else 0.2) for c in range(2) for i in range(10)], "clone long, bin long, share double")
    votes = {r["bin"]: r["phase"] for r in fitting.phased_by_vote(profiles, path.select("clone", "bin"), 0.1).collect()}
    assert votes == {i: int(i < 5) for i in range(10)}
