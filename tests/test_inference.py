"""The whole slice on a planted instance, and configuration and record files."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import generate, inference
from tessera.operators import scoring, spatial
from tessera.sources import config, outputs

OFFSETS = [(0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)]


def test_planted_clones_are_recovered(spark):
    spots = generate.hex_array(spark, 12, 8).cache()
    truth = generate.bands(spots, 3, 12).cache()
    levels = [(0.0, 0.5), (math.log(1.5), 0.67), (math.log(0.5), 0.95)]
    path = generate.copy_path(spark, 3, 24, 3, 6, seed=3)
    counts = generate.draw_counts(truth, path, levels, depth=15, reads=10, seed=7).cache()
    edges = spatial.lattice_edges(spots, "spot", "row", "col", OFFSETS).cache()
    start = spots.select("spot", F.least(F.lit(2), F.call_function("div", F.col("row") + 1, F.lit(4))).cast("long").alias("label"))
    states = [inference.State(m, 0.02, p, 60.0) for m, p in [(0.0, 0.5), (0.3, 0.6), (-0.6, 0.9)]]
    fit = inference.fit(counts, start, edges, states, rounds=3)
    pairs = fit.labels.join(truth.withColumnRenamed("label", "planted"), "spot")
    found = scoring.adjusted_rand(scoring.contingency(pairs, "label", "planted"), "label", "planted").first()
    assert found["ari"] > 0.95
    assert fit.states[1].log_mu == pytest.approx(math.log(1.5), abs=0.15)


def test_generators_do_not_depend_on_partitions(spark):
    spots = generate.square_array(spark, 5, 7)
    draw = lambda df: sorted((r["spot"], r["z"]) for r in df.select("spot", generate.normal(1, F.col("spot")).alias("z")).collect())
    assert draw(spots) == draw(spots.repartition(5))
    codes = [r["barcode"] for r in generate.barcodes(spots, 16, 2).collect()]
    assert len(set(codes)) == 35 and all(len(c) == 16 and set(c) <= set("ACGT") for c in codes)


def test_manifests_and_overrides(tmp_path):
    (tmp_path / "a.toml").write_text("x = 1\n[t]\ny = 2\nz = 3\n")
    (tmp_path / "b.toml").write_text('extends = "a.toml"\n[t]\ny = 9\n')
    assert config.manifest(str(tmp_path / "b.toml"), ("x",)) == {"x": 1, "t": {"y": 9, "z": 3}}
    with pytest.raises(KeyError):
        config.manifest(str(tmp_path / "b.toml"), ("q",))
    (tmp_path / "c.json").write_text('// note\n{"a": "None", "b": {"c": 1}}\n')
    read = config.commented_json(str(tmp_path / "c.json"))
    assert read == {"a": None, "b": {"c": 1}}
    assert config.overridden(read, ["b.c=5", "b.d=1"]) == ({"a": None, "b": {"c": "5"}}, ["b.d"])
    assert config.audit(read, {"a"}) == ["b.c"]


def test_records_and_wide_tables(spark, tmp_path):
    df = spark.createDataFrame([("g1", 0, 1, 1), ("g1", 1, 2, 0), ("g2", 0, 1, 1)], "gene string, clone int, A int, B int")
    wide = outputs.wide(df, ["gene"], "clone", [0, 1], ["A", "B"])
    assert wide.columns == ["gene", "clone0 A", "clone0 B", "clone1 A", "clone1 B"] and wide.count() == 2
    path = str(tmp_path / "record")
    outputs.write_record(spark, {"calls": df}, {"run": "r"}, path)
    back, meta = outputs.read_record(spark, path)
    assert meta == {"run": "r"} and back["calls"].count() == 3
    assert outputs.content_hash(df).first() == outputs.content_hash(df.repartition(3)).first()
    long = outputs.long_profile(spark.createDataFrame([(1, 2, 0)], "bin int, t_A_copy int, t_B_copy int"), ["bin"], ["t"])
    assert [tuple(r) for r in long.collect()] == [(1, "t", 2, 0)]
