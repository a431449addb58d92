"""Bins, filters, fits, labels, decoding, files and simulations against brute force and planted cases."""

import io
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import simulate
from tessera.functions import special
from tessera.functions.likelihood import bb_log_pmf, nb_log_pmf
from tessera.operators import bins, chunks, decode, filters, fitting, labelling, normal, ordered
from tessera.sources import arrays, outputs, runs, tables


def plain_bins(rows, floors, longest):
    """Greedy packing of (length, sums...) rows as the docstring of ``Bins`` says, by restarting sums."""
    out, s, k = [], 0, 0
    n = len(rows)
    met = lambda a, b: all(sum(r[i + 1] for r in rows[a:b]) >= f for i, f in enumerate(floors))
    while s < n:
        t = s + 1
        while t < n:
            if met(s, t):
                if sum(r[0] for r in rows[s:t]) >= longest:
                    t = max(t - 1, s + 1)
                break
            t += 1
        if s > 0 and t == n and not met(s, t):
            out += [k - 1] * (t - s)
        else:
            out += [k] * (t - s)
            k += 1
        s = t
    return out


def test_bins_meet_floors_and_back_off_where_too_long():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.randrange(1, 30), rng.randrange(20), rng.randrange(5)) for _ in range(rng.randrange(1, 25))]
        floors, longest = (25, 6), 60
        fold, got = bins.Bins(floors, longest), []
        cut = rng.randrange(len(rows) + 1)
        for part in (rows[:cut], rows[cut:]):
            if part:
                got += fold.feed(*(np.array(c, float) for c in zip(*part)))
        assert got + fold.end() == plain_bins(rows, floors, longest)


def test_bin_ranges_do_not_cross_cuts_or_long_blocks(spark):
    rows = [(i, 100 * i, 100 * i + (900 if i == 6 else 50), 10) for i in range(12)]
    blocks = spark.createDataFrame(rows, "block long, start long, end long, umi long")
    cuts = spark.createDataFrame([(9,)], "block long")
    got = {r["block"]: r["bin"] for r in bins.bin_ranges(blocks, {"umi": 20}, 500, cuts).collect()}
    assert [got[i] for i in range(12)] == [0, 0, 1, 1, 2, 2, 3, 4, 4, 5, 5, 5]


def test_gene_site_table_within_reach(spark):
    genes = spark.createDataFrame([(1, 0, 100, 1), (1, 10, 50, 2), (2, 0, 9, 3)], "chr long, start long, end long, gene long")
    sites = spark.createDataFrame([(1, 20, 7), (1, 60, 8), (1, 100, 9), (2, 3, 10)], "chr long, pos long, snp long")
    of = lambda reach: {r["snp"]: r["gene"] for r in bins.gene_site_table(genes, sites, reach).where("snp IS NOT NULL").collect()}
    assert of(None) == of(100) == {7: 2, 8: 1, 10: 3}
    assert of(2) == {7: 2, 10: 3}


def test_folds_carry_over_batches(spark):
    rows = [(g, i, float((g * 7 + i * 3) % 11)) for g in range(5) for i in range(400 + g)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r["g"], r["i"]): r["bin"] for r in ordered.pack(df, "g", ["i"], "v", 25).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for g in range(5):
        total, bin_, want = 0.0, 0, []
        for _, _, v in (r for r in rows if r[0] == g):
            want.append(bin_)
            total += v
            if total >= 25:
                total, bin_ = 0.0, bin_ + 1
        assert [got[g, i] for i in range(len(want))] == [min(b, max(0, bin_ - 1)) for b in want]


def test_whole_groups_are_whole():
    import pyarrow as pa

    rng = random.Random(2)
    keys = sorted(rng.randrange(30) for _ in range(500)) + [None] * 5
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 17], pa.int64())], ["k"]) for i in range(0, len(keys), 17)]
    seen = []
    for batch, edges in chunks.whole_groups(iter(batches), rows=40):
        values = batch.column(0).to_pylist()
        for lo, hi in zip(edges[:-1], edges[1:]):
            assert len(set(values[lo:hi])) == 1
            seen.append((values[lo], hi - lo))
    assert len({k for k, _ in seen}) == len(seen) and sum(n for _, n in seen) == len(keys)


def test_special_functions(spark):
    xs = [0.05, 0.5, 1.0, 3.7, 40.0, 1e5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(special.digamma(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        h = 1e-4 * x
        assert g == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5, abs=1e-6)
    tails = df.limit(1).select(*(special.chi_square_tail(F.lit(s), F.lit(d)) for s, d in ((5.991464547, 2.0), (3.841458821, 1.0), (0.5, 2.0), (60.0, 40.0)))).first()
    assert list(tails) == pytest.approx([0.05, 0.05, math.exp(-0.25), sum(math.exp(-30) * 30**k / math.factorial(k) for k in range(20))], rel=1e-6)
    assert special.chi_square_cut(0.95) == pytest.approx(5.991464547) and special.chi_square_cut(0.95, 1) == pytest.approx(3.841458821, rel=1e-6)


def test_partials_are_slopes(spark):
    one = spark.range(1)
    at = lambda c: one.select(c).first()[0]
    h = 1e-5
    for k, base, mu, alpha in ((7, 4.0, 0.3, 0.2), (0, 9.0, -0.5, 1.3), (120, 50.0, 0.4, 0.05)):
        f = lambda m, la: at(nb_log_pmf(F.lit(k), F.lit(base), F.lit(m), F.lit(math.exp(la))))
        part = special.nb_partials(F.lit(k), F.lit(base), F.lit(mu), F.lit(alpha))
        la = math.log(alpha)
        assert at(part["log_mu"]) == pytest.approx((f(mu + h, la) - f(mu - h, la)) / (2 * h), rel=1e-3, abs=1e-4)
        assert at(part["log_alpha"]) == pytest.approx((f(mu, la + h) - f(mu, la - h)) / (2 * h), rel=1e-3, abs=1e-4)
    for k, n, p, tau in ((3, 10, 0.4, 12.0), (0, 5, 0.2, 40.0)):
        logit = math.log(p / (1 - p))
        f = lambda x, lt: at(bb_log_pmf(F.lit(k), F.lit(n), F.lit(1 / (1 + math.exp(-x))), F.lit(math.exp(lt))))
        part = special.bb_partials(F.lit(k), F.lit(n), F.lit(p), F.lit(tau))
        lt = math.log(tau)
        assert at(part["logit_p"]) == pytest.approx((f(logit + h, lt) - f(logit - h, lt)) / (2 * h), rel=1e-3, abs=1e-4)
        assert at(part["log_tau"]) == pytest.approx((f(logit, lt + h) - f(logit, lt - h)) / (2 * h), rel=1e-3, abs=1e-4)


def planted_cells(spark, bins_each=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for chain in range(4):
        state = 0
        for i in range(bins_each):
            state = 1 - state if rng.random() < 0.03 else state
            mean, p = 20.0 * (1.0, 1.8)[state], (0.5, 0.2)[state]
            umi = int(rng.poisson(rng.gamma(10.0) * mean / 10.0))
            total = int(rng.integers(5, 30))
            rows.append((f"c{chain}", i, umi, 20.0, int(rng.binomial(total, rng.beta(p * 40, (1 - p) * 40))), total, state))
    return spark.createDataFrame(rows, "chain string, bin long, umi long, base double, a long, total long, truth long")


def test_fit_rises_every_round_and_finds_planted_states(spark):
    cells = planted_cells(spark)
    start = fitting.Params((0.2, 0.3), (0.5, 0.5), (0.45, 0.35), (10.0, 10.0))
    found, levels = fitting.fitted(cells, start, 0.97, "chain", ["bin"], rounds=2, inner=1)
    assert all(b >= a - 1e-6 for a, b in zip(levels, levels[1:])) and levels[-1] > levels[0]
    at = int(np.argmax(found.log_mu))
    assert found.log_mu[at] > found.log_mu[1 - at] + 0.1 and found.p[at] < found.p[1 - at] - 0.1
    x = fitting.packed(found, share_alpha=True)
    again = fitting.unpacked(x, found, share_alpha=True)
    assert again.log_mu == pytest.approx(found.log_mu) and again.p == pytest.approx(found.p) and again.tau == pytest.approx(found.tau)
    hard = fitting.dispersions(cells.withColumnRenamed("truth", "state"), fitting.Params((0.0, math.log(1.8)), (0.5, 0.5), (0.5, 0.2), (10.0, 10.0)), rounds=1)
    assert all(a < 0.5 for a in hard.alpha) and all(t >= 10 for t in hard.tau)


def test_observed_errors_of_a_quadratic():
    inverse = fitting.observed_errors(lambda t: -2 * t[0] ** 2 - 0.5 * t[1] ** 2, np.array([0.1, -0.2]))
    assert np.allclose(inverse, [[0.25, 0], [0, 1.0]], atol=1e-4)
    errors = fitting.errors(fitting.Params((0.0,), (0.1,), (0.5,), (10.0,)), np.eye(4))
    assert errors == {"log_mu": [1.0], "p": [0.25], "alpha": [0.1], "tau": [10.0]}


def test_components_and_neutral_state(spark):
    out = fitting.distinct_components(np.array([[0.0, 0], [0.05, 0], [2.0, 0]]), np.array([0.5, 0.2, 0.3]), 0.1)
    assert [round(w, 6) for _, w in out] == [0.7, 0.3]
    path = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 0)], "clone long, state long")
    params = fitting.Params((0.0, 0.1, 0.2), (0.1,) * 3, (0.5, 0.48, 0.5), (30.0,) * 3)
    assert fitting.neutral_state(path, params, 0) == 1


def small_field(spark):
    rng = random.Random(3)
    n = 36
    edges = [(i, j, 1.0) for i in range(n) for j in (i + 1, i + 6) if j < n and (j != i + 1 or j % 6)]
    edges = edges + [(j, i, w) for i, j, w in edges]
    values = {(i, k): rng.random() * 2 for i in range(n) for k in range(3)}
    field = spark.createDataFrame([(i, k, v) for (i, k), v in values.items()], "spot long, label long, value double")
    labels = spark.createDataFrame([(i, rng.randrange(3)) for i in range(n)], "spot long, label long")
    return field, spark.createDataFrame(edges, "src long, dst long, w double"), labels, values


def test_floor_and_expansion(spark):
    field, edges, labels, values = small_field(spark)
    total = lambda x: labelling.spatial.potts_energy(field, edges, x, 0.4).first()["total"]
    moved = labelling.expansion(field, edges, labels, 0.4, 1)
    assert total(moved) >= total(labels)
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = min(sizes, key=lambda k: (sizes[k], k))
    floored = {r["spot"]: r["label"] for r in labelling.floor_labels(field, labels, sizes[small] + 1).collect()}
    old = {r["spot"]: r["label"] for r in labels.collect()}
    left = [k for k in range(3) if k != small]
    if len({k for k in floored.values()}) == 2:
        assert all(floored[i] == (old[i] if old[i] != small else max(left, key=lambda k: (values[i, k], -k))) for i in old)
    fine = labelling.finite(field.withColumn("value", F.when(F.col("label") == 2, F.lit(float("-inf"))).otherwise(F.col("value"))), edges, 0.4)
    # less than a spot's other values and its own edges together can make up for
    degree = {r["src"]: r["n"] for r in edges.groupBy("src").agg(F.sum("w").alias("n")).collect()}
    for r in fine.where("label = 2").collect():
        assert r["value"] == pytest.approx(min(values[r["spot"], k] for k in (0, 1)) - 0.4 * degree[r["spot"]] - 1)
    assert {(r["spot"], r["label"]): r["value"] for r in fine.where("label < 2").collect()} == {k: v for k, v in values.items() if k[1] < 2}


def test_starts_and_deals(spark):
    spots = spark.createDataFrame([(i, i % 20, i // 20) for i in range(400)], "spot long, x long, y long")
    held = labelling.block_starts(spots, 4, seed=2).groupBy("label").count().collect()
    assert len(held) == 4 and all(r["count"] >= 20 for r in held)
    assert labelling.feasible([5, 5, 5], 3, 5) and not labelling.feasible([9, 1, 1], 2, 3)
    starts = labelling.refined_starts(spots.withColumn("parent", F.col("x") % 2), spark.createDataFrame([(0, 100.0), (1, 1.0)], "parent long, w double"), 3, 50.0)
    assert sorted(r["label"] for r in starts.select("label").distinct().collect()) == [0, 1, 2, 3]
    assert labelling.allowed_labels(starts).where("spot = 0").count() == 3
    best = labelling.trial_partitions(spots, 2, 2, 30).first()
    assert 0 <= best["trial"] < 30 and best["variance"] >= 0
    assert labelling.no_edges(spark).count() == 0


def test_decoding(spark):
    states = [(1.0, 0.5, 50), (1.5, 1 / 3, 30), (0.5, 1.0, 20)]
    assert decode.diploid_state(states) == 0
    assert decode.climbed(states, diploid=0) == [(1, 1), (1, 2), (1, 0)]
    with pytest.raises(ValueError):
        decode.diploid_state([(1.0, 0.9, 5)])
    profiles = spark.createDataFrame([(c, b, s) for c, row in enumerate(["aabb", "aabc", "xxxx", "aacc"]) for b, s in enumerate(row)], "clone long, bin long, state string")
    got = {r["clone"]: r["merged"] for r in decode.named_clones(profiles, "clone", "bin", "state", 0.75).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    assert decode.clone_groups([(0, 1), (1, 2), (0, 2), (3, 4)], [0, 1, 2, 3, 4, 5]) == [[0, 1, 2], [3, 4], [5]]


def test_lattice_paths_find_planted_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        a, b = (1, 1) if i < 40 else (0, 1)
        depth, share = 0.8 * (a + b) / 2 + 0.2, (0.8 * a + 0.2) / (0.8 * (a + b) + 0.4)
        rows.append((0, 1, i, int(rng.poisson(60 * depth)), 60.0, int(rng.binomial(40, share)), 40))
    cells = spark.createDataFrame(rows, "clone long, contig long, bin long, umi long, base double, a long, total long")
    best, path = decode.lattice_paths(cells, [0.5, 0.8], [0.0], 0.01, 80.0, most_total=3, most_allele=2)
    assert best.first()["purity"] == 0.8
    got = {r["bin"]: (r["a"], r["b"]) for r in path.collect()}
    assert sum(got[i] == ((1, 1) if i < 40 else (0, 1)) for i in range(80)) >= 76


def test_outliers_on_a_line(spark):
    rng = random.Random(7)
    values = [rng.gauss(0, 1) for _ in range(200)] + [40.0, -35.0]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r["id"]: r["factor"] for r in filters.local_outliers(df, "id", "v", k=10).collect()}
    v = np.array(values)
    far = np.abs(v[:, None] - v[None, :])
    order = np.argsort(far + np.eye(len(v)) * 1e9, axis=1, kind="stable")[:, :10]
    reach = np.take_along_axis(far, order, 1).max(axis=1)
    density = 1 / np.array([np.maximum(reach[order[i]], far[i, order[i]]).mean() for i in range(len(v))])
    want = np.array([density[order[i]].mean() / density[i] for i in range(len(v))])
    assert len(got) == len(v) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in got)
    flagged = {r["id"] for r in filters.local_outliers(df, "id", "v", k=10).where("outlier").collect()}
    assert {200, 201} <= flagged


def test_names_warnings_and_shapes(spark):
    df = spark.createDataFrame([("clone 7",), ("-1",), ("0",), ("clone 49",), ("x",)], "l string")
    assert [r[0] for r in df.select(filters.clone_name(F.col("l"))).collect()] == ["Clone VII", "WARN", "Clone 0", "Clone XLIX", None]
    assert filters.config_warnings({"s": {"min_n": 3, "max_n": 2}}) == ["s.min_n is above s.max_n"]
    with pytest.raises(ValueError):
        filters.config_warnings({"s": {"min_n": -1}})
    segments = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "segment long, contig long")
    lengths = spark.createDataFrame([(1, 2), (2, 2)], "contig long, length long")
    cells = spark.createDataFrame([(0, 5, 2, 4), (9, 1, 0, 0), (1, 1, 3, 2)], "segment long, umi long, a long, total long")
    assert sorted(r["fault"] for r in filters.shape_faults(segments, lengths, cells).collect()) == ["counts of segment 1", "length of contig 2", "no segment 9"]


def test_array_files(spark, tmp_path):
    np.save(tmp_path / "ids.npy", np.array(["1_5", "1_9", "2_3"]))
    np.savez(tmp_path / "m.npz", data=np.array([2, 0, 7]), indices=np.array([0, 1, 2]), indptr=np.array([0, 2, 3]), shape=np.array([2, 3]), format=np.array("csr"))
    assert [r["value"] for r in arrays.npy(spark, str(tmp_path / "ids.npy")).orderBy("at").collect()] == ["1_5", "1_9", "2_3"]
    assert sorted(map(tuple, arrays.npz_sparse(spark, str(tmp_path / "m.npz")).collect())) == [(0, 0, 2.0), (1, 2, 7.0)]
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% x\n3 2 4\n1 1 5\n3 2 4\n2 2 nan\n3 1 1\n")
    (folder / "barcodes.tsv").write_text("AA-1\nCC-1\n")
    (folder / "features.tsv").write_text("g1\tX\ng2\tY\ng3\tX\n")
    got = sorted(map(tuple, arrays.feature_counts(spark, str(folder)).collect()))
    assert got == [("AA-1", "X", 5), ("AA-1", "X-1", 1), ("CC-1", "X-1", 4)]
    objects = io.BytesIO()
    np.save(objects, np.array([{}], dtype=object), allow_pickle=True)
    (tmp_path / "o.npy").write_bytes(objects.getvalue())
    with pytest.raises(Exception, match="pickle"):
        arrays.npy(spark, str(tmp_path / "o.npy")).collect()


def test_runs_and_ledgers(spark, tmp_path):
    path = str(tmp_path / "stage")
    df = spark.range(5).withColumnRenamed("id", "x")
    runs.write_staged({"t": df}, path)
    assert runs.read_staged(spark, path, "t").count() == 5
    df.limit(4).write.mode("overwrite").parquet(f"{path}/t")
    with pytest.raises(ValueError, match="not what was staged"):
        runs.read_staged(spark, path, "t")
    calls = []
    make = lambda: calls.append(1) or df
    assert runs.cached(spark, str(tmp_path / "c"), make).count() == runs.cached(spark, str(tmp_path / "c"), make).count() == 5 and len(calls) == 1
    run = spark.createDataFrame([("r1", "easy")], "run_id string, fixture string")
    metrics = spark.createDataFrame([("r1", "ari", 0.5)], "run_id string, metric string, value double")
    outputs.append_run(run, metrics, str(tmp_path / "ledger"))
    with pytest.raises(ValueError):
        outputs.append_run(run, metrics, str(tmp_path / "ledger"))
    text = outputs.ledger_markdown(metrics.join(run, "run_id"), ["ari", "gap"])
    assert text.splitlines()[-1] == "| r1 | easy | 0.5 | — |"
    (tmp_path / "p.tsv").write_text("spot\tTumor\na\t0.5\nb\tx\n")
    spots = spark.createDataFrame([("a",), ("b",)], "spot string")
    assert {tuple(r) for r in runs.tumour_proportions(spark, str(tmp_path / "p.tsv"), spots).collect()} == {("a", 0.5), ("b", None)}
    with pytest.raises(ValueError):
        runs.tumour_proportions(spark, str(tmp_path / "p.tsv"), spots.limit(1))
    assert tables.barcodes(spark, str(Path(path).parent / "p.tsv")).orderBy("ord").first()["combined_barcode"] == "spot\tTumor"


def test_simulated_trees_counts_and_slides(spark):
    parents, events = simulate.clone_tree(4, {1: 1_000_000, 2: 500_000}, mean_events=2.0, seed=9)
    assert set(parents) >= {0, 1, 2, 3} and all(0 <= e.start < e.end for e in events)
    table = simulate.event_table(spark, parents, events, 4)
    assert table.where("clone = 0").count() >= 1
    assert simulate.clone_tree(4, {1: 1_000_000}, seed=9) == simulate.clone_tree(4, {1: 1_000_000}, seed=9)
    spots = spark.createDataFrame([(i, i % 2, 300) for i in range(60)], "spot long, label long, depth long")
    shares = {0: [6.0, 3.0, 1.0], 1: [1.0, 3.0, 6.0]}
    for urn in (False, True):
        drawn = simulate.dirichlet_multinomial(spots, shares, 50.0, seed=1, urn=urn)
        mean = {r["gene"]: r["m"] for r in drawn.where("spot % 2 = 0").groupBy("gene").agg((F.sum("n") / 9000).alias("m")).collect()}
        assert mean[0] == pytest.approx(0.6, abs=0.06)
        again = simulate.dirichlet_multinomial(spots.repartition(3), shares, 50.0, seed=1, urn=urn)
        assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    law = simulate.Mixture(((0.7, 0.5, 0.3), (0.3, 4.0, 0.5)))
    assert law.mass(200).sum() == pytest.approx(1.0, abs=1e-6)
    cells = simulate.independent_entries(spark, 40, 200, law, seed=4).agg(F.avg("n").alias("m"), F.count(F.lit(1)).alias("k")).first()
    assert cells["k"] / 8000 == pytest.approx(1 - law.mass(0)[0], abs=0.03) and cells["m"] == pytest.approx((0.35 + 1.2) / (1 - law.mass(0)[0]), rel=0.08)
    grid = spark.createDataFrame([(i, i % 30, i // 30) for i in range(900)], "spot long, x long, y long")
    polygon = simulate.sized_polygon(grid, (15.0, 15.0), 7, 200, seed=3)
    assert simulate.laid_out(grid, [polygon]).where("label = 1").count() == pytest.approx(200, abs=25)
    slide = simulate.stained(grid.limit(4).withColumn("label", F.lit(1)), 3, [(10, 20, 30), (200, 100, 50)])
    assert slide.count() == 36 and 190 <= slide.agg(F.avg("red")).first()[0] <= 210
    assert len(set(simulate.sample_names(20))) == 20
    marks = simulate.mock_map(spark, {1: 10_000, 2: 5_000}, 1000).collect()
    assert len(marks) == 17 and all(r["cm"] == 0 for r in marks if r["pos"] == 0)


def test_normal_spots(spark):
    profiles = spark.createDataFrame([(c, b, 0.5 if c == 1 else 0.2) for c in range(3) for b in range(6)], "clone long, bin long, baf double")
    labels = spark.createDataFrame([(i, i % 3) for i in range(30)], "spot long, clone long")
    cells = spark.createDataFrame([(b, i, (i * b) % 9) for i in range(30) for b in range(6)], "bin long, spot long, umi long")
    spread = {r["spot"]: r["spread"] for r in normal.spread_of_logs(cells, labels, 6).collect()}
    want = {i: float(np.std(np.log1p([(i * b) % 9 for b in range(6)]))) for i in range(30)}
    assert all(spread[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    found = {r["spot"] for r in normal.by_balance(profiles, labels, normal.spread_of_logs(cells, labels, 6)).collect()}
    own = [i for i in range(30) if i % 3 == 1]
    assert found == {i for i in own if round(want[i], 9) < max(round(want[j], 9) for j in own)}
    tau = normal.fit_concentration(spark.createDataFrame([(k, 40) for k in (12, 15, 18, 20, 22, 25, 28, 20, 19, 21)], "b long, total long"))
    assert 30 <= tau <= 400
    judged = normal.unbalanced_bins(spark.createDataFrame([(0, 20, 40), (1, 1, 40), (2, 39, 40)], "bin long, b long, total long"), 60.0, 0.025, 0.975)
    assert {r["bin"]: r["code"] for r in normal.kept_bins(judged).collect()} == {0: 0}
