"""Lattice starts: passes against plain sums, planted purity, and polish that never falls."""

import math

import numpy as np
import pytest

from tessera.operators import starts


def planted(seed, n=1500, purity=0.7, scale=1.05, pairs=((1, 1), (0, 1), (1, 2), (2, 2))):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = pairs[rng.choice(len(pairs), p=[0.55, 0.15, 0.15, 0.15])]
        depth = scale * (purity * (a + b) / 2 + 1 - purity)
        share = (purity * a + 1 - purity) / (purity * (a + b) + 2 * (1 - purity))
        exposure, trials = float(rng.integers(80, 200)), int(rng.integers(40, 90))
        mean = exposure * depth
        rows.append((int(rng.poisson(rng.gamma(60.0, mean / 60.0))), exposure, int(rng.binomial(trials, rng.beta(share * 300, (1 - share) * 300))), trials))
    return rows


SCHEMA = "total long, exposure double, b long, trials long"


def nb(k, m, r):
    return math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + m)) + k * math.log(m / (r + m)) if m > 0 else 0.0


def bb(k, n, p, c):
    if n <= 0 or not 0 <= k <= n:
        return 0.0
    p = min(1 - 1e-4, max(1e-4, p))
    a, b, g = p * c, (1 - p) * c, math.lgamma
    return g(n + 1) - g(k + 1) - g(n - k + 1) + g(k + a) + g(n - k + b) - g(n + c) - g(a) - g(b) + g(c)


def density(row, s):
    k, e, b, n = row
    return [nb(k, e * r, s.size) + bb(b, n, s.error + (1 - 2 * s.error) * p, s.concentration) for r, p in zip(s.rate, s.share)]


def test_a_pass_by_hand(spark, monkeypatch):
    monkeypatch.setattr(starts, "TOGETHER", 7)
    rows = planted(1, 60) + [(3, 0.0, 0, 0), (3, 0.0, 5, 2), (0, 50.0, 0, 0)] * 2
    cells = starts.distinct_cells(spark.createDataFrame([*rows, (None, 1.0, 1, 1)], SCHEMA).repartition(3))
    s = starts.lattice(0.7, 1.0, 3)
    d = [[x + w for x, w in zip(density(r, s), s.log_weight)] for r in rows]
    ask = {"size": [5.0, 50.0], "concentration": [30.0], "error": [0.02, 0.05], "rate": [1.1], "share": [0.3]}
    for soft in (False, True):
        got = starts.swept(cells, [s, starts.lattice(1.0, 1.1, 3)], [ask, {}], soft)[0]
        top = [max(x) for x in d]
        held = np.array([[math.exp(v - t) / sum(math.exp(u - t) for u in x) for v in x] if soft else [float(i == x.index(t)) for i in range(len(x))] for x, t in zip(d, top)])
        level = sum(t + math.log(sum(math.exp(v - t) for v in x)) if soft else t for x, t in zip(d, top))
        assert got["level"][0] == pytest.approx(level) and got["weight"] == pytest.approx(held.sum(axis=0))
        whole = lambda f: sum(held[i, k] * f(r, k) for i, r in enumerate(rows) for k in range(len(s.rate)) if held[i, k])
        assert got["size"] == pytest.approx([whole(lambda r, k: nb(r[0], r[1] * s.rate[k], c)) for c in ask["size"]])
        assert got["concentration"] == pytest.approx([whole(lambda r, k: bb(r[2], r[3], s.error + (1 - 2 * s.error) * s.share[k], c)) for c in ask["concentration"]])
        assert got["error"] == pytest.approx([whole(lambda r, k: bb(r[2], r[3], c + (1 - 2 * c) * s.share[k], s.concentration)) for c in ask["error"]])
        assert got["rate"].sum() == pytest.approx(whole(lambda r, k: nb(r[0], r[1] * s.rate[k] * 1.1, s.size)))


def test_classification_by_hand(spark):
    rows = planted(2, 80)
    s = starts.lattice(0.7, 1.0, 3)
    weights = list(s.log_weight)
    for _ in range(3):
        joint = [[x + w for x, w in zip(density(r, s), weights)] for r in rows]
        counts = [sum(x.index(max(x)) == k for x in joint) for k in range(len(weights))]
        weights = [math.log(max(c / len(rows), 1 / (10 * len(rows)))) for c in counts]
    found, levels = starts.classified(starts.distinct_cells(spark.createDataFrame(rows, SCHEMA)), [s])
    assert found[0].log_weight == pytest.approx(weights)
    assert levels[0] == pytest.approx(sum(max(x + w for x, w in zip(density(r, s), weights)) for r in rows))


def test_start_recovers_what_was_planted(spark):
    cells = starts.distinct_cells(spark.createDataFrame(planted(3), SCHEMA).repartition(4))
    start = starts.lattice_start(cells, 4, purities=(1.0, 0.7, 0.5), scales=(0.95, 1.0, 1.05))
    assert (start.purity, start.scale) == (0.7, 1.05)
    want = {(round(1.05 * (0.7 * (a + b) / 2 + 0.3), 6), round((0.7 * a + 0.3) / (0.7 * (a + b) + 0.6), 2)) for a, b in ((1, 1), (0, 1), (1, 2), (2, 2))}
    assert {(round(math.exp(m), 6), round(p, 2)) for m, p in zip(start.log_mu, start.p)} == want
    assert 30 < start.size < 120 and 100 < start.concentration < 1500
    better, levels = starts.polished(cells, start, rounds=12)
    assert all(b >= a - 1e-6 for a, b in zip(levels, levels[1:])) and better.log_likelihood >= levels[0]
    assert sum(better.weight) == pytest.approx(1)


def test_starts_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    start = starts.run_start(none, 3, seed=lambda c, k: starts.lattice_start(c, k, (1.0, 0.5), (1.0,), rounds=1), rounds=1)
    assert len(start.log_mu) == 3 and start.log_likelihood == 0.0
    one = starts.run_start(spark.createDataFrame([(10, 10.0, 5, 10)] * 3, SCHEMA), 2, seed=lambda c, k: starts.lattice_start(c, k, (1.0,), (1.0,), rounds=1), rounds=2)
    assert len(one.log_mu) == 2 and math.isfinite(one.log_likelihood)


def test_seed_on_a_part_and_polish_on_the_whole(spark):
    rows = planted(5, 600)
    df = spark.createDataFrame(rows, SCHEMA)
    seed = lambda c, k: starts.lattice_start(c, k, (0.7,), (1.05,), most=4, rounds=1)
    part = starts.run_start(df, 4, seed_on=spark.createDataFrame(rows[:150], SCHEMA), fit_on=spark.createDataFrame(rows[:300], SCHEMA), seed=seed, rounds=6)
    alone = starts.swept(starts.distinct_cells(df), [starts.Setting(tuple(map(math.exp, part.log_mu)), part.p, part.size, part.concentration, 0.0, tuple(map(math.log, part.weight)))], soft=True)
    assert part.log_likelihood == pytest.approx(alone[0]["level"][0])
