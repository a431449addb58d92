"""Decoding with purity: scores and paths against plain recursions, levels that never fall, planted purities found."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import purity

SCHEMA = "clone long, contig long, bin long, umi long, base double, a long, total long"


def nb(k, m, r):
    return math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + m)) + k * math.log(m / (r + m)) if m > 0 else 0.0


def bb(k, n, p, c):
    if n <= 0 or not 0 <= k <= n:
        return 0.0
    p = min(1 - 1e-4, max(1e-4, p))
    a, b, g = p * c, (1 - p) * c, math.lgamma
    return g(n + 1) - g(k + 1) - g(n - k + 1) + g(k + a) + g(n - k + b) - g(n + c) - g(a) - g(b) + g(c)


def planted(seed=2, bins=120):
    rng = np.random.default_rng(seed)
    truth = {0: (1.0, 0.0), 1: (0.8, 0.1), 2: (0.55, -0.08)}
    rows, copies = [], {}
    for clone, (p, shift) in truth.items():
        for i in range(bins):
            a, b = (1, 1) if clone == 0 or i < 50 else (0, 1) if i < 75 else (2, 1) if i < 100 else (2, 2)
            depth, share = math.exp(shift) * (p * (a + b) / 2 + 1 - p), (p * a + 1 - p) / (p * (a + b) + 2 * (1 - p))
            mean = 300 * depth
            rows.append((clone, i // 60, i, int(rng.poisson(rng.gamma(200.0, mean / 200.0))), 300.0, int(rng.binomial(120, rng.beta(share * 400, (1 - share) * 400))), 120))
            copies[clone, i] = (a, b)
    return rows, copies, truth


def emission(row, pair, s):
    _, _, _, k, e, b, t = row
    a, d = pair
    mean = e * math.exp(s.shift) * max(1e-6, s.purity * (a + d) / 2 + 1 - s.purity)
    share = (s.purity * a + 1 - s.purity) / (s.purity * (a + d) + 2 * (1 - s.purity))
    return nb(k, mean, 1 / s.alpha) + bb(b, t, share, s.tau) - purity.PARSIMONY * abs(a + d - 2)


def test_scores_and_paths_by_enumeration(spark, monkeypatch):
    monkeypatch.setattr(purity, "TOGETHER", 2)
    rows = [r for r in planted()[0] if r[2] in (10, 55, 60, 90, 110) and r[0] < 2] + [(5, 1, 1, 0, 0.0, 0, 0)]
    model = purity.lattice(2, 2, 0.9)
    stay, move = model.moves
    at = {c: [purity.At(0.7, 0.05, 0.02, 50.0), purity.At(1.0, -0.2, 0.1, 500.0)] for c in (0, 1, 5)}
    cells = spark.createDataFrame([*rows, (None, 1, 1, 1, 1.0, 0, 0)], SCHEMA)
    got = purity.scores(cells, model, at)
    path = {(r["clone"], r["bin"]): r["state"] for r in purity.paths(cells, model, {c: s[0] for c, s in at.items()}).collect()}
    for clone, settings in at.items():
        for j, s in enumerate(settings):
            level, states = 0.0, {}
            for contig in sorted({r[1] for r in rows if r[0] == clone}):
                own = sorted(r for r in rows if r[:2] == (clone, contig))
                score = lambda z: -math.log(5) + sum(emission(r, model.pairs[k], s) for r, k in zip(own, z)) + sum(stay if x == y else move for x, y in zip(z, z[1:]))  # noqa: B023, E731
                best = max(itertools.product(range(5), repeat=len(own)), key=score)
                level += score(best)
                states.update({r[2]: k for r, k in zip(own, best)})
            assert got[clone][j] == pytest.approx(level)
            if j == 0 and clone != 5:
                assert {b: k for (c, b), k in path.items() if c == clone} == states


def test_decode_finds_what_was_planted(spark):
    rows, copies, truth = planted()
    fit = purity.decode(spark.createDataFrame(rows, SCHEMA).repartition(5), normal=0, model=purity.lattice(4, 2, 1 - 1e-4), rounds=3)
    assert all(b >= a - 1e-6 for a, b in zip(fit.levels, fit.levels[1:])) and len(fit.levels) > 1
    for clone, (p, shift) in truth.items():
        assert abs(fit.settings[clone].purity - p) < 0.06 and abs(fit.settings[clone].shift - shift) < 0.06
    got = {(r["clone"], r["bin"]): (r["a"], r["b"]) for r in fit.paths.collect()}
    assert sum(got[k] == v for k, v in copies.items()) >= 0.97 * len(copies)
    # read counts are spread by 1/200, shares by a concentration of 400
    assert 0.001 < fit.settings[0].alpha < 0.02 and 100 < fit.settings[0].tau < 2000


def test_decode_of_odd_tables(spark):
    none = purity.decode(spark.createDataFrame([], SCHEMA))
    assert none.settings == {} and none.paths.collect() == []
    rows = [(1, 1, 1, 5, 5.0, 2, 4)] * 2 + [(1, 1, None, 4, 4.0, None, None), (1, None, 2, 1, 1.0, 1, 1), (None, 1, 1, 1, 1.0, 0, 0), (2, 1, 1, None, None, None, None)]
    fit = purity.decode(spark.createDataFrame(rows, SCHEMA), model=purity.lattice(2, 2), rounds=1, passes=1, purities=(1.0, 0.5))
    assert sorted((r["clone"], r["bin"] or -1) for r in fit.paths.collect()) == [(1, -1), (1, 1), (1, 1), (2, 1)]
    held = purity.decode(spark.createDataFrame(rows, SCHEMA), normal=1, model=purity.lattice(1, 1), rounds=1, passes=1, fit_purity=False, fit_shifts=False, fit_dispersions=False)
    assert all((s.purity, s.shift, s.alpha, s.tau) == (1.0, 0.0, 0.01, 100.0) for s in held.settings.values())
