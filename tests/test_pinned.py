"""Pinned errors against the unpinned information, and starts by drawing."""

import math

import numpy as np
import pytest

from tessera.operators import pinned, starts
from tessera.operators.fitting import Params

CELLS, PATH = "clone long, contig long, bin long, umi long, base double, a long, total long", "clone long, contig long, bin long, state long"
PARAMS = Params((0.0, 0.4, -0.6), (0.01,) * 3, (0.5, 0.7, 0.2), (150.0,) * 3)


def planted(seed=1, bins=80):
    rng = np.random.default_rng(seed)
    rows, path = [], []
    for clone in range(2):
        states = [0 if clone == 0 else (0, 1, 0, 2)[4 * i // bins] for i in range(bins)]
        base = rng.integers(40, 90, bins).astype(float)
        scale = base.sum() / sum(b * math.exp(PARAMS.log_mu[s]) for b, s in zip(base, states))
        for i, s in enumerate(states):
            mean = base[i] * math.exp(PARAMS.log_mu[s]) * scale
            rows.append((clone, i // 40, i, int(rng.poisson(rng.gamma(100.0, mean / 100.0))), float(base[i]), int(rng.binomial(60, rng.beta(PARAMS.p[s] * 150, (1 - PARAMS.p[s]) * 150))), 60))
            path.append((clone, i // 40, i, s))
    return rows, path


def test_pinned_errors_are_the_unpinned_ones_by_the_delta_method(spark):
    rows, path = planted()
    cells, paths = spark.createDataFrame(rows, CELLS), spark.createDataFrame(path, PATH)
    found = pinned.pinned_errors(cells, paths, PARAMS, 0, 0.95, refits=2)
    assert found.neutral == 0 and found.mu[0] == 1.0 and found.covariance[0, 0, 0] == 0.0
    assert abs(math.log(found.mu[1]) - 0.4) < 5 * math.sqrt(found.covariance[1, 0, 0]) / found.mu[1] + 0.05
    assert found.decrement < 1.0
    # all rates free: moving them together changes nothing, and differences from the neutral one have the same errors
    weights = pinned.path_weights(cells, paths)
    log_mu, p = [0.0, *found.theta[:2]], 1 / (1 + np.exp(-found.theta[2:]))
    every = pinned.Coordinates((0, 1, 2), (0, 1, 2), tuple(log_mu), tuple(p.tolist()))
    score = lambda points: pinned.levels(cells, [every.at(x) for x in points], weights, 0.01, 150.0, 0.95)
    _, _, hessian = pinned.curvature(score, every.values())
    assert np.abs(hessian @ np.array([1, 1, 1, 0, 0, 0])).max() < 1e-2 * np.abs(hessian).max()
    turn = np.array([[-1, 1, 0, 0, 0, 0], [-1, 0, 1, 0, 0, 0], *np.eye(6)[3:]])
    by_delta = turn @ np.linalg.pinv(-hessian, rcond=1e-4, hermitian=True) @ turn.T
    assert np.allclose(by_delta, np.linalg.inv(found.information), rtol=0.02, atol=1e-6)
    assert found.minor[1] == pytest.approx(1 - p[1]) and found.covariance[1, 1, 1] == pytest.approx(by_delta[3, 3] * (p[1] * (1 - p[1])) ** 2, rel=0.05)


def test_levels_by_hand(spark):
    rows, path = planted(2, 8)
    cells, paths = spark.createDataFrame(rows, CELLS).repartition(3), spark.createDataFrame(path, PATH)
    weights = pinned.path_weights(cells, paths)
    assert all(sum(w.values()) == pytest.approx(1) for w in weights.values())
    log_mu, p = np.array(PARAMS.log_mu), np.array(PARAMS.p)
    got = pinned.levels(cells, [(log_mu, p), (log_mu + 0.7, p)], weights, 0.01, 150.0, 0.9)
    want = 0.0
    for clone in range(2):
        shift = math.log(sum(w * math.exp(log_mu[s]) for s, w in weights[clone].items()))
        for contig in sorted({r[1] for r in rows}):
            ahead = None
            for _, _, _, k, b, a, n in sorted(r for r in rows if r[:2] == (clone, contig)):
                e = np.array([float(starts.nb_by_size(np.array(k), np.array(b * math.exp(m - shift)), np.array(100.0)) + starts.bb(np.array(a), np.array(n), np.array(q), np.array(150.0))) for m, q in zip(log_mu, p)])
                trans = np.full((3, 3), 0.05) + np.eye(3) * 0.85
                ahead = np.exp(e) / 3 if ahead is None else (ahead @ trans) * np.exp(e)
            want += math.log(ahead.sum())
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want)


def test_states_without_information_are_held(spark):
    rows, path = planted(3, 40)
    params = Params((0.0, 0.4, -0.6, 2.0), (0.01,) * 4, (0.5, 0.7, 1.0, 0.5), (150.0,) * 4)
    found = pinned.pinned_errors(spark.createDataFrame(rows, CELLS), spark.createDataFrame(path, PATH), params, 0, 0.95, refits=0)
    assert found.covariance[3].max() == 0 and found.covariance[2, 1, 1] == 0 and found.covariance[2, 0, 0] > 0
    with pytest.raises(ValueError):
        pinned.pinned_errors(spark.createDataFrame(rows, CELLS), spark.createDataFrame([], PATH), params, 0, 0.95)


def test_drawn_starts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        rate, share = ((1.0, 0.5), (1.6, 0.3), (0.5, 0.05))[i % 3]
        rows.append((int(rng.poisson(100 * rate)), 100.0, int(rng.binomial(80, share)), 80))
    df = spark.createDataFrame([*rows, (0, 0.0, 0, 0)], "total long, exposure double, b long, trials long")
    cells = starts.distinct_cells(df)
    one = starts.mixture_start(cells, 3, tries=1, seed=3)
    several = starts.mixture_start(cells, 3, tries=2, seed=3)
    assert several.log_likelihood >= one.log_likelihood
    again = starts.mixture_start(starts.distinct_cells(df.repartition(7)), 3, tries=1, seed=3)
    assert again.p == one.p and again.log_mu == one.log_mu
    fitted, _ = starts.polished(cells, several, rounds=14)
    assert sorted(round(p, 1) for p in fitted.p) == [0.0, 0.3, 0.5] or sorted(round(p, 1) for p in fitted.p) == [0.1, 0.3, 0.5]
    capped = starts.mixture_start(cells, 2, tries=1, seed=3, anneal=True, most_rate=1.2)
    assert all(math.exp(m) <= 1.2 + 1e-9 for m in capped.log_mu)
    assert starts.mixture_start(cells.limit(0), 2, tries=1).p == (0.5, 0.5)
