"""Chains with phases: the combined law against the factored step, and both against enumeration of paths."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fitting, hmm


@pytest.mark.parametrize("same_state", [False, True])
@pytest.mark.parametrize("k", [1, 2, 4])
def test_factored_step_is_the_combined_law(k, same_state):
    rng = np.random.default_rng(k)
    trans = np.log(rng.dirichlet(np.ones(k), size=k))
    flip = np.log(rng.uniform(0.001, 0.5, 7))
    a = rng.normal(size=(7, 2 * k)) * 3
    moves = hmm.combined_moves(trans, flip, same_state)
    assert np.allclose(np.exp(moves).sum(axis=2), 1)
    assert np.allclose(hmm.factored_step(a, trans, flip, same_state), np.log(np.exp(a[:, :, None] + moves).sum(axis=1)))
    assert np.allclose(hmm.factored_step(a, trans.T, flip, same_state), np.log(np.exp(moves + a[:, None, :]).sum(axis=2)))


@pytest.mark.parametrize("same_state", [False, True])
def test_phased_chain_by_enumeration(spark, same_state):
    rng = np.random.default_rng(3)
    k, trans, start = 2, [[0.8, 0.2], [0.3, 0.7]], [0.6, 0.4]
    chains = {0: 5, 1: 1, 2: 4}
    rows = [(g, t, *map(float, np.log(rng.uniform(0.05, 1, 4))), float(np.log(rng.uniform(0.01, 0.4)))) for g, n in chains.items() for t in range(n)]
    df = spark.createDataFrame(rows, "g long, t long, e0 double, e1 double, e2 double, e3 double, s double").repartition(3)
    logs = [[math.log(p) for p in r] for r in trans]
    level, states = hmm.phased(df, "g", ["t"], ["e0", "e1", "e2", "e3"], logs, list(map(math.log, start)), "s", same_state)
    levels = {r["g"]: r["log_likelihood"] for r in level.collect()}
    found = {(r["g"], r["t"]): r for r in states.collect()}
    for g, n in chains.items():
        own = sorted(r for r in rows if r[0] == g)
        weight = np.zeros((n, 4))
        for z in itertools.product(range(4), repeat=n):
            p = 0.5 * start[z[0] % k]
            for i, (x, y) in enumerate(zip(z, z[1:])):
                w = math.exp(own[i][6])
                turn = w if x // k != y // k else 1 - w
                p *= trans[x % k][y % k] * (0.5 if same_state and x % k != y % k else turn)
            p *= math.exp(sum(own[i][2 + x] for i, x in enumerate(z)))
            for i, x in enumerate(z):
                weight[i, x] += p
        assert levels[g] == pytest.approx(math.log(weight[0].sum()))
        for t in range(n):
            post = weight[t] / weight[t].sum()
            assert found[g, t]["posterior"] == pytest.approx(post.tolist())
            state = int(np.argmax(post[:2] + post[2:]))
            assert found[g, t]["state"] == state and found[g, t]["phase"] == int(post[2 + state] > post[state])


def test_initial_phase_by_contig(spark):
    """Bins are numbered in each contig anew; phases of one are not votes in the other."""
    rng = np.random.default_rng(5)
    flips = {(c, b): int(b >= 6) if c == 0 else int(b < 4) for c in range(2) for b in range(12)}
    rows = []
    for clone in range(3):
        for (c, b), flip in flips.items():
            share = 0.2 if flip == 0 else 0.8
            rows.append((clone, c, b, int(rng.poisson(50)), 50.0, int(rng.binomial(60, share)), 60, math.log(0.05)))
    cells = spark.createDataFrame(rows, "clone long, contig long, bin long, umi long, base double, a long, total long, switch double")
    params = fitting.Params((0.0, 0.0), (0.01, 0.01), (0.2, 0.5), (80.0, 80.0))
    votes, pieces = fitting.initial_phase(cells, params, 0.9, "switch", 0.05, 0.1, 2)
    got = {(r["contig"], r["bin"]): r["phase"] for r in votes.collect()}
    assert got == flips
    assert pieces.count() == 24 and pieces.where(F.col("piece").isNull()).count() == 0


def test_phased_chains_of_odd_tables(spark):
    df = spark.createDataFrame([], "g long, t long, e0 double, e1 double, s double")
    level, states = hmm.phased(df, "g", ["t"], ["e0", "e1"], [[0.0]], [0.0], "s")
    assert level.collect() == [] and states.collect() == []
    certain = spark.createDataFrame([(1, 0, -1.0, -2.0, 0.0), (1, 1, -1.0, -2.0, float("-inf"))], df.schema)
    level, _ = hmm.phased(certain, "g", ["t"], ["e0", "e1"], [[0.0]], [0.0], "s")
    # the phase surely flips
    assert level.first()["log_likelihood"] == pytest.approx(math.log(0.5 * math.exp(-3) * 2))
