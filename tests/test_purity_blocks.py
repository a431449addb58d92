"""Chains in blocks: a long chain is dealt over many tasks, and its scores and path are those of one plain recursion."""

import math

import numpy as np
import pytest

from tessera.operators import purity

SCHEMA = "clone long, contig long, bin long, umi long, base double, a long, total long"


def plain(model, e):
    """(worth, path) of the best path by one recursion over all bins."""
    stay, move = model.moves
    v, back = e[0] - math.log(e.shape[1]), []
    for row in e[1:]:
        top = int(v.argmax())
        back.append(np.where(v + stay >= v[top] + move, np.arange(len(v)), top))
        v = np.maximum(v + stay, v[top] + move) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return float(v.max()), path[::-1]


@pytest.mark.parametrize("size", [7, 1])
def test_a_chain_of_many_blocks_is_scored_and_followed_as_one(spark, monkeypatch, size):
    monkeypatch.setattr(purity, "BLOCK", size)
    rng = np.random.default_rng(5)
    level = np.repeat(rng.choice([0.6, 1.0, 1.5], 12), 25)
    rows = [(1, 1, i, int(rng.poisson(60 * x)), 60.0, int(rng.binomial(20, 0.5 if x == 1 else 0.35)), 20) for i, x in enumerate(level)]
    rows += [(1, 2, 0, 70, 60.0, 4, 20), *((2, 1, *r[2:]) for r in rows[:40])]
    cells = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model, tried = purity.lattice(3, 2, 0.95), [purity.At(0.8, 0.0, 0.02, 60.0), purity.At(0.5, 0.1, 0.1, 20.0)]
    held = purity.blocks(cells)
    assert held.where("clone = 1 AND contig = 1").count() >= len(level) // size
    # more than one task has bins of the long chain
    assert len({r["at"] >> 33 for r in held.where("clone = 1 AND contig = 1").collect()}) > 1
    got = purity.scores(cells, model, {1: tried, 2: tried[:1]})
    found = {(r["clone"], r["contig"], r["bin"]): r["state"] for r in purity.paths(cells, model, {1: tried[0], 2: tried[0]}).collect()}
    assert len(found) == len(rows)
    want = {}
    for clone, contig in ((1, 1), (1, 2), (2, 1)):
        own = np.array([r[3:] for r in rows if r[:2] == (clone, contig)], float).T
        for j, s in enumerate(tried[: 3 - clone]):
            worth, path = plain(model, purity.emissions(model, [s], *own)[:, 0])
            want[clone, j] = want.get((clone, j), 0.0) + worth
            if j == 0:
                assert [found[clone, contig, i] for i in range(len(path))] == path
    assert {(c, j): v for c, x in got.items() for j, v in enumerate(x)} == pytest.approx(want)


def test_blocks_side_by_side_are_joined_as_each_alone():
    rng = np.random.default_rng(1)
    model, lengths = purity.lattice(2, 2, 0.9), np.array([90, 41, 16, 2, 1])
    stay, move = model.moves
    e = rng.normal(size=(200, 2, 5)) * 3
    which = rng.integers(0, 200, (90, 5))
    got = purity._joined(model, lengths, which, e)
    for b, n in enumerate(lengths):
        for first in range(5):
            v = np.full((2, 5), -math.inf)
            v[:, first] = e[which[0, b], :, first]
            for t in range(1, n):
                v = np.maximum(v + stay, v.max(axis=1, keepdims=True) + move) + e[which[t, b]]
            assert np.allclose(got[b, :, first], v, atol=1e-8)
