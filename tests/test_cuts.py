"""Minimum cuts against enumeration on small graphs, and on odd ones."""

import itertools
import random

import pytest

from tessera.operators import cuts, labelling, spatial

SPOT = "spot long, label long"


def graph(seed, n=12, labels=3, integer=False):
    rng = random.Random(seed)
    edges = {(i, j): (rng.randint(1, 3) if integer else rng.random() * 1.5) for i in range(n) for j in range(n) if i < j and (j == i + 1 or j == i + 4 or rng.random() < 0.1)}
    values = {(i, k): (rng.randint(0, 3) if integer else rng.random() * 2) for i in range(n) for k in range(labels)}
    return edges, values, [rng.randrange(labels) for _ in range(n)], [rng.randrange(labels) for _ in range(n)]


def energy(edges, values, x, weight):
    return sum(values[i, k] for i, k in enumerate(x)) + weight * sum(w for (i, j), w in edges.items() if x[i] == x[j])


def frames(spark, edges, values):
    both = [(i, j, float(w)) for (i, j), w in edges.items()] + [(j, i, float(w)) for (i, j), w in edges.items()]
    return spark.createDataFrame([(i, k, float(v)) for (i, k), v in values.items()], "spot long, label long, value double"), spark.createDataFrame(both, "src long, dst long, w double")


def listed(df):
    return [r["label"] for r in df.orderBy("spot").collect()]


def test_a_cut_by_enumeration():
    rng = random.Random(4)
    for trial in range(300):
        n = rng.randint(1, 9)
        whole = trial % 2
        gains = [float(rng.randint(-4, 4)) if whole else rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, float(rng.randint(1, 3)) if whole else rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        value = lambda x: sum(g for g, t in zip(gains, x) if t) - sum(q for i, j, q in edges if x[i] != x[j])  # noqa: B023, E731
        best = max(map(value, itertools.product((False, True), repeat=n)))
        got = cuts.minimum_cut(gains, edges)
        assert value(got) == pytest.approx(best)
        fewest = min(sum(x) for x in itertools.product((False, True), repeat=n) if value(x) >= best - 1e-9)
        assert sum(got) == fewest


@pytest.mark.parametrize("seed", [1, 2])
def test_moves_by_enumeration(spark, seed):
    edges, values, old, other = graph(seed, integer=seed == 2)
    field, links = frames(spark, edges, values)
    labels = spark.createDataFrame(list(enumerate(old)), SPOT)
    value = lambda x: energy(edges, values, x, 0.7)
    for alpha in range(3 if seed == 2 else 1):
        moved = listed(cuts.expansion(field, links, labels, 0.7, alpha))
        best = max(value([alpha if t else k for t, k in zip(x, old)]) for x in itertools.product((0, 1), repeat=12))
        assert value(moved) == pytest.approx(best)
        assert spatial.potts_energy(field, links, spark.createDataFrame(list(enumerate(moved)), SPOT), 0.7).first()["total"] == pytest.approx(best)
        if seed == 1 and alpha == 0:
            descent = listed(labelling.expansion(field, links, labels, 0.7, alpha, colours=2, sweeps=2))
            assert value(moved) >= value(descent) - 1e-9
    both = listed(cuts.fused(field, links, labels, spark.createDataFrame(list(enumerate(other)), SPOT), 0.7))
    assert value(both) >= max(value(old), value(other)) - 1e-9 and all(k in (a, b) for k, a, b in zip(both, old, other))


def test_without_rounds_everything_is_cut(spark, monkeypatch):
    edges, values, old, _ = graph(7)
    field, links = frames(spark, edges, values)
    labels = spark.createDataFrame(list(enumerate(old)), SPOT)
    quick = listed(cuts.expansion(field, links, labels, 0.7, 1))
    plain = cuts.decided
    monkeypatch.setattr(cuts, "decided", lambda nodes, near: (plain(nodes.limit(0), near.limit(0), 1)[0], nodes, near))
    assert listed(cuts.expansion(field, links, labels, 0.7, 1)) == quick


def test_cycles_end_where_no_move_gains(spark):
    edges, values, old, _ = graph(3, n=6, labels=2)
    field, links = frames(spark, edges, values)
    labels = spark.createDataFrame(list(enumerate(old)), SPOT)
    found, levels = cuts.alpha_expansion(field, links, labels, 0.7, [0, 1], cycles=2)
    assert levels == sorted(levels)
    value = lambda x: energy(edges, values, x, 0.7)
    x = listed(found)
    assert value(x) == pytest.approx(levels[-1])
    for alpha in range(2):
        assert value(x) >= max(value([alpha if t else k for t, k in zip(m, x)]) for m in itertools.product((0, 1), repeat=6)) - 1e-9
    floored = listed(cuts.fused_and_floored(field, links, labels, 0.7, [0, 1], floor=2, sweeps=1, cycles=1))
    assert all(floored.count(k) >= 2 for k in set(floored))


def test_odd_graphs(spark):
    inf = float("-inf")
    field = spark.createDataFrame([(0, 0, 1.0), (0, 1, inf), (1, 0, inf), (1, 1, 0.0), (2, 0, 0.0)], "spot long, label long, value double")
    edges = spark.createDataFrame([(0, 1, 9.0), (1, 0, 9.0), (2, 2, 5.0), (2, 7, 3.0), (1, 2, None)], "src long, dst long, w double")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], SPOT)
    # 0 may not take 1, 1 must, 2 has no value for 1
    assert listed(cuts.expansion(field, edges, labels, 1.0, 1)) == [0, 1, 0]
    none = edges.limit(0)
    assert listed(cuts.expansion(field, none, labels, 1.0, 1)) == [0, 1, 0]
    assert cuts.expansion(field, edges, labels.limit(0), 1.0, 1).collect() == []
    assert listed(cuts.fused(field, edges, labels, labels.limit(0), 1.0)) == [0, 0, 0]
