"""Normal mixtures in the plane: planted components, rising likelihood, odd tables."""

import numpy as np
import pytest

from tessera.operators import fitting

POINTS = "x double, y double"


def test_planted_components(spark):
    rng = np.random.default_rng(1)
    parts = [((-3.0, 1.0), 200), ((0.0, -2.0), 240), ((4.0, 0.0), 160)]
    rows = [(float(a), float(b)) for (mx, my), n in parts for a, b in rng.normal((mx, my), (0.5, 0.8), (n, 2))]
    found, levels = fitting.plane_mixture(spark.createDataFrame([*rows, (None, 1.0), (float("nan"), 0.0)], POINTS).repartition(3), "x", "y", 3, 30)
    got = found.orderBy("component").collect()
    assert all(b >= a - 1e-9 for a, b in zip(levels, levels[1:]))
    for r, ((mx, my), n) in zip(got, parts):
        assert abs(r["x"] - mx) < 0.2 and abs(r["y"] - my) < 0.3 and r["weight"] == pytest.approx(n / 600, abs=0.03) and abs(r["v_yy"] - 0.64) < 0.25


def test_odd_tables(spark):
    none, levels = fitting.plane_mixture(spark.createDataFrame([], POINTS), "x", "y", 2)
    assert none.collect() == [] and levels == []
    same, levels = fitting.plane_mixture(spark.createDataFrame([(1.0, 2.0)] * 4, POINTS), "x", "y", 2, 3)
    assert all((r["x"], r["y"]) == pytest.approx((1.0, 2.0)) for r in same.collect()) and len(levels) == 3
