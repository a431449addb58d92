"""Curves with bands against plain resampling."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import curves

ROWS = "`group` string, member long, x double, y double, n long"


def newton(x, y, w):
    kept = [(a, b, c) for a, b, c in zip(x, y, w) if c > 0]
    if len(kept) < 2 or len({b for _, b, _ in kept}) < 2:
        return None
    a = b = 0.0
    for _ in range(50):
        h = hx = hxx = r = rx = 0.0
        for u, v, m in kept:
            p = 1 / (1 + math.exp(-(a + b * u)))
            h, hx, hxx = h + m * p * (1 - p), hx + m * p * (1 - p) * u, hxx + m * p * (1 - p) * u * u
            r, rx = r + m * (v - p), rx + m * (v - p) * u
        h, hxx = h + 1e-9, hxx + 1e-9
        det = h * hxx - hx * hx
        da, db = (hxx * r - hx * rx) / det, (h * rx - hx * r) / det
        a, b = a + da, b + db
        if abs(b) > 1e3:
            return None
        if max(abs(da), abs(db)) < 1e-8:
            break
    return a, b


def test_fits_and_rates_by_hand(spark):
    rng = random.Random(1)
    rows = []
    for member in range(12):
        for _ in range(15):
            x = round(rng.uniform(0, 4), 1)
            rows.append(("a" if member % 2 else "b", member, x, float(rng.random() < 1 / (1 + math.exp(-2 * (x - 2)))), rng.randint(1, 3)))
    weight = lambda m, d: (m * 3 + d * 5 + m * d) % 3
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0, 1), ("a", 3, None, 1.0, 1)], ROWS)
    found = curves.fits(df, 6, lambda m, d: (m * 3 + d * 5 + m * d) % 3)
    for (g, draw), ab in found.items():
        own = [r for r in rows if r[0] == g]
        want = newton([r[2] for r in own], [r[3] for r in own], [r[4] * (1 if draw < 0 else weight(r[1], draw)) for r in own])
        assert ab == pytest.approx(want, abs=1e-6)
    cross = {r["group"]: r for r in curves.crossings(spark, found).collect()}
    for g in "ab":
        ats = sorted(-found[g, d][0] / found[g, d][1] for d in range(6) if found[g, d] and found[g, d][1] > 0)
        assert cross[g]["draws"] == len(ats) and ats[0] <= cross[g]["low"] <= cross[g]["high"] <= ats[-1]
        assert 1 < cross[g]["crossing"] < 3
    got = {(r["group"], r["bin"]): r for r in curves.rates(df, [0.0, 1.0, 2.0, 9.0, 10.0], 6, lambda m, d: (m * 3 + d * 5 + m * d) % 3).collect()}
    for g in "ab":
        for i, (lo, hi) in enumerate(((0, 1), (1, 2), (2, 9), (9, 10))):
            own = [r for r in rows if r[0] == g and lo <= r[2] < hi]
            assert got[g, i]["n"] == sum(r[4] for r in own)
            if own:
                assert got[g, i]["rate"] == pytest.approx(sum(r[3] * r[4] for r in own) / sum(r[4] for r in own))
            else:
                assert got[g, i]["rate"] is None and got[g, i]["low"] is None
    band = curves.bands(spark, found, 0.0, 4.0, 5).where("x = 2.0").collect()
    assert all(r["low"] <= r["fitted"] + 0.2 and r["fitted"] - 0.2 <= r["high"] for r in band)


def test_runaway_and_empty_fits(spark):
    rows = [("sep", i, float(i), float(i > 4), 1) for i in range(10)] + [("one", 0, 1.0, 1.0, 5), ("flat", 0, 1.0, 0.0, 1), ("flat", 1, 2.0, 0.0, 1)]
    found = curves.fits(spark.createDataFrame(rows, ROWS), 0, curves.by_hash(), rounds=5)
    assert found["one", -1] is None and found["flat", -1] is None
    assert found["sep", -1] is None or found["sep", -1][1] > 1.5
    none = spark.createDataFrame([], ROWS)
    assert curves.fits(none, 3, curves.by_hash()) == {} and curves.rates(none, [0.0, 1.0], 3, curves.by_hash()).collect() == []
    assert curves.crossings(spark, {}).collect() == []


def test_poisson_draws_have_mean_one(spark):
    drawn = spark.range(20000).select(curves.by_hash(3)(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(drawn["m"] - 1) < 0.03 and abs(drawn["v"] - 1) < 0.06


def test_summary_is_on_the_members_of_all_groups(spark):
    rng = random.Random(2)
    segments = [(g, m, int(10 ** rng.uniform(1, 4)), float(rng.random() < 0.5)) for g in ("1", "2") for m in range(10) if (g, m) != ("2", 4) for _ in range(8)] + [("1", 1, 0, 1.0)]
    rows = curves.rounded_counts(spark.createDataFrame(segments, "`group` string, member long, reads long, y double"))
    rate, cross = curves.summary(rows, [1.0, 2.0, 3.0, 4.01], 5)
    sizes = {r["group"]: (r["members"], r["items"]) for r in cross.collect()}
    assert sizes == {"1": (9, 72), "2": (9, 72)}
    assert rate.agg(F.sum("n")).first()[0] == 144
