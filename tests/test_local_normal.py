"""The local normal mask against a plain reading of its rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import normal


def by_hand(baf, spots, reads, width, slack=0.05, margin=0.01, ratio=1.1, low=0.8, high=1.25):
    """baf[c][b], spots[c], reads[c][b]: the clones accepted in each bin."""
    clones, bins = range(len(baf)), len(baf[0])
    dev = [[max(0.0, abs(v - 0.5) - slack) for v in row] for row in baf]
    anchor = min(clones, key=lambda c: (sum(dev[c]), c))
    library = [sum(r) for r in reads]
    share = [[v / library[c] if library[c] else 0.0 for v in reads[c]] for c in clones]
    logs = [[math.log1p(v / spots[c]) if spots[c] else 0.0 for v in reads[c]] for c in clones]
    mean = lambda xs: sum(xs) / len(xs)

    def sd(xs):
        m = mean(xs)
        return math.sqrt(mean([(x - m) ** 2 for x in xs]))

    out = []
    for b in range(bins):
        at = range(max(0, b - width), min(bins, b + width + 1))
        local = {c: mean([dev[c][i] for i in at]) for c in clones if spots[c]}
        fits = []
        for c in local:
            xy = sum(share[anchor][i] * share[c][i] / (share[anchor][i] + 1e-8) for i in at)
            xx = sum(share[anchor][i] ** 2 / (share[anchor][i] + 1e-8) for i in at)
            if c != anchor and local[c] <= min(local.values()) + margin and low <= (xy / xx if xx > 1e-12 else 0.0) <= high:
                fits.append((sd([logs[c][i] for i in at]), c))
        fits.sort()
        pool = [sd([logs[anchor][i] for i in at]), *(s for s, _ in fits)]
        keep = len(pool)
        if len(pool) > 3:
            p = 0.4
            while p <= 0.95:
                k = min(max(int(p * len(pool)), 1), len(pool) - 2) + 1
                parts = [pool[:k], pool[k:]]
                within = sum((x - mean(part)) ** 2 for part in parts for x in part)
                apart = sum(len(part) * (mean(part) - mean(pool)) ** 2 for part in parts)
                if within > 1e-12 and apart > ratio * within:
                    keep = k
                    break
                p += 0.05
        out.append(({anchor} if spots[anchor] else set()) | {c for _, c in fits[: keep - 1]})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mask_by_hand(spark, seed):
    rng = random.Random(seed)
    clones, bins = 9, 40
    spots = [rng.randint(1, 3) for _ in range(clones)]
    spots[4] = 0
    baf = [[0.5 + rng.choice([0.0, 0.02, 0.06, 0.2 if c % 3 == 0 else 0.03]) * rng.choice([1, -1]) for _ in range(bins)] for c in range(clones)]
    profile = [rng.randint(20, 60) for _ in range(bins)]
    ids = [(c, s) for c in range(clones) for s in range(spots[c])]
    loud = [rng.random() for _ in range(clones)]
    cells = {(c, s, b): max(0, round(profile[b] * (1 + loud[c] * rng.uniform(-0.9, 0.9)))) for c, s in ids for b in range(bins)}
    reads = [[sum(cells[c, s, b] for s in range(spots[c])) for b in range(bins)] for c in range(clones)]
    want = by_hand(baf, spots, reads, 3)
    got = normal.local_mask(
        spark.createDataFrame([(c, b, baf[c][b]) for c in range(clones) for b in range(bins)], "clone long, bin long, baf double"),
        spark.createDataFrame([(c * 10 + s, c) for c, s in ids], "spot long, clone long"),
        spark.createDataFrame([(c * 10 + s, b, v) for (c, s, b), v in cells.items()], "spot long, bin long, umi long"),
        3,
    ).collect()
    assert len(got) == clones * bins
    found = [{r["clone"] for r in got if r["bin"] == b and r["normal"]} for b in range(bins)]
    assert found == want and len({len(x) for x in want}) > 1


def test_mask_of_odd_tables(spark):
    none = spark.createDataFrame([], "clone long, bin long, baf double")
    labels, cells = spark.createDataFrame([], "spot long, clone long"), spark.createDataFrame([], "spot long, bin long, umi long")
    assert normal.local_mask(none, labels, cells, 2).collect() == []
    one = spark.createDataFrame([(1, 0, None), (1, 1, 0.9)], none.schema)
    got = normal.local_mask(one, spark.createDataFrame([(5, 1)], labels.schema), spark.createDataFrame([(5, 0, None)], cells.schema), 2).collect()
    assert [r["normal"] for r in got] == [True, True]
    assert not any(r["normal"] for r in normal.local_mask(one, labels, cells, 2).collect())


def test_baseline_by_mask_and_by_proportion(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(s, b, rng.randint(1, 9)) for s in range(6) for b in range(8)], "spot long, bin long, umi long")
    labels = spark.createDataFrame([(s, s % 2) for s in range(6)], "spot long, clone long")
    profiles = spark.createDataFrame([(c, b, 0.5 if c == 0 else 0.9) for c in range(2) for b in range(8)], "clone long, bin long, baf double")
    by_mask = {(r["bin"], r["spot"]): r["base"] for r in normal.local_normal_baseline(cells, labels, profiles, 2).collect()}
    pure = spark.createDataFrame([(s, 0.01 if s % 2 == 0 else 0.9) for s in range(6)], "spot long, proportion double")
    by_share = {(r["bin"], r["spot"]): r["base"] for r in normal.local_normal_baseline(cells, labels, profiles, proportions=pure, needed=1).collect()}
    assert by_mask == pytest.approx(by_share)
    own = {r["bin"]: r["n"] for r in cells.where("spot % 2 = 0").groupBy("bin").agg(F.sum("umi").alias("n")).collect()}
    total = {r["spot"]: r["n"] for r in cells.groupBy("spot").agg(F.sum("umi").alias("n")).collect()}
    assert by_mask == pytest.approx({(b, s): own[b] / sum(own.values()) * total[s] for b in range(8) for s in range(6)})
