"""Scores of runs against plain counting."""

import itertools
import random

import pytest

from tessera.operators import audit

PLANTED, FITTED = "spot long, clone long", "spot long, clone long"
SEGMENTS = "segment long, chrom string, start long, end long, clone long, a long, b long, state long"
PROFILE = "row long, chrom string, start long, end long, clone long, a long, b long"


def ari(left, right):
    n, pairs = len(left), lambda x: x * (x - 1) / 2
    count = lambda xs: sum(pairs(xs.count(v)) for v in set(xs))
    both = count(list(zip(left, right)))
    a, b = count(list(left)), count(list(right))
    expected = a * b / pairs(n) if n > 1 else 0
    return 1.0 if (a + b) / 2 == expected else (both - expected) / ((a + b) / 2 - expected)


def run(seed=1):
    rng = random.Random(seed)
    planted = {i: rng.randrange(3) for i in range(200)}
    fitted = {i: (p + 1) % 3 if rng.random() < 0.8 else rng.randrange(4) for i, p in planted.items() if i % 13}
    states = [(1, 1), (0, 1), (2, 1), (2, 2), (2, 0)]
    profile = [(r, str(c), s, s + 100, k, *(states[0] if k == 0 else rng.choice(states))) for r, (c, s) in enumerate(itertools.product((1, 2), (0, 100, 200))) for k in range(3)]
    profile += [(9, "1", 50, 120, k, 2, 2) for k in range(3)]  # a later row on top
    segments = []
    for i, (c, s) in enumerate(itertools.product((1, 2, 3), range(0, 330, 15))):
        for k in range(4):
            a, b = rng.choice(states) if k < 3 or rng.random() < 0.004 else segments[-1][5:7]
            segments.append((i, str(c), s, s + 14, k, a, b, rng.randrange(5)))
    return planted, fitted, profile, segments


def test_scores_by_hand(spark):
    planted, fitted, profile, segments = run()
    spots = [(planted[i], fitted[i]) for i in planted if i in fitted]
    best = max(itertools.permutations(range(4), 3), key=lambda m: sum((p, m[p]) in [x] for x in spots for p in [x[0]]))
    t, ab, z = [], [], []
    for seg, c, s, e, k, a, b, state in segments:
        for p in range(3):
            if best[p] == k:
                rows = [x for x in profile if x[1] == c and x[2] <= (s + e) // 2 < x[3] and x[4] == p]
                if rows:
                    t.append(rows[-1][5] * 1000 + rows[-1][6])
                    ab.append(a * 1000 + b)
                    z.append(state)
    got = {r["metric"]: r["value"] for r in audit.score_run(
        spark.createDataFrame(list(planted.items()), PLANTED), spark.createDataFrame(list(fitted.items()), FITTED), spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(profile, PROFILE)).collect()}
    free = lambda x: (min(x // 1000, x % 1000), max(x // 1000, x % 1000))
    assert got["clone_ari"] == pytest.approx(ari(*zip(*spots)))
    assert got["spots"] == len(spots) and got["clones"] == 4 and got["kept"] == pytest.approx(len(spots) / len(planted))
    assert got["state_ari"] == pytest.approx(ari(t, z)) and got["copy_ari"] == pytest.approx(ari(t, ab))
    assert got["copy_ari_pf"] == pytest.approx(ari(list(map(free, t)), list(map(free, ab))))
    assert got["exact"] == pytest.approx(sum(x == y for x, y in zip(t, ab)) / len(t)) and got["clone_bins"] == len(t)
    altered = [i for i, x in enumerate(t) if x != 1001]
    assert got["exact_altered_pf"] == pytest.approx(sum(free(t[i]) == free(ab[i]) for i in altered) / len(altered))
    loh = [i for i, x in enumerate(t) if 0 in free(x)]
    assert got["exact_loh"] == pytest.approx(sum(t[i] == ab[i] for i in loh) / len(loh))
    assert got["copy_ari_loh"] == pytest.approx(ari([t[i] for i in loh], [ab[i] for i in loh]))
    assert got["copy_ari_balanced_gain"] is None  # one pair only
    # the last clone differs from the third in few bins at most
    profiles = {k: [(a, b) for _, _, _, _, c, a, b, _ in sorted(segments) if c == k] for k in range(4)}
    merge = lambda share: {k: next((j for j in range(k) if sum(x == y for x, y in zip(profiles[j], profiles[k])) >= share * len(profiles[k])), k) for k in range(4)}
    for name, share in audit.AGREEMENTS.items():
        into = merge(share)
        assert got[f"clone_ari_{name}"] == pytest.approx(ari([p for p, _ in spots], [into[f] for _, f in spots]))


def test_planted_rows(spark):
    segments = spark.createDataFrame([(0, "1", 0, 9), (1, "1", 10, 30), (2, "1", 25, 40), (3, "2", 0, 5)], "segment long, chrom string, start long, end long")
    bins = spark.createDataFrame([(0, "1", 9), (1, "1", 10), (2, "1", 27), (3, "1", 41), (4, "2", 5), (5, "3", 1)], "bin long, chrom string, position long")
    assert {r["bin"]: r["segment"] for r in audit.planted_rows(segments, bins).collect()} == {0: 0, 1: 1, 2: 2, 3: None, 4: 3, 5: None}
    assert {r["bin"]: r["segment"] for r in audit.planted_rows(segments, bins.limit(4)).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_state_scores_by_hand(spark):
    rng = random.Random(6)
    true = {0: (1.0, 0.5), 1: (1.5, 0.66), 2: (0.5, 0.9)}
    fit = {(c, s): (1.0 + 0.4 * s + 0.1 * c, 0.5 - 0.1 * s) for c in range(2) for s in range(4)}
    bins = [(rng.randrange(2), (p := rng.randrange(3)), p + 1 if rng.random() < 0.7 else rng.randrange(4), rng.randrange(3), rng.randrange(3)) for _ in range(150)]
    got = {r["metric"]: r["value"] for r in audit.state_scores(
        spark.createDataFrame(bins, "fitted long, planted_state long, state long, a long, b long"),
        spark.createDataFrame([(s, *v) for s, v in true.items()], "state long, mu double, p double"),
        spark.createDataFrame([(*k, *v) for k, v in fit.items()], "clone long, state long, mu double, p double"),
    ).collect()}
    median = lambda x: (sorted(x)[(len(x) - 1) // 2] + sorted(x)[len(x) // 2]) / 2
    assert got["mu_error_median"] == pytest.approx(median([abs(fit[c, s][0] - true[p][0]) for c, p, s, _, _ in bins]))
    assert got["baf_error_median"] == pytest.approx(median([abs(min(fit[c, s][1], 1 - fit[c, s][1]) - min(true[p][1], 1 - true[p][1])) for c, p, s, _, _ in bins]))
    due = [round(2 * true[p][0]) for _, p, *_ in bins]
    total = [a + b for *_, a, b in bins]
    assert got["copy_exact"] == pytest.approx(sum(x == y for x, y in zip(due, total)) / 150)
    assert got["copy_error_altered_median"] == median([abs(x - y) for x, y, b in zip(due, total, bins) if b[1]])
    best = max(itertools.permutations(range(4), 3), key=lambda m: sum(m[p] == s for _, p, s, _, _ in bins))
    assert got["state_match"] == pytest.approx(sum(best[p] == s for _, p, s, _, _ in bins) / 150)
    assert got["state_ari"] == pytest.approx(ari([b[1] for b in bins], [b[2] for b in bins]))


def test_scores_of_an_empty_run(spark):
    frame = lambda schema: spark.createDataFrame([], schema)
    got = {r["metric"]: r["value"] for r in audit.score_run(spark.createDataFrame([(1, 0)], PLANTED), frame(FITTED), frame(SEGMENTS), frame(PROFILE)).collect()}
    assert got["spots"] == 0 and got["kept"] == 0 and got["clone_bins"] == 0 and got["exact"] is None and got["copy_ari_loh"] is None
    assert audit.state_scores(frame("fitted long, planted_state long, state long, a long, b long"), frame("state long, mu double, p double"), frame("clone long, state long, mu double, p double")).where("value IS NOT NULL").count() == 0
