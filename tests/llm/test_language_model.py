"""Strengths of the language model: all training documents teach them, and each token is judged by counts without it."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_model as lm


def test_all_training_documents_teach_strengths(spark, monkeypatch):
    # training documents by the fold, of which none is in the quarter by hash that taught strengths alone before
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1 and zlib.crc32(str(i).encode()) // 5 % 4][:60]
    gradients = []
    moved = lm.moved
    monkeypatch.setattr(lm, "moved", lambda g, c: gradients.append(np.abs(g).sum()) or moved(g, c))
    df = spark.createDataFrame([(i, "the sea the boat the wave " * (1 + i % 3)) for i in ids], "doc_id long, text string")
    lm.score(df)
    assert len(gradients) == 2 * lm.ROUNDS and all(g > 0 for g in gradients[::2])


@pytest.mark.parametrize("narrow", [True, False])
def test_slopes_leave_each_token_out_of_the_counts_that_judge_it(narrow):
    rng = np.random.default_rng(3)
    rows, classes, n = 16, 5, 40
    at = rng.integers(0, rows // lm.FEATURES, (lm.FEATURES, n)) + np.arange(lm.FEATURES)[:, None] * (rows // lm.FEATURES)
    goal, share = rng.integers(0, classes, n), np.array([0.1, 0.2, 0.3, 0.25, 0.15])
    seen = np.zeros((rows, classes), np.float32)
    for each in at:
        np.add.at(seen, (each, goal), 1)
    table, m = lm.Table.of(seen, share), lm.FEATURES * lm.LEVELS
    bias = np.log(share).astype(np.float32)

    def level(factor):
        total = 0.0
        for i in range(n):
            left = seen.copy()
            left[at[:, i], goal[i]] -= 1
            own = lm.Table(lm.Table.of(left, share).weights, table.strength).stronger(factor).weights
            z = own[at[:, i]].astype(float).sum(axis=0) + bias
            total += z[goal[i]] - np.log(np.exp(z).sum())
        return total

    gradient, curvature = np.zeros(m), np.zeros((m, m))
    powers = table.powers() if narrow else None
    lm.slopes(table, lm.Table.less(seen, share), powers, np.exp(bias) if narrow else bias, lm.Room(classes), at, goal, gradient, curvature)
    for k in np.unique(table.strength):
        step = np.zeros(m)
        step[k] = 1e-2
        assert gradient[k] / lm.GRAIN == pytest.approx((level(np.exp(step)) - level(np.exp(-step))) / 2e-2, abs=2e-3)
    assert (np.diag(curvature)[np.unique(table.strength)] > 0).all() and np.array_equal(curvature, np.rint(curvature))


def test_texts_are_split_as_bytes_are():
    bodies = [None, b"", b"  ", b" A b\x0b\x0cC \t", b"\xff\xfe q \xc3", b"\xc3\x89a\x1cZ", b"z"]
    words, codes, edges = lm.split(pa.array(bodies, pa.binary()).slice(1))
    got = [[words[c] for c in codes[a:b]] for a, b in zip(edges[:-1], edges[1:])]
    assert got == [[*lm.tokens(b), lm.END] for b in bodies[1:]]


def test_rare_words_are_classed_together_as_each_would_be_alone():
    head = [b"sea", b"season", b"boat", b"boats", b"aaa", b"\xc3\xa9t\xc3\xa9"]
    own = np.array([0, 3, 1, 1, 2, 5])
    letters, size = {}, np.bincount(own, minlength=lm.CLUSTERS) + 1.0
    for w, k in zip(head, own):
        for g in lm.grams(w):
            letters.setdefault(g, np.zeros(lm.CLUSTERS))[k] += 1
    words = [b"seaside", b"goat", b"", b"zzz", b"aaaaaa", b"\xff\x00", b"\xc3\xa9t", b"q", b"a" * 5000, *head] * 3
    want = []
    for w in words:
        total = sum((np.log((letters[g] + 0.1) / size) for g in lm.grams(w) if g in letters), np.zeros(lm.CLUSTERS))
        want.append(int(np.argmax(np.round(total, 9))) * len(lm.BANDS) + len(lm.BANDS) - 1)
    spelling = lm.spelling(head, own)
    assert lm.spelled(words, spelling).tolist() == want
    assert [int(lm.spelled([w], spelling)[0]) for w in words] == want
    assert lm.spelled([], spelling).tolist() == [] and lm.spelled([b"sea"], lm.spelling([], own[:0])).tolist() == [len(lm.BANDS) - 1]


def test_slopes_of_many_tokens_are_those_of_their_pieces():
    rng = np.random.default_rng(5)
    rows, classes, n = 64, 7, 2 * lm.BATCH + 3
    at = rng.integers(0, rows // lm.FEATURES, (lm.FEATURES, n)) + np.arange(lm.FEATURES)[:, None] * (rows // lm.FEATURES)
    goal, share = rng.integers(0, classes, n), np.full(classes, 1 / classes)
    seen = np.zeros((rows, classes), np.float32)
    for each in at:
        np.add.at(seen, (each, goal), 1)
    table, less, m = lm.Table.of(seen, share), lm.Table.less(seen, share), lm.FEATURES * lm.LEVELS
    sums = []
    for piece in (n, 1000, 1):
        gradient, curvature = np.zeros(m), np.zeros((m, m))
        room = lm.Room(classes)
        for a in range(0, n, piece):
            lm.slopes(table, less, True, None, room, at[:, a : a + piece], goal[a : a + piece], gradient, curvature)
        sums.append((gradient, curvature))
    for gradient, curvature in sums[1:]:
        assert np.array_equal(gradient, sums[0][0]) and np.array_equal(curvature, sums[0][1])


def test_counts_of_words_are_whole_whatever_blanks_stand_at_edges(spark):
    bodies = [None, b"", b"  ", b" A b\x0b\x0cC \t", b"a  a", b"\xff\xc3 b"]
    got = {r["word"]: r["n"] for r in lm.counted(spark.createDataFrame([(b,) for b in bodies], "body binary")).collect()}
    assert {bytes(w): n for w, n in got.items()} == {b"a": 3, b"b": 2, b"c": 1, b"\xff\xc3": 1, lm.END: len(bodies)}
