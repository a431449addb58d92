"""Hot tokens, identifiers and pivots with forced small limits, against brute force."""

import random

import numpy as np

from tessera.llm import jaccard_join, pii, vp_search


def test_tiles_of_unlike_classes_are_cut_in_blocks(spark, monkeypatch):
    """One phrase begins hundreds of unlike texts, some of which have near copies: parts stay small and no link is lost."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    phrase = "all of these texts begin alike"
    rows, want = [], {}
    for i in range(400):
        body = rng.choices(words, k=6)
        copies = rng.choice([1, 1, 1, 2])
        for c in range(copies):
            ident = len(rows)
            rows.append((ident, f"{phrase} {' '.join(body)}" + (" more" if c else "")))
            want.setdefault(i, ident)
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    near = {}
    for i, a in enumerate(sets):
        near[i] = min(j for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b))
    got = {r["ident"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), tile=32).collect()}
    assert got == near
    members = []
    plain = jaccard_join.tiles
    monkeypatch.setattr(jaccard_join, "tiles", lambda m, p: (members.append(m), plain(m, p))[1])
    jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), tile=32).collect()
    sizes = [r["count"] for m in members for r in m.groupBy("token").count().collect()]
    assert max(sizes) < 4 * 32


def test_a_text_of_many_identifiers(spark):
    """Terms of a text are met with its identifiers once, and only identifiers of several texts count."""
    rng = random.Random(3)
    many = " ".join(f"user{i}@example.org" for i in range(2000))
    rows = [(0, many + " " + " ".join(f"word{chr(97 + i % 26)}" for i in range(300)))]
    rows += [(i, f"mail boss@corp.example about quixotic matters {rng.random()}") for i in range(1, 6)]
    rows += [(i, f"plain text about matters number {'abcdefghij'[i % 10] * 3} {rng.random()}") for i in range(6, 200)]
    found = {r["term"]: r["share"] for r in pii.disclosing(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()}
    assert "quixotic" in found and found["quixotic"] == 1.0 and "matters" not in found and not any(t.startswith("word") for t in found)


def test_more_than_a_thousand_pivots(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2600, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in vp_search.search(df, every=100, k=5, factor=1.0, least_shards=1100).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, 2600, 100):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(2600), -score)) if i != q][:5]
        assert [got[q][r] for r in range(1, 6)] == order
    assert 9000 not in got


def test_few_pairs_are_scored_exactly(monkeypatch):
    """Where nothing can be pruned, a leaf's product of single precision leaves few pairs, and the answer is the brute one, ties included."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[2000:2100] = x[:100]  # copies tie
    x[2500] *= 1e-30
    most = float(np.sqrt((x * x).sum(axis=1).max()))
    ids, asks = np.arange(len(x)) * 3, np.arange(0, len(x), 10)
    scored, einsum = [0], np.einsum

    def counted(form, *args, **rest):
        out = einsum(form, *args, **rest)
        scored[0] += out.size
        return out

    monkeypatch.setattr(np, "einsum", counted)
    found, score = vp_search.Tree(ids, x, most).search(ids[asks], x[asks], 5, 1.0)
    monkeypatch.undo()
    assert scored[0] < len(x) * len(asks) / 10
    for q, got, s in zip(asks.tolist(), found, score):
        every = np.einsum("ij,ij->i", np.broadcast_to(x[q], x.shape), x)
        every[q] = -np.inf
        best = np.lexsort((ids, -every))[:5]
        assert got.tolist() == ids[best].tolist() and np.allclose(s, every[best], rtol=1e-12, atol=0)
