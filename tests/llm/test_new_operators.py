"""Fill-in-middle, whitening and byte-level BPE: brute force, exact round trips and odd rows."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, fill_middle, whitening
from tessera.llm.queries import QUERIES, SQL

P = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
ODD = [None, "", " ", "a", "é", "€<P", "<P><S>", "x<M>y", "<<P", "<S", ">", "😀" * 700, "ab\x00c\n\n\n d", "日本語のテキスト" * 300, "z" * 5000, "<P" * 600, "don't  stop\t\n 12345"]


def middle_by_hand(ident, text):
    t = text or ""
    h = [int(hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (ident, n, "plain", None, None, t)
    if h[3] % 100 < 20:
        return (ident, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return (ident, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


def random_texts(seed, many):
    rnd = random.Random(seed)
    alphabets = ["ab <PSM>", "héllo €", "😀<>PS", "abc\n "]
    return ["".join(rnd.choices(rnd.choice(alphabets), k=rnd.choice([1, 2, 7, 60, 511, 512, 513, 1500]))) for _ in range(many)]


def test_middle_by_brute_force(spark):
    rows = list(enumerate(ODD + random_texts(1, 400))) + [(None, "no id"), (None, "no id"), (7, "repeated"), (7, "repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("theirs"))
    cut = fill_middle.transform(docs)
    got = fill_middle.restore(cut).collect()
    key = lambda r: (r[0] is None, r[0], r[5])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((middle_by_hand(*r) for r in rows), key=key)
    texts = sorted((r["doc_id"] or -1, r["restored"]) for r in got)
    assert texts == sorted((i or -1, t or "") for i, t in rows)


def test_middle_refuses_and_empties(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.restore(fill_middle.transform(docs)).collect() == []
    with pytest.raises(ValueError):
        fill_middle.transform(docs.withColumn("n", F.lit(1)), keep=("doc_id", "n"))
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "ba", "c"), ("<P>", "P", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.Automaton(bad)
    broken = spark.createDataFrame([("<P>a<S>b", "psm"), ("<S>a<P>b<M>c", "psm"), (None, "plain"), (None, "psm"), ("x", None), ("x<P>a<S>b<M>c", "psm")], "output string, form string")
    assert [r["restored"] for r in fill_middle.restore(broken).collect()] == [None] * 6


def test_middle_with_other_sentinels(spark):
    marks = ("⟦p⟧", "<|suffix|>", "é")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(3, 200) + ["naïve é", "⟦p", "⟦p⟧", "<|suffix|"] * 8)], "doc_id long, text string")
    got = fill_middle.restore(fill_middle.transform(docs, keep=("doc_id", "text"), sentinels=marks), sentinels=marks).collect()
    assert all(r["restored"] == r["text"] for r in got)
    assert all(r["form"] == "plain" for r in got if any(m in r["text"] for m in marks))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middle_long_texts_cross_lanes(monkeypatch):
    monkeypatch.setattr(fill_middle, "LANE", 5)
    monkeypatch.setattr(fill_middle, "TOGETHER", 64)
    import pyarrow as pa

    texts = random_texts(5, 120)
    for first, many, data, starts, ends in fill_middle.groups(pa.array(texts)):
        own = texts[first : first + many]
        found = fill_middle.Texts(fill_middle.Automaton(), data, starts, ends)
        assert found.lengths().tolist() == [len(t) for t in own]
        assert found.sentinels().tolist() == [sum(t.count(s) for s in fill_middle.SENTINELS) for t in own]
        for units in (np.zeros(many, int), np.array([len(t) // 2 for t in own]), np.array([len(t) for t in own])):
            assert (found.cuts(units) - starts).tolist() == [len(t[:u].encode()) for t, u in zip(own, units)]


def whitened_by_hand(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, c, e[::-1], v[:, ::-1]


def test_whitening_by_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "TOGETHER", 7)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.1).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [1.0] * 11 + [float("inf")]), (904, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(11)
    got = whitening.whiten(df.withColumn("n", F.lit("theirs"))).collect()
    x, n, s, c, e, v = whitened_by_hand(vectors)
    assert len(got) == 300 * 8 and {r["n"] for r in got} == {300}
    for r in got:
        k = r["component"] - 1
        assert int(r["deviation"]) == int(sum(int(a) ** 2 for a in n * x[r["vec_id"]] - s))
        assert abs(r["explained"] - e[k] / e.sum()) < 1e-9
        assert abs(abs(r["whitened"]) - abs(c[r["vec_id"]] @ v[:, k]) / np.sqrt(e[k])) < 1e-6
        assert r["identity_error"] < 1e-9
    w = np.zeros((300, 8))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-9


def test_whitening_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame([(1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # two vectors span one direction; a vector of another length stands alone; repeats count
    got = whitening.whiten(frame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 2.0, 3.0])])).collect()
    pair = [r for r in got if r["n"] == 3]
    assert len(pair) == 6 and all((r["whitened"] is None) == (r["component"] == 2) for r in pair)
    assert all(r["identity_error"] < 1e-9 for r in pair) and sum(r["n"] == 1 for r in got) == 3
    huge = whitening.whiten(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])])).collect()
    assert len(huge) == 4 and len({int(r["deviation"]) for r in huge}) == 1
    with pytest.raises(ValueError):
        whitening.whiten(frame([]).withColumn("n", F.lit(1)), keep=("vec_id", "n"))


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as f:
        return byte_bpe.Vocabulary(f.read(), PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def long_pieces():
    rnd = random.Random(4)
    for alphabet in ("a", "ab", "aeinorst", "éüß", "漢字かな", "0123456789", "=-", " ", "\t\n "):
        for n in (1, 63, 64, 65, 129, 700, 6000):
            yield "".join(rnd.choices(alphabet, k=n))
    yield "a" * 40_001 + "b" + "a" * 40_000
    yield "the" * 9_999


def test_ids_are_the_librarys(vocabulary, library, monkeypatch):
    texts = [t or "" for t in ODD] + list(long_pieces()) + random_texts(6, 200)
    want = [library.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in vocabulary.encode(texts)] == want
    assert [vocabulary.bytes_of(ids) for ids in want] == [t.encode() for t in texts]
    # short leaves, small blocks and a small memory change nothing
    for name, value in (("LEAF", 3), ("TOGETHER", 50), ("HELD", 4), ("REMEMBERED", 10), ("JOINED", 2)):
        monkeypatch.setattr(byte_bpe, name, value)
    short = [t for t in texts if len(t) < 2000]
    assert [x.tolist() for x in vocabulary.encode(short)] == [library.encode_ordinary(t) for t in short]


def test_merging_side_by_side_is_merging_alone(vocabulary):
    pieces = [p.encode()[:64] for p in long_pieces()] + [b"", bytes(range(256))[:64], b"\xff\xfe"]
    ids, edges = vocabulary.merge_all(pieces)
    assert [ids[i:j].tolist() for i, j in zip(edges, edges[1:])] == [vocabulary.merge(p) for p in pieces]


def test_ranks_without_a_training_order():
    """A table in which merging does not reach every token, and a new pair can rank below the one just merged."""
    tiktoken = pytest.importorskip("tiktoken")
    rnd = random.Random(8)
    for _ in range(20):
        tokens = {bytes([b]) for b in range(256)} | {bytes(rnd.choices(b"abc", k=rnd.randint(2, 5))) for _ in range(60)}
        order = sorted(tokens, key=lambda t: (len(t) > 1, rnd.random()))
        file = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order))
        own = byte_bpe.Vocabulary(file, r"[a-z]+|[^a-z]+")
        theirs = tiktoken.Encoding("own", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=own.ranks, special_tokens={})
        texts = ["".join(rnd.choices("abc", k=n)) for n in (2, 5, 64, 65, 200, 900)]
        assert [x.tolist() for x in own.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_bpe_on_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("theirs"))
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    key = lambda r: (r[0] is None, r[0])
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=key) == sorted(want, key=key)
    assert byte_bpe.encode(docs.limit(0), RANKS, PATTERN).collect() == []
    odd = spark.createDataFrame([([],), (None,), ([1, None],), ([-1],), ([10**6],)], "ids array<int>")
    assert [r["decoded"] for r in byte_bpe.decode(odd, RANKS, PATTERN).collect()] == [b"", None, None, None, None]
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, RANKS, PATTERN, keep=("doc_id", "ids"))


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_whitening", "op13_byte_bpe"])
def test_queries_on_the_supplied_tables(spark, sf_dir, name):
    import duckdb

    got = QUERIES[name](spark, sf_dir)
    if name in SQL:
        want = duckdb.sql(SQL[name].replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        return
    rows = got.collect()
    if name == "op12_whitening":
        vectors = [r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
        *_, e, _ = whitened_by_hand(vectors)
        assert len(rows) == 8 * len(vectors)
        assert all(abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9 and r["identity_error"] < 1e-6 for r in rows)
        return
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids)).encode()), digest((r["text"] or "").encode())))
    assert sorted(tuple(r) for r in rows) == sorted(want)
