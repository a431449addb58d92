"""Models, search, mixing, sharding and URL rules against brute force, planted cases and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm.queries")
from tessera.llm import jaccard_join, language_model, mixing, queries, sharding, toxicity, url_filter, vp_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en", "a", 0),
    (2, None, None, None, None),
    (None, "one two", "en", None, 7),
    (4, " \t\n", "en", "b", 3),
    (5, "one two", "en", "b", 7),
    (5, "one two", "en", "b", 7),
    (7, "w " * 50_000, "de", "c", 100_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "tion", "ly", "ou", "st", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


# --- toxicity


def test_toxicity_learns_marks_and_leaves_clean_documents(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        if toxic:
            words[rng.randrange(60)] = rng.choice(["zorkig", "zorkum", "zorkeit", "idiot"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scored.values())
    hit = [scored[i] >= 0.7 for i, y in labels if y]
    assert np.mean(hit) > 0.95 and not any(scored[i] >= 0.7 for i, y in labels if not y)
    assert model.score("a zorkest thing") > 0.5 > model.score("a plain thing")


def test_toxicity_label_model_ranks_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    seen = Counter()
    for t in y:
        seen[tuple(1 if (rng.random() < right) == t else -1 for right in (0.95, 0.9, 0.85, 0.6))] += 1
    evidence, prior, rho = toxicity.label_model(dict(seen), 0.2)
    assert abs(prior - 0.2) < 0.05
    gain = [e[1] - e[-1] for e in evidence]
    assert gain[0] > gain[2] > gain[3]
    assert rho.shape == (4, 4)


def test_toxicity_capitals_count_over_the_whole_text():
    assert toxicity.patterns("a" * 4000 + "B" * 8000)[1]
    assert not toxicity.patterns("A" * 4000 + "b" * 8000)[1]
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("aBcDÉéßΩω𝔘 1.") for _ in range(rng.randrange(60)))
        letters = sum(map(str.isalpha, text))
        assert toxicity.capitals(text) == (letters > 20 and sum(map(str.isupper, text)) > 0.6 * letters)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        model = toxicity.fit(odd, given)
        got = toxicity.score(odd, model)
        assert got.columns == [*odd.columns, "score"] and got.count() == len(ODD)
    assert toxicity.score(odd.limit(0), model).count() == 0


# --- language model


def plain_base(rows):
    counts = Counter()
    texts = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    for i, w in texts:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return sorted(((str(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in texts))


@pytest.mark.parametrize("carried", [60, 300_000])
def test_language_model_base_is_exact_and_model_learns(spark, carried):
    rng = random.Random(1)
    halves = (["the", "of", "sea", "boat", "wave", "salt"], ["le", "la", "mer", "bateau", "onde", "sel"])
    rows = [(i, " ".join(rng.choice(halves[i % 2]) for _ in range(80)) + f" rare{i}") for i in range(120)]
    got = language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), carried=carried).collect()
    assert sorted((str(r["ident"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == plain_base(rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_language_model_odd_rows(spark, odd):
    got = language_model.score(odd).collect()
    assert sorted((str(r["ident"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == plain_base([r[:2] for r in ODD])
    assert language_model.score(odd.limit(0)).count() == 0


def test_language_model_chances_are_a_distribution():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << 15, language_model.N_CLASSES)).astype(np.float32)
    hashes = language_model.contexts(np.arange(10, dtype=np.uint64), np.zeros(10, np.int64))
    at = language_model.rows_of(hashes, 15)
    p = language_model.chances(w, np.zeros(language_model.N_CLASSES, np.float32), at)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and at.max() < 1 << 15


def test_language_model_has_its_whole_size():
    assert language_model.N_CLASSES == 12 * 4 + 1
    ids, starts = np.arange(100, 104, dtype=np.uint64), np.zeros(4, np.int64)
    other = ids.copy()
    other[0] = 999  # three words before the last
    one, two = language_model.contexts(ids, starts)[:, 3], language_model.contexts(other, starts)[:, 3]
    assert len(one) == language_model.FEATURES == 4 and (one[:3] == two[:3]).all() and one[3] != two[3]
    assert language_model.grams(b"abcdefghij") == {b"^ab", b"abc", b"bcd", b"cde", b"def", b"efg", b"fgh", b"ghi", b"hij", b"ij$"}


def test_language_model_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one, many = ({r["ident"]: round(r["score"], 9) for r in language_model.score(docs.repartition(n)).collect()} for n in (1, 8))
    assert one == many


def test_language_model_probabilities_of_the_next_word_sum_to_one(spark):
    """Over all words that training saw and the unseen one, whatever the context."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "ee"]) for _ in range(40))) for i in range(60)]
    probes = ["a", "b", "c", "dd", "ee", "", "zzz"]
    # one-word texts that are held out: the first token's chance times the end's; the end alone is the empty text
    held = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 5 == 1][: len(probes)]
    df = spark.createDataFrame(rows + list(zip(held, probes)), "doc_id long, text string")
    got = {r["ident"]: r["score"] for r in language_model.score(df).collect()}
    # P(w) is at least P(w then the end), and the empty text is the end itself
    total = sum(10 ** got[i] for i in held)
    assert 0 < total <= 1 + 1e-6


def test_most_frequent_keeps_words_even_where_the_first_step_is_too_full(spark):
    words = spark.createDataFrame([(f"w{i}".encode(), 5) for i in range(1000)] + [(b"top", 90)], "word binary, n long")
    got = language_model.most_frequent(words, 300)
    assert 200 < len(got) <= 300 and got[b"top"] == 90
    assert 900 < len(language_model.most_frequent(words, 950)) <= 950


# --- nearest neighbours


def plain_nearest(rows, k=20, every=20):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            fine[i] = min(fine.get(i, v), v)
    out = {}
    for q in fine:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:k]
            out[q] = [i for _, i in found]
    return out


def test_exact_search_at_factor_one_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 1.0, 0.0, 2.0]) for i in range(150)]
    rows += [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 0.0, 0.0]), (2060, [math.nan, 1.0, 0.0, 0.0]), (2080, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (2100, [1.0, 2.0]), (2101, [2.0, 2.0]), (20, [9.0, 9.0, 9.0, 9.0]), (2120, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in vp_search.search(df, factor=1.0, least_shards=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == plain_nearest(rows)
    assert vp_search.search(df.limit(0)).count() == 0


def test_recall_at_the_production_factor(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = plain_nearest(rows), {}
    for r in queries.op4_nearest(spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.95


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        unit = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if unit * w[s] > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else unit * w[s] for s in order}
        capped |= set(over)


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([5, 50, 400])), None if i % 50 == 0 else f"s{min(i % 9, 5)}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = mixing.mix(df, shard_tokens=30_000).collect()
    b = mixing.mix(df.repartition(7), shard_tokens=30_000).collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"]) for r in rs)
    assert key(a) == key(b)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = plain_targets(sizes), Counter()
    for r in a:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.03)
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.005)


def test_seats_are_sainte_lague(spark):
    def plain(votes, most, total):
        won = [0] * len(votes)
        for _ in range(total):
            i = max((i for i in range(len(votes)) if won[i] < most[i] and votes[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[i] += 1
        return won

    rng = random.Random(2)
    cases = []
    for _ in range(50):
        votes = [rng.random() * 100 for _ in range(5)]
        most = [rng.randrange(1, 60) for _ in range(5)]
        cases.append((votes, most, rng.randrange(0, sum(most))))
    # ties go to the earlier; a party without votes has no seat
    cases += [([10.0, 10.0, 10.0], [9, 9, 9], 4), ([0.0, 3.0], [5, 2], 2)]
    df = spark.createDataFrame(cases, "votes array<double>, most array<long>, total long")
    got = df.select("votes", "most", "total", mixing.seats(df.votes, df.most, df.total).alias("won")).collect()
    for r in got:
        assert r["won"] == plain(r["votes"], r["most"], r["total"])


def test_mix_odd_rows(spark, odd):
    got = mixing.mix(odd.withColumnRenamed("n_chars", "taken")).collect()
    assert len(got) == len(ODD) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.sample(odd).columns == odd.columns


# --- sharding


def test_shards_are_even_whole_and_gapless(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([10, 100]))) for i in range(3000)] + [(10_000 + i, "the same text again") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, shards=10).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        assert r["size"] == len(r["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode())
    sizes = [sum(r["size"] for r in g) for g in by.values()]
    assert set(by) == set(range(10)) and max(sizes) - min(sizes) <= 0.01 * sum(sizes)
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(df.repartition(5), shards=10).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_shards_of_odd_rows(spark, odd):
    got = sharding.shard(odd.withColumnRenamed("n_chars", "slot")).collect()
    assert len(got) == len(ODD)
    assert sharding.shard(odd.limit(0)).count() == 0


# --- URL rules


def plain_judgement(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m.group(2)) if m else ("", "")
    best = None
    for name, verdict in queries.BASE_RULES:
        h, _, p = name.partition("/")
        if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}") and (best is None or len(name) > len(best[0])):
            best = (name, verdict)
    if best:
        return host, path, *best
    hit = re.match(r"([^/]*\.)?(spam-farm|cheap-pills|free-bets|ads-track|doubleclick)\.|(?s:([^/]*\.)?(casino|adult)-.*\.)", host + path) or "/adserver/" in path or "/popunder/" in path
    return host, path, None, "block" if hit else "allow"


URLS = ["http://A.example.net/en/1", "http://example.net/de", "http://xexample.net/en/", "http://example.com/de/", "http://example.com/DE/", "org", "http://fr.org/fr/", "http://org/fr/x?y", "http://net", "http://net/", "http://net:80/", "", None, "ftp://a://b/c", "http://spam-farm.x/y", "http://casino-q.z/", "http://h/adserver/1", "http://a.net#/en/", "://", "http:///net/"]


@pytest.mark.parametrize("inline", [0, 256])
def test_url_rules(spark, inline):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, queries.url_rules(), inline=inline).collect()}
    assert got == {i: plain_judgement(u) for i, u in enumerate(URLS + URLS[:3])}
    assert url_filter.judge(df.limit(0), queries.url_rules(), inline=inline).count() == 0
    assert url_filter.judge(df, []).where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


# --- the pipeline


def test_deduplicate_keeps_one_of_each_group(spark, odd):
    rng = random.Random(9)
    text = prose(rng, 80)
    near = text.rsplit(" ", 1)[0] + " changed"
    rows = [*ODD, (30, text, "en", "a", 1), (20, near, "en", "a", 1), (40, text, "en", "a", 1)]
    kept = jaccard_join.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "4", "None", "7", "20"])


def test_pipeline_stages_take_effect(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pipeline.run(spark, sf_dir).cache()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert set(kept) < ids and max(kept.values()) <= 3
    groups = {r["doc_id"]: r["component_id"] for r in queries.op6_jaccard_join(spark, sf_dir).collect()}
    assert len({groups[i] for i in kept}) == len(kept)
    dirty = {r["doc_id"] for r in queries.op9_decontaminate(spark, sf_dir).where("contaminated").collect()}
    toxic = {r["doc_id"] for r in queries.op1_toxicity(spark, sf_dir).where("predicted = 1").collect()}
    assert not dirty & set(kept) and not toxic & set(kept)
