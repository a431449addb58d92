"""Secrets, personal data, decontamination and the Jaccard join against brute force on the small tables and on odd rows."""

import hashlib
import re
from collections import defaultdict

import pytest

pytest.importorskip("tessera.llm.queries")
from tessera.llm import decontaminate, jaccard_join, pii, queries, secrets
from tessera.llm.text import find_all

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "", "en", "a", 0),
    (2, None, None, None, None),
    (None, "one two", "en", None, 7),
    (4, " \t\n", "en", "b", 3),
    (5, "one two", "en", "b", 7),
    (5, "one two", "en", "b", 7),
    (6, "é𝔘 password: abcdefgh12 mail a.b@c.de +1 (988) 555-2485 " * 3, "fr", "a", 9),
    (7, "w " * 50_000 + "token=" + "Zz9" * 2000, "de", "c", 100_000),
]


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def sha(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return out


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return out


def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_find_all_places(spark):
    df = spark.createDataFrame([("aXbXXc",), ("",), ("XX",), ("𝔘X",), ("abc",)], "t string")
    got = [[(h["start"], h["end"]) for h in r[0]] for r in df.select(find_all(df.t, "X+")).collect()]
    assert got == [[(1, 2), (3, 5)], [], [(0, 2)], [(1, 2)], []]
    many = spark.createDataFrame([("ab " * 3000,)], "t string")
    assert [h["start"] for h in many.select(find_all(many.t, "a")).first()[0]] == list(range(0, 9000, 3))


def test_secrets_base(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op8_secrets(spark, sf_dir).collect()}
    docs = texts(spark, sf_dir)
    assert len(got) == len(docs)
    for i, text in docs:
        want = plain_secrets(text or "")
        assert [got[i][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(s[1] == k for s in want) for k in range(3)]
        assert got[i]["base_sha256"] == sha(want, secrets.KINDS)
        assert {f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want} <= set(got[i]["spans"].split(",")) | {""}


def test_secrets_finds_random_strings_and_not_prose(spark):
    import random

    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    prose = ["".join(rng.choice(["the", "tion", "er", "an", "ing", "ed"]) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame([(i, f"see {w} now") for i, w in enumerate(keys + prose)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.scan(df).collect() if r["random"]}
    assert len([i for i in found if i < 60]) >= 50
    assert len([i for i in found if i >= 60]) <= 3


@pytest.mark.parametrize("before", ["com/api-v1/", "my_team/", "a-b+c/", "my/team_"])
def test_secrets_finds_keys_in_runs_that_mix_alphabets(spark, before):
    import random

    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(i, f"see {before}{k} now") for i, k in enumerate(keys)], "doc_id long, text string")
    got = secrets.scan(df).collect()
    found = [(r["doc_id"], s["start"], s["end"]) for r in got for s in r["random"]]
    key = 4 + len(before)
    assert len({i for i, s, e in found if s <= key and e == key + 40}) >= 45


def test_secrets_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = secrets.scan(df).collect()
    assert len(got) == len(ODD)
    assert secrets.scan(df.limit(0)).count() == 0
    for row, want in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(ODD, key=lambda r: str(r[0]))):
        assert [(s["start"], s["rank"], s["end"]) for s in row["base"]] == sorted(plain_secrets(want[1] or ""))


def test_pii_base(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op3_pii(spark, sf_dir).collect()}
    docs = texts(spark, sf_dir)
    assert len(got) == len(docs)
    for i, text in docs:
        want = plain_pii(text or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[1] == k for s in want) for k in range(4)]
        assert got[i]["base_sha256"] == sha(want, pii.KINDS)


@pytest.mark.parametrize("text", ["a@b.cc_x@d.ef", "x@y x@y.z @a.b a@@b.c", "1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.4", "4111 1111-1111 1111", "+1 (988) 555-2485 +12+123456789", "1 2  3", ".@a-.b a.@b.c."])
def test_pii_base_of_odd_texts(text):
    assert pii.base_spans(text) == sorted(plain_pii(text))


def test_pii_disclosing_terms(spark):
    rows = [(i, f"start{i} of it zaphod wrote from z@mail.org about w{i} end{i}") for i in range(5)]
    rows += [(100 + i, f"nothing here about word{i} of it") for i in range(200)]
    rows += [(500, "where is zaphod today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert "term:9:15" in got[500]["spans"]
    assert got[500]["n_email"] == 0 and got[500]["base"] == ""
    assert "<EMAIL>" in got[0]["sanitised"] and "zaphod" not in got[0]["sanitised"]
    assert got[100]["sanitised"] == rows[5][1]


def test_pii_terms_of_fixed_sentences_and_far_away(spark):
    rows = [(i, f"other{i} matter{i} trillian once came here and then told all of them: please do write soon to me at t@mail.org for more news about the next two trips, body{i}") for i in range(5)]
    rows += [(100 + i, f"nothing here about word{i} of it") for i in range(200)]
    rows += [(500, "where is trillian today")]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:9:17" in got[500]["spans"]
    copies = [(i, "ford wrote from f@mail.org") for i in range(5)] + rows[5:]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert "term" not in got[0]["spans"]


def test_pii_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = pii.sanitise(df, keep=("doc_id", "lang")).collect()
    assert len(got) == len(ODD)
    assert pii.sanitise(df.limit(0)).count() == 0


def plain_windows(items):
    out = defaultdict(set)
    for i, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        for s in range(max(1, len(w) - 9)) if w else ():
            out[tuple(w[s : s + 10])].add(i)
    return out


def plain_contained(docs, items):
    windows = plain_windows(items)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= who
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op9_decontaminate(spark, sf_dir).collect())
    assert got == sorted(plain_contained(texts(spark, sf_dir), items))


@pytest.mark.parametrize("most", [0, 500_000])
def test_decontaminate_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BITS", max(1024, most))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    docs = [*ODD, (8, "A b c, d e f g h i j k l", "x", "y", 1), (9, "q one two three. one TWO", "x", "y", 1), (10, "z b c d e f g h i j k", "x", "y", 1)]
    items = [(1, "a b c d e f g h i j k"), (2, "one two"), (3, ""), (4, None), (5, "!!"), (10, "one"), (2, "one two")]
    df, it = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained(df, it).select("ident", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got) == order(plain_contained([d[:2] for d in docs], [i for i in items]))
    kept = decontaminate.decontaminate(df, it)
    assert kept.columns == df.columns and kept.count() == sum(not x[-1] for x in plain_contained([d[:2] for d in docs], items))
    assert decontaminate.contained(df, it.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contained(df.limit(0), it).count() == 0


def plain_join(docs, percent=80):
    sets = []
    for _, text in docs:
        w = WORD.findall(low(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def test_jaccard_join(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.op6_jaccard_join(spark, sf_dir).collect())
    want = sorted(plain_join(texts(spark, sf_dir)))
    assert any(c != d for d, _, c in want)
    assert got == want


def test_jaccard_join_chains_ties_and_odd_rows(spark):
    import random

    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(6):
        words = [f"g{g}{w}" for w in base]
        for k in range(12):
            rows.append((1000 * g + k, " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = f"x{g}{k}"
            if k % 3 == 0:
                words.append(f"tail{k}")
    common = " ".join(f"common{i}" for i in range(40))
    rows += [(20_000 + i, f"{common} own{i} " + " ".join(f"o{i}{j}" for j in range(i % 9))) for i in range(60)]
    rows += [d[:2] for d in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.join(df).collect()), key=str)
    assert got == sorted(plain_join(rows), key=str)
    assert jaccard_join.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [64, jaccard_join.TILE])
def test_jaccard_join_of_a_large_group_of_near_copies(spark, tile):
    import random

    rng = random.Random(4)
    base = [f"b{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1500):
        words = list(base)
        # from one change (alike to the base) to four (alike to few or none)
        for j in range(rng.choice((1, 1, 1, 2, 2, 3, 4))):
            words[rng.randrange(90)] = f"x{k}y{j}" if rng.random() < 0.5 else f"z{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.join(df, tile=tile).collect())
    want = sorted(plain_join(rows))
    assert len({c for _, _, c in want}) > 20
    assert got == want


def test_overlap_bound_never_undercounts():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 300)))
        b = np.unique(rng.choice(pool, rng.integers(1, 300)))
        bound = jaccard_join.most_overlap(jaccard_join.bitmap(a), len(a), jaccard_join.bitmap(b), len(b))
        assert bound >= len(np.intersect1d(a, b))
