"""The registered queries of this package: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fill_middle, jaccard_join, language_model, mixing, pii, secrets, sharding, toxicity, url_filter, vp_search, whitening
from .text import read

#: The base rules (host and path prefix) and the verdicts they give.
BASE_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Patterns of unwanted hosts and tracking links that hold where no base rule does: a few by name, the rest from two lists of words.
NAMED = ["||spam-farm.", "||cheap-pills.", "||casino-*.", "||adult-*.", "||free-bets.", "||ads-track.", "||doubleclick.", "/adserver/", "/popunder/"]
UNWANTED = "pills poker slots loans payday replica torrent warez escort dating lottery viagra crypto bets clickbait tracker popads malware phishing coupons".split()
SELLING = "online bonus cheap free best deals shop store world zone hub click".split()
PATTERNS = NAMED + [f"||{a}-{b}." for a in UNWANTED for b in SELLING] + [f"/{a}/{b}/" for a in UNWANTED[:5] for b in SELLING[:4]]

#: Fixed value: documents that score at least this are predicted toxic.
TOXIC_FROM = 0.7
#: Recall against brute force at this factor is measured in the tests and stated in the README.
NEAREST_FACTOR = 1.5


def url_rules() -> list[url_filter.Rule]:
    return [url_filter.Rule(name, verdict, f"||{name}", base=True) for name, verdict in BASE_RULES] + [url_filter.Rule(p, "block", p) for p in PATTERNS]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the base rules, then the pattern list."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge(pages, url_rules()).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host || path, '^([^/]*\.)?(spam-farm|cheap-pills|free-bets|ads-track|doubleclick)\.', 's')
    OR regexp_matches(host || path, '^([^/]*\.)?(casino|adult)-.*\.', 's')
    OR regexp_matches(host || path, '^([^/]*\.)?(UNWANTED)-(SELLING)\.', 's')
    OR regexp_matches(host || path, '/(FIRST)/(WORDS)/', 's')
    OR contains(path, '/adserver/') OR contains(path, '/popunder/') THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
""".replace("UNWANTED", "|".join(UNWANTED)).replace("SELLING", "|".join(SELLING)).replace("FIRST", "|".join(UNWANTED[:5])).replace("WORDS", "|".join(SELLING[:4]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model's score of every document, learned outside the held-out fold."""
    return language_model.score(read(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("ident", "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and disclosing terms of every document."""
    found = pii.sanitise(read(spark, sf_dir, "documents", "doc_id", "text"), rewrite=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every twentieth vector, at the measured factor."""
    return vp_search.search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), factor=NEAREST_FACTOR)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the weights 5, 2, 1."""
    mixed = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of five-word-shingle links at 0.8."""
    found = jaccard_join.join(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumnRenamed("ident", "doc_id")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    sharded = sharding.shard(read(spark, sf_dir, "documents", "doc_id", "text"))
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")



def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed patterns and random strings in every document."""
    found = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in windows of the benchmark."""
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.contained(docs, items)
    return found.select(F.col("ident").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and put together again, and the text rebuilt from that."""
    cut = fill_middle.transform(read(spark, sf_dir, "documents", "doc_id", "text"))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return fill_middle.restore(cut).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents),
h AS (SELECT *, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
x AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first eight components, at unit variance."""
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, and the bytes that they decode to."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"), ranks, pattern)
    decoded = byte_bpe.decode(ids, ranks, pattern)
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM t),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS pair_size, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * o >= 80 * (pair_size - o)),
x AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(u, v) AS (SELECT u, v FROM x UNION SELECT r.u, x.v FROM r JOIN x ON x.u = r.v),
m AS (SELECT u AS doc_id, min(v) AS least FROM r GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM s LEFT JOIN m USING (doc_id)
"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win
  FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS win FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens)),
hit AS (SELECT DISTINCT doc_id, item_id, s, dw.n FROM dw JOIN bw USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op2_language_model": op2_language_model, "op1_toxicity": op1_toxicity, "op4_nearest": op4_nearest, "op6_jaccard_join": op6_jaccard_join, "op3_pii": op3_pii, "op8_secrets": op8_secrets, "op9_decontaminate": op9_decontaminate, "op5_mix_sources": op5_mix_sources, "op7_shard": op7_shard, "op10_url_filter": op10_url_filter, "op11_fill_middle": op11_fill_middle, "op12_whitening": op12_whitening, "op13_byte_bpe": op13_byte_bpe}
SQL = {"op6_jaccard_join": OP6_SQL, "op9_decontaminate": OP9_SQL, "op10_url_filter": OP10_SQL, "op11_fill_middle": OP11_SQL}
