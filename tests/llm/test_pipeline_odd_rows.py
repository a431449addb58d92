"""The whole pipeline over NULLs, empty texts, repeated rows, and an empty table."""

import corpus_pipeline
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", "a window of ten words that a document must not hold"), ("q2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    story = "it was a calm day and all who lived by the sea went out to look for shells"
    rows = [
        (1, story, "en", "web", 70), (2, story + " again", "en", "web", 76), (1, story, "en", "web", 70), (None, "no id but words enough to be a text", None, None, None),
        (3, None, "en", "book", None), (4, "", "en", None, 0), (5, "here: a window of ten words that a document must not hold, said they", "en", "book", 60), (6, "two words", "fr", "book", 9),
    ]
    got = corpus_pipeline.run(spark, written(spark, tmp_path / "odd", rows)).collect()
    ids = [r["doc_id"] for r in got]
    # one of the group stays, the leaked text goes; documents without words are taken no times or more
    assert 2 not in ids and 5 not in ids and {1, 6, None} <= set(ids)
    assert all(0 <= r["shard"] < 40 for r in got)
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [])).collect() == []
