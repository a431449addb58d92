"""Filters of documents whose columns have the names that the operators use for their own."""

from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, toxicity

OWN = ("__id", "__print", "__own", "__ident", "__chars", "ident", "print", "score")


def clashing(df):
    return df.withColumns({name: F.lit(f"theirs {name}") for name in OWN})


def test_deduplicate_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, text + " eleven"), (3, "another text of few words"), (4, None), (4, None), (5, ""), (1, text), (None, text)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = jaccard_join.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["3", "4", "4", "5", "None"]
    assert {r["__print"] for r in got.collect()} == {"theirs __print"} and {r["__own"] for r in got.collect()} == {"theirs __own"}


def test_decontaminate_keeps_columns_of_any_name(spark):
    window = "a b c d e f g h i j"
    docs = clashing(spark.createDataFrame([(1, f"x {window} y"), (1, "clean"), (2, None), (None, window)], "doc_id long, text string"))
    got = decontaminate.decontaminate(docs, spark.createDataFrame([("q", window)], "item_id string, text string"))
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2"]
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id string, text string"))
    assert none.count() == 4


def test_scores_replace_a_column_of_that_name(spark):
    bad = "you are a horrible idiot"
    docs = spark.createDataFrame([(i, f"{bad} number{i}" if i % 4 == 0 else f"a calm text about things number{i} {i * 7}") for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    scored = toxicity.score(clashing(docs), toxicity.fit(docs, labels))
    assert scored.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in scored.collect())
