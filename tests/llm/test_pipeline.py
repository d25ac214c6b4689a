
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Result of every stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf))
        out.append((name, docs))
    return dict(out)


def test_stages_keep_the_columns_of_documents(steps):
    assert list(steps) == ["toxicity", "ngram_join", "secrets", "mixing", "packing"]
    assert all(df.columns == COLUMNS for name, df in steps.items() if name != "packing")


def test_decisions_take_effect(steps, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0.7 * docs.count() < steps["toxicity"].count() < docs.count()
    assert steps["ngram_join"].join(steps["toxicity"], "doc_id", "left_anti").isEmpty()
    assert steps["ngram_join"].groupBy("text").count().where("count > 1").isEmpty()
    assert steps["secrets"].count() == steps["ngram_join"].count()
    assert steps["secrets"].where(F.col("text").rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}")).isEmpty()
    assert steps["secrets"].where("n_chars <> length(text)").isEmpty()
    assert steps["mixing"].join(steps["secrets"], "doc_id", "left_anti").isEmpty()
    assert steps["packing"].agg(F.count_distinct("doc_id")).first()[0] == steps["mixing"].select("doc_id").distinct().count()
    tokens = steps["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.count(F.when(F.col("start") == 0, 1)).alias("c"))
    assert tokens.where("n <> t * c").isEmpty()


@pytest.mark.parametrize("number", range(5))
def test_stages_take_messy_and_empty_tables(spark, sf, messy, nothing, number):
    name, stage = corpus_pipeline.STAGES[number]
    rows = messy.select(*COLUMNS)
    out = stage(spark, rows, sf).collect()
    assert out and stage(spark, nothing.select(*COLUMNS), sf).isEmpty()
    if name == "ngram_join":
        assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None and r["doc_id"] < 20) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    if name == "secrets":
        assert len(out) == rows.count()


def test_different_texts_of_one_id_are_judged_apart(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcde"}
    rows = [(1, "a", "en"), (1, "b", "en"), (2, "a", "en"), (None, "c", "en"), (None, "c", "en"), (None, "d", "en"), (None, "d", "en"),
            (3, "c", "en"), (4, "e", "en"), (4, "e", "de")]
    docs = spark.createDataFrame([(k, text[t], lang, "s", len(text[t])) for k, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 7):
        out = corpus_pipeline.drop_near_copies(spark, docs.repartition(parts), "").collect()
        assert sorted((str(r["doc_id"]), r["text"][0], r["lang"]) for r in out) == [
            ("1", "a", "en"), ("1", "b", "en"), ("3", "c", "en"), ("4", "e", "de"), ("None", "d", "en")]


@pytest.mark.parametrize("number", range(4))
def test_columns_named_like_results_stay_as_they_are(spark, sf, number):
    """Columns score, size, a.b, _row and a map pass every stage; rows of an id that repeats too."""
    words = "one two three four five six seven eight"
    rows = [(i, f"{words} {i} {i * i}", "s", -5.0 - i, -7, f"x{i}", {"k": i}) for i in range(12)] + [(3, "another text", "s", 1.0, 2, "y", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, size int, `a.b` string, `_row` map<string,int>")
    out = corpus_pipeline.STAGES[number][1](spark, docs, sf)
    assert out.schema.simpleString() == docs.schema.simpleString()
    given = {r[1]: r for r in rows}
    got = out.collect()
    assert got and all(tuple(r) == given[r["text"]] for r in got)


def test_copies_without_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "g h")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == ["a b c", "d e f", "g h"]
