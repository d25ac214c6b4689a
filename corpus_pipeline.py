"""A corpus pipeline: reject toxic documents, keep one of each near-duplicate group, redact secrets, mix, pack.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but
the last return the columns of their input, whatever these are called.  Each result is written as Parquet and read again.

A null or empty text is judged like a text without words, holds no secrets and weighs nothing in the mix.  A null source is
a source of its own.  Repeated rows stay once.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions.ordering import row_index
from millrace.llm import mixing, ngram_join, packing, secrets, toxicity
from millrace.llm.common import col, materialise, read_table
from millrace.llm.pairs import small_or_shuffled

#: SQL cannot express the trained classifier, the tokenizer and the packing; the stages are tested by brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """Whole rows in one column ``_row`` beside the columns a stage reads, so that no name can clash with a result's."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), *[col(n) for n in names])


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    rows = _packed(docs, "doc_id", "text")
    scored = toxicity.score_documents(rows, read_table(spark, sf_dir, "labels"), carry=["_row"])
    return _unpacked(scored.where("predicted = 0"), docs)


def _one_per_text(docs: DataFrame) -> DataFrame:
    """Packed rows: those of one id and text stay once, the first by the other columns; _no numbers the rest by id, a null id last."""
    text = F.coalesce(F.sha2("text", 256), F.lit(""))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), 256)
    sortable = [f.name for f in docs.schema.fields
                if f.name not in ("doc_id", "text") and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    order = [F.col("_row").getField(n) for n in sortable] or [F.lit(0)]
    rows = _packed(docs, "doc_id", "text").withColumn("_key", key)
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    rows = materialise(rows.withColumn("_first", first).where("_first = 1").drop("_first"))
    numbers = materialise(row_index(rows.select("doc_id", "_key"), ["doc_id", "_key"], "_no").select("_key", "_no"))
    return materialise(rows.join(small_or_shuffled(numbers), "_key"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Where ids repeat or are null, id and text together are the document: equal ones stay once, and of different texts
    of one id each is judged by itself.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        judged = ngram_join.join_ngrams(docs.select("doc_id", "text"), "doc_id")
        dropped = materialise(judged.where("not kept").select("doc_id"))
        return docs.join(small_or_shuffled(dropped), "doc_id", "left_anti").select(*[col(c) for c in docs.columns])
    rows = _one_per_text(docs)
    judged = ngram_join.join_ngrams(rows.select("_no", "text"), "_no")
    dropped = materialise(judged.where("not kept").select(F.col("doc_id").alias("_no")))
    return _unpacked(rows.join(small_or_shuffled(dropped), "_no", "left_anti"), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars, where there is one, follows the text."""
    clean, names = secrets.redact(docs), docs.columns
    if "n_chars" not in names:
        return clean
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[length.alias(n) if n == "n_chars" else col(n) for n in names])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is repeated as often as the mix takes it."""
    mixed = mixing.mix_sources(_packed(docs, "doc_id", "text", "source"), carry=["_row", "doc_id"]).where("copies > 0")
    return _unpacked(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("ngram_join", drop_near_copies), ("secrets", redact_secrets),
          ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
