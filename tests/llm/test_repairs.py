"""Faults found in earlier rounds."""

from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, fingerprint, secrets
from millrace.llm.common import new_folder


def test_a_blob_that_two_handles_scanned_gives_one_row(spark):
    folder = new_folder(spark, "ledger")
    rows = spark.createDataFrame([(1, "password = abcdefghijkl1234")], "doc_id long, text string")
    handles = [secrets.BlobLedger(spark, folder) for _ in range(2)]
    first = handles[0].scan(rows, "text")
    # What a second scan at the same time adds.
    doubled = handles[1].entries().collect()
    spark.createDataFrame(doubled, secrets.LEDGER_SCHEMA).write.mode("append").parquet(folder)
    second = handles[1].scan(rows, "text")
    assert first.count() == 1 and second.count() == 1
    assert handles[1].entries().count() == 2 and handles[1].started


def test_lanes_depend_on_the_text_from_seeds_of_their_own(spark):
    lanes = spark.createDataFrame([("one\n\ntwo",), ("two\none",), ("",), ("one",), ("two",)], "t string") \
        .select(fingerprint.identity_lanes(F.col("t")).alias("v"), *[(F.xxhash64(F.lit(i), F.lit("one"))).alias(f"h{i}") for i in range(2)])
    both, turned, empty, one, two = [r["v"] for r in lanes.collect()]
    hashes = lanes.first()
    assert both == turned == [(a + b) & fingerprint.MASK for a, b in zip(one, two, strict=True)] and set(empty) == {0}
    assert one[:2] == [hashes["h0"] & fingerprint.MASK, hashes["h1"] & fingerprint.MASK] and len(set(one)) == fingerprint.IDENTITY


def test_every_length_of_vectors_is_searched(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, 2.0, 0.1, 0.0]), (4, [1.0, 2.0, 3.0]), (5, [2.0, 4.0, 6.0]),
            (6, [-1.0, 2.0, 3.0]), (7, [5.0]), (8, [3.0]), (9, []), (10, [0.0, 0.0, 0.0]), (11, None)]
    out = embedding_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    pairs = {2: (1, 2, True), 3: (1, 2, False), 4: (1, 4, True), 5: (1, 4, False), 7: (1, 7, True), 8: (1, 7, False)}
    assert got == {i: pairs.get(i, (0, i, True)) for i, _ in rows}
