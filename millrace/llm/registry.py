"""Registered queries of this package and their SQL."""

from __future__ import annotations

from . import alignment, bpe, embedding_dedup, fingerprint, language_model, mixing, ngram_join, packing, secrets, toxicity, url_filter, warc, whitening
from .common import read_table


def op1_embedding_dedup(spark, sf):
    return embedding_dedup.dedup_embeddings(read_table(spark, sf, "embeddings"))


def op2_mix_sources(spark, sf):
    return mixing.mix_sources(read_table(spark, sf, "documents"), carry=["doc_id"]).drop("copies")


def op3_url_cascade(spark, sf):
    return url_filter.judge_urls(read_table(spark, sf, "pages"), url_filter.RULES, carry=["page_id"])


def op4_lm_scores(spark, sf):
    return language_model.score_documents(read_table(spark, sf, "documents"))


def op5_toxicity(spark, sf):
    return toxicity.score_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"), carry=["doc_id"])


def op6_pack_sequences(spark, sf):
    import public_tokenizers

    return packing.pack_documents(read_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_secret_ledger(spark, sf):
    return secrets.scan_secrets(read_table(spark, sf, "documents"))


def op8_warc_captures(spark, sf):
    return warc.digest_rows(warc.archive_and_read(read_table(spark, sf, "pages"), keep_payload=False))


def op9_multiset_fingerprints(spark, sf):
    return fingerprint.fingerprint_documents(read_table(spark, sf, "documents"))


def op10_ngram_join(spark, sf):
    return ngram_join.join_ngrams(read_table(spark, sf, "documents"))


def op11_aligned_tokenizers(spark, sf):
    import public_tokenizers

    return alignment.alignment_digests(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitened(spark, sf):
    return whitening.whiten_embeddings(read_table(spark, sf, "embeddings"))


def op13_bpe_round_trip(spark, sf):
    import public_tokenizers

    return bpe.round_trip_digests(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def QUERIES() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run,
            "op1_embedding_dedup": op1_embedding_dedup, "op2_mix_sources": op2_mix_sources, "op3_url_cascade": op3_url_cascade,
            "op4_lm_scores": op4_lm_scores,
            "op5_toxicity": op5_toxicity, "op6_pack_sequences": op6_pack_sequences,
            "op7_secret_ledger": op7_secret_ledger, "op8_warc_captures": op8_warc_captures,
            "op9_multiset_fingerprints": op9_multiset_fingerprints,
            "op10_ngram_join": op10_ngram_join, "op11_aligned_tokenizers": op11_aligned_tokenizers,
            "op12_whitened": op12_whitened,
            "op13_bpe_round_trip": op13_bpe_round_trip}


def SQL() -> dict:
    return {"op2_mix_sources": mixing.SQL, "op3_url_cascade": url_filter.SQL,
            "op8_warc_captures": warc.SQL}
