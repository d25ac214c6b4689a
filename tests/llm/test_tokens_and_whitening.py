"""Byte-level BPE, alignment of two tokenizers and whitening against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, bpe, whitening

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCRAPS = ["a", "b", "e", "th", "the", "ing", "don't", "'s", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "日", "本", "😀", "ﬁ", "́", "=", "--", ";\r", "0", "12",
          "　", "\xa0", " ", "\x1c", "\x85", "\x00", "<|endoftext|>", "<s>", "foo,", "bar.", "(x)", "!?"]


def scraps(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(SCRAPS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(A)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


# ---- byte-level BPE

def test_every_token_that_spells_itself_may_be_proposed(own):
    for token in random.Random(3).sample(range(256, 50_256), 3_000):
        word = own.bytes_of[token]
        assert (own.proposals.get(word) == token) == (own.merge_exactly(word) == [token])


def test_seams_hold_exactly_where_both_tokens_come_back(own):
    rng = random.Random(5)
    pairs = [(rng.randrange(50_256), rng.randrange(50_256)) for _ in range(1_500)]
    pairs += [(t, u) for t in rng.sample(range(256, 3_000), 60) for u in rng.sample(range(256, 3_000), 60)]
    good = set(own.proposals.values())
    pairs = [(t, u) for t, u in pairs if t in good and u in good]
    held = own.seams_hold(*map(np.array, zip(*pairs)))
    assert 0 < held.sum() < len(pairs)
    for (t, u), ok in zip(pairs, held, strict=True):
        assert ok == (own.merge_exactly(own.bytes_of[t] + own.bytes_of[u]) == [t, u])


def test_only_failing_words_are_merged(own):
    words = [b" the", b" tokenization", b"zzzqqqx", b"a" * 200]
    out, failed = own.encode_words(words)
    assert out == [own.merge_exactly(w) for w in words] and failed < len(words)


def test_long_and_short_merging_agree(own):
    for text in scraps(300, 9):
        ids = [own.byte_ids[b] for b in text.encode()]
        assert own._merge_short(list(ids)) == own._merge_long(list(ids))


def test_ids_equal_the_librarys(spark, library):
    texts = scraps(3_000) + ["a" * 30_000, "ab" * 10_000, " " * 5_000, "日本" * 3_000, "<|endoftext|>" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in bpe.decode_documents(bpe.encode_documents(docs, A), A).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids, skip_special_tokens=False) == text


def test_any_ids_are_decoded_as_by_the_library(spark, library):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(50_257) for _ in range(rng.randint(0, 6))]) for i in range(800)]
    rows += [(900, [60_000, 5, 70_000]), (901, []), (None, [256])]
    out = bpe.decode_documents(spark.createDataFrame([*rows, (902, None)], "doc_id long, ids array<int>"), A).collect()
    got = {r["doc_id"]: r["decoded"] for r in out}
    assert all(got[i] == library.decode(ids, skip_special_tokens=False) for i, ids in rows) and got[902] == ""


def test_memory_of_a_worker_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 10_000)
    encoder = bpe.ByteBpe(A)
    memo = bpe.ChunkMemo({"ids": np.int32}, lambda chunks: [(chunks, {"ids": bpe.flat_ids(encoder.encode_chunks(chunks))})])
    for text in scraps(400, 4):
        text = text.replace("<|endoftext|>", "")
        slots = memo.look_up(bpe.CHUNK.findall(text))
        ids, _ = memo.values["ids"].take(slots)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert memo.held < 25_000


def test_round_trip_digests_of_messy_and_empty_tables(spark, messy, nothing, library):
    out = bpe.round_trip_digests(messy, A)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and bpe.round_trip_digests(nothing, A).isEmpty()
    want = []
    for r in messy.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows_of(out) == sorted(want, key=lambda r: tuple(map(str, r)))


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


# ---- alignment

def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    names = bpe.read_tokenizer(A)[1]

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        x, y = [names[i] for i in a], [piece(i) for i in b]
        groups, at = [], [0, 0]
        if text and b"".join(x) == b"".join(y) == (" " + text).encode():
            a_ends, b_ends = np.cumsum([len(v) for v in x]).tolist(), np.cumsum([len(v) for v in y]).tolist()
            for end in sorted(set(a_ends) & set(b_ends)):
                to = [a_ends.index(end, at[0]) + 1, b_ends.index(end, at[1]) + 1]
                groups.append((a[at[0]:to[0]], b[at[1]:to[1]]))
                at = to
        docs.append((doc, groups))
        counts.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for doc, groups in docs:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def test_alignment_equals_the_plain_one(spark, messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()] + list(enumerate(scraps(800)))
    rows += [(1, "▁ a"), (2, "a" * 4_000), (2, "日本" * 900), *[(5, "the same text")] * 300]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(alignment.alignment_digests(docs, A, B)) == brute_alignment(rows)
    assert alignment.alignment_digests(nothing, A, B).isEmpty()


def test_alignment_of_a_large_table_of_pairs_and_split_rows(spark, monkeypatch):
    """The way without a broadcast and texts of several rows of pairs give the same."""
    rows = list(enumerate(scraps(60, 8)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(alignment.settings, "BROADCAST_BYTES", 0)
    assert rows_of(alignment.alignment_digests(docs, A, B)) == brute_alignment(rows)


def test_linked_ids_come_in_blocks_of_whole_a_ids(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 40, 3_000), rng.integers(0, 30, 2_500)
    a_group, b_group = (np.sort(np.concatenate([np.arange(20), rng.integers(0, 20, n - 20)])) for n in (3_000, 2_500))
    want = Counter()
    for g in range(20):
        for p, n in Counter(a[a_group == g].tolist()).items():
            for q, k in Counter(b[b_group == g].tolist()).items():
                want[p << 32 | q] += n * k
    monkeypatch.setattr(alignment, "ROW_PAIRS", 500)
    blocks = list(alignment.linked_ids(a, b, a_group, b_group))
    assert len(blocks) > 5 and all(len(p) <= 500 + 30 * 20 for p, _ in blocks)
    assert sum(len(p) for p, _ in blocks) == len(want)
    assert {int(k): int(n) for p, m in blocks for k, n in zip(p, m, strict=True)} == dict(want)


def test_groups_are_kept_as_text(spark):
    out = alignment.align_documents(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), A, B).first()
    assert len(out["groups"].split(";")) == out["n_groups"] and out["n_links"] == out["n_best"] == out["count_sum"]


# ---- whitening

def brute_whitening(rows, k=4):
    x = {i: np.floor(256 * np.asarray(v, float)).astype(np.int64) for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, values[:k], values.sum(), {
        i: (int(((n * v - s) ** 2).sum()), (v - s / n) @ vectors[:, :k] / np.sqrt(values[:k])) for i, v in x.items()}


def check_whitening(spark, rows, wanted=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    out = whitening.whiten_embeddings(df).collect()
    n, values, total, want = brute_whitening([(i, np.asarray(v, np.float32)) for i, v in rows], wanted)
    got = defaultdict(dict)
    for r in out:
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == set(want) and all(sorted(v) == list(range(1, wanted + 1)) for v in got.values())
    ours = np.array([[got[i][c]["whitened"] for c in range(1, wanted + 1)] for i in want])
    theirs = np.array([w for _, w in want.values()])
    signs = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours * signs - theirs).max() < 1e-7
    assert all(r["n"] == n and r["deviation"] == want[r["vec_id"]][0] for r in out)
    assert all(abs(r["explained"] - values[r["component"] - 1] / total) < 1e-9 and r["identity_error"] < 1e-8 for r in out)


def test_whitening_equals_a_dense_eigensolver(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 40)) * np.linspace(1.6, 0.5, 40))]
    check_whitening(spark, rows + [(1_000 + i, rows[3][1]) for i in range(200)])


def test_whitening_of_fewer_dimensions_than_a_block(spark):
    rng = np.random.default_rng(2)
    check_whitening(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 6)))])
    check_whitening(spark, [(i, [float(v)]) for i, v in enumerate(rng.normal(size=20))], wanted=1)


def test_partial_sums_are_added_in_tasks_too(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    check_whitening(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 20)) * np.linspace(3, 1, 20))])


def test_filter_damps_what_lies_below_the_cut():
    values = np.array([10.0, 6.0, 2.0, 1.0, 0.1, 0.0])
    out = np.diag(whitening.damp(lambda q: values[:, None] * q, np.eye(6), 2.0, 10.0))
    assert abs(out[0]) > 0.9 and abs(out[1]) < abs(out[0]) and np.abs(out[2:]).max() < 1e-4 * abs(out[1])


def test_unusable_vectors_lengths_and_flat_tables(spark):
    bad, nan, inf = [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 1.0]
    rows = [(1, None), (2, bad), (3, nan), (4, inf), (5, []), (None, [0.1, 0.2, 0.9]), (6, [0.5, -0.2, 0.1]), (6, [0.3, 0.3, 0.3]),
            (7, [0.7, 0.1]), (8, [0.2, 0.9])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, n int")
    out = whitening.whiten_embeddings(df).collect()
    # Three vectors of length 3 spread over a plane, two of length 2 along a line.
    assert Counter(r["vec_id"] for r in out) == {None: 2, 6: 4, 7: 1, 8: 1}
    assert {r["n"] for r in out if r["vec_id"] == 7} == {2} and {r["n"] for r in out if r["vec_id"] == 6} == {3}
    assert whitening.whiten_embeddings(df.where("vec_id < 6")).isEmpty()
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert whitening.whiten_embeddings(same).isEmpty()
    assert whitening.whiten_embeddings(same.limit(0)).isEmpty()


def test_sums_and_deviations_beyond_longs(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.5])]
    out = whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: r["deviation"] for r in out}[1] is None and all(np.isfinite(r["whitened"]) for r in out)
    n, sums = whitening.exact_sums(whitening.packed(spark.createDataFrame([([2 ** 63 - 1],)] * 5, "x array<long>"), 1), 1)
    assert (n, sums) == (5, [5 * (2 ** 63 - 1)])


def test_results_do_not_depend_on_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    one, many = (whitening.whiten_embeddings(df.repartition(k)).orderBy("vec_id", "component").select(
        F.abs("whitened").alias("w"), "deviation").toPandas() for k in (1, 9))
    assert (one["deviation"] == many["deviation"]).all() and np.abs(one["w"] - many["w"]).max() < 1e-8
