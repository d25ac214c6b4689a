"""Language-model scores: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax."""

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import col, id_fold, materialise, shuffle_parts

# Words kept in every task with their counts; the others are met by a join. Bounds what travels to the tasks.
HEAD_WORDS = 200_000
# Outputs form a tree of three softmaxes of WIDTH: class, group of the class, word of the group. The end and the most
# frequent words have an output of their own in the order of their counts; the other words share the last class by their ending.
WIDTH, ENDING = 32, 3
OUTPUTS, SHARED = WIDTH ** 3, WIDTH ** 2
FIRST_SHARED = OUTPUTS - SHARED
OWN_WORDS = FIRST_SHARED - 1
END = 0
# Features of each softmax: the previous word (0), the word before it (1), both (2). Each hashes, with the class and group
# so far, to a row of WIDTH cells of one table. Most rows are met at few branches, so features that share a row seldom
# share a cell.
KINDS = ((0, 1, 2), (0, 1), (0, 1))
KIND_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
# Cells: at least CELLS_A_WORD times the distinct training words, a power of two between these.
CELLS_A_WORD, LEAST_BITS, MOST_BITS = 8, 12, 22
# Gradient rounds: the first over all training rows, each other over one of SLICES parts by a hash of the text. A step is
# shrunk by PRIOR counts a cell and divided by the word features that are active TOGETHER at every softmax.
ROUNDS, SLICES, PRIOR, TOGETHER = 3, 8, 4.0, 2
# Cells travel in blocks of this size.
BLOCK = 128
FLUSH_WORDS, CHUNK_WORDS, STEP_WORDS = 300_000, 300_000, 4_096


def tokens(text: str) -> list[bytes]:
    """Words in UTF-8; of letters only A-Z are lower-cased, and only the six ASCII white-space characters separate."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shared_output(word: bytes) -> int:
    return FIRST_SHARED + zlib.crc32(word[-ENDING:]) % SHARED


def word_hash(word: bytes) -> int:
    """Identity of a word as a feature, the same whether it is kept in the task or not; the end's is 0."""
    return zlib.crc32(word) + 1


def tree_path(out: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each softmax: the branch that an output takes, and the number of the node it branches at."""
    return [(out // WIDTH ** 2, np.zeros_like(out)), (out // WIDTH % WIDTH, 1 + out // WIDTH ** 2),
            (out % WIDTH, 1 + WIDTH + out // WIDTH)]


def cell_row(feature: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Row of cells of a feature at a node of the tree."""
    h = (feature ^ (node.astype(np.uint64) * np.uint64(MIX[1]))) * np.uint64(MIX[0])
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX[1])
    return (h >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Vocabulary:
    """Head words with log10(count + 1), feature hash and output; totals over the training tokens."""

    index: dict[bytes, int] = field(default_factory=dict)
    log_count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    output: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    tokens: int = 0
    distinct: int = 0
    end_count: int = 0
    shared_log: np.ndarray = field(default_factory=lambda: np.zeros(OUTPUTS))
    bias: np.ndarray = field(default_factory=lambda: np.zeros((1 + WIDTH + WIDTH ** 2, WIDTH), np.float32))

    def encode(self, texts: list[str]) -> dict:
        """Outputs of all tokens of the texts in a row, every text closed by the end token."""
        get, flat, tails, starts = self.index.get, [], [], [0]
        for k, text in enumerate(texts):
            words = tokens(text)
            ids = [get(w, -1) for w in words]
            if -1 in ids:
                base = len(flat)
                tails += [(base + j, k, words[j]) for j, i in enumerate(ids) if i < 0]
            flat += ids
            flat.append(-2)
            starts.append(len(flat))
        ids = np.asarray(flat, np.int64)
        known = np.flatnonzero(ids >= 0)
        out, hashes = np.full(len(ids), END, np.int64), np.zeros(len(ids), np.uint64)
        out[known], hashes[known] = self.output[ids[known]], self.hashes[ids[known]]
        for at, _, word in tails:
            out[at], hashes[at] = shared_output(word), word_hash(word)
        begin = np.asarray(starts[:-1], np.int64)
        before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])
        skip = np.concatenate([np.zeros(2, np.uint64), hashes[:-2]])[:len(out)]
        skip[begin] = 0
        pair = before * np.uint64(MIX[1]) + skip
        features = [(v + np.uint64(1)) * np.uint64(seed) for v, seed in zip((before, skip, pair), KIND_SEEDS, strict=True)]
        return {"ids": ids, "out": out, "features": features, "begin": begin, "tails": tails,
                "end": np.asarray(starts[1:], np.int64)}


def _chunks(ids, texts):
    """Runs of rows with a bounded number of characters; a long text is a run of its own."""
    rows, size = [], 0
    for row in zip(ids, texts, strict=True):
        rows.append(row)
        size += len(row[1])
        if size > 6 * CHUNK_WORDS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def count_words(train: DataFrame) -> DataFrame:
    """(word, n): counts of the training words; combined in the task first. ``train`` has the column text."""

    def count(batches):
        found: Counter = Counter()

        def rows():
            return pd.DataFrame({"word": list(found.keys()), "n": list(found.values())})

        for batch in batches:
            for text in batch["text"]:
                found.update(tokens(text))
                if len(found) > FLUSH_WORDS:
                    yield rows()
                    found.clear()
        yield rows()

    return train.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def build_vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    out = Vocabulary(tokens=(total["n"] or 0) + documents, distinct=total["v"] + (documents > 0), end_count=documents)
    # Smallest count for which the words of at least that count fit the bound, from a histogram of the counts.
    sizes = counts.groupBy(F.least(F.col("c"), F.lit(1 << 16)).alias("c")).agg(F.count("*").alias("n")).collect()
    least, words = (1 << 16) + 1, 0
    for row in sorted(sizes, key=lambda r: -r["c"]):
        if words + row["n"] > HEAD_WORDS:
            break
        words, least = words + row["n"], row["c"]
    head = counts.where(F.col("c") >= least)
    bound = max(HEAD_WORDS, OWN_WORDS)
    if words < OWN_WORDS:
        head = counts.orderBy(F.desc("c"), "word").limit(bound)
    found = head.select("word", "c").toArrow()
    words, often = found["word"].to_pylist(), found["c"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-often[i], words[i]))
    own = order[:OWN_WORDS]
    out.index = {words[i]: rank for rank, i in enumerate(order)}
    out.log_count = np.log10(1.0 + often[order])
    out.output = np.asarray([1 + rank if rank < OWN_WORDS else shared_output(words[i]) for rank, i in enumerate(order)], np.int64)
    out.hashes = np.asarray([word_hash(words[i]) for i in order], np.uint64)
    # Shared outputs: a word's part is (count + 1) / (their tokens + their words + 1).
    ending = (F.crc32(F.substring("word", -ENDING, ENDING)) % SHARED).cast("int") + FIRST_SHARED
    mass, used = np.zeros(OUTPUTS), np.zeros(OUTPUTS)
    for r in counts.groupBy(ending.alias("o")).agg(F.sum(F.col("c") + 1).alias("n"), F.sum("c").alias("c")).collect():
        mass[r["o"]], used[r["o"]] = r["n"], r["c"]
    for i in own:
        mass[shared_output(words[i])] -= 1 + often[i]
        used[shared_output(words[i])] -= often[i]
    out.shared_log = np.where(np.arange(OUTPUTS) >= FIRST_SHARED, np.log10(mass + 1), 0.0)
    # Unigram logs of every branch; half a count for each output in use, the shared ones are open to unseen words.
    used[FIRST_SHARED:] += 0.5
    used[END], used[1:len(own) + 1] = documents + 0.5, often[own] + 0.5
    for level in range(3):
        inner = used.reshape(WIDTH ** (level + 1), -1).sum(1).reshape(-1, WIDTH)
        at = (0, 1, 1 + WIDTH)[level]
        total = inner.sum(1, keepdims=True)
        part = np.divide(inner, total, out=np.full_like(inner, 1 / WIDTH), where=total > 0)
        out.bias[at:at + len(inner)] = np.log(np.maximum(part, 1e-13))
    return out


@dataclass
class Model:
    """Weights of the cells, as rows of WIDTH; ``bits`` of a hash name a row."""

    bits: int
    cells: np.ndarray

    @classmethod
    def empty(cls, distinct: int) -> "Model":
        bits = min(max(math.ceil(math.log2(max(CELLS_A_WORD * distinct, 1))), LEAST_BITS), MOST_BITS)
        bits -= int(math.log2(WIDTH))
        return cls(bits, np.zeros((1 << bits, WIDTH), np.float32))

    def branches(self, bias: np.ndarray, features: list, node: np.ndarray, level: int) -> tuple[list, np.ndarray]:
        """Rows of the active features, and the sums of weights of all branches of the node."""
        rows = [cell_row(features[k], node, self.bits) for k in KINDS[level]]
        logit = np.take(bias, node, axis=0)
        for r in rows:
            logit += np.take(self.cells, r, axis=0)
        return rows, logit

    def log_probabilities(self, bias: np.ndarray, features: list, out: np.ndarray) -> np.ndarray:
        """Natural log of each output after its features."""
        result, ones = np.zeros(len(out)), np.ones(WIDTH, np.float32)
        for i in range(0, len(out), STEP_WORDS):
            part = slice(i, i + STEP_WORDS)
            now = [v[part] for v in features]
            for level, (branch, node) in enumerate(tree_path(out[part])):
                logit = self.branches(bias, now, node, level)[1]
                result[part] += logit[np.arange(len(branch)), branch] - np.log(np.exp(logit) @ ones)
        return result


def add_gradient(model: Model, bias: np.ndarray, features: list, out: np.ndarray, draws: np.random.Generator,
                 observed: np.ndarray, expected: np.ndarray) -> None:
    """Count the cells that the tokens meet and those that the model expects.

    The expectation is unbiased: at each softmax one branch is drawn from the model's distribution in the context met.
    Both tables have the shape of the model's.
    """
    untrained = not model.cells.any()
    unigram = np.cumsum(np.exp(bias), axis=1) if untrained else None
    for i in range(0, len(out), CHUNK_WORDS):
        chunk = [], []
        for j in range(i, min(i + CHUNK_WORDS, len(out)), STEP_WORDS):
            part = slice(j, min(j + STEP_WORDS, i + CHUNK_WORDS))
            now = [v[part] for v in features]
            for level, (branch, node) in enumerate(tree_path(out[part])):
                if untrained:
                    rows, reach = [cell_row(now[k], node, model.bits) for k in KINDS[level]], np.take(unigram, node, axis=0)
                else:
                    rows, logit = model.branches(bias, now, node, level)
                    reach = np.cumsum(np.exp(logit, out=logit), axis=1, out=logit)
                drawn = (reach < (draws.random(len(branch), np.float32) * reach[:, -1])[:, None]) @ np.ones(WIDTH, np.float32)
                drawn = np.minimum(drawn.astype(np.int64), WIDTH - 1)
                for r in rows:
                    chunk[0].append(r * WIDTH + branch)
                    chunk[1].append(r * WIDTH + drawn)
        for table, met in zip((observed, expected), chunk, strict=True):
            table += np.bincount(np.concatenate(met), minlength=table.size).reshape(table.shape).astype(np.int32)


def step_of(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Change of the weights: the gap of observed and expected counts on a log scale, shrunk by the prior counts."""
    return (np.log((observed + PRIOR) / (expected + PRIOR)) / TOGETHER).astype(np.float32)


def pack(counts: np.ndarray) -> list[bytes]:
    """Each row of counts as its lowest bytes, then its second ones and so on: small counts leave runs of zeros, which
    the shuffle's compression removes."""
    planes = np.ascontiguousarray(counts, "<i4").view(np.uint8).reshape(len(counts), -1, 4).transpose(0, 2, 1)
    return [r.tobytes() for r in planes]


def unpack(cells: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(4, -1).T).view("<i4")[:, 0]


def gradient_blocks(train: DataFrame, vocabulary: Vocabulary, model: Model, turn: int) -> DataFrame:
    """(block, cells): observed and expected counts of each block of cells that a task met."""

    def gather(batches):
        context = TaskContext.get()
        draws = np.random.default_rng([turn, context.partitionId() if context else 0])
        observed, expected = np.zeros(model.cells.shape, np.int32), np.zeros(model.cells.shape, np.int32)
        for batch in batches:
            for rows in _chunks(range(len(batch)), batch["text"]):
                e = vocabulary.encode([t for _, t in rows])
                add_gradient(model, vocabulary.bias, e["features"], e["out"], draws, observed, expected)
        o, x = observed.reshape(-1, BLOCK), expected.reshape(-1, BLOCK)
        met = np.flatnonzero(o.any(1) | x.any(1))
        for i in range(0, len(met), 2_048):
            part = met[i:i + 2_048]
            both = np.concatenate([o[part], x[part]], 1)
            yield pd.DataFrame({"block": part, "cells": pack(both)})

    return train.select("text").mapInPandas(gather, "block int, cells binary")


def steps(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, step): sums of a block over all tasks, taken as a stream, so a task holds its share of the table only."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch["block"], batch["cells"], strict=True):
                row = unpack(cells)
                if block in sums:
                    sums[block] += row
                else:
                    sums[block] = row.astype(np.int64)
        keys = list(sums)
        for i in range(0, len(keys), 2_048):
            part = keys[i:i + 2_048]
            yield pd.DataFrame({"block": part, "step": [step_of(sums[k][:BLOCK], sums[k][BLOCK:]).tobytes() for k in part]})

    return blocks.repartition(parts, "block").mapInPandas(add, "block int, step binary")


def train_model(train: DataFrame, vocabulary: Vocabulary) -> Model:
    """Distributed gradient updates: tasks add up observed and expected counts of the cells under the current weights,
    the sums meet by block, and the driver adds the steps to the table, whose size MOST_BITS bounds.

    The first round takes every training row; each later one the rows of one of SLICES parts.
    """
    model = Model.empty(vocabulary.distinct)
    rows = train.select("text", F.pmod(F.xxhash64("text"), F.lit(SLICES)).alias("slice"))
    parts = shuffle_parts(train.sparkSession)
    for turn in range(ROUNDS if vocabulary.tokens else 0):
        chosen = rows if turn == 0 else rows.where(F.col("slice") == (turn - 1) % SLICES)
        found = steps(gradient_blocks(chosen, vocabulary, model, turn), parts).toArrow()
        cells = model.cells.reshape(-1, BLOCK).copy()
        if found.num_rows:
            cells[found["block"].to_numpy()] += np.frombuffer(b"".join(found["step"].to_pylist()), np.float32).reshape(-1, BLOCK)
        model = Model(model.bits, cells.reshape(-1, WIDTH))
    return model


PART_SCHEMA = "rid long, word binary, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_model double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """Score every whole text; documents whose crc32(id) mod ``folds`` is ``held_out`` are not learnt from.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10 of the
    text's probability.  The model gives the next token's output from the two before it; a word that shares an
    output has its part of it by add-one counts, so the probabilities of all words, unseen ones together as one,
    sum to one.  Features are of the words themselves, rare ones too; their table grows with the distinct training
    words up to 2 ** MOST_BITS cells, the own outputs with the words up to OWN_WORDS.

    A null text counts as empty and is the end token alone.  Equal rows are scored alike, each as a row; a null
    id is kept.  Without training rows base_score is 0.  Other input columns are ignored; an empty table stays empty.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"),
                       (id_fold(id_col, folds) == held_out).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = materialise(count_words(train))
    vocabulary = build_vocabulary(counts, train.select("doc_id").count())
    model = train_model(train, vocabulary)

    def score(batches):
        for batch in batches:
            held = batch["held_out"].to_numpy()
            docs_, rids = batch["doc_id"], batch["rid"].to_numpy()
            for part in _chunks(range(len(batch)), batch["text"]):
                e = vocabulary.encode([t for _, t in part])
                at = np.asarray([i for i, _ in part])
                value = model.log_probabilities(vocabulary.bias, e["features"], e["out"]) / math.log(10)
                value -= vocabulary.shared_log[e["out"]]
                head = e["ids"] >= 0
                log_count = np.zeros(len(head))
                log_count[head] = vocabulary.log_count[e["ids"][head]]
                value += np.where(e["out"] >= FIRST_SHARED, log_count, 0.0)
                yield pd.DataFrame({
                    "rid": rids[at], "word": None, "doc_id": docs_.iloc[at].astype("Int64").to_numpy(), "held_out": held[at],
                    "n_tokens": e["end"] - e["begin"], "head_known": np.add.reduceat(head.astype(np.int64), e["begin"]),
                    "head_base": np.add.reduceat(log_count, e["begin"]), "head_model": np.add.reduceat(value, e["begin"])})
                if e["tails"]:
                    yield pd.DataFrame({"rid": rids[at[[k for _, k, _ in e["tails"]]]], "word": [w for _, _, w in e["tails"]]}) \
                        .reindex(columns=["rid", "word", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_model"])

    parts = materialise(rows.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(score, PART_SCHEMA))
    # A word that no training text has counts 0 and adds log10(1) to either score.
    tails = parts.where(F.col("word").isNotNull()).select("rid", "word").join(counts, "word") \
        .groupBy("rid").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("c") + 1)).alias("_log"))
    known, extra = F.coalesce("_known", F.lit(0)), F.coalesce("_log", F.lit(0.0))
    size = float(np.log10(vocabulary.tokens + vocabulary.distinct + 1))
    end_known, end_log = int(vocabulary.end_count > 0), float(np.log10(vocabulary.end_count + 1))
    return parts.where(F.col("word").isNull()).join(tails, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + known + end_known).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + extra + end_log - F.col("n_tokens") * size).alias("base_score"),
        (F.col("head_model") + extra).alias("score"))
