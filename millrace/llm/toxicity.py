"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language."""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import col, id_fold

# Hashed embedding table, filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 12
SLOTS = sum(WIDTHS)
# Bounds of the labelled sample that the classifier is fitted on: documents of each class, bytes of one text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_TEXT_BYTES = 1_500, 3_500, 60_000
EPOCHS, BATCH, RATE, DECAY = 7, 64, 0.08, 1e-5
PREDICT_FROM = 0.7
# Words remembered by a Python worker.
TABLE_WORDS = 160_000

#: Frequent short words by which a text's language is guessed.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as"),
    "fr": ("le", "la", "les", "des", "et", "du", "un", "une", "qui", "que", "dans", "pour"),
    "de": ("der", "die", "und", "das", "den", "von", "ist", "nicht", "mit", "ein", "zu", "sich"),
    "es": ("el", "los", "las", "del", "y", "una", "por", "con", "para", "su", "lo", "se"),
}
LANGUAGES = tuple(STOP_WORDS)
_VOTE = {w: i for i, words in reversed(list(enumerate(STOP_WORDS.values()))) for w in words}
_words = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def features(word: str) -> list[int]:
    """Hash buckets of a word: itself and its beginnings, so that inflected and compound forms share weights."""
    raw, n = word.encode(), len(word)
    return [zlib.crc32(raw) % BUCKETS, *[zlib.crc32(raw[:k], k) % BUCKETS if n >= k else BUCKETS for k in (4, 5, 7)]]


class Network:
    """Embeddings -> filters of several widths -> largest response per filter -> logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        # The last row stands for an absent feature and stays zero.
        self.table = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
        self.table[BUCKETS] = 0
        self.filters = (rng.standard_normal((DIM, SLOTS * FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.shift = np.float32(-1.0)
        self.cuts = dict.fromkeys((*LANGUAGES, "other"), 0.0)

    def project(self, feats: np.ndarray) -> np.ndarray:
        """Filter responses of single words, one block of FILTERS columns per width and place in the window."""
        # In double precision, so that rounding does not depend on the words projected together.
        return (self.table[feats].sum(1).astype(np.float64) @ self.filters.astype(np.float64)).astype(np.float32)

    def responses(self, projected: np.ndarray) -> np.ndarray:
        """(words, widths x filters): response of the window that starts at each word."""
        n, out, slot = len(projected), [], 0
        for width in WIDTHS:
            total = projected[:, slot * FILTERS:(slot + 1) * FILTERS].copy()
            for j in range(1, width):
                s = (slot + j) * FILTERS
                total[:n - j] += projected[j:, s:s + FILTERS]
            out.append(total)
            slot += width
        return np.concatenate(out, 1)

    def logits(self, peaks: np.ndarray) -> np.ndarray:
        return np.round((np.maximum(peaks + self.bias, 0) * self.out).sum(1, dtype=np.float64) + float(self.shift), 5)


def _ragged(ids: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of several texts one after the other, each followed by padding.

    Windows that start in the padding belong to no text; their responses are set to 0, that of a text without words.
    """
    gap = np.full(max(WIDTHS) - 1, pad)
    parts = [p for i in ids for p in (i, gap)]
    lengths = np.asarray([len(i) + len(gap) for i in ids])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)[:-1]])


def train(texts: list[str], labels: list[int], weights: list[float], seed: int = 7) -> Network:
    """Fit by stochastic gradients; every fourth text only sets the thresholds of the languages."""
    net, rng = Network(seed), np.random.default_rng(seed)
    # A text without words is clean; a few of them keep it so.
    blank = len(texts) // 40 + 1 if any(labels) else 0
    texts, labels, weights = [*texts, *[""] * blank], [*labels, *[0] * blank], [*weights, *[0.0] * blank]
    vocabulary: dict[str, int] = {}
    ids = [np.asarray([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    feats = np.asarray([features(w) for w in vocabulary] + [[BUCKETS] * 4], np.int64)
    pad = len(vocabulary)
    y = np.asarray(labels, np.float32)
    fit = np.flatnonzero(np.arange(len(texts)) % 4 != 3)
    if len(set(y[fit].tolist())) < 2:
        net.out[:] = 0
        net.shift = np.float32(-6.0 if not y.any() else 6.0)
        return net
    acc = {k: np.full(v.shape, 1e-6, np.float32) for k, v in (("table", net.table), ("filters", net.filters), ("bias", net.bias), ("out", net.out))}
    acc_shift = 1e-6
    lengths = np.asarray([len(i) for i in ids])
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        # Texts of similar length share a batch; the batches come in random order.
        order = fit[np.lexsort((rng.random(len(fit)), lengths[fit] // 64))]
        batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            rows = batches[b]
            flat, starts = _ragged([ids[i] for i in rows], pad)
            used, inverse = np.unique(flat, return_inverse=True)
            embedded = net.table[feats[used]].sum(1)
            answers = net.responses((embedded @ net.filters)[inverse])
            answers[flat == pad] = 0
            ends = np.append(starts[1:], len(flat))
            at = np.stack([s + answers[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
            peaks = np.take_along_axis(answers, at, 0) + net.bias
            hidden = np.maximum(peaks, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.shift, -30, 30)))
            error = (p - y[rows]) / len(rows)
            g_hidden = np.outer(error, net.out) * (peaks > 0)
            g_words = g_hidden * (flat[at] != pad)
            grads = {"out": hidden.T @ error + DECAY * net.out, "bias": g_hidden.sum(0)}
            g_shift = float(error.sum())
            g_filters = np.zeros_like(net.filters)
            touched, changes, slot = [], [], 0
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(width):
                    place = np.minimum(at[:, own] + j, len(flat) - 1)
                    word = inverse[place]
                    columns = np.arange((slot + j) * FILTERS, (slot + j + 1) * FILTERS)
                    g = g_words[:, own]
                    g_filters[:, columns] += np.einsum("bf,bfd->df", g, embedded[word])
                    touched.append(word.ravel())
                    changes.append((g[:, :, None] * net.filters[:, columns].T[None]).reshape(-1, DIM))
                slot += width
            word_grad = np.zeros((len(used), DIM), np.float32)
            np.add.at(word_grad, np.concatenate(touched), np.concatenate(changes))
            hit = np.flatnonzero(np.abs(word_grad).sum(1))
            target = feats[used[hit]]
            rows_, back = np.unique(target.ravel(), return_inverse=True)
            g_table = np.zeros((len(rows_), DIM), np.float32)
            np.add.at(g_table, back, np.repeat(word_grad[hit], target.shape[1], 0))
            real = rows_ != BUCKETS
            acc["table"][rows_[real]] += g_table[real] ** 2
            net.table[rows_[real]] -= rate * g_table[real] / np.sqrt(acc["table"][rows_[real]])
            grads["filters"] = g_filters + DECAY * net.filters
            for name, g in grads.items():
                acc[name] += g ** 2
                setattr(net, name, (getattr(net, name) - rate * g / np.sqrt(acc[name])).astype(np.float32))
            acc_shift += g_shift ** 2
            net.shift = np.float32(net.shift - rate * g_shift / np.sqrt(acc_shift))
    _calibrate(net, texts, y, np.asarray(weights))
    return net


def _calibrate(net: Network, texts: list[str], y: np.ndarray, weights: np.ndarray) -> None:
    """Per language the logit above which the weighted F1 is largest, on texts without gradients."""
    held = [i for i in range(len(texts)) if i % 4 == 3]
    scorer = Scorer(net)
    logits, languages = scorer.logits([texts[i] for i in held])
    y, w = y[held], weights[held]

    def best(rows):
        if not len(rows) or not y[rows].any():
            return None
        order = rows[np.argsort(-logits[rows])]
        good = np.cumsum(w[order] * y[order])
        f1 = 2 * good / (np.cumsum(w[order]) + (w[order] * y[order]).sum())
        k = int(f1.argmax())
        after = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
        return float((logits[order[k]] + after) / 2)

    every = best(np.arange(len(held)))
    every = 0.0 if every is None else every
    blank = float(net.logits(np.zeros((1, len(net.bias)), np.float32))[0])
    for i, name in enumerate((*LANGUAGES, "other")):
        rows = np.flatnonzero(languages == i)
        cut = best(rows) if y[rows].sum() >= 10 else None
        net.cuts[name] = every if cut is None else cut
        if name == "other":
            # Texts without a known word of any language say nothing.
            net.cuts[name] = max(net.cuts[name], blank + 2)


class Scorer:
    """Scores texts with a table of words met so far, started afresh when it is full."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.rows = {"": 0}
        self.projected = np.zeros((TABLE_WORDS + 1, SLOTS * FILTERS), np.float32)
        self.votes = np.zeros((TABLE_WORDS + 1, len(LANGUAGES)), np.int32)

    def _ids(self, words: list[str]) -> np.ndarray:
        get = self.rows.get
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            new = list(dict.fromkeys(w for w, i in zip(words, ids, strict=True) if i < 0))
            first = len(self.rows)
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
            self.projected[first:first + len(new)] = self.net.project(np.asarray([features(w) for w in new]))
            for i, w in enumerate(new, first):
                if w in _VOTE:
                    self.votes[i, _VOTE[w]] = 1
            ids = [self.rows[w] for w in words]
        return np.asarray(ids, np.int64)

    def _part(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Peaks and language votes of a run of words, followed by padding."""
        peaks, votes = None, 0
        step, overlap = TABLE_WORDS // 4, max(WIDTHS) - 1
        for at in range(0, max(1, len(words)), step):
            part = words[at:at + step + overlap]
            if len(self.rows) + len(part) > TABLE_WORDS:
                self.reset()
            flat = np.concatenate([self._ids(part), np.zeros(overlap, np.int64)])
            # The padding at the end counts as a response of 0, as in the runs of short texts.
            top = self.net.responses(self.projected[flat]).max(0)
            peaks = top if peaks is None else np.maximum(peaks, top)
            votes = votes + self.votes[flat[:step]].sum(0)
        return peaks, votes

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language number) of every whole text."""
        peaks, votes, pending, size = [], [], [], 0

        def flush():
            nonlocal pending, size
            if pending:
                flat, starts = _ragged([self._ids(w) for w in pending], 0)
                answers = self.net.responses(self.projected[flat])
                answers[flat == 0] = 0
                peaks.append(np.maximum.reduceat(answers, starts, 0))
                votes.append(np.add.reduceat(self.votes[flat], starts, 0))
            pending, size = [], 0

        for text in texts:
            words = words_of(text)
            if len(words) > TABLE_WORDS // 4:
                flush()
                top, vote = self._part(words)
                peaks.append(top[None])
                votes.append(np.asarray(vote)[None])
                continue
            if size + len(words) > TABLE_WORDS // 4:
                flush()
            if len(self.rows) + size + len(words) > TABLE_WORDS:
                flush()
                self.reset()
            pending.append(words)
            size += len(words)
        flush()
        if not peaks:
            return np.zeros(0), np.zeros(0, int)
        votes_ = np.concatenate(votes)
        return self.net.logits(np.concatenate(peaks)).astype(float), np.where(votes_.max(1) > 0, votes_.argmax(1), len(LANGUAGES))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability-like score; the language's threshold lies at 0.7."""
        logits, languages = self.logits(texts)
        cuts = np.asarray([self.net.cuts[n] for n in (*LANGUAGES, "other")])
        base = np.log(PREDICT_FROM / (1 - PREDICT_FROM))
        return 1 / (1 + np.exp(-np.clip(logits - cuts[languages] + base, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", folds: int = 3, held_out: int = 1) -> list[tuple[str, int, float]]:
    """(text, label, weight) of a bounded sample of labelled rows outside the held-out fold, chosen by hash of the id.

    A document labelled more than once counts as toxic if any row says so.  Only ids are sampled first, so the
    documents are read once and no text moves but the sample's.
    """
    own = labels.where(col(id_col).isNotNull() & col(label_col).isNotNull() & (id_fold(id_col, folds) != held_out)) \
        .groupBy(col(id_col).alias("_id")).agg(F.max(col(label_col)).cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in own.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = {1: min(1.0, SAMPLE_TOXIC / max(1, n.get(1, 0))), 0: min(1.0, SAMPLE_CLEAN / max(1, n.get(0, 0)))}
    # At most about 7,000 ids by the shares above.
    chosen = own.where(draw < F.when(F.col("_y") == 1, share[1]).otherwise(share[0])).select("_id", "_y")
    rows = docs.where(F.coalesce(F.octet_length(col(text_col)), F.lit(0)) <= SAMPLE_TEXT_BYTES) \
        .select(col(id_col).alias("_id"), F.coalesce(col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "_id") \
        .dropDuplicates(["_id"]).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"]))
    return [(r["t"], r["_y"], 1 / share[r["_y"]]) for r in rows]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", carry: list[str] | None = None) -> DataFrame:
    """Add held_out, score and predicted to every row.

    Ids whose crc32 mod 3 is 1 are held out: their labels are not used.  Scores depend on the text alone; the
    language whose threshold applies is guessed from the text.  Null and empty texts get the score of a text
    without words.  Without labels of both classes every score is near 0 (or 1, if all are toxic).  Repeated rows are
    scored alike; input columns named like a result column are replaced; an empty table stays empty.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("held_out", "score", "predicted")]
    sample = labelled_sample(docs, labels, id_col, text_col, label_col)
    net = train([t for t, _, _ in sample], [y for _, y, _ in sample], [w for _, _, w in sample])
    scorers: list[Scorer] = []

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if not scorers:
                scorers.append(Scorer(net))
            yield pd.Series(scorers[0].scores(texts.tolist()), dtype="float64")

    out = docs.select(*[col(c) for c in names], (id_fold(id_col, 3) == 1).alias("held_out"),
                      score(F.coalesce(col(text_col), F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
