"""Packing token sequences: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.values import scalar_array
from .common import col, materialise

WINDOW, END_ID = 4096, 2
# Words, and pieces of words, that a Python worker remembers twice over: the latest and as many before them.
WORD_CACHE = 220_000
# Pieces of one length that are numbered in one task.
RANK_ROWS = 2_000
# Combinations offered to the least squares problem, and its sweeps.
MAX_COMBINATIONS, SWEEPS = 30_000, 300

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if printable, else the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Token ids of a word without white space, as little-endian 32-bit bytes.

    The tokenizer splits at white space before anything else, so a text's ids are those of its words in a row.
    Words of Latin letters are cut into the tokenizer's pieces here, and each distinct piece goes through its merges
    once.  Of the words met, the last WORD_CACHE and as many before them are remembered.
    """

    plain = re.compile("[!-~\xa1-ɏ]*")
    #: The pre-tokenizer's pattern, fixed by the tokenizer file.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.find = Tokenizer.from_file(path), regex.compile(self.pattern).findall
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.before: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pieces_before: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        known = self.pieces_before.get(piece)
        if known is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.merge(letters)]
            known = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.pieces) > WORD_CACHE:
            self.pieces_before, self.pieces = self.pieces, {}
        self.pieces[piece] = known
        return known

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if self.plain.fullmatch(word):
                low = word.lower()
                if low.isalpha():
                    ids = self.pieces.get(low) or self.piece(low)
                else:
                    ids = b"".join([self.pieces.get(p) or self.piece(p) for p in self.find(low)])
            else:
                ids = self.encode(word)
        if len(self) > WORD_CACHE:
            self.before = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        # Special tokens are found in the whole text.
        if "<|" in text:
            return self.encode(text)
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


_WORDS: dict[str, WordIds] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every text once, end it with id 2 and cut it into pieces of 4,096 ids and a shorter rest."""

    def cut(batches):
        words = _WORDS.get(tokenizer)
        if words is None:
            words = _WORDS[tokenizer] = WordIds(tokenizer)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = memoryview(words.text(text) + end)
                total = len(ids) // 4
                for start in range(0, total, WINDOW):
                    part = ids[4 * start:4 * (start + WINDOW)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
            yield frame

    rows = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, PIECE_SCHEMA)


def combinations(counts: np.ndarray) -> list[tuple[int, ...]]:
    """Up to three lengths that fill a window exactly; pairs first, then triples of frequent lengths."""
    present = np.flatnonzero(counts[:WINDOW])
    out = [(WINDOW,)] if counts[WINDOW] else []
    out += [(int(a), WINDOW - int(a)) for a in present if a <= WINDOW // 2 and counts[WINDOW - a]]
    # For every length the partners of largest count, whose complement is present.
    common = present[np.argsort(-counts[present], kind="stable")][:256]
    triples: dict[tuple[int, ...], int] = {}
    for a in present:
        rest = WINDOW - int(a) - common
        ok = rest > 0
        ok[ok] &= counts[rest[ok]] > 0
        for b, c in list(zip(common[ok], rest[ok], strict=True))[:12]:
            key = tuple(sorted((int(a), int(b), int(c))))
            triples[key] = int(min(counts[list(key)]))
    best = sorted(triples, key=lambda k: (-triples[k], k))[:max(0, MAX_COMBINATIONS - len(out))]
    return out + best


def repeat_counts(combos: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, where A counts the lengths of each combination.

    Projected gradient steps with momentum; the step is bounded by the largest row and column sums of A.
    """
    if not combos:
        return np.zeros(0)
    member = np.concatenate([np.asarray(c) for c in combos])
    owner = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    step = 1.0 / (np.bincount(member).max() * np.bincount(owner).max())
    x = np.zeros(len(combos))
    ahead, t = x.copy(), 1.0
    for _ in range(SWEEPS):
        off = np.bincount(member, ahead[owner], len(counts)) - counts
        new = np.maximum(0.0, ahead - step * np.bincount(owner, off[member], len(combos)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan_sequences(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of every kind of sequence; together they use every counted piece exactly once."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[int, tuple[int, ...]]] = []

    def take(lengths: tuple[int, ...], most: int) -> None:
        kinds, each = np.unique(lengths, return_counts=True)
        n = int(min(most, (left[kinds] // each).min()))
        if n > 0:
            left[kinds] -= n * each
            plan.append((n, lengths))

    combos = combinations(counts)
    x = repeat_counts(combos, counts)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        take(combos[j], int(round(x[j])))
    # What rounding and shallow combinations leave: longest first, filled up with the longest that fit.
    while left.any():
        present = np.flatnonzero(left)
        lengths, room, used = [], WINDOW, {}
        while room > 0:
            fit = present[present <= room]
            fit = [int(v) for v in fit[::-1][:64] if left[v] > used.get(int(v), 0)]
            if not fit:
                low = [int(v) for v in present[present <= room] if left[v] > used.get(int(v), 0)]
                if not low:
                    break
                fit = [low[-1]]
            lengths.append(fit[0])
            used[fit[0]] = used.get(fit[0], 0) + 1
            room -= fit[0]
        take(tuple(lengths), int(left.max()))
    return plan


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of all texts into sequences of at most 4,096 ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.  The driver
    sees only the histogram of piece lengths (4,096 numbers) and the kinds of sequences; pieces are numbered
    within their length in groups of bounded size, and a number decides sequence and offset.

    A null or empty text is the single id 2.  Equal rows are packed separately.  A null id stays null.  Other
    input columns are ignored.  An empty table gives an empty table.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, id_col, text_col))
    counts = np.zeros(WINDOW + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = plan_sequences(counts)
    starts, firsts, places, repeats, taken, base = [], [], [], [], np.zeros(WINDOW + 1, np.int64), 0
    for n, lengths in plan:
        at = 0
        for length, each in zip(*(v.tolist() for v in np.unique(lengths, return_counts=True)), strict=True):
            starts.append((length << 40) + int(taken[length]))
            firsts.append(base)
            places.append(at)
            repeats.append(each)
            taken[length] += n * each
            at += length * each
        base += n
    order = np.argsort(np.asarray(starts, np.int64), kind="stable")
    slots = [np.asarray(v, np.int64)[order] for v in (starts, firsts, places, repeats)]

    groups = scalar_array([max(1, -(-int(c) // RANK_ROWS)) for c in counts], "int")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()),
                                               F.element_at(groups, (F.col("length") + 1).cast("int"))).cast("int"))
    # The numbering is written down, so that a lost task cannot change it.
    numbered = materialise(salted.withColumn("_rank", F.row_number().over(
        Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")) - 1))
    sizes = numbered.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
    ranked = numbered.join(before.drop("_n"), ["length", "_salt"]) \
        .withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")

    def place(batches):
        start, first, at, each = slots
        for batch in batches:
            key = (batch["length"].to_numpy(np.int64) << 40) + batch["_rank"].to_numpy(np.int64)
            slot = np.searchsorted(start, key, "right") - 1
            k = key - start[slot]
            batch["sequence_id"] = first[slot] + k // each[slot]
            batch["offset"] = at[slot] + (k % each[slot]) * batch["length"].to_numpy(np.int64)
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return ranked.mapInPandas(place, PIECE_SCHEMA + ", sequence_id long, offset long")
