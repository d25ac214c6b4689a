"""Byte-level BPE by speculation: longest matches are proposed, adjacent pairs are checked, failing words are merged.

A sequence of tokens is what the merges give exactly if every adjacent pair of it is: merges inside a token never see
its neighbour unless a merge across the seam comes first.  So a word is first cut by greedy longest match, all
seams of all new words are checked together, and only words with a seam that merges would cross are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import col
from .packing import byte_letters

# Pieces of text no token reaches beyond: words of plain letters before a common mark, else white space and what follows it.
CHUNK = re.compile(r" ?[A-Za-z]++(?=[\s.,;:!?)])|\s*\S+|\s+")
# The pre-tokenizer's words in ASCII text (the pattern is fixed by the tokenizer's kind).
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
# Longest word whose merges are found by scanning.
SHORT = 64
# Bytes of text worked on at once, and bytes of remembered chunks and their values before a worker starts anew.
SLICE_BYTES, MEMO_BYTES = 1_000_000, 90_000_000
NEVER = np.int64(1) << 40


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[start:start + length] in a row."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Ragged:
    """Growing list of number arrays in one buffer."""

    def __init__(self, dtype):
        self.flat, self.size = np.zeros(1024, dtype), 0
        self.starts, self.lengths, self.count = np.zeros(256, np.int64), np.zeros(256, np.int64), 0

    @staticmethod
    def _room(held: np.ndarray, size: int) -> np.ndarray:
        return held if size <= len(held) else np.concatenate([held, np.zeros(max(size, len(held)), held.dtype)])

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.size + len(flat))
        self.flat[self.size:self.size + len(flat)] = flat
        self.starts, self.lengths = (self._room(v, self.count + len(lengths)) for v in (self.starts, self.lengths))
        new = slice(self.count, self.count + len(lengths))
        self.lengths[new] = lengths
        self.starts[new] = self.size + np.cumsum(lengths) - lengths
        self.size += len(flat)
        self.count += len(lengths)

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[slots]
        return gather(self.flat, self.starts[slots], lengths), lengths


def read_tokenizer(path: str) -> tuple[dict, list[bytes]]:
    """The tokenizer file and the bytes of every id; raises for any other kind than plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    fits = (model["type"] == "BPE" and not spec["normalizer"] and not model.get("dropout") and not model.get("ignore_merges")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added))
    if not fits:
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    back = {c: b for b, c in byte_letters().items()}
    tokens = [*model["vocab"].items(), *[(t["content"], t["id"]) for t in added]]
    bytes_of = [b""] * (max(i for _, i in tokens) + 1)
    for token, i in tokens:
        known = all(c in back for c in token)
        bytes_of[i] = bytes(back[c] for c in token) if known else token.encode()
    return spec, bytes_of


class ByteBpe:
    """Token ids of a byte-level BPE tokenizer file, without normalisation or dropout."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec, self.bytes_of = read_tokenizer(path)
        model, added, size = spec["model"], spec["added_tokens"], len(self.bytes_of)
        self.words_of = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        letters = byte_letters()
        self.back = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        #: Rank and result of a pair's merge, in one number.
        self.merge: dict[tuple[int, int], int] = {}
        sound = True
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made, a, b = vocab[a + b], vocab[a], vocab[b]
            sound &= self.rank[made] < 0 and (a, b) not in self.merge
            self.merge[a, b] = r << 32 | made
            self.left[made], self.right[made], self.rank[made] = a, b, r
        keys = np.array([a << 32 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], np.fromiter(self.merge.values(), np.int64, len(self.merge))[order] >> 32
        #: Tokens that may be proposed: those whose own bytes merge into them.
        self.proposals: dict[bytes, int] = {}
        #: Length of the longest one by its first three bytes; where none has them, two bytes at most.
        self.longest: dict[bytes, int] = {}
        if sound:
            self._collect_proposals()

    def _collect_proposals(self) -> None:
        made = np.flatnonzero(self.rank >= 0)
        whole = self.seams_hold(self.left[made], self.right[made], self.rank[made])
        good = np.zeros(len(self.rank), bool)
        good[self.byte_ids] = True
        for t, ok in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            good[t] = ok and good[self.left[t]] and good[self.right[t]]
        for t in np.flatnonzero(good).tolist():
            token = self.bytes_of[t]
            self.proposals[token] = t
            self.longest[token[:3]] = max(self.longest.get(token[:3], 2), len(token))

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(a), NEVER)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)

    def seams_hold(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For pairs of tokens: True where no merge before ``limit`` crosses the seam between them.

        Seen backwards in time, the parts beside the seam are a's right spine and b's left spine.  Two of them meet
        between their own making and the earlier of the merges that swallow them; a merge of the two in that time crosses
        the seam.  Equal merges go from left to right, so one that swallows the left part comes first and one that
        swallows the right part comes later.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        until_a = np.full(len(a), NEVER) if limit is None else np.array(limit, np.int64)
        until_b = until_a.copy()
        holds, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            m = self._pair_rank(x, y)
            crossed = (m < until_a[live]) & (m <= until_b[live]) & (m < NEVER)
            holds[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            undo_a = rx > ry
            left, right = live[undo_a], live[~undo_a]
            until_a[left], a[left] = rx[undo_a], self.right[x[undo_a]]
            until_b[right], b[right] = ry[~undo_a], self.left[y[~undo_a]]
        return holds

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        at, n, out, find, longest = 0, len(word), [], self.proposals.get, self.longest.get
        while at < n:
            for end in range(min(n, at + longest(word[at:at + 3], 2)), at, -1):
                t = find(word[at:end])
                if t is not None:
                    break
            out.append(t)
            at = end
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merges in their order, the leftmost of equal ones first."""
        ids = [self.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        none, find = int(NEVER) << 32, self.merge.get
        offers = [find(pair, none) for pair in zip(ids, ids[1:])]
        while offers:
            best = min(offers)
            if best == none:
                break
            i = offers.index(best)
            ids[i:i + 2] = [best & 0xFFFFFFFF]
            del offers[i]
            if i:
                offers[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(offers):
                offers[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, find = len(ids), self.merge.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := find((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (found >> 32, i, ids[i], ids[j], found & 0xFFFFFFFF))

        for i in range(n):
            offer(i)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i] if ids[i] == x else -1
            if j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of every word, and how many of the words had to be merged step by step."""
        if not self.proposals:
            return [self.merge_exactly(w) for w in words], len(words)
        out = [self.propose(w) for w in words]
        flat, lengths = flat_ids(out)
        ends = np.cumsum(lengths)
        seam = np.ones(len(flat), bool)
        seam[ends[lengths > 0] - 1] = False
        seam = np.flatnonzero(seam)
        key, which = np.unique(flat[seam] << 32 | flat[seam + 1], return_inverse=True)
        bad = seam[~self.seams_hold(key >> 32, key & 0xFFFFFFFF)[which]]
        failing = np.unique(np.searchsorted(ends, bad, "right"))
        for i in failing.tolist():
            out[i] = self.merge_exactly(words[i])
        return out, len(failing)

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk that merges stay inside of."""
        if chunk.isascii():
            return [w.encode() for w in ASCII_WORDS.findall(chunk)]
        back = self.back
        return [bytes([back[c] for c in w]) for w, _ in self.words_of(chunk)]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of every chunk of text; equal words of the chunks are encoded once."""
        numbers: dict[bytes, int] = {}
        parts = [[numbers.setdefault(w, len(numbers)) for w in self.words(chunk)] for chunk in chunks]
        words, _ = self.encode_words(list(numbers))
        return [words[p[0]] if len(p) == 1 else [t for i in p for t in words[i]] for p in parts]


def flat_ids(ids: list[list[int]], dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and how many each list has."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype, int(lengths.sum())), lengths


class ChunkMemo:
    """Number arrays of the chunks a worker has met, of bounded size.

    ``compute`` takes new chunks and yields them in parts: (chunks, {field: (all numbers, numbers per chunk)}).
    """

    def __init__(self, fields: dict[str, type], compute, most: int | None = None):
        self.fields, self.compute, self.most = fields, compute, MEMO_BYTES if most is None else most
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.values = {name: Ragged(dtype) for name, dtype in self.fields.items()}
        self.held = 0

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """Slot of every chunk; new ones are computed together."""
        if self.held > self.most:
            self._reset()
        slots = self.slots
        new = [c for c in dict.fromkeys(chunks) if c not in slots]
        if new:
            for part, fields in self.compute(new):
                first = len(slots)
                for name, (flat, lengths) in fields.items():
                    self.values[name].extend(flat, lengths)
                    self.held += flat.nbytes + 16 * len(lengths)
                slots.update(zip(part, range(first, first + len(part)), strict=True))
            self.held += sum(map(len, new)) + 150 * len(new)
        return np.fromiter(map(slots.__getitem__, chunks), np.int64, len(chunks))


def slices(texts: pa.Array):
    """(start, texts) of ranges of rows of about SLICE_BYTES, or one row."""
    reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(reach, (reach[start - 1] if start else 0) + SLICE_BYTES, "right"))
        end = min(max(end, start + 1), len(texts))
        yield start, texts.slice(start, end - start).to_pylist()
        start = end


_WORKER: dict[str, tuple[ByteBpe, ChunkMemo]] = {}


def _encoder(path: str) -> tuple[ByteBpe, ChunkMemo]:
    if path not in _WORKER:
        bpe = ByteBpe(path)

        def compute(chunks):
            special = [c for c in chunks if c in bpe.special]
            if special:
                yield special, {"ids": flat_ids([[bpe.special[c]] for c in special])}
            plain = [c for c in chunks if c not in bpe.special] if special else chunks
            yield plain, {"ids": flat_ids(bpe.encode_chunks(plain))}

        _WORKER[path] = bpe, ChunkMemo({"ids": np.int32}, compute)
    return _WORKER[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text by a byte-level BPE tokenizer file: doc_id, ids array<int>.

    Special tokens are found in the text, none is added.  A null or empty text has no ids.  Rows stay as they are, repeated
    ones and null ids too; other columns are ignored.  An empty table gives an empty table.
    """

    def encode(batches):
        bpe, memo = _encoder(tokenizer)
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                chunks, counts = [], []
                for text in texts:
                    before = len(chunks)
                    if bpe.special_split is None or not any(s in text for s in bpe.special):
                        chunks += CHUNK.findall(text)
                    else:
                        for part in bpe.special_split(text):
                            chunks += [part] if part in bpe.special else CHUNK.findall(part)
                    counts.append(len(chunks) - before)
                slots = memo.look_up(chunks)
                ids, lengths = memo.values["ids"].take(slots)
                reach = np.concatenate([[0], np.cumsum(lengths)])
                offsets = reach[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(start, len(texts)),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))})

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows (doc_id, ids) with their ``decoded`` text; special tokens are written out, unknown and null ids skipped.

    Bytes that are no UTF-8 become U+FFFD.  Null ids give an empty text.
    """

    def decode(batches):
        _, bytes_of = read_tokenizer(tokenizer)
        table = np.frombuffer(b"".join(bytes_of), np.uint8)
        lengths = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            lists = batch.column("ids")
            rows = max(1, SLICE_BYTES * len(lists) // max(1, 4 * len(lists.flatten())))
            for at in range(0, batch.num_rows, rows):
                part = lists.slice(at, rows)
                flat = part.flatten()
                known = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                valid = (known >= 0) & (known < len(starts))
                safe = np.where(valid, known, 0)
                width = np.where(valid, lengths[safe], 0)
                data = gather(table, starts[safe], width)
                reach = np.concatenate([[0], np.cumsum(width)])
                ends = reach[np.concatenate([[0], np.cumsum(sizes)])]
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, rows), "ids": part,
                                                  "decoded": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its comma-joined ids and of the text decoded from them."""
    both = decode_documents(encode_documents(docs, tokenizer, id_col, text_col), tokenizer)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
