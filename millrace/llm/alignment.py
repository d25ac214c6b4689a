"""Alignment of two tokenizers over a corpus, every distinct text once.

Texts are shuffled by their full text and each distinct one is tokenised and aligned once, with the number of documents that
hold it.  The texts' pairs of ids, weighted by that number, give the corpus counts; a text's measures are joined back
to all its documents by the digest of the text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import settings
from ..functions.joins import keyed_join, measured_bytes
from .bpe import ChunkMemo, Ragged, flat_ids, gather, read_tokenizer, slices
from .common import col, materialise

# Words of plain letters before a common mark, else white space and characters up to a space or line end: no token of either
# tokenizer reaches beyond (checked when they are loaded).
CHUNK = re.compile(r" ?[A-Za-z]++(?=[ \n.,;:!?)])|\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")
MARKS = ".,;:!?)"
# Characters of a chunk beyond which its groups are taken to be possibly large.
LONG_CHUNK = 1_000
# Bytes of remembered chunks and their values before a worker starts anew.
MEMO_BYTES = 48_000_000
# Pairs of ids put into one row of the pair table.
ROW_PAIRS = 1_000_000
# A text held by more than this share of all documents is joined back by itself, so there are at most as many.
HOT_SHARE = 1_000

MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups string"


class PieceBpe:
    """Ids and bytes of a sentencepiece BPE model, for pieces of text that need not start with its added space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if not norm.add_dummy_prefix or norm.remove_extra_whitespaces or norm.precompiled_charsmap or not norm.escape_whitespaces:
            raise ValueError(f"{path} changes texts before it cuts them")
        names = [p.piece for p in model.pieces]
        if any((b in "▁\n" and not (a.isspace() or a == "▁")) or (b in MARKS and a.isascii() and a.isalpha())
               for n in names for a, b in zip(n, n[1:])):
            raise ValueError(f"{path} has pieces that reach over the start of a word")
        norm.add_dummy_prefix = False
        self.encode = SentencePieceProcessor(model_proto=model.SerializeToString()).encode
        byte_kind = model.SentencePiece.BYTE
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == byte_kind else p.piece.replace("▁", " ").encode()
                         for p in model.pieces]


def common_cuts(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every A token and of every B token, from their byte lengths; groups end where both end."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)


def linked_ids(a_ids, b_ids, a_group, b_group):
    """(pair, links) arrays in blocks of distinct pairs: all of one A id's pairs are in one block.

    Equal ids within a group are counted first; a block holds about ROW_PAIRS entries before its repeats are added up.
    """
    a_key, a_count = np.unique(a_ids.astype(np.int64) << 32 | a_group, return_counts=True)
    b_key, b_count = np.unique(b_group.astype(np.int64) << 32 | b_ids, return_counts=True)
    a_id, group = a_key >> 32, a_key & 0xFFFFFFFF
    b_first = np.searchsorted(b_key >> 32, np.arange(int(b_group.max()) + 2))
    partners = b_first[group + 1] - b_first[group]
    reach = np.cumsum(partners)
    start = 0
    while start < len(a_key):
        end = int(np.searchsorted(reach, (reach[start - 1] if start else 0) + ROW_PAIRS, "right"))
        end = int(np.searchsorted(a_id, a_id[min(max(end, start + 1), len(a_id)) - 1], "right"))
        n = partners[start:end]
        ends = np.cumsum(n)
        b_at = np.repeat(b_first[group[start:end]] - (ends - n), n) + np.arange(ends[-1])
        pair = np.repeat(a_id[start:end], n) << 32 | (b_key[b_at] & 0xFFFFFFFF)
        links = np.repeat(a_count[start:end], n) * b_count[b_at]
        yield add_equal(pair, links)
        start = end


def add_equal(pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their links."""
    if len(pair) == links.sum():
        return np.unique(pair, return_counts=True)
    order = np.argsort(pair, kind="stable")
    pair, links = pair[order], links[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return pair[first], np.add.reduceat(links, first)


class Aligner:
    """Aligned groups of whole texts.  Groups never reach over a chunk's ends, so those of a chunk are remembered."""

    def __init__(self, bytes_tokenizer: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a_bytes, self.b = read_tokenizer(bytes_tokenizer)[1], PieceBpe(piece_model)
        self.a = Tokenizer.from_file(bytes_tokenizer)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.a_len, self.b_len = (np.fromiter(map(len, v), np.int64, len(v)) for v in (self.a_bytes, self.b.bytes_of))
        # Per chunk: sizes (A tokens, B tokens, groups, links; -1 A tokens where bytes differ), text of groups, pairs.
        self.memo = ChunkMemo({"sizes": np.int64, "groups": np.uint8, "pair": np.int64, "links": np.int64},
                              self.align_chunks, MEMO_BYTES)

    def align_chunks(self, chunks: list[str]):
        """Chunks in parts with their values; short ones are aligned together."""
        a = flat_ids([e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)])
        b = flat_ids(self.b.encode(chunks, num_threads=1))
        spelt = self.spelt(chunks, a, b)
        short = spelt & np.fromiter((len(c) <= LONG_CHUNK for c in chunks), bool, len(chunks))
        if short.all():
            yield chunks, self.align_row(a, b)
            return
        firsts = [(ids, lengths, np.cumsum(lengths) - lengths) for ids, lengths in (a, b)]
        if short.any():
            rows = [(gather(ids, first[short], lengths[short]), lengths[short]) for ids, lengths, first in firsts]
            yield [c for c, ok in zip(chunks, short.tolist(), strict=True) if ok], self.align_row(*rows)
        for i in np.flatnonzero(~short).tolist():
            if spelt[i]:
                values = self.align_long(*[ids[first[i]:first[i] + lengths[i]] for ids, lengths, first in firsts])
            else:
                values = [np.array([-1, 0, 0, 0]), *[np.zeros(0, np.int64)] * 3]
            yield [chunks[i]], {n: (v, np.array([len(v)])) for n, v in zip(self.memo.fields, values, strict=True)}

    def spelt(self, chunks: list[str], *tokens) -> np.ndarray:
        """True for chunks whose bytes are those of their tokens by both tokenizers."""
        raw = [c.encode() for c in chunks]
        ok, all_raw = np.ones(len(raw), bool), b"".join(raw)
        for (ids, lengths), table, sizes in zip(tokens, (self.a_bytes, self.b.bytes_of), (self.a_len, self.b_len), strict=True):
            per_chunk = np.add.reduceat(sizes[ids], np.cumsum(lengths) - lengths) if len(ids) and lengths.all() else None
            written = b"".join([table[i] for i in ids.tolist()])
            if per_chunk is not None and written == all_raw and (per_chunk == [len(r) for r in raw]).all():
                continue
            at = 0
            for i, n in enumerate(lengths.tolist()):
                ok[i] &= b"".join([table[t] for t in ids[at:at + n].tolist()]) == raw[i]
                at += n
        return ok

    def align_row(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> dict:
        """Values of chunks that are spelt: in a row they are one text whose groups end where theirs do."""
        (a, a_count), (b, b_count) = a, b
        a_group, b_group = common_cuts(self.a_len[a], self.b_len[b])
        n = int(a_group[-1]) + 1
        b_first = np.searchsorted(b_group, np.arange(n + 1))
        partners = np.diff(b_first)[a_group]
        pair = np.repeat(a, partners) << 32 | b[gather(np.arange(len(b)), b_first[a_group], partners)]
        a_ends, b_ends = np.cumsum(a_count), np.cumsum(b_count)
        pairs = np.diff(np.cumsum(partners)[a_ends - 1], prepend=0)
        text, text_ends = self.written(a, b, a_group, b_group)
        sizes = np.stack([a_count, b_count, np.diff(a_group[a_ends - 1] + 1, prepend=0), pairs], axis=1)
        return {"sizes": (sizes.ravel(), np.full(len(sizes), 4)),
                "groups": (text, np.diff(text_ends[a_ends + b_ends - 1], prepend=0)),
                "pair": (pair, pairs), "links": (np.ones(len(pair), np.int64), pairs)}

    def align_long(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """The same of one long chunk, whose groups may be large: equal ids of a group are counted before they meet."""
        a_group, b_group = common_cuts(self.a_len[a], self.b_len[b])
        blocks = list(linked_ids(a, b, a_group, b_group))
        pair, links = (np.concatenate(v) for v in zip(*blocks, strict=True))
        size = np.array([len(a), len(b), int(a_group[-1]) + 1, int(links.sum())])
        return [size, self.written(a, b, a_group, b_group)[0], pair, links]

    @staticmethod
    def written(a, b, a_group, b_group) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``a1,a2|b1;`` for all groups, each ended by the semicolon; and where every token's part ends."""
        group = np.concatenate([a_group * 2, b_group * 2 + 1])
        order = np.argsort(group, kind="stable")
        ids, group = np.concatenate([a, b])[order], group[order]
        last = np.append(group[1:] != group[:-1], True)
        marks = np.where(last, np.where(group & 1, 2, 1), 0)
        text = "".join([f"{t}{',|;'[m]}" for t, m in zip(ids.tolist(), marks.tolist(), strict=True)])
        digits = 1 + np.searchsorted(10 ** np.arange(1, 19), ids, "right")
        return np.frombuffer(text.encode(), np.uint8), np.cumsum(digits + 1)

    def align(self, texts: list[str]):
        """For every text (sizes or None, groups, pairs, links)."""
        chunks, counts = [], []
        for text in texts:
            found = CHUNK.findall(" " + text) if text else []
            chunks += found
            counts.append(len(found))
        slots, values = self.memo.look_up(chunks), self.memo.values
        taken = {name: values[name].take(slots) for name in values}
        sizes = taken["sizes"][0].reshape(-1, 4)
        ends = np.cumsum(counts)
        reach = {name: np.concatenate([[0], np.cumsum(taken[name][1])])[np.concatenate([[0], ends])].tolist()
                 for name in ("groups", "pair")}
        written = taken["groups"][0].tobytes()
        start = 0
        for i, end in enumerate(ends.tolist()):
            mine, start = sizes[start:end], end
            if not len(mine) or (mine[:, 0] < 0).any():
                yield None, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            pair, links = (taken[n][0][reach["pair"][i]:reach["pair"][i + 1]] for n in ("pair", "links"))
            yield mine.sum(axis=0), written[reach["groups"][i]:reach["groups"][i + 1] - 1].decode(), *add_equal(pair, links)


_WORKER: dict[tuple[str, str], Aligner] = {}


def align_texts(texts: DataFrame, bytes_tokenizer: str, piece_model: str, keep: list[str]) -> DataFrame:
    """Align the column ``text`` of every row: its measures, the groups as text, and distinct id pairs with their links.

    A text is one row, or more if it has over ROW_PAIRS distinct pairs: the further ones (``part`` > 0) hold only pairs.
    The columns in ``keep`` are carried.
    """
    kept = texts.select(*[col(c) for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def work(batches):
        aligner = _WORKER.get((bytes_tokenizer, piece_model))
        if aligner is None:
            aligner = _WORKER[bytes_tokenizer, piece_model] = Aligner(bytes_tokenizer, piece_model)
        for batch in batches:
            for start, rows in slices(batch.column("text")):
                at, part, sizes, groups = [], [], [], []
                pairs, links = Ragged(np.int64), Ragged(np.int64)
                for i, (size, group, pair, link) in enumerate(aligner.align(rows), start):
                    for k in range(0, max(1, len(pair)), ROW_PAIRS):
                        at.append(i)
                        part.append(k // ROW_PAIRS)
                        sizes.append(size if size is not None and not k else np.zeros(4, np.int64))
                        groups.append("" if k else group)
                        block = slice(k, k + ROW_PAIRS)
                        pairs.extend(pair[block], np.array([len(pair[block])]))
                        links.extend(link[block], np.array([len(link[block])]))
                sizes = np.stack(sizes)
                offsets = pa.array(np.concatenate([[0], np.cumsum(pairs.lengths[:pairs.count])]).astype(np.int32))
                out = {c: batch.column(c).take(pa.array(at)) for c in keep}
                out |= {"part": pa.array(part, pa.int32())}
                out |= {c: pa.array(sizes[:, k]) for k, c in enumerate(["n_a", "n_b", "n_groups", "n_links"])}
                out |= {"groups": pa.array(groups, pa.string()),
                        "pairs": pa.ListArray.from_arrays(offsets, pa.array(pairs.flat[:pairs.size])),
                        "links": pa.ListArray.from_arrays(offsets, pa.array(links.flat[:links.size]))}
                yield pa.RecordBatch.from_pydict(out)

    return texts.select(*[col(c) for c in keep], "text").mapInArrow(
        work, f"{schema}, part int, {MEASURES}, pairs array<long>, links array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, in_docs, best): documents that hold an id pair linked, and whether that is the highest count of its A id."""
    counts = aligned.select(F.explode("pairs").alias("pair"), "docs").groupBy("pair").agg(F.sum("docs").alias("in_docs"))
    counts = materialise(counts)
    # One row per id of the first tokenizer: bounded by its vocabulary.
    top = counts.groupBy(F.shiftright("pair", 32).alias("_a")).agg(F.max("in_docs").alias("_top"))
    return materialise(counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("_a"))
                       .select("pair", "in_docs", (F.col("in_docs") == F.col("_top")).alias("best")))


def align_documents(docs: DataFrame, bytes_tokenizer: str, piece_model: str, id_col: str = "doc_id",
                    text_col: str = "text", written: dict[str, Column] | None = None) -> DataFrame:
    """Alignment measures of every document between a byte-level BPE file (A) and a sentencepiece BPE model (B).

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the columns ``written`` derives from a text's
    ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of both in order); by default these are the groups themselves.  Texts
    are encoded without special tokens, whose strings are plain text, with a space before them.

    Null and empty texts and those whose tokens do not spell the text (such as one with U+2581) have no tokens: zeros and
    empty groups.  Repeated rows are counted and returned each; a null id stays null.  Other columns are ignored.  An
    empty table gives an empty table.
    """
    written = {"groups": F.col("groups")} if written is None else written
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    # The shuffle is by the full text; copies are combined in each task before it.
    distinct = rows.groupBy("text").agg(F.count("*").alias("docs"))
    texts = distinct.select(F.unhex(F.sha2("text", 256)).alias("digest"), "docs", "text")
    aligned = materialise(align_texts(texts, bytes_tokenizer, piece_model, ["digest", "docs"]).select(
        "digest", "docs", "part", "n_a", "n_b", "n_groups", "n_links", *[c.alias(n) for n, c in written.items()], "pairs", "links"))
    counts = pair_counts(aligned)
    each = aligned.where(F.size("pairs") > 0).select("digest", F.explode(F.arrays_zip("pairs", "links")).alias("_p")) \
        .select("digest", F.col("_p.pairs").alias("pair"), F.col("_p.links").alias("links"))
    size = measured_bytes(counts)
    met = each.join(F.broadcast(counts), "pair") if size <= settings.BROADCAST_BYTES \
        else keyed_join(each, counts, ["pair"], "inner", stored=True)
    sums = met.groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("links") * F.col("in_docs")).alias("count_sum"))
    names = ["n_a", "n_b", "n_groups", "n_links", *written]
    of_text = materialise(aligned.where("part = 0").select("digest", "docs", *names).join(sums, "digest", "left").select(
        "digest", "docs", *names[:4], F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), *names[4:]))
    # Texts of more than a thousandth of the documents: under a thousand rows.
    limit = (of_text.agg(F.sum("docs")).first()[0] or 0) // HOT_SHARE + 1
    keyed = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    hot = F.broadcast(of_text.where(F.col("docs") > limit))
    out = keyed.join(hot, "digest").unionByName(
        keyed.join(F.broadcast(of_text.where(F.col("docs") > limit).select("digest")), "digest", "left_anti")
        .join(of_text.where(F.col("docs") <= limit), "digest"))
    return out.select("doc_id", *names[:4], "n_best", "count_sum", *names[4:])


def alignment_digests(docs: DataFrame, bytes_tokenizer: str, piece_model: str) -> DataFrame:
    """The measures of every document, with the SHA-256 of its groups ('' without tokens)."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return align_documents(docs, bytes_tokenizer, piece_model, written={"groups_sha256": digest})
