"""Document fingerprints: a homomorphic multiset hash of paragraphs, and the next document in id order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import scalar_array
from .common import col, materialise

# Identity lanes: 8 seeded hashes of a paragraph of 32 bits, summed modulo 2**32.
IDENTITY, MASK = 8, 0xFFFFFFFF
# Likeness lanes: word pairs of the paragraph add their hash bits to 64 lanes, two lanes of 31 bits to a long.
PACKED, LANE_BITS = 32, 31
LANE = (1 << LANE_BITS) - 1
PAIR = 1 | (1 << LANE_BITS)
# Blocks of neighbouring ids: cells of equal id width are grouped until a block has this many bytes of text.
CELLS, BLOCK_BYTES, MAX_BLOCKS = 1 << 16, 16 << 20, 1 << 14


def paragraphs(text: Column) -> Column:
    """Lines."""
    return F.split(text, "\n")


def identity_lanes(text: Column) -> Column:
    """Sums of the hashes of the paragraphs that are not empty, one per lane; each lane hashes the text from its own seed."""
    seeds = F.sequence(F.lit(0), F.lit(IDENTITY - 1))
    return F.reduce(
        F.filter(paragraphs(text), lambda p: p != ""), F.transform(seeds, lambda i: F.lit(0).cast("long")),
        lambda sums, p: F.zip_with(sums, seeds, lambda s, i: (s + F.xxhash64(i, p).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))))


def _pairs(paragraph: Column) -> Column:
    """Neighbouring words of a paragraph, the last one paired with nothing."""
    words = F.split(paragraph, r"[\x20\x09-\x0D]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b"))


def fingerprints(rows: DataFrame, key: list[str], texts: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``key`` with a fingerprint (array of longs) of each text column.

    A paragraph hashes to a wide vector and the document's vector is the sum, so the order of paragraphs
    does not matter and ``combine`` inserts or deletes paragraphs without the rest of the text.  Sums are taken
    inside the task that holds the text; one short row per document and task is shuffled.  The result
    column of text column t is named by ``texts[t]``; the longs are identity lanes, likeness lanes, pair count.
    ``keep`` names whole-number columns, fixed per key, to carry along.  Empty lines do not count.
    """
    keys = [col(k) for k in key]
    both = F.array(*[F.struct(F.lit(n).alias("t"), col(t).alias("x"), identity_lanes(col(t)).alias("i"))
                     for n, t in enumerate(texts)])
    lanes = [F.element_at("_u.i", i + 1).alias(f"s{i}") for i in range(IDENTITY)]
    carried = [col(k) for k in keep]
    flat = rows.select(*keys, *carried, F.explode(both).alias("_u")) \
        .select(*keys, *carried, F.col("_u.t").alias("t"), *lanes, F.explode(paragraphs(F.col("_u.x"))).alias("p"))
    names = [F.col(f"s{i}") for i in range(IDENTITY)]
    flat = flat.select(*keys, *carried, "t", *names, (F.col("p") != "").alias("_full"), F.explode(_pairs(F.col("p"))).alias("z")) \
        .select(*keys, *carried, "t", *names, F.when(F.col("_full"), F.xxhash64("z.a", "z.b")).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(PAIR))).alias(f"b{i}") for i in range(PACKED)]
    summed = flat.groupBy(*keys, "t").agg(*sums, F.count("h").alias("n"), *[F.max(c).alias(f"s{i}") for i, c in enumerate(names)],
                                          *[F.max(col(k)).alias(k) for k in keep])
    zero = F.lit(0).cast("long")
    vector = F.array(*names, *[F.coalesce(F.col(f"b{i}"), zero) for i in range(PACKED)], F.col("n"))
    return summed.select(*keys, "t", *carried, vector.alias("v")).groupBy(*keys).agg(
        *[F.max(F.when(F.col("t") == n, F.col("v"))).alias(name) for n, name in enumerate(texts.values())],
        *[F.max(col(k)).alias(k) for k in keep])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of two texts' paragraphs together (sign 1), or of the first without the second's (sign -1)."""
    lanes = F.zip_with(F.slice(a, 1, IDENTITY), F.slice(b, 1, IDENTITY),
                       lambda x, y: (x + y * sign).bitwiseAND(F.lit(MASK)))
    rest = F.zip_with(F.slice(a, IDENTITY + 1, PACKED + 1), F.slice(b, IDENTITY + 1, PACKED + 1),
                      lambda x, y: x + y * sign)
    return F.concat(lanes, rest)


def as_text(v: Column) -> Column:
    return F.concat(F.array_join(F.transform(F.slice(v, 1, IDENTITY), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
                    F.array_join(F.transform(F.slice(v, IDENTITY + 1, PACKED), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""),
                    F.lit(":"), F.element_at(v, -1).cast("string"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two documents' word-pair counts, estimated from the likeness lanes: 1 for equal fingerprints."""
    def lanes(v):
        count = F.element_at(v, -1).cast("double")
        packed = F.slice(v, IDENTITY + 1, PACKED)
        # A lane counts the pairs whose hash bit is set; the bit as +1 or -1 sums to 2 * lane - count.
        low = F.transform(packed, lambda x: 2.0 * x.bitwiseAND(F.lit(LANE)) - count)
        high = F.transform(packed, lambda x: 2.0 * F.shiftright(x, LANE_BITS) - count)
        return F.concat(low, high)

    def dot(x, y):
        return F.reduce(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = lanes(a), lanes(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, 1.0).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm))).otherwise(0.0)


def _block_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, int]:
    """Block number that rises with the id; ids of one block are neighbours. (column, number of blocks)"""
    bounds = docs.agg(F.min(col(id_col)).alias("a"), F.max(col(id_col)).alias("b")).first()
    low, high = bounds["a"] or 0, bounds["b"] or 0
    width = (high - low) // CELLS + 1
    cell = F.coalesce(F.floor((col(id_col) - F.lit(low)) / F.lit(width)), F.lit(0)).cast("int")
    # At most 65,536 rows.
    weights = docs.groupBy(cell.alias("c")).agg(F.sum(F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + 64).alias("w")) \
        .collect()
    per_block = max(BLOCK_BYTES, sum(r["w"] for r in weights) // MAX_BLOCKS)
    table, block, filled, by_cell = [], 0, 0, {r["c"]: r["w"] for r in weights}
    for c in range(max(by_cell, default=0) + 1):
        weight = by_cell.get(c, 0)
        if filled and filled + weight > per_block:
            block, filled = block + 1, 0
        table.append(block)
        filled += weight
    return F.element_at(scalar_array(table, "int"), cell + 1), block + 1


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_block, _row, id, text, next text, next's block and row): the next row by ascending id, after the last the first.

    Equal ids are ordered by text; a null id comes first.  Rows of neighbouring ids meet in a block of bounded
    size; each block also holds a copy of the first row of the following one.
    """
    block, blocks = _block_of(docs, id_col, text_col)
    base = docs.select(col(id_col).alias("_id"), F.coalesce(col(text_col), F.lit("")).alias("_text"), block.alias("_block"))
    # One row per block.
    heads = base.groupBy("_block").agg(F.min("_id").alias("_head"), F.count(F.when(F.col("_id").isNull(), 1)).alias("_nulls")).collect()
    order = sorted(r["_block"] for r in heads)
    first_of = {r["_block"]: None if r["_nulls"] else r["_head"] for r in heads}
    ghosts = None
    if order:
        spark = docs.sparkSession
        before = {b: order[i - 1] for i, b in enumerate(order)}
        table = spark.createDataFrame([(first_of[b], before[b], b) for b in order], "h long, _to int, _b int")
        ghosts = base.withColumn("_one", F.lit(1)).join(F.broadcast(table), F.col("_id").eqNullSafe(F.col("h"))) \
            .select("_id", "_text", F.col("_to").alias("_block"), F.lit(1).alias("_ghost"), F.col("_b").alias("_own"))
    rows = base.withColumn("_ghost", F.lit(0)).withColumn("_own", F.col("_block"))
    rows = rows if ghosts is None else rows.unionByName(ghosts)
    window = Window.partitionBy("_block").orderBy("_ghost", F.col("_id").asc_nulls_first(), "_text")
    rows = rows.withColumn("_row", F.row_number().over(window)) \
        .withColumn("_next", F.lead("_text").over(window)).withColumn("_last", F.lead("_ghost").over(window))
    rows = rows.where(F.col("_ghost") == 0)
    following = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    table = [following.get(b, 0) for b in range(blocks)]
    return rows.select("_block", "_row", "_id", "_text", "_next",
                       F.when(F.col("_last") == 0, F.col("_block")).otherwise(
                           F.element_at(scalar_array(table, "int"), F.col("_block") + 1)).alias("_next_block"),
                       F.when(F.col("_last") == 0, F.col("_row") + 1).otherwise(1).alias("_next_row"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare them.

    The edited text has its last floor(n_chars/4) code points replaced by the first as many (or all) of the next
    document by ascending id; the last is followed by the first.  Returns the id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next, one row per input row.

    A null text counts as empty; empty texts have the zero fingerprint and likeness 1 to each other, 0 to others.
    Rows of one id are ordered by text; a null id comes first.  A single row is its own next.  Other input
    columns are not looked at.  An empty table gives an empty table.
    """
    rows = with_next(docs, id_col, text_col)
    length = F.length("_text")
    cut = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), length - cut), F.substring(F.col("_next"), F.lit(1), cut))
    # The digest travels as whole numbers, 13 hex digits each, so that the aggregation stays a hash aggregation.
    digest = F.sha2(F.col("_edited"), 256)
    rows = rows.withColumn("_edited", edited).withColumn("n_chars", length.cast("long")) \
        .withColumn("_sha", digest).withColumns({f"_d{i}": F.conv(F.substring("_sha", 13 * i + 1, 13), 16, 10).cast("long")
                                                 for i in range(5)})
    keep = ("_id", "_next_block", "_next_row", "n_chars", *[f"_d{i}" for i in range(5)])
    prints = materialise(fingerprints(rows, ["_block", "_row"], {"_text": "_v", "_edited": "_e"}, keep))
    prints = prints.withColumn("edited_sha256", F.concat(*[F.lpad(F.lower(F.hex(f"_d{i}")), 13 if i < 4 else 12, "0")
                                                           for i in range(5)]))
    after = prints.select(F.col("_block").alias("_next_block"), F.col("_row").alias("_next_row"), F.col("_v").alias("_n"))
    out = prints.join(after, ["_next_block", "_next_row"], "left")
    return out.select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("_v")).alias("fingerprint"),
                      as_text(F.col("_e")).alias("edited_fingerprint"),
                      likeness(F.col("_v"), F.col("_e")).alias("near_edited"),
                      likeness(F.col("_v"), F.col("_n")).alias("near_next"))
