"""WARC archives: write captures as linked records, read the records back and assemble them to captures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import col, new_folder

REVISIT_FROM_BYTES = 100
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
# Archives are read whole, file by file, so the writer closes a file after so many captures.
CAPTURES_PER_FILE = 2_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = """kind string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long,
payload_digest string, payload_bytes long, payload string, block string"""


def _record(headers: list, block: Column) -> Column:
    """Text of one record without its closing empty lines; headers are (name, Column) pairs."""
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        # A line break inside a value would end the header.
        lines.append(F.concat(F.lit(name + ": "), F.translate(value, "\r\n", "  ")))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_captures(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """Write a request, a response or revisit, and a metadata record for every row, as concatenated WARC records.

    Payloads of at least 100 bytes that equal each other are written once, by the row with the smallest id; the
    others become revisits that refer to it.  The first holder of a payload is found by a combined
    aggregation on the digest, so groups of copies of any size are met by one short row.
    """
    html = F.coalesce(col(html_col), F.lit(""))
    base = pages.select(col(id_col).cast("long").alias("id"), F.coalesce(col(url_col), F.lit("")).alias("url"),
                        col(url_col).isNull().alias("no_url"), html.alias("html"), F.sha2(html, 256).alias("digest"),
                        F.octet_length(html).alias("bytes"))
    first = base.where(F.col("bytes") >= REVISIT_FROM_BYTES).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "first")
    rows = base.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    ident = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    # Equal for equal rows: a capture is its page, address and payload.
    name = F.concat(ident, F.lit(":"), F.md5(F.concat_ws("|", "url", "digest")))
    main, request, meta = (F.concat(F.lit(f"<urn:capture:{k}:"), name, F.lit(">")) for k in ("main", "request", "metadata"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE)), ("X-Page-Id", ident)]
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                      F.col("bytes").cast("string"), F.lit(END))
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))]
    facts = F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit("\r\nurlKnown: "),
                     (~F.col("no_url")).cast("string"), F.lit("\r\n"))
    response = F.when(revisit, _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", main), *common, *digest, ("WARC-Profile", F.lit(PROFILE)),
         ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
         ("Content-Type", F.lit("application/http; msgtype=response"))], answer)).otherwise(_record(
             [("WARC-Type", F.lit("response")), ("WARC-Record-ID", main), *common, *digest,
              ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(answer, F.col("html"))))
    records = F.array(
        _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", request), ("WARC-Concurrent-To", main), *common,
                 ("Content-Type", F.lit("application/http; msgtype=request"))], ask),
        response,
        _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", meta), ("WARC-Concurrent-To", main), *common,
                 ("Content-Type", F.lit("application/warc-fields"))], facts))
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip") \
        .option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE).text(folder)


_HEAD = re.compile(rb"\r\n\r\n")


def parse_records(content: bytes) -> Iterator[dict]:
    """Records of one archive: header fields by lower-case name, and the block."""
    at = 0
    while at < len(content):
        end = _HEAD.search(content, at)
        if end is None:
            raise ValueError(f"no header end after byte {at}")
        lines = content[at:end.start()].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield {"head": head, "block": content[end.end():end.end() + size]}
        at = end.end() + size
        if content[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record does not end at byte {at}")
        at += 4


def _row(record: dict, keep_payload: bool) -> tuple:
    head, block = record["head"], record["block"]
    kind = head["warc-type"]
    payload, size, digest = None, None, None
    if kind == "response":
        payload = block[_HEAD.search(block).end():]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if head.get("warc-payload-digest", "sha256:" + digest) != "sha256:" + digest:
            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
    elif kind == "revisit":
        digest = head["warc-payload-digest"].partition(":")[2]
    page = head.get("x-page-id", "none")
    return (kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
            None if page == "none" else int(page), digest, size,
            payload.decode("utf-8") if keep_payload and payload is not None else None,
            None if kind in ("response", "revisit") else block.decode("utf-8"))


def read_records(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the archives (.gz or plain) of a folder.

    Digests of payloads are computed from what was read and compared with the header; a difference raises.
    """
    names = [x.split()[0] for x in RECORD_SCHEMA.replace("\n", " ").split(", ")]

    def parse(batches):
        import gzip

        for batch in batches:
            for content in batch["content"]:
                rows = [_row(r, keep_payload) for r in parse_records(
                    gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content))]
                for i in range(0, len(rows), 500):
                    frame = pd.DataFrame(rows[i:i + 500], columns=names)
                    frame["page_id"] = pd.array(frame["page_id"], dtype="Int64")
                    frame["payload_bytes"] = pd.array(frame["payload_bytes"], dtype="Int64")
                    yield frame

    # One archive per Arrow batch and task: binary rows are large.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(folder).select("content")
    return files.mapInPandas(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the main record with its request and metadata.

    Request and metadata records are joined to the response or revisit that their concurrent-to names; all
    three sides meet in one shuffle on that identifier.  Records that were written n times give n captures.
    A capture without request or metadata has null there; a request or metadata record whose response is
    missing gives no capture.
    """
    link = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    main = F.col("kind").isin("response", "revisit")
    nested = F.struct("kind", "record_id", "target_uri", "page_id", "payload_digest", "payload_bytes", "payload", "refers_to")
    other = F.struct("record_id", "block")
    grouped = records.where(link.isNotNull()).groupBy(link.alias("capture_id")).agg(
        F.max(F.when(main, nested)).alias("response"), F.max(F.when(F.col("kind") == "request", other)).alias("request"),
        F.max(F.when(F.col("kind") == "metadata", other)).alias("metadata"), F.count(F.when(main, 1)).alias("_copies"))
    return grouped.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))) \
        .drop("_copies", "_copy")


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     folder: str | None = None, keep_payload: bool = True) -> DataFrame:
    """Write the pages as WARC archives and return the captures read back from them.

    A null html is an empty payload, a null url an empty target.  Equal rows are separate captures with one
    identifier; of rows with equal ids and payloads none revisits the other.  Other input columns are ignored.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    write_captures(pages, folder, id_col, url_col, html_col)
    return assemble(read_records(pages.sparkSession, folder, keep_payload))


def digest_rows(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every capture."""
    stated = F.regexp_extract("metadata.block", r"payloadBytes: (\d+)", 1).cast("long")
    return captures.select(
        F.col("response.page_id").alias("page_id"), F.coalesce("response.payload_bytes", stated).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"),
        F.regexp_extract("response.refers_to", r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
