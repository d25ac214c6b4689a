"""Secret scans over a ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import col, new_folder

RULE_VERSION = "1"
#: Base kinds in their listed order, fixed by the contract, then the kinds this ledger adds.
KINDS = ("assign", "access", "hex", "private_key", "web_token", "service_token")
BASE = KINDS[:3]
_FIND = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    # The maximal runs of these characters with 16 or more.
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "private_key": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "service_token": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
}
# Every text in which one of the above can match has one of these.
MAY_MATCH = (r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|PRIVATE KEY|eyJ[A-Za-z0-9_-]{10}|gh[pousr]_")

LEDGER_SCHEMA = "blob binary, rule_version string, spans array<struct<kind: string, start: int, end: int>>"


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost and non-overlapping within a kind, by start and then kind."""
    out = []
    for rank, kind in enumerate(KINDS):
        for m in _FIND[kind].finditer(text):
            if kind == "assign" and len(m[2]) < 12 or kind == "access" and m.end() - m.start() < 18:
                continue
            out.append((m.start(), rank, m.end()))
    return [(KINDS[rank], start, end) for start, rank, end in sorted(out)]


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class BlobLedger:
    """What has been scanned: (blob, rule version) with the spans found.

    ``scan`` takes a table of versions (any number of rows per path, any history), scans the blobs that the ledger does
    not have under this rule version, adds them, and joins the findings to all rows.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, rule_version: str = RULE_VERSION):
        self.spark, self.folder, self.rule_version = spark, folder or new_folder(spark, "ledger"), rule_version

    @property
    def started(self) -> bool:
        """Whether anything was scanned into the folder, through this handle or another."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def entries(self) -> DataFrame:
        """Scanned pairs under this rule version."""
        if not self.started:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.folder).where(F.col("rule_version") == self.rule_version)

    def scan(self, versions: DataFrame, text_col: str) -> DataFrame:
        """``versions`` with the columns blob and spans; clashing input columns are replaced."""
        text = F.coalesce(col(text_col), F.lit(""))
        # Copies are combined before the shuffle; one text per blob goes on.
        blobs = versions.select(blob_id(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        if self.started:
            blobs = blobs.join(self.entries().select("blob"), "blob", "left_anti")
        hit = F.col("text").rlike(MAY_MATCH)

        def search(batches):
            for batch in batches:
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] if h else []
                         for t, h in zip(batch["text"], batch["hit"], strict=True)]
                yield pd.DataFrame({"blob": batch["blob"], "rule_version": self_version, "spans": spans})

        self_version = self.rule_version
        found = blobs.select("blob", F.when(hit, F.col("text")).otherwise("").alias("text"), hit.alias("hit")) \
            .mapInPandas(search, LEDGER_SCHEMA)
        found.write.mode("append").parquet(self.folder)
        # Two scans at once, or one that was run again, may have added a blob twice; the spans are the same.
        findings = self.entries().where(F.size("spans") > 0).groupBy(F.col("blob").alias("_b")).agg(F.first("spans").alias("spans"))
        rows = versions.select(*[col(c) for c in versions.columns if c not in ("blob", "spans")], blob_id(text).alias("blob"))
        # Rows without findings take no part in the join; a frequent blob's rows are split by the engine.
        return rows.join(findings, F.col("blob") == F.col("_b"), "left").drop("_b") \
            .withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<kind: string, start: int, end: int>>")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans, one row per input row.

    A null or empty text has no spans.  Equal texts are scanned once.  Repeated rows and null ids are kept.
    Other input columns are ignored.  An empty table gives an empty table.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    found = ledger.scan(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("_text")), "_text")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[F.size(_of("spans", kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _of(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ledger: BlobLedger | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one mark.

    All columns stay; a null text stays null.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    names = docs.columns
    held = docs.select(F.struct(*[col(n) for n in names]).alias("_row"), col(text_col).alias("_text"))
    found = ledger.scan(held, "_text")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else replace_spans(t, [(x["start"], x["end"]) for x in s], mark)
                          for t, s in zip(text, spans, strict=True)], dtype=object)

    # Only texts with findings go to Python.
    some = F.size("spans") > 0
    out = found.withColumn("_new", cut(F.when(some, F.col("_text")), F.when(some, F.col("spans"))))
    text = F.when(some, F.col("_new")).otherwise(F.col("_text"))
    return out.select(*[text.alias(n) if n == text_col else F.col("_row").getField(n).alias(n) for n in names])


def replace_spans(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at, covered = [], 0, -1
    for start, end in sorted(spans):
        if start < covered:
            covered = max(covered, end)
            at = covered
            continue
        out += [text[at:start], mark]
        at = covered = end
    return "".join(out) + text[at:]


def reference_digest(text: str | None) -> str:
    """base_sha256 of one text, for tests."""
    spans = [s for s in find_spans(text or "") if s[0] in BASE]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
