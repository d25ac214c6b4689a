"""File readers.  Schemas are declared where possible, so no pass is spent on guessing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.values import as_list, col, epoch_seconds, timestamp

# Attribute kinds of ARFF headers and the Spark type of each (fixed values).
ARFF_TYPES = {"numeric": "double", "real": "double", "integer": "bigint", "string": "string", "date": "string"}


def parquet(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Parquet, reading only the wanted columns that exist."""
    df = spark.read.parquet(*as_list(path))
    return df if columns is None else df.select(*[col(n) for n in columns if n in df.columns])


def csv(spark: SparkSession, path, schema=None, columns: list[str] | None = None, sep: str = ",",
        encoding: str = "UTF-8", **options) -> DataFrame:
    """CSV with a header.  Without a schema types are inferred, which costs a pass."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df if columns is None else df.select(*[col(n) for n in columns if n in df.columns])


def csv_folder(spark: SparkSession, folder: str, schema, pattern: str = "*.csv", **options) -> DataFrame:
    """All matching CSV files of a folder tree; unreadable files are skipped."""
    return spark.read.options(header=True, recursiveFileLookup=True, pathGlobFilter=pattern,
                              ignoreCorruptFiles=True, ignoreMissingFiles=True, **options).schema(schema).csv(folder)


def headerless_csv(spark: SparkSession, path, first: list[str], rest_prefix: str = "feat_", schema=None) -> DataFrame:
    """CSV without a header: given names, then numbered ones."""
    reader = spark.read.option("header", False)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    names = first + [f"{rest_prefix}{i}" for i in range(len(df.columns) - len(first))]
    return df.toDF(*names[:len(df.columns)])


def delimited(spark: SparkSession, path, schema, sep: str = "::", encoding: str = "ISO-8859-1",
              header: bool = False, quote: str = '"') -> DataFrame:
    """Text with a delimiter of one or more characters and a declared schema."""
    return spark.read.options(header=header, sep=sep, encoding=encoding, quote=quote).schema(schema).csv(path)


def json_lines(spark: SparkSession, path, schema, renames: dict[str, str] | None = None) -> DataFrame:
    """JSON lines (plain or gzip); only the fields of the schema are parsed."""
    return spark.read.schema(schema).json(path).withColumnsRenamed(renames or {})


def arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF: attribute header, CSV body, '?' is missing, nominal values lose quotes and b'' marks.

    Of several files the first one's header counts.  Only its first lines are read for it.
    """
    lines = spark.read.text(path)
    first, n = spark.read.text(sorted(lines.inputFiles())[0]), 256
    while True:
        head = [r["value"] for r in first.take(n)]
        ends = [i for i, line in enumerate(head) if line.strip().lower().startswith("@data")]
        if ends or len(head) < n:
            break
        n *= 4
    attributes = [x for x in head[:ends[0] if ends else None] if x.strip().lower().startswith("@attribute")]
    fields, nominal = [], []
    for line in attributes:
        m = re.match(r"(?i)\s*@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)$", line)
        name, kind = m.group(1).strip("'\""), m.group(2).strip().lower()
        spark_type = ARFF_TYPES.get(kind.split()[0], "string") if not kind.startswith("{") else "string"
        if spark_type == "string":
            nominal.append(name)
        fields.append(T.StructField(name, T._parse_datatype_string(spark_type)))
    body = lines.where(~F.trim("value").rlike(r"^(@|%|$)"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = body.select(F.from_csv(F.trim("value"), ddl, {
        "nullValue": "?", "quote": "'", "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")
    return rows.withColumns({n: F.regexp_replace(col(n), r"^b'(.*)'$", "$1") for n in nominal}) if nominal else rows


def parse_list(c: Column, element: str = "bigint") -> Column:
    """'[1, 2]' as an array; text that is no list becomes an empty array."""
    return F.coalesce(F.from_json(c, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def list_from_text(c: Column, sep: str = "|", trim: bool = False) -> Column:
    """Delimited text as an array; missing text becomes an empty array."""
    parts = F.split(c, "\\Q" + sep + "\\E")
    parts = F.transform(parts, lambda x: F.trim(x)) if trim else parts
    return F.coalesce(parts, F.array().cast("array<string>"))


def epoch_column(df: DataFrame, name: str, out: str, missing: float | None = None) -> DataFrame:
    """Seconds since 1970 of a date column; ``missing`` replaces unreadable dates."""
    seconds = epoch_seconds(timestamp(df, name))
    return df.withColumn(out, seconds if missing is None else F.coalesce(seconds, F.lit(float(missing))))
