"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import col
from ..session import materialise, shared_folder

# Words of the contracts: runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own under the shared folder, for tables written and read back."""
    return f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"


def text_of(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def lower_ascii(value: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_fold(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(col(name).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["WORD", "col", "id_fold", "lower_ascii", "materialise", "new_folder", "read_table", "shared_folder",
           "shuffle_parts", "text_of"]
