"""Shared plumbing of the training-data operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import Stage

__all__ = ["Stage", "bound_arrow", "crc_mod", "id_kind", "read", "whole"]

#: Arrow batches stay under this size, so that a few very long texts cannot
#: fill a Python worker.
ARROW_BATCH_BYTES = 4 << 20
ARROW_BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows for the Python stages of this session."""
    conf = spark.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))


def whole(col: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, m: int):
    """crc32 of an id written as text, modulo m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def id_kind(df: DataFrame, col: str) -> str:
    """The type in which ids are compared: long for every whole number, else their own."""
    kind = df.schema[col].dataType.simpleString()
    return "bigint" if kind in ("tinyint", "smallint", "int") else kind
