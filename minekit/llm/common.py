"""Small helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from minekit.lineage import cut

#: Upper and lower case of the 26 ASCII letters, for the contracts that lower-case A-Z alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id has remainder -1 and so is in no special fold."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor, F.lit(-1))


def fresh(df: DataFrame, name: str) -> str:
    """``name`` or a longer one that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows``, so that a run of long texts fits a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def partitions_for(df: DataFrame, rows: int, rows_each: int) -> int:
    """A partition count that follows the row count and is never below the session's own."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


__all__ = ["LOWER", "UPPER", "bounded_batches", "cut", "fresh", "partitions_for", "remainder", "table", "text_of"]
