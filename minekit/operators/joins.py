"""Joins by key. No side is hinted: Spark broadcasts a side only below its own size threshold."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window, functions as F

log = logging.getLogger(__name__)


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    right_names = set(right.columns)
    return [c for c in left.columns if c in right_names]


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every shared column name; the computed key is logged, as a stray name changes it."""
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("the frames share no column name")
    log.info("natural join on %s", keys)
    return left.join(right, keys, how)


def lookup_join(df: DataFrame, column: str, lookup: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """Dictionary lookup that ignores case; the first match (least value) wins, no match gives NULL."""
    entries = lookup.groupBy(F.lower(F.col(name)).alias("_name")).agg(F.min(F.col(value)).alias("_value"))
    return (
        df.join(entries, F.lower(F.col(column)) == F.col("_name"), "left")
        .withColumn(out, F.col("_value"))
        .drop("_name", "_value")
    )


def attach_by_key(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Attach columns by key; a key that repeats in ``extra`` is an error, not a row multiplier."""
    others = [c for c in extra.columns if c != key]
    once = extra.groupBy(key).agg(F.count(F.lit(1)).alias("_times"), *[F.first(c).alias(c) for c in others])
    repeated = F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))
    unique = once.filter(F.when(F.col("_times") > 1, repeated.cast("boolean")).otherwise(F.lit(True))).drop("_times")
    return df.join(unique, key, "left")


def join_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found on one side only or repeated on a side, with the row count of either side.

    Both sides are reduced to one row per key before they meet.
    """
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, keys, "full").na.fill(0, ["n_left", "n_right"])
    status = (
        F.when(F.col("n_right") == 0, "left_only")
        .when(F.col("n_left") == 0, "right_only")
        .when(F.col("n_right") > 1, "right_repeats")
    )
    return both.withColumn("status", status).filter(F.col("status").isNotNull())


def first_rows(df: DataFrame, partition_by: list[str], order_by: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark trims each group before the shuffle."""
    window = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
