"""Sorting, top-k and labelled unions. Every order is completed by the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from minekit.lineage import cut


def sort_desc(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), F.asc(key))


def sort_asc(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(column), F.asc(key))


def top_n(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows; each partition keeps ``n``, and only those meet."""
    return sort_desc(df, column, key).limit(n)


def best_worst(df: DataFrame, key: str, metrics: list[str], n: int) -> DataFrame:
    """For each metric, the ``n`` highest (worst) and ``n`` lowest (best) entities.

    The key and the metrics are written once; each ranking then keeps ``n`` rows per partition.
    """
    parts = []
    narrow = cut(df.select(key, *metrics))
    for metric in metrics:
        value = F.col(metric).cast("double").alias("value")
        base = narrow.select(F.lit(metric).alias("metric"), F.col(key), value).filter(F.col("value").isNotNull())
        parts.append(base.orderBy(F.desc("value"), F.asc(key)).limit(n).withColumn("side", F.lit("worst")))
        parts.append(base.orderBy(F.asc("value"), F.asc(key)).limit(n).withColumn("side", F.lit("best")))
    return reduce(DataFrame.unionByName, parts)


def union_labelled(parts: dict[str, DataFrame], label: str = "method") -> DataFrame:
    """Stack frames of equal columns under a name each."""
    return reduce(
        DataFrame.unionByName, [df.select(F.lit(name).alias(label), "*") for name, df in parts.items()]
    )
