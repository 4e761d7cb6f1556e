"""Cutting lineage and numbering rows without funnelling them through one task."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder in ``spark.checkpoint.dir``; invent one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="minekit-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/minekit-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors.

    A written table also tells the planner its size, so small sides are broadcast without a hint.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_PARTITION, LARGE_PARTITION, MANY_PARTITIONS = 50_000, 5_000_000, 4_000


def steady_layout(df: DataFrame, *key: str) -> DataFrame:
    """A layout that depends on the rows alone, so an iterative fit does not vary with the input's files.

    Without a key all columns are one: rows that agree in all of them are alike to any fit.
    """
    key = key or tuple(df.columns)
    rows = cut(df)
    n = rows.count()
    partitions = min(math.ceil(n / SMALL_PARTITION), max(MANY_PARTITIONS, math.ceil(n / LARGE_PARTITION)))
    partitions = max(partitions, 1)
    return rows.repartition(partitions, *key).sortWithinPartitions(*key)


def number_rows(df: DataFrame, order_by, partition_by=(), name: str = "position") -> DataFrame:
    """Add a 0-based position inside each ``partition_by`` group, in ``order_by`` order.

    A window over the group alone would sort a hot group in one task. Here the rows are range
    partitioned by (group, order), numbered inside each range, and shifted by the size of the
    earlier ranges. ``order_by`` must identify a row inside its group.
    """
    group = list(partition_by)
    order = list(order_by)
    ranged = cut(
        df.repartitionByRange(*[F.col(c) for c in group + order]).withColumn("_range", F.spark_partition_id())
    )
    # one row per (range, group): bounded by the partition count plus the number of groups
    sizes = ranged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size"))
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    numbered = ranged.withColumn("_local", F.row_number().over(inside) - 1)
    same = F.col("n._range") == F.col("o._range")
    for c in group:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = numbered.alias("n").join(offsets.alias("o"), same)
    return joined.select(
        *[F.col(f"n.{c}") for c in df.columns],
        (F.col("n._local") + F.col("o._offset")).cast("long").alias(name),
    )
