"""Display formatting and table output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minekit.functions.expr import quoted


def format_table(df: DataFrame, round_to: dict[str, int], percent: dict[str, int]) -> DataFrame:
    """Round some columns and render others as percentages, ready to show."""
    out = []
    for c in df.columns:
        if c in percent:
            out.append(F.format_string(f"%.{percent[c]}f%%", F.col(quoted(c)).cast("double") * 100).alias(c))
        elif c in round_to:
            out.append(F.round(F.col(quoted(c)), round_to[c]).alias(c))
        else:
            out.append(F.col(quoted(c)))
    return df.select(*out)


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    """Write parquet, partitioned by low-cardinality group keys so later group filters prune files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
