"""Column expressions shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def ratio(numerator, denominator) -> Column:
    """Division whose zero or missing divisor gives NULL instead of an ANSI error."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def no_nan(column) -> Column:
    """NULL is the only missing value inside the library; NaN becomes NULL on the way in."""
    c = _col(column)
    return F.when(~F.isnan(c), c)


def is_missing(field: T.StructField) -> Column:
    """True where a cell is NULL, or NaN for a floating-point column."""
    c = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def bands(column, cuts, labels) -> Column:
    """Left-closed bands: ``labels[i]`` below ``cuts[i]``, the last label from the last cut up."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one more label than cuts is needed")
    c = _col(column)
    out = F.when(c < F.lit(cuts[0]), F.lit(labels[0]))
    for cut_point, label in zip(cuts[1:], labels[1:-1]):
        out = out.when(c < F.lit(cut_point), F.lit(label))
    return out.when(c >= F.lit(cuts[-1]), F.lit(labels[-1]))


def first_match_case(rules, default=None) -> Column:
    """First condition that holds decides; with no default an unmatched row is NULL."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


def literal_frame(spark: SparkSession, rows, names) -> DataFrame:
    """A short frame of constants, written into the plan."""
    rows = list(rows)
    if len(rows) > 32:
        table = pa.table({n: [row[i] for row in rows] for i, n in enumerate(names)})
        return spark.createDataFrame(table)
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rounded(df: DataFrame, places: int = 6, cols=None) -> DataFrame:
    """Round the floating-point columns (all, or those listed)."""
    chosen = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols)
    }
    # adding zero turns -0.0 into 0.0
    return df.select(
        *[
            (F.round(F.col(quoted(c)), places) + F.lit(0.0)).alias(c) if c in chosen else F.col(quoted(c))
            for c in df.columns
        ]
    )


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column
