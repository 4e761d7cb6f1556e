"""Projection, filtering and reshaping of wide keyed tables.

Operators whose output columns depend on the data run one aggregate that returns one small row,
then build a lazy projection from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from minekit.functions.expr import is_missing, numeric_columns, quoted, ratio, string_columns
from minekit.lineage import number_rows


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(quoted(c)) for c in numeric_columns(df)])


def select_non_numeric(df: DataFrame) -> DataFrame:
    numeric = set(numeric_columns(df))
    return df.select(*[F.col(quoted(c)) for c in df.columns if c not in numeric])


def select_range(df: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Columns by position, Python slice rules (negative positions count from the end)."""
    return df.select(*[F.col(quoted(c)) for c in df.columns[start:stop]])


def move_front(df: DataFrame, front: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in front]
    return df.select(*[F.col(quoted(c)) for c in [*front, *rest]])


def project_like(df: DataFrame, other_columns, extra=()) -> DataFrame:
    """Project to another frame's columns plus some more; a repeated name is kept once."""
    return df.select(*[F.col(quoted(c)) for c in dict.fromkeys([*other_columns, *extra])])


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: the row count and one missing-cell count per column, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(is_missing(f)).alias(f.name) for f in df.schema.fields],
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Missing cells per column, long form."""
    counts = missing_counts(df)
    return counts.unpivot(["n_rows"], df.columns, "column", "n_missing").select("column", "n_missing", "n_rows")


def complete_columns(df: DataFrame) -> DataFrame:
    """Keep only columns without a single missing cell."""
    counts = missing_counts(df).first().asDict()
    return df.select(*[F.col(quoted(c)) for c in df.columns if counts[c] == 0])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Keep columns holding at least one value."""
    counts = missing_counts(df).first().asDict()
    return df.select(*[F.col(quoted(c)) for c in df.columns if counts[c] < counts["n_rows"]])


def coerce_numeric(df: DataFrame, cols=None) -> DataFrame:
    """Coerce columns to double: unparsable text gives NULL, a date its day number, NaN gives NULL."""
    chosen = set(df.columns if cols is None else cols)
    out = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if f.name in chosen:
            if isinstance(f.dataType, T.DateType):
                c = F.unix_date(c).cast("double")
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                c = F.unix_date(F.to_date(c)).cast("double")
            else:
                c = c.try_cast("double")
                c = F.when(~F.isnan(c), c)
            c = c.alias(f.name)
        out.append(c)
    return df.select(*out)


def rates(df: DataFrame, specs: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Add ``name = numerator / denominator * scale``; a zero divisor gives NULL."""
    return df.withColumns({name: ratio(a, b) * F.lit(float(scale)) for name, (a, b, scale) in specs.items()})


def null_out(df: DataFrame, condition: Column, cols: list[str]) -> DataFrame:
    """Set cells to NULL on the rows where ``condition`` is true."""
    keep = ~F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(keep, F.col(quoted(c))) for c in cols})


def normalise_block(df: DataFrame, keep_first: int, divisor: str) -> DataFrame:
    """Divide every column after the first ``keep_first`` by one column."""
    return df.withColumns({c: ratio(F.col(quoted(c)), divisor) for c in df.columns[keep_first:]})


def encode_factors(df: DataFrame, cols=None) -> DataFrame:
    """Add ``<c>_code``: the 1-based alphabetical rank of a string among the distinct values.

    Levels are ranked by a range-partitioned sort, so a column with many levels needs no single task.
    """
    out = df
    for c in string_columns(df) if cols is None else cols:
        levels = df.select(F.col(quoted(c)).alias("_level")).filter(F.col("_level").isNotNull()).distinct()
        codes = number_rows(levels, ["_level"], name="_code")
        out = (
            out.join(codes, F.col(quoted(c)) == F.col("_level"), "left")
            .withColumn(f"{c}_code", F.col("_code") + 1)
            .drop("_level", "_code")
        )
    return out


def unpivot_measures(df: DataFrame, ids: list[str], cols: list[str], name="variable", value="value") -> DataFrame:
    """Wide to long; a map-side expansion without a shuffle."""
    return df.select(*ids, *[F.col(quoted(c)).cast("double").alias(c) for c in cols]).unpivot(ids, cols, name, value)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"))


def table_structure(df: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """Position, name, type and the values of the ``k`` rows with the lowest keys, one row per column, as ``str`` prints it."""
    shown = {c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("NA")) for c in df.columns}
    first = df.orderBy(*[F.col(quoted(c)).asc_nulls_last() for c in key]).limit(k)
    numbered = first.select(F.struct(*[F.col(quoted(c)) for c in key]).alias("_at"), *[v.alias(c) for c, v in shown.items()])
    long = numbered.unpivot(["_at"], list(df.columns), "column", "value")
    values = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), " ")
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    places = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns, 1) for x in (c, i)])
    return long.groupBy("column").agg(values.alias("first_values")).select(
        places[F.col("column")].cast("long").alias("position"), "column", kinds[F.col("column")].alias("type"), "first_values"
    )


def filter_not_in(df: DataFrame, column: str, values) -> DataFrame:
    """Negated membership that keeps NULL rows."""
    return df.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    """Listwise deletion of rows with a NULL or NaN cell."""
    return df.na.drop(subset=list(df.columns if cols is None else cols))


def complete_case_counts(df: DataFrame) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [is_missing(f) for f in df.schema.fields])
    return df.groupBy((~missing).alias("complete")).agg(F.count(F.lit(1)).alias("n"))


def snapshot(df: DataFrame, date_column: str, as_of, days_back: int) -> DataFrame:
    """Rows dated exactly ``days_back`` days before ``as_of``."""
    return df.filter(F.col(date_column) == F.date_sub(F.lit(as_of).cast("date"), days_back))


def scatter_layer(df: DataFrame, x: str, y: str, size: str, label: str, label_when: Column, group=None) -> DataFrame:
    """The table behind a labelled scatter: a label only on the rows that meet a condition."""
    extra = [F.col(group).alias("group")] if group else []
    return df.select(
        F.col(x).alias("x"), F.col(y).alias("y"), F.col(size).alias("size"), *extra,
        F.when(label_when, F.col(label)).alias("label"),
    )
