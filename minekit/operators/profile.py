"""Aggregations and descriptive profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from minekit.functions.expr import is_missing, literal_frame, numeric_columns, quoted, ratio
from minekit.functions.special import t_quantile_975
from minekit.lineage import cut

# quantile sketch: rank error at most 1 / accuracy
SKETCH_ACCURACY = 10_000
# distinct values of one bracket that a task may hold, and parts that a wider bracket is cut into
BRACKET, PARTS = 10_000, 100


def long_values(df: DataFrame, cols, by=()) -> DataFrame:
    """``(by..., column, value)`` with missing cells removed; a map-side expansion."""
    wide = df.select(*by, *[F.col(quoted(c)).cast("double").alias(c) for c in cols])
    long = wide.unpivot(list(by), list(cols), "column", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def linear_rank(n, prob: float):
    """0-based position of a quantile when the ranks 0..n-1 are interpolated linearly."""
    return (n - 1) * F.lit(float(prob))


def hinge_rank(n, prob: float):
    """0-based position of Tukey's hinges, the medians of the two halves."""
    depth = F.floor((n + 3) / 2) / 2
    if prob == 0.25:
        return depth - 1
    return n - depth if prob == 0.75 else linear_rank(n, prob)


def quantile_table(df: DataFrame, cols, probs, by=(), rank=linear_rank) -> DataFrame:
    """Exact interpolated quantiles, long form ``(by..., column, prob, n, value)``.

    ``percentile`` would gather every distinct value of a column in one task. Instead a bounded
    sketch brackets each quantile; a second pass counts what lies below the bracket and keeps only
    the distinct values inside it (about 4 rows in 10,000). A bracket that may hold more than
    ``BRACKET`` distinct values is narrowed by further counting passes, so what a task holds of a
    group is bounded whatever its size; the running count inside gives the answer.
    """
    by = list(by)
    group = [*by, "column"]
    margin = 2.0 / SKETCH_ACCURACY
    edges = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    values = long_values(df, cols, by)
    sketch = values.groupBy(*group).agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", F.array(*[F.lit(e) for e in edges]), SKETCH_ACCURACY).alias("edge"),
    )
    targets = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("prob"),
                F.element_at("edge", 2 * i + 1).alias("low"),
                F.element_at("edge", 2 * i + 2).alias("high"),
                F.floor(rank(F.col("n"), p)).alias("i"),
                rank(F.col("n"), p).cast("double").alias("h"),
            )
            for i, p in enumerate(probs)
        ]
    )
    brackets = cut(sketch.select(*group, "n", targets.alias("targets")))
    matched = _attach_per_column(values, brackets, by)
    each = matched.select(*group, "n", "value", F.explode("targets").alias("t")).select(
        *group, "n", "value", "t.*"
    )
    inside = F.when(F.col("value").between(F.col("low"), F.col("high")), F.col("value"))
    # rows outside a bracket collapse to one row per group in the map-side combine
    counted = each.groupBy(*group, "prob", "n", "i", "h", "low", "high", inside.alias("inside")).agg(
        F.count(F.lit(1)).alias("here"),
        F.count_if(F.col("value") < F.col("low")).alias("below"),
        F.max(F.when(F.col("value") < F.col("low"), F.col("value"))).alias("before"),
        F.min(F.when(F.col("value") > F.col("high"), F.col("value"))).alias("after"),
    )
    # a bracket is two margins wide and the sketch may err by half a margin at either end
    if (brackets.agg(F.max("n")).first()[0] or 0) * 3 * margin > BRACKET:
        counted = _narrowed(counted, group)
    held = counted.groupBy(*group, "prob", "n", "i", "h").agg(
        F.sum("below").alias("below"),
        F.max("before").alias("before"),
        F.min("after").alias("after"),
        F.sort_array(F.collect_list(F.when(F.col("inside").isNotNull(), F.struct("inside", "here")))).alias("kinds"),
    )
    picked = held.withColumn("at_i", _at_rank("kinds", F.col("i"))).withColumn(
        "at_next", _at_rank("kinds", F.least(F.col("i") + 1, F.col("n") - 1))
    )
    low = F.when(F.col("i") < F.col("below"), F.col("before")).otherwise(F.coalesce("at_i", "after"))
    high = F.coalesce("at_next", "after")
    return picked.select(
        *group, "prob", "n", (low + (F.col("h") - F.col("i")) * (high - low)).alias("value")
    )


def _at_rank(kinds: str, rank):
    """``inside`` of the (inside, here) pair that holds the 0-based rank, ``below`` rows lying before the first pair."""
    first = F.struct(F.col("below").alias("seen"), F.get(kinds, F.lit(-1))["inside"].alias("found"))
    return F.aggregate(
        kinds,
        first,
        lambda a, x: F.struct(
            (a["seen"] + x["here"]).alias("seen"),
            F.coalesce(a["found"], F.when(a["seen"] + x["here"] > rank, x["inside"])).alias("found"),
        ),
    )["found"]


def _narrowed(counted: DataFrame, group: list[str]) -> DataFrame:
    """Cut every bracket into ``PARTS`` by its distinct values and keep the part with the rank, until all are small."""
    key = [*group, "prob", "n", "i", "h"]
    while True:
        counted = cut(counted)
        brackets = cut(
            counted.groupBy(*key).agg(
                F.count("inside").alias("size"),
                F.sum("below").alias("below"),
                F.percentile_approx("inside", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), 10 * PARTS).alias("edges"),
            )
        )
        if (brackets.agg(F.max("size")).first()[0] or 0) <= BRACKET:
            return counted
        placed = _attach(counted, brackets.select(*key, "edges"), key).withColumn(
            "part", F.when(F.col("inside").isNotNull(), F.size(F.filter("edges", lambda e: e < F.col("inside"))))
        )
        parts = placed.filter(F.col("part").isNotNull()).groupBy(*key, "part").agg(F.sum("here").alias("here"))
        filled = parts.groupBy(*key).agg(
            F.sort_array(F.collect_list(F.struct(F.col("part").alias("inside"), "here"))).alias("parts")
        )
        beyond = F.when(F.col("i") < F.col("below"), F.lit(0)).otherwise(F.lit(PARTS - 1))
        chosen = _attach(filled, brackets.select(*key, "below"), key).select(
            *key, F.coalesce(_at_rank("parts", F.col("i")), beyond).alias("chosen")
        )
        lower, higher = F.col("part") < F.col("chosen"), F.col("part") > F.col("chosen")
        inside = F.when(F.col("part") == F.col("chosen"), F.col("inside"))
        counted = (
            _attach(placed.drop("edges"), cut(chosen), key)
            .groupBy(*key, inside.alias("narrow"))
            .agg(
                F.sum("here").alias("here"),
                F.sum(F.col("below") + F.when(lower, F.col("here")).otherwise(0)).alias("below"),
                F.max(F.greatest("before", F.when(lower, F.col("inside")))).alias("before"),
                F.min(F.least("after", F.when(higher, F.col("inside")))).alias("after"),
            )
            .withColumnRenamed("narrow", "inside")
        )


def _attach(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join on keys that may be NULL, one copy of the keys."""
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{quoted(c)}").eqNullSafe(F.col(f"b.{quoted(c)}")) for c in key])
    return a.join(b, same).select("a.*", *[F.col(f"b.{quoted(c)}") for c in right.columns if c not in key])


def _attach_per_column(values: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Add the columns of a written table that has one row per (by..., column).

    Without groups the table is one scalar map, so the values are not shuffled. With groups the
    planner knows the size of the written table and broadcasts it when it is small.
    """
    if by:
        return _attach(values, table, [*by, "column"])
    extra = [c for c in table.columns if c != "column"]
    entry = F.struct("column", F.struct(*extra).alias("row"))
    lookup = table.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
    found = values.withColumn("_row", lookup[F.col("column")])
    return found.select(*values.columns, *[F.col(f"_row.{c}").alias(c) for c in extra])


def quantiles_wide(df: DataFrame, cols, probs: dict[str, float], by=(), rank=linear_rank) -> DataFrame:
    """One row per (by, column), one column per named quantile."""
    table = quantile_table(df, cols, sorted(set(probs.values())), by, rank)
    return table.groupBy(*by, "column").agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in probs.items()]
    )


def _moments(df: DataFrame, cols, by=()) -> DataFrame:
    """Count, missing count, mean and sample deviation, one row per (by, column)."""
    wide = df.select(*by, *[F.col(quoted(c)).cast("double").alias(c) for c in cols])
    long = wide.unpivot(list(by), list(cols), "column", "value")
    v = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy(*by, "column").agg(
        F.count(v).alias("n"),
        (F.count(F.lit(1)) - F.count(v)).alias("n_missing"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.var_samp(v).alias("variance"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def summary_numeric(df: DataFrame, cols=None, by=()) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count, long form."""
    cols = numeric_columns(df) if cols is None else list(cols)
    base = _moments(df, cols, by)
    middle = quantiles_wide(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    keys = [*by, "column"]
    return base.join(middle, keys, "left").select(
        *keys, "n", "n_missing", "min", "q1", "median", "mean", "q3", "max"
    )


def summary_dates(df: DataFrame, cols, by=()) -> DataFrame:
    """Least, quartiles, mean and greatest day of date or timestamp columns, the missing count and the range in days.

    A timestamp counts as its day; a quantile or mean between two days is the earlier one.
    """
    days = df.select(*by, *[F.unix_date(F.col(quoted(c)).cast("date")).alias(c) for c in cols])
    numbers = summary_numeric(days, cols, by)
    day = {c: F.date_from_unix_date(F.floor(c).cast("int")).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")}
    return numbers.select(*by, "column", "n", "n_missing", *day.values(), (F.col("max") - F.col("min")).cast("long").alias("range_days"))


def summary_categorical(df: DataFrame, cols) -> DataFrame:
    """Level counts and shares of string columns, long form."""
    long = df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "level")
    counts = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    # a missing cell is a level too, so every column has as many cells as the table has rows
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    return counts.select("column", "level", "n", ratio(F.col("n"), n_rows).alias("share"))


def summary_table(df: DataFrame, numeric, categorical) -> DataFrame:
    """N, mean, sd, minimum, quartiles, maximum per numeric column; N and percent per level."""
    numbers = _moments(df, numeric).join(
        quantiles_wide(df, numeric, {"pctl25": 0.25, "pctl75": 0.75}), "column"
    )
    left = numbers.select(
        F.col("column").alias("variable"), F.lit(None).cast("string").alias("level"), "n", "mean", "sd", "min",
        "pctl25", "pctl75", "max", F.lit(None).cast("double").alias("percent"),
    )
    empty = [F.lit(None).cast("double").alias(c) for c in ("mean", "sd", "min", "pctl25", "pctl75", "max")]
    right = summary_categorical(df, categorical).select(
        F.col("column").alias("variable"), "level", "n", *empty, (F.col("share") * 100).alias("percent")
    )
    return left.unionByName(right)


def descriptive_stats(df: DataFrame, cols) -> DataFrame:
    """Median, mean, standard error, 95 % half-width, variance, deviation, coefficient of variation."""
    return (
        _moments(df, cols)
        .join(quantiles_wide(df, cols, {"median": 0.5}), "column")
        .withColumn("se_mean", ratio("sd", F.sqrt("n")))
        .withColumn("ci_mean", F.col("se_mean") * t_quantile_975((F.col("n") - 1).cast("double")))
        .select(
            "column", "median", "mean", "se_mean", "ci_mean", "variance", "sd",
            ratio("sd", "mean").alias("coef_var"),
        )
    )


def profile_intro(df: DataFrame) -> DataFrame:
    """Shares of discrete, continuous and all-missing columns, complete rows and missing cells."""
    numeric = set(numeric_columns(df))
    any_missing = reduce(lambda a, b: a | b, [is_missing(f) for f in df.schema.fields])
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~any_missing).alias("n_complete"),
        *[F.count_if(is_missing(f)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)],
    )
    missing = [F.col(f"m{i}") for i in range(len(df.columns))]
    empty = reduce(lambda a, b: a + b, [F.when(m == F.col("n_rows"), 1).otherwise(0) for m in missing])

    def of_kind(wanted: bool):
        flags = [
            F.when(m < F.col("n_rows"), 1).otherwise(0) for c, m in zip(df.columns, missing) if (c in numeric) == wanted
        ]
        return reduce(lambda a, b: a + b, flags, F.lit(0))

    width = F.lit(len(df.columns))
    return counts.select(
        F.col("n_rows"),
        width.cast("long").alias("n_cols"),
        (ratio(of_kind(False), width) * 100).alias("pct_discrete"),
        (ratio(of_kind(True), width) * 100).alias("pct_continuous"),
        (ratio(empty, width) * 100).alias("pct_all_missing"),
        (ratio("n_complete", "n_rows") * 100).alias("pct_complete_rows"),
        (ratio(reduce(lambda a, b: a + b, missing), F.col("n_rows") * width) * 100).alias("pct_missing_cells"),
    )


def group_means(df: DataFrame, by: str, cols) -> DataFrame:
    """Group means that skip missing cells and report how many were skipped."""
    return df.groupBy(by).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in cols],
        *[F.count_if(F.col(c).isNull()).alias(f"n_null_{c}") for c in cols],
    )


def class_shares(df: DataFrame, by: str, label: str, classes) -> DataFrame:
    return df.groupBy(by).agg(
        *[F.avg(F.when(F.col(label) == c, 1.0).otherwise(0.0)).alias(f"{c}_pct") for c in classes]
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def contingency_table(df: DataFrame, left: str, right: str, levels) -> DataFrame:
    """Counts over the whole grid of given levels, zero cells included."""
    counts = df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    # the grid comes from the level list, not from data
    grid = literal_frame(df.sparkSession, [(a, b) for a in levels for b in levels], [left, right])
    return grid.join(counts, [left, right], "left").na.fill(0, ["n"])


def histogram_bins(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width left-closed bins on [min, max]; the last bin is closed on both sides."""
    value = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    extent = value.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("e")).scalar()
    placed = value.withColumn("e", extent).withColumn("width", (F.col("e.hi") - F.col("e.lo")) / bins)
    slot = F.when(F.col("width") > 0, F.floor(F.try_divide(F.col("v") - F.col("e.lo"), F.col("width")))).otherwise(0)
    return (
        placed.groupBy(F.least(slot, F.lit(bins - 1)).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("e.lo").alias("lo"), F.first("width").alias("width"))
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "n",
        )
    )


def box_fences(df: DataFrame, cols, by=(), hinges: bool = False) -> DataFrame:
    """Quartiles (or Tukey hinges) and the fences at 1.5 spreads, one row per (by, column)."""
    base = quantiles_wide(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by, hinge_rank if hinges else linear_rank)
    spread = F.col("q3") - F.col("q1")
    return base.withColumns({"low_fence": F.col("q1") - 1.5 * spread, "high_fence": F.col("q3") + 1.5 * spread})


def box_stats(df: DataFrame, cols, by=(), hinges: bool = False) -> DataFrame:
    """Box-plot statistics: quartiles, whiskers to the outermost points within the fences, outlier count."""
    by = list(by)
    values = _attach_per_column(long_values(df, cols, by), cut(box_fences(df, cols, by, hinges)), by)
    kept = F.when(F.col("value").between(F.col("low_fence"), F.col("high_fence")), F.col("value"))
    return values.groupBy(*by, "column").agg(
        F.min(kept).alias("whisker_low"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.max(kept).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - F.count(kept)).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, key: str, cols) -> DataFrame:
    """The values outside the fences, with their keys."""
    fences = box_fences(df, cols).select("column", "low_fence", "high_fence")
    values = _attach_per_column(long_values(df, cols, [key]), fences, [])
    return values.filter((F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence"))).select(
        key, "column", "value"
    )


def filter_above_quantile(df: DataFrame, column: str, prob: float) -> DataFrame:
    """Rows above a column's own quantile; the threshold is one scalar, so the filter needs no join."""
    threshold = quantile_table(df, [column], [prob]).select("value").scalar()
    return df.filter(F.col(column) > threshold)


def column_sd(df: DataFrame, cols) -> DataFrame:
    return df.agg(*[F.stddev_samp(F.col(quoted(c)).cast("double")).alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "sd"
    )


def arg_max(df: DataFrame, item: str, value: str) -> DataFrame:
    """Item of the greatest value; the least item on ties."""
    return df.agg(
        F.max_by(item, F.struct(F.col(value), -F.col(item))).alias(f"best_{item}"), F.max(value).alias(value)
    )


