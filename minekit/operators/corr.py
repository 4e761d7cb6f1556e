"""Scaling and correlation. Matrices are long frames ``(var_i, var_j, r, n)``."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from minekit.functions.expr import literal_frame, quoted, ratio
from minekit.functions.special import t_p_value
from minekit.operators.clean import drop_incomplete


def _double(c: str):
    v = F.col(quoted(c)).cast("double")
    return F.when(~F.isnan(v), v)


def _moment_row(df: DataFrame, cols):
    """Mean and deviation of every column as one scalar struct, computed once and used as a literal."""
    fields = [F.avg(_double(c)).alias(f"m{i}") for i, c in enumerate(cols)]
    fields += [F.stddev_samp(_double(c)).alias(f"s{i}") for i, c in enumerate(cols)]
    return df.agg(F.struct(*fields).alias("moments")).scalar()


def standardise(df: DataFrame, cols) -> DataFrame:
    """(x - mean) / sample sd; a constant column becomes NULL."""
    wide = df.withColumn("_m", _moment_row(df, cols))
    scaled = {c: ratio(_double(c) - F.col(f"_m.m{i}"), F.col(f"_m.s{i}")) for i, c in enumerate(cols)}
    return wide.withColumns(scaled).drop("_m")


def scale_only(df: DataFrame, cols) -> DataFrame:
    """x / sample sd, without centring."""
    wide = df.withColumn("_m", _moment_row(df, cols))
    return wide.withColumns({c: ratio(_double(c), F.col(f"_m.s{i}")) for i, c in enumerate(cols)}).drop("_m")


def zscore_outliers(df: DataFrame, cols, limit: float = 3.0) -> DataFrame:
    """Drop rows with any column more than ``limit`` deviations from its mean."""
    wide = df.withColumn("_m", _moment_row(df, cols))
    far = F.lit(False)
    for i, c in enumerate(cols):
        z = F.abs(ratio(_double(c) - F.col(f"_m.m{i}"), F.col(f"_m.s{i}")))
        far = far | F.coalesce(z > limit, F.lit(False))
    return wide.filter(~far).drop("_m")


def _pair_moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, means, centred sums and extremes of [i, j], of column i over the rows where i and j are present."""
    p, present = x.shape[1], ~np.isnan(x)
    out = {name: np.zeros((p, p)) for name in ("n", "mean", "square", "product")}
    out["low"], out["high"] = np.full((p, p), np.inf), np.full((p, p), -np.inf)
    for j in range(p):
        rows = present[:, j]
        if not rows.any():
            continue
        m, own = present[rows], x[rows, j][:, None]
        values = np.where(m, x[rows], 0.0)
        n = m.sum(axis=0)
        some = np.maximum(n, 1)
        mean, other = values.sum(axis=0) / some, (m * own).sum(axis=0) / some
        away = np.where(m, values - mean, 0.0)
        out["n"][:, j], out["mean"][:, j] = n, mean
        out["square"][:, j], out["product"][:, j] = (away * away).sum(axis=0), (away * (own - other)).sum(axis=0)
        out["low"][:, j] = np.where(m, values, np.inf).min(axis=0)
        out["high"][:, j] = np.where(m, values, -np.inf).max(axis=0)
    return out


def _merge_moments(a, b):
    """Moments of two sets of rows together."""
    n = a["n"] + b["n"]
    some, step = np.maximum(n, 1), np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
    both = a["n"] * b["n"] / some
    return {
        "n": n, "mean": (a["n"] * a["mean"] + b["n"] * b["mean"]) / some,
        "square": a["square"] + b["square"] + step * step * both, "product": a["product"] + b["product"] + step * step.T * both,
        "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"]),
    }


def pair_moments(df: DataFrame, cols, by=()) -> DataFrame:
    """``(by..., i, j, n, xx, yy, xy, flat)`` per pair of column positions i < j, in one pass over the rows.

    Missing cells are masked: all moments run over the rows where both columns are present, and are centred on the
    means of those rows. ``flat`` says that one of the two has a single value there. The plan is the same for any
    number of columns.
    """
    cols, by = list(cols), list(by)
    p = len(cols)
    names, key_names = [f"v{i}" for i in range(p)], [f"k{i}" for i in range(len(by))]
    plain = df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(by, key_names)], *[_double(c).alias(v) for c, v in zip(cols, names)])
    left, right = np.triu_indices(p, 1)
    fields = {"n": "n", "mx": "mean", "xx": "square", "xy": "product", "x0": "low", "x1": "high"}
    mirrored = {"my": "mean", "yy": "square", "y0": "low", "y1": "high"}

    def table(moments, key=()):
        out = {n: [v] * len(left) for n, v in zip(key_names, key)} | {"i": left.astype("int32"), "j": right.astype("int32")}
        out |= {n: moments[m][left, right] for n, m in fields.items()} | {n: moments[m][right, left] for n, m in mirrored.items()}
        return pd.DataFrame(out)

    def run(batches):
        total = _pair_moments(np.zeros((0, p)))
        for batch in batches:
            if not by:
                total = _merge_moments(total, _pair_moments(batch[names].to_numpy(float)))
                continue
            for k, g in batch.groupby(key_names, dropna=False, sort=False):
                yield table(_pair_moments(g[names].to_numpy(float)), k if isinstance(k, tuple) else (k,))
        if not by:
            yield table(total)

    doubles = [*fields, *mirrored]
    schema = T.StructType(
        [T.StructField(n, plain.schema[n].dataType) for n in key_names] + [T.StructField(n, T.IntegerType()) for n in ("i", "j")] + [T.StructField(n, T.DoubleType()) for n in doubles]
    )
    group = [*key_names, "i", "j"]
    whole = Window.partitionBy(*group)
    parts = plain.mapInPandas(run, schema)
    shift = {c: F.col(c) - ratio(F.sum(F.col("n") * F.col(c)).over(whole), F.sum("n").over(whole)) for c in ("mx", "my")}
    parts = parts.withColumns({f"d{c}": v for c, v in shift.items()})

    def centred(c, one, two):
        return F.sum(F.col(c) + F.coalesce(F.col("n") * F.col(one) * F.col(two), F.lit(0.0))).alias(c)

    summed = parts.groupBy(*group).agg(
        F.sum("n").alias("n"), centred("xx", "dmx", "dmx"), centred("yy", "dmy", "dmy"), centred("xy", "dmx", "dmy"),
        ((F.min("x0") >= F.max("x1")) | (F.min("y0") >= F.max("y1"))).alias("flat"),
    )
    return summed.select(*[F.col(n).alias(c) for n, c in zip(key_names, by)], "i", "j", "n", "xx", "yy", "xy", "flat")


def correlation_pairs(df: DataFrame, cols, by=()) -> DataFrame:
    """``(by..., var_i, var_j, r, n)`` for each unordered pair, over the rows where both columns are present."""
    cols, by = list(cols), list(by)
    r = F.when(~F.col("flat"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))))
    names = F.array(*[F.lit(c) for c in cols])
    return pair_moments(df, cols, by).select(
        *by, F.element_at(names, F.col("i") + 1).alias("var_i"), F.element_at(names, F.col("j") + 1).alias("var_j"), r.alias("r"), F.col("n").cast("long").alias("n")
    )


def correlation_dense(df: DataFrame, cols) -> np.ndarray:
    """p x p matrix on the driver for p columns; entries without a correlation are NaN."""
    place = {c: i for i, c in enumerate(cols)}
    out = np.eye(len(place))
    for row in correlation_pairs(df, cols).collect():
        i, j = place[row.var_i], place[row.var_j]
        out[i, j] = out[j, i] = np.nan if row.r is None else row.r
    return out


def correlation_matrix(df: DataFrame, cols, full: bool = True) -> DataFrame:
    """Pearson matrix where a missing cell in either column makes the entry NULL."""
    cols = list(cols)
    total = df.agg(F.count(F.lit(1))).scalar()
    upper = correlation_pairs(df, cols).select("var_i", "var_j", F.when(F.col("n") == total, F.col("r")).alias("r"))
    return mirror(upper, cols) if full else upper


def mirror(upper: DataFrame, cols) -> DataFrame:
    """Upper triangle to the full matrix with a unit diagonal."""
    lower = upper.select(F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), "r")
    diagonal = df_of_names(upper, cols).select(
        F.col("name").alias("var_i"), F.col("name").alias("var_j"), F.lit(1.0).alias("r")
    )
    return upper.unionByName(lower).unionByName(diagonal)


def df_of_names(like: DataFrame, cols) -> DataFrame:
    return literal_frame(like.sparkSession, list(enumerate(cols)), ["position", "name"])


def correlation_complete(df: DataFrame, cols) -> DataFrame:
    """Matrix over the rows complete in all the columns; NULL entries when there is none."""
    complete = drop_incomplete(df.select(*cols), cols)
    return mirror(correlation_pairs(complete, cols).select("var_i", "var_j", "r"), list(cols))


def correlation_test(df: DataFrame, cols) -> DataFrame:
    """Per pair: r and n over pairwise-complete rows, t on n - 2 degrees of freedom, two-sided p."""
    pairs = correlation_pairs(df, cols)
    t = F.col("r") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    with_t = pairs.withColumn("t", F.when(F.abs("r") < 1, t))
    return with_t.withColumn("p", t_p_value("t", (F.col("n") - 2).cast("double")))


def correlation_significant(df: DataFrame, cols, t_limit: float, triangle: str = "upper") -> DataFrame:
    """Entries whose test statistic passes ``t_limit``; one triangle or both."""
    pairs = correlation_pairs(df, cols)
    t = F.abs(F.col("r")) * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    kept = pairs.withColumn("t", t).filter(F.col("t") > t_limit).select("var_i", "var_j", "r")
    if triangle == "upper":
        return kept
    return kept.unionByName(kept.select(F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), "r"))


def correlation_order(df: DataFrame, cols) -> DataFrame:
    """Order variables by complete-link merging on 1 - r; p x p work on the driver, p = column count."""
    cols = list(cols)
    r = {(row.var_i, row.var_j): row.r for row in correlation_matrix(df, cols).collect()}
    groups = [[c] for c in cols]

    def gap(a, b):
        return max(1.0 - (r[(x, y)] if r[(x, y)] is not None else 0.0) for x in a for y in b)

    while len(groups) > 1:
        i, j = min(combinations(range(len(groups)), 2), key=lambda ij: (gap(groups[ij[0]], groups[ij[1]]), ij))
        groups[i] = groups[i] + groups.pop(j)
    return df_of_names(df, groups[0])


def redundant_by_mean_corr(df: DataFrame, cols, cutoff: float) -> DataFrame:
    """For each pair above the cutoff in size, suggest the column with the larger mean |r|; ties the later one."""
    cols = list(cols)
    matrix = correlation_matrix(df, cols)
    off = matrix.filter(F.col("var_i") != F.col("var_j")).withColumn("a", F.abs("r"))
    means = off.groupBy("var_i").agg(F.avg("a").alias("mean_abs_r"))
    place = df_of_names(df, cols)
    ranked = means.join(place, F.col("var_i") == F.col("name")).select("name", "position", "mean_abs_r")
    one = ranked.select(F.col("name").alias("var_i"), F.struct("mean_abs_r", "position", "name").alias("a1"))
    two = ranked.select(F.col("name").alias("var_j"), F.struct("mean_abs_r", "position", "name").alias("a2"))
    return (
        off.filter(F.col("a") > cutoff)
        .join(one, "var_i")
        .join(two, "var_j")
        .select(F.greatest("a1", "a2").alias("drop"))
        .select(F.col("drop.name").alias("name"), F.col("drop.mean_abs_r").alias("mean_abs_r"))
        .distinct()
    )


def collinear_columns(df: DataFrame, cols, cutoff: float = 0.95, signed: bool = True) -> DataFrame:
    """Columns judged by any later column: ``(name, because_of, r)``, from one matrix, not greedily."""
    upper = correlation_matrix(df, cols, full=False)
    r = F.col("r") if signed else F.abs("r")
    return upper.filter(r > cutoff).select(
        F.col("var_i").alias("name"), F.col("var_j").alias("because_of"), "r"
    )


def drop_collinear(df: DataFrame, cols, cutoff: float = 0.95, signed: bool = True) -> DataFrame:
    dropped = {row.name for row in collinear_columns(df, cols, cutoff, signed).select("name").distinct().toLocalIterator()}
    return df.drop(*dropped)


def correlation_dummies(df: DataFrame, numeric, categorical, max_levels: int = 20) -> DataFrame:
    """Correlations of numeric columns with 0/1 columns of the low-cardinality strings."""
    # a set of at most max_levels + 1 values per column says exactly whether it has too many
    low = [c for c in categorical if df.select(c).filter(F.col(c).isNotNull()).distinct().limit(max_levels + 1).count() <= max_levels]
    encoded, names = df, list(numeric)
    for c in low:
        levels = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).collect()]
        dummies = {f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for v in levels}
        encoded = encoded.withColumns(dummies)
        names += list(dummies)
    return mirror(correlation_pairs(encoded, names).select("var_i", "var_j", "r"), names)


