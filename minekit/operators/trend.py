"""Dated series and trend lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minekit.functions.expr import ratio
from minekit.functions.special import t_quantile_975

GRID = 80


def event_markers(df: DataFrame, date: str, markers: list[tuple[str, str]], ids, measures) -> DataFrame:
    """Long dated series, each date labelled with the latest marker on or before it.

    The marker list is a handful of literals, so the as-of lookup is a CASE, not a range join.
    """
    chain = None
    for day, name in sorted(markers, reverse=True):
        condition = F.col(date) >= F.lit(day).cast("date")
        chain = F.when(condition, F.lit(name)) if chain is None else chain.when(condition, F.lit(name))
    wide = df.select(*ids, date, chain.alias("marker"), *[F.col(m).cast("double").alias(m) for m in measures])
    return wide.unpivot([*ids, date, "marker"], list(measures), "measure", "value")


def linear_trend(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Least-squares line of y on x with the residual standard error, from one aggregate."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    m = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(a).alias("mean_x"),
        F.avg(b).alias("mean_y"),
        F.var_pop(a).alias("vx"),
        F.var_pop(b).alias("vy"),
        F.covar_pop(a, b).alias("vxy"),
        F.min(a).alias("min_x"),
        F.max(a).alias("max_x"),
    )
    slope = ratio("vxy", "vx")
    rss = F.col("n") * (F.col("vy") - slope * F.col("vxy"))
    return m.select(
        *by,
        "n",
        slope.alias("slope"),
        (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"),
        ratio(F.col("vxy") * F.col("vxy"), F.col("vx") * F.col("vy")).alias("r2"),
        F.sqrt(ratio(F.greatest(rss, F.lit(0.0)), F.when(F.col("n") > 2, F.col("n") - 2))).alias("residual_se"),
        "mean_x",
        (F.col("n") * F.col("vx")).alias("sxx"),
        "min_x",
        "max_x",
    )


def linear_band(df: DataFrame, x: str, y: str, grid: int = GRID) -> DataFrame:
    """The fitted line and its 95 % band on an even grid over the range of x."""
    line = linear_trend(df, x, y).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    at = F.col("min_x") + (F.col("max_x") - F.col("min_x")) * F.col("g") / F.lit(grid - 1)
    placed = line.withColumn("x", at)
    half = (
        t_quantile_975((F.col("n") - 2).cast("double"))
        * F.col("residual_se")
        * F.sqrt(ratio(F.lit(1), "n") + ratio((F.col("x") - F.col("mean_x")) * (F.col("x") - F.col("mean_x")), "sxx"))
    )
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    return placed.select("x", fit.alias("fit"), half.alias("half")).select(
        "x", "fit", (F.col("fit") - F.col("half")).alias("low"), (F.col("fit") + F.col("half")).alias("high")
    )


def local_trend(df: DataFrame, x: str, y: str, grid: int = GRID, span: float = 0.75) -> DataFrame:
    """Tricube-weighted local quadratic at ``grid`` points.

    Rows collapse to one per distinct x first (count, sum and sum of squares of y). The window of a
    grid point reaches to the ``span`` quantile of the distances, taken from a bounded sketch.
    """
    a, b = F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    rows = df.select(a, b).filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    extent = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()

    def point(i: int):
        return F.col("e.lo") + (F.col("e.hi") - F.col("e.lo")) * F.lit(i / (grid - 1))

    reach = (
        rows.withColumn("e", extent)
        .agg(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("g"),
                        F.first(point(i)).alias("at"),
                        F.percentile_approx(F.abs(F.col("x") - point(i)), span, 10_000).alias("h"),
                    )
                    for i in range(grid)
                ]
            ).alias("grid")
        )
        .scalar()
    )
    distinct = rows.groupBy("x").agg(
        F.count(F.lit(1)).alias("c"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")
    )
    spread = distinct.select("x", "c", "sy", "syy", F.explode(reach).alias("p")).select(
        "c", "sy", "syy", "p.g", "p.at", "p.h", ratio(F.col("x") - F.col("p.at"), "p.h").alias("u")
    )
    near = spread.filter(F.abs("u") < 1)
    u = F.col("u")
    w = F.pow(1 - F.pow(F.abs(u), 3), 3)
    wc = w * F.col("c")
    s = near.groupBy("g", "at").agg(
        F.count(F.lit(1)).alias("n_x"),
        *[F.sum(wc * F.pow(u, k)).alias(f"s{k}") for k in range(5)],
        *[F.sum(w * F.col("sy") * F.pow(u, k)).alias(f"t{k}") for k in range(3)],
        F.sum(w * F.col("syy")).alias("q"),
    )
    c = {name: F.col(name) for name in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}
    # cofactors of the symmetric 3 x 3 normal matrix
    k00 = c["s2"] * c["s4"] - c["s3"] * c["s3"]
    k01 = c["s2"] * c["s3"] - c["s1"] * c["s4"]
    k02 = c["s1"] * c["s3"] - c["s2"] * c["s2"]
    k11 = c["s0"] * c["s4"] - c["s2"] * c["s2"]
    k12 = c["s1"] * c["s2"] - c["s0"] * c["s3"]
    k22 = c["s0"] * c["s2"] - c["s1"] * c["s1"]
    det = c["s0"] * k00 + c["s1"] * k01 + c["s2"] * k02
    b0 = ratio(k00 * c["t0"] + k01 * c["t1"] + k02 * c["t2"], det)
    b1 = ratio(k01 * c["t0"] + k11 * c["t1"] + k12 * c["t2"], det)
    b2 = ratio(k02 * c["t0"] + k12 * c["t1"] + k22 * c["t2"], det)
    rss = F.greatest(F.col("q") - b0 * c["t0"] - b1 * c["t1"] - b2 * c["t2"], F.lit(0.0))
    enough = F.col("n_x") >= 3
    # the intercept at the grid point has variance sigma^2 times the first diagonal cofactor over det
    se = F.sqrt(ratio(rss, "s0") * ratio(k00, det))
    return s.select(F.col("g"), F.col("at").alias("x"), F.when(enough, b0).alias("fit"), F.when(enough, se).alias("se"))
