"""Linear models, feature importance and principal components.

Only matrices sized by the column count reach the driver; row data stays in tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from minekit.functions.expr import literal_frame
from minekit.lineage import cut
from minekit.operators.clean import drop_incomplete
from minekit.operators.corr import correlation_dense, scale_only, standardise


def independent_columns(df: DataFrame, cols, tolerance: float = 1e-9) -> list[str]:
    """Columns that are not a linear combination of earlier ones (or constant).

    One Gram pass in Spark, then a p x p elimination on the driver in column order.
    """
    spread = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cols]).first().asDict()
    varying = [c for c in cols if spread[c]]
    if len(varying) < 2:
        return varying
    matrix = correlation_dense(df, varying)
    kept: list[int] = []
    for j in range(len(varying)):
        if kept:
            part = matrix[np.ix_(kept, kept)]
            against = matrix[kept, j]
            unexplained = 1.0 - against @ np.linalg.solve(part, against)
        else:
            unexplained = 1.0
        if unexplained > tolerance:
            kept.append(j)
    return [varying[j] for j in kept]


def linear_model(df: DataFrame, cols, target: str) -> DataFrame:
    """Least squares on all independent features: ``(term, coefficient, std_error, t)``; aliased terms are NULL."""
    rows = cut(drop_incomplete(df.select(*[F.col(c).cast("double").alias(c) for c in [*cols, target]])))
    used = independent_columns(rows, cols)
    assembled = VectorAssembler(inputCols=used, outputCol="features").transform(rows)
    model = LinearRegression(labelCol=target, solver="normal", standardization=True).fit(assembled)
    summary = model.summary
    terms = [*used, "(intercept)"]
    values = [*map(float, model.coefficients), float(model.intercept)]
    out = [
        (name, value, float(se), float(t))
        for name, value, se, t in zip(terms, values, summary.coefficientStandardErrors, summary.tValues)
    ]
    fitted = literal_frame(df.sparkSession, out, ["term", "coefficient", "std_error", "t"])
    aliased = [c for c in cols if c not in used]
    if not aliased:
        return fitted
    empty = literal_frame(df.sparkSession, [(c,) for c in aliased], ["term"])
    return fitted.unionByName(empty, allowMissingColumns=True)


def importance_t(df: DataFrame, cols, target: str) -> DataFrame:
    """|t| of each predictor on features divided by their deviation, greatest first."""
    model = linear_model(scale_only(df, cols), cols, target)
    return (
        model.filter((F.col("term") != "(intercept)") & F.col("t").isNotNull())
        .select(F.col("term").alias("feature"), F.abs("t").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def top_features(df: DataFrame, cols, target: str, n: int) -> DataFrame:
    """Project to the ``n`` most important predictors; the target is not a predictor and is not kept."""
    names = [r.feature for r in importance_t(df, cols, target).limit(n).collect()]
    return df.select(*names)


def fold_number(key: str, folds: int, seed: int):
    """Fold from a hash of the key: stable under any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int")


def _gram_rows(width: int, repeats: int):
    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch.iloc[:, :width].to_numpy(float)])
            for r in range(repeats):
                fold = batch.iloc[:, width + r].to_numpy()
                for f in np.unique(fold):
                    part = x[fold == f]
                    sums[(r, int(f))] = sums.get((r, int(f)), 0.0) + part.T @ part
        if sums:
            yield pd.DataFrame(
                {
                    "repeat": [k[0] for k in sums],
                    "fold": [k[1] for k in sums],
                    "gram": [v.ravel().tolist() for v in sums.values()],
                }
            )

    return run


def repeated_cv(df: DataFrame, key: str, cols, target: str, folds: int = 10, repeats: int = 3) -> DataFrame:
    """Repeated k-fold cross-validation of least squares: ``(repeat, fold, n, rmse, r2, mae)``.

    All folds x repeats models come from one pass: a partition adds up one small moment matrix per
    fold, and each training matrix is the total less its fold. A second pass scores all models.
    """
    cols = list(cols)
    width = len(cols) + 1
    numbers = [F.col(c).cast("double").alias(c) for c in [*cols, target]]
    rows = standardise(cut(drop_incomplete(df.select(key, *numbers))), cols)
    rows = cut(rows)
    used = independent_columns(rows, cols)
    keep = [0] + [1 + cols.index(c) for c in used]
    with_folds = rows.select(
        *cols, target, *[fold_number(key, folds, r).alias(f"fold{r}") for r in range(repeats)]
    )
    partial = with_folds.mapInPandas(_gram_rows(width, repeats), "repeat int, fold int, gram array<double>")
    summed = (
        partial.select("repeat", "fold", F.posexplode("gram"))
        .groupBy("repeat", "fold", "pos")
        .agg(F.sum("col").alias("value"))
        .collect()
    )
    # folds x repeats x (p + 2)^2 numbers
    grams = np.zeros((repeats, folds, (width + 1) ** 2))
    for r in summed:
        grams[r["repeat"], r["fold"], r["pos"]] = r["value"]
    grams = grams.reshape(repeats, folds, width + 1, width + 1)
    models = []
    for r in range(repeats):
        total = grams[r].sum(axis=0)
        for f in range(folds):
            train = total - grams[r, f]
            beta = np.linalg.solve(train[np.ix_(keep, keep)], train[keep, width])
            models.append((r, f, *map(float, beta)))
    table = literal_frame(
        df.sparkSession, [(m[0], m[1], list(m[2:])) for m in models], ["repeat", "fold", "beta"]
    )
    scored = with_folds.select(
        F.array(F.lit(1.0), *[F.col(c) for c in used]).alias("x"),
        F.col(target).alias("y"),
        F.posexplode(F.array(*[F.col(f"fold{r}") for r in range(repeats)])).alias("repeat", "fold"),
    ).join(table, ["repeat", "fold"])
    guess = F.aggregate(
        F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v
    )
    residual = F.col("y") - F.col("guess")
    return (
        scored.withColumn("guess", guess)
        .groupBy("repeat", "fold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(residual * residual)).alias("rmse"),
            F.pow(
                F.try_divide(F.covar_pop("y", "guess"), F.stddev_pop("y") * F.stddev_pop("guess")), 2
            ).alias("r2"),
            F.avg(F.abs(residual)).alias("mae"),
        )
    )


def _signed(loadings: np.ndarray) -> np.ndarray:
    """Flip each axis so its largest loading in size is positive."""
    top = np.argmax(np.abs(loadings), axis=0)
    signs = np.sign(loadings[top, range(loadings.shape[1])])
    return loadings * np.where(signs == 0, 1.0, signs)


class PcaResult:
    """Loadings (variables x axes) and the variance share of each axis."""

    def __init__(self, spark, cols, loadings: np.ndarray, variances: np.ndarray):
        self.spark, self.cols = spark, list(cols)
        self.loadings, self.variances = _signed(loadings), variances

    def loading_table(self, axes: int = 2) -> DataFrame:
        rows = [(c, a + 1, float(self.loadings[i, a])) for i, c in enumerate(self.cols) for a in range(axes)]
        return literal_frame(self.spark, rows, ["variable", "axis", "loading"])

    def scree_table(self) -> DataFrame:
        share = self.variances / self.variances.sum()
        rows = [(a + 1, float(v), float(100 * s)) for a, (v, s) in enumerate(zip(self.variances, share))]
        return literal_frame(self.spark, rows, ["axis", "variance", "percent"])

    def cos2_table(self, axes: int = 2) -> DataFrame:
        """Coordinates of the variables and their squared cosine with the first axes."""
        coords = self.loadings * np.sqrt(np.maximum(self.variances, 0.0))
        norm = (coords**2).sum(axis=1)
        rows = [
            (c, float(coords[i, 0]), float(coords[i, 1]), float((coords[i, :axes] ** 2).sum() / norm[i]))
            for i, c in enumerate(self.cols)
        ]
        return literal_frame(self.spark, rows, ["variable", "coord_1", "coord_2", "cos2"])

    def scores(self, df: DataFrame, key: str, axes: int = 2) -> DataFrame:
        """Rows of a standardised frame projected on the first axes; plain Column arithmetic."""
        out = []
        for a in range(axes):
            terms = [F.col(c) * F.lit(float(self.loadings[i, a])) for i, c in enumerate(self.cols)]
            out.append(sum(terms[1:], terms[0]).alias(f"axis_{a + 1}"))
        return df.select(key, *out)


def pca_fit(df: DataFrame, cols) -> PcaResult:
    """Principal components of the standardised columns."""
    rows = cut(drop_incomplete(standardise(df, cols).select(*cols)))
    vectors = VectorAssembler(inputCols=list(cols), outputCol="v").transform(rows)
    model = PCA(k=len(cols), inputCol="v", outputCol="s").fit(vectors)
    share = model.explainedVariance.toArray()
    return PcaResult(df.sparkSession, cols, model.pc.toArray(), share * len(cols))


def pca_of_matrix(df: DataFrame, cols) -> PcaResult:
    """Compatibility mode: the correlation matrix itself is taken as p data rows, divisor p."""
    matrix = correlation_dense(drop_incomplete(df.select(*cols)), cols)
    centred = matrix - matrix.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(cols))
    order = np.argsort(-values)
    return PcaResult(df.sparkSession, cols, vectors[:, order], np.maximum(values[order], 0.0))


