"""Labels, splits, feature ranking, classifiers and their evaluation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from minekit.functions import special
from minekit.functions.expr import literal_frame, ratio
from minekit.lineage import cut, number_rows, steady_layout
from minekit.operators import network, space
from minekit.operators.clean import drop_incomplete, filter_not_in
from minekit.operators.profile import contingency_table, quantiles_wide

FITS_AT_ONCE = 8
#: Folds of a grid whose training rows are kept at a time.
FOLDS_AT_ONCE = 2


# ---------------------------------------------------------------- labels and splits


# Class cuts on deaths per case
HIGH_RISK, MEDIUM_RISK = 0.016, 0.011


def risk_class(column, high: float = HIGH_RISK, medium: float = MEDIUM_RISK) -> Column:
    """Above ``high``, above ``medium``, else low; a NULL falls to low."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c > high, "high").when(c > medium, "medium").otherwise("low")


def class_balance(df: DataFrame, label: str, part: str) -> DataFrame:
    """Class counts overall and within each part, from one aggregate."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label, part).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy(label).agg(F.sum("n").alias("n")).withColumn(part, F.lit("all"))
    return counts.unionByName(overall)


def group_holdout(df: DataFrame, group: str, held_out) -> tuple[DataFrame, DataFrame]:
    """Whole groups to (train, test); a row without a group trains."""
    return filter_not_in(df, group, held_out), df.filter(F.col(group).isin(*held_out))


def _class_position(df: DataFrame, key: str, label: str, seed: int | None) -> DataFrame:
    """Position of a row inside its class, in hash order of the key (or key order without a seed)."""
    order = F.col(key) if seed is None else F.xxhash64(F.lit(seed), F.col(key))
    return number_rows(df.withColumn("_order", order), ["_order", key], [label], "_position").drop("_order")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 10, seed: int | None = None) -> DataFrame:
    """Add ``fold``: classes dealt out evenly, each row in exactly one fold."""
    placed = _class_position(df, key, label, seed)
    return placed.withColumn("fold", F.pmod("_position", F.lit(k)).cast("int")).drop("_position")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8, seed: int | None = None) -> DataFrame:
    """Add ``part``: the first ``ceil(share * n)`` rows of each class train, the rest test."""
    placed = _class_position(df, key, label, seed)
    sizes = cut(df.groupBy(F.col(label).alias("_label")).agg(F.ceil(F.count(F.lit(1)) * share).alias("_train")))
    joined = placed.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    part = F.when(F.col("_position") < F.col("_train"), "train").otherwise("test")
    return joined.withColumn("part", part).drop("_position", "_label", "_train")


# ---------------------------------------------------------------- feature ranking


def cramers_v(df: DataFrame, label: str, cols) -> DataFrame:
    """Cramer's V of the label with each binned column: ``(feature, n_bins, chi2, v)``."""
    long = df.select(F.col(label).alias("class"), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ["class"], list(cols), "feature", "bin"
    )
    counts = long.filter(F.col("bin").isNotNull() & F.col("class").isNotNull()).groupBy("feature", "bin", "class").agg(
        F.count(F.lit(1)).alias("n")
    )
    return v_from_counts(counts)


def v_from_counts(counts: DataFrame) -> DataFrame:
    """chi-squared is n (sum n_ij^2 / (n_i n_j) - 1), so empty cells need no rows."""
    bins = counts.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    classes = counts.groupBy("feature", "class").agg(F.sum("n").alias("n_class"))
    n = F.sum("n")
    cells = counts.join(bins, ["feature", "bin"]).join(classes, ["feature", "class"])
    square = F.col("n").cast("double") * F.col("n")
    per = cells.groupBy("feature").agg(
        n.alias("n"),
        F.count_distinct("bin").alias("n_bins"),
        F.count_distinct("class").alias("n_classes"),
        F.sum(ratio(square, F.col("n_bin").cast("double") * F.col("n_class"))).alias("fit"),
    )
    chi2 = F.greatest(F.col("n") * (F.col("fit") - 1), F.lit(0.0))
    smaller = F.least(F.col("n_bins"), F.col("n_classes")) - 1
    v = F.when(smaller > 0, F.sqrt(ratio(chi2, F.col("n") * smaller))).otherwise(0.0)
    return per.select("feature", "n_bins", chi2.alias("chi2"), v.alias("v"))


def value_counts(df: DataFrame, label: str, cols) -> DataFrame:
    """Class counts ``(feature, value, class, n)`` per distinct value; a missing cell leaves out its own feature only."""
    def cell(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v).alias(c)

    long = df.select(F.col(label).alias("class"), *[cell(c) for c in cols]).unpivot(["class"], list(cols), "feature", "value")
    return long.filter(F.col("value").isNotNull() & F.col("class").isNotNull()).groupBy("feature", "value", "class").agg(F.count(F.lit(1)).alias("n"))


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def _pays(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the gain of a split into class counts ``a`` and ``b`` pays for its description."""
    total = a + b
    n = total.sum()
    whole = _entropy(total)
    e = (a.sum() * _entropy(a) + b.sum() * _entropy(b)) / n
    k, k1, k2 = (int((v > 0).sum()) for v in (total, a, b))
    delta = math.log2(3**k - 2) - (k * whole - k1 * _entropy(a) - k2 * _entropy(b))
    return whole - e > (math.log2(n - 1) + delta) / n


def _segment(cuts, feature: str, column: str) -> Column:
    """Number of cuts of a feature at or below its value."""
    table = F.create_map(*[x for c, v in cuts.items() for x in (F.lit(c), F.array(*[F.lit(float(y)) for y in v]).cast("array<double>"))])
    return F.size(F.filter(table[F.col(feature)], lambda y: y <= F.col(column)))


def mdl_discretise(df: DataFrame, label: str, cols):
    """Supervised cuts per feature: ``{feature: [cut, ...]}`` and the counts they are judged on.

    A cut is the least value of its upper side. Any border between two distinct values may be one: the values lie in
    range partitions, and prefix sums inside a range, shifted by the sums of the earlier ranges, give the class
    counts below each value. Every round splits all open segments of all features; only the best split of each
    segment reaches the driver.
    """
    cols = list(cols)
    counts = cut(value_counts(df, label, cols))
    classes = [r[0] for r in counts.select("class").distinct().orderBy("class").collect()]
    cuts = {c: [] for c in cols}
    if not classes:
        return cuts, counts
    names = [f"n{i}" for i in range(len(classes))]
    wide = counts.groupBy("feature", "value").agg(
        *[F.sum(F.when(F.col("class") == v, F.col("n")).otherwise(0)).alias(n) for v, n in zip(classes, names)]
    )
    ranged = cut(wide.repartitionByRange("feature", "value").withColumn("range", F.spark_partition_id()))
    closed = set()
    while True:
        placed = ranged.withColumn("segment", _segment(cuts, "feature", "value"))
        # one row per range and segment: bounded by the partitions plus the accepted cuts
        sizes = placed.groupBy("feature", "segment", "range").agg(*[F.sum(n).alias(n) for n in names])
        group = Window.partitionBy("feature", "segment")
        before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = cut(sizes.select(
            "feature", "segment", "range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o_{n}") for n in names],
            *[F.sum(n).over(group).alias(f"t_{n}") for n in names],
        ))
        inside = Window.partitionBy("range", "feature", "segment").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        below = placed.select("feature", "segment", "range", "value", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in names])
        sides = below.join(offsets, ["feature", "segment", "range"])
        left = [F.col(n) + F.col(f"o_{n}") for n in names]
        right = [F.col(f"t_{n}") - x for n, x in zip(names, left)]

        def bits(side):
            """Rows times class entropy of a side."""
            def part(x):
                return F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(0.0)

            return part(sum(side[1:], side[0])) - sum((part(x) for x in side[1:]), part(side[0]))

        least = F.min(F.struct(F.round(bits(left) + bits(right), 6).alias("e"), "value", F.array(*left).alias("a"), F.array(*right).alias("b")))
        best = sides.filter(sum(left[1:], left[0]) > 0).groupBy("feature", "segment").agg(least.alias("best")).collect()
        found = []
        for r in best:
            at = cuts[r.feature]
            span = (r.feature, at[r.segment - 1] if r.segment else None, at[r.segment] if r.segment < len(at) else None)
            if span in closed:
                continue
            if _pays(np.array(r.best.a, float), np.array(r.best.b, float)):
                found.append((r.feature, r.best.value))
            else:
                closed.add(span)
        if not found:
            return cuts, counts
        for c, v in found:
            cuts[c] = sorted([*cuts[c], v])


def mdl_cuts(df: DataFrame, label: str, cols) -> DataFrame:
    cuts, _ = mdl_discretise(df, label, cols)
    rows = [(c, i + 1, v) for c in cols for i, v in enumerate(cuts[c])]
    if not rows:
        return literal_frame(df.sparkSession, [("", 0, 0.0)], ["feature", "position", "cut"]).limit(0)
    return literal_frame(df.sparkSession, rows, ["feature", "position", "cut"])


def rank_features(df: DataFrame, label: str, cols) -> DataFrame:
    """Cramer's V of each feature after supervised discretisation; a feature without a cut scores 0."""
    cuts, counts = mdl_discretise(df, label, cols)
    placed = counts.withColumn("bin", _segment(cuts, "feature", "value").cast("string"))
    return v_from_counts(placed.groupBy("feature", "bin", "class").agg(F.sum("n").alias("n"))).orderBy(F.desc("v"), "feature")


# ---------------------------------------------------------------- nearest neighbours


def scaled_like(train: DataFrame, test: DataFrame, cols):
    """Both frames divided by the deviations of the training rows."""
    deviations = train.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in cols]).alias("s"))

    def scale(df: DataFrame) -> DataFrame:
        wide = df.withColumn("_s", deviations.scalar())
        return wide.withColumns({c: ratio(F.col(c), F.col(f"_s.{c}")) for c in cols}).drop("_s")

    return scale(train), scale(test)


def knn_classify(
    train: DataFrame, test: DataFrame, key: str, cols, label: str, ks, scaled: bool = True,
    leaf_points: int = space.LEAF_POINTS,
) -> DataFrame:
    """Majority vote of the k nearest training rows for every k at once: ``(key, k, predicted)``.

    One neighbour search to rank max(ks) serves all k. Distance ties go to the lower key, vote ties to
    the first class in alphabetical order.
    """
    cols, ks = list(cols), sorted(set(ks))
    train = drop_incomplete(train.select(key, label, *cols))
    test = drop_incomplete(test.select(key, *cols))
    if scaled:
        train, test = scaled_like(train, test, cols)
    train, test = cut(train), cut(test)
    places = space.distinct_points(test, key, cols).select(F.col("pid").alias("qid"), *cols)
    found = space.knn_join(places, train, key, cols, ks[-1], leaf_points)
    ranked = found.select("qid", F.posexplode("found").alias("pos", "f")).select(
        "qid", (F.col("pos") + 1).alias("rank"), F.col("f.key").alias(key)
    )
    votes = (
        ranked.join(train.select(key, label), key)
        .withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
        .filter(F.col("rank") <= F.col("k"))
        .groupBy("qid", "k", label)
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    winner = votes.groupBy("qid", "k").agg(
        F.min(F.struct((-F.col("votes")).alias("v"), F.col(label).alias("predicted"))).alias("w")
    )
    per_place = places.join(winner, "qid").select(*cols, "k", F.col("w.predicted").alias("predicted"))
    return test.join(per_place, cols).select(key, "k", "predicted")


def knn_cv(df: DataFrame, key: str, cols, label: str, fold: str, ks) -> DataFrame:
    """Fold metrics of the neighbour vote: ``(model, fold, metric, value)`` on a shared fold column."""
    rows = cut(drop_incomplete(df.select(key, label, fold, *cols)))

    def run(f):
        held = rows.filter(F.col(fold) == f)
        votes = knn_classify(rows.filter(F.col(fold) != f), held, key, cols, label, ks)
        guesses = votes.join(held.select(key, F.col(label).alias("actual")), key)
        named = guesses.withColumn("model", F.format_string("knn k=%d", "k")).withColumn("fold", F.lit(f))
        return confusion_cells(named).collect()

    return metrics_from_cells(_cell_frame(df, _at_once(df, run, _levels(rows, fold))))


def _levels(df: DataFrame, column: str) -> list:
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def _at_once(df: DataFrame, run, tasks) -> list:
    """Run independent fits on a few driver threads and chain their short row lists."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(run), tasks))
    return [row for rows in found for row in rows]


def _cell_frame(df: DataFrame, rows) -> DataFrame:
    # models x folds x classes^2 counts
    names = ["model", "fold", "actual", "predicted", "n"]
    return literal_frame(df.sparkSession, [tuple(r[n] for n in names) for r in rows], names)


# ---------------------------------------------------------------- fitted classifiers


def class_codes(df: DataFrame, label: str) -> list[str]:
    """The classes in alphabetical order; their position is the numeric label."""
    return [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def _with_code(df: DataFrame, label: str, classes) -> DataFrame:
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    return df.withColumn("label", code.cast("double"))


def classifier_stages(kind: str, cols, classes, **settings):
    """Assembler, scaler where it matters, and the estimator of a kind."""
    assemble = VectorAssembler(inputCols=list(cols), outputCol="raw_features")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=kind == "mlp")
    if kind == "forest":
        settings = {"numTrees": 50, "maxDepth": 8, "seed": 1000, **settings}
        return [assemble, RandomForestClassifier(featuresCol="raw_features", **settings)]
    if kind == "tree":
        return [assemble, DecisionTreeClassifier(featuresCol="raw_features", **{"maxDepth": 8, "seed": 1000, **settings})]
    if kind == "bayes":
        return [assemble, NaiveBayes(featuresCol="raw_features", modelType="gaussian", **settings)]
    if kind == "mlp":
        hidden = settings.pop("hidden", 5)
        layers = [len(cols), hidden, len(classes)]
        return [assemble, scale, MultilayerPerceptronClassifier(layers=layers, **{"maxIter": 60, "seed": 1000, **settings})]
    raise ValueError(f"unknown classifier {kind}")


def fit_classifier(train: DataFrame, cols, label: str, kind: str, classes=None, **settings):
    """Fit on complete rows; returns the fitted stages and the class list."""
    rows = fitting_rows(train, cols, label)
    if classes is None:
        classes = class_codes(rows, label)
    model = fit_laid_out(rows, cols, label, kind, classes, **settings)
    rows.unpersist()
    return model, classes


def fitting_rows(train: DataFrame, cols, label: str) -> DataFrame:
    """The complete rows, laid out once and kept for all the passes and fits that read them."""
    return steady_layout(drop_incomplete(train.select(label, *cols))).persist()


def fit_laid_out(rows: DataFrame, cols, label: str, kind: str, classes, **settings):
    return Pipeline(stages=classifier_stages(kind, cols, classes, **settings)).fit(_with_code(rows, label, classes))


def predict(model, classes, test: DataFrame, key: str, cols, name: str = "predicted") -> DataFrame:
    """``(key, <name>)`` for the rows with complete features."""
    scored = model.transform(drop_incomplete(test.select(key, *cols)))
    return scored.select(key, _class_name(classes).alias(name))


def _class_name(classes) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int") + 1)


def predict_all(train: DataFrame, test: DataFrame, key: str, cols, label: str, k: int = 5) -> DataFrame:
    """Predictions of three models side by side, joined by key."""
    out = test.select(key, F.col(label).alias("actual"))
    for kind in ("forest", "mlp"):
        model, classes = fit_classifier(train, cols, label, kind)
        out = out.join(predict(model, classes, test, key, cols, f"predicted_{kind}"), key)
    votes = knn_classify(train, test, key, cols, label, [k])
    return out.join(votes.select(key, F.col("predicted").alias("predicted_knn")), key)


def forest_importance(train: DataFrame, cols, label: str) -> DataFrame:
    """Impurity importances scaled so that the least is 0 and the greatest 100."""
    model, _ = fit_classifier(train, cols, label, "forest")
    raw = model.stages[-1].featureImportances.toArray()
    low, high = float(raw.min()), float(raw.max())
    rows = [(c, float((v - low) / (high - low) * 100) if high > low else 0.0) for c, v in zip(cols, raw)]
    return literal_frame(train.sparkSession, rows, ["feature", "importance"]).orderBy(F.desc("importance"), "feature")


def tune_grid(df: DataFrame, key: str, cols, label: str, fold: str, grid: dict[str, tuple[str, dict]]) -> DataFrame:
    """Cross-validate every candidate on the shared folds: ``(model, fold, metric, value)``.

    ``grid`` maps a candidate name to (kind, settings). Fits overlap, and each gives back only its
    confusion counts. The training rows of a fold are laid out once for all candidates.
    """
    rows = steady_layout(drop_incomplete(df.select(key, label, fold, *cols)), key).persist()
    classes = class_codes(rows, label)

    def run(task):
        name, (kind, settings), f, training = task
        model = fit_laid_out(training, cols, label, kind, classes, **settings)
        held = rows.filter(F.col(fold) == f)
        scored = model.transform(held).select(
            F.lit(name).alias("model"), F.lit(f).alias("fold"), F.col(label).alias("actual"),
            _class_name(classes).alias("predicted"),
        )
        return confusion_cells(scored).collect()

    levels, found = _levels(rows, fold), []
    for some in (levels[i : i + FOLDS_AT_ONCE] for i in range(0, len(levels), FOLDS_AT_ONCE)):
        laid_out = _at_once(df, lambda f: [(f, fitting_rows(rows.filter(F.col(fold) != f), cols, label))], some)
        found += _at_once(df, run, [(name, spec, f, training) for f, training in laid_out for name, spec in grid.items()])
        for _, training in laid_out:
            training.unpersist()
    rows.unpersist()
    return metrics_from_cells(_cell_frame(df, found))


# ---------------------------------------------------------------- evaluation


def confusion_matrix(df: DataFrame, predicted: str, actual: str, classes) -> DataFrame:
    """Counts over the full grid of classes."""
    return contingency_table(df, predicted, actual, classes)


def confusion_cells(guesses: DataFrame) -> DataFrame:
    """Counts of (actual, predicted) per model and fold."""
    return guesses.groupBy("model", "fold", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def fold_metrics(guesses: DataFrame) -> DataFrame:
    """Accuracy and kappa per (model, fold): ``(model, fold, metric, value)``."""
    return metrics_from_cells(confusion_cells(guesses))


def metrics_from_cells(cells: DataFrame) -> DataFrame:
    group = ["model", "fold"]
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    margins = cells.unpivot([*group, "n"], ["actual", "predicted"], "side", "class")
    sides = margins.groupBy(*group, "class").agg(
        F.sum(F.when(F.col("side") == "actual", F.col("n")).otherwise(0)).alias("n_actual"),
        F.sum(F.when(F.col("side") == "predicted", F.col("n")).otherwise(0)).alias("n_predicted"),
    )
    chance = sides.groupBy(*group).agg(F.sum(F.col("n_actual").cast("double") * F.col("n_predicted")).alias("by_chance"))
    per = cells.groupBy(*group).agg(F.sum("n").alias("n"), right.alias("right")).join(chance, group)
    accuracy = ratio("right", "n")
    expected = ratio("by_chance", F.col("n").cast("double") * F.col("n"))
    return per.select(
        *group, accuracy.alias("accuracy"), ratio(accuracy - expected, 1 - expected).alias("kappa")
    ).unpivot(group, ["accuracy", "kappa"], "metric", "value")


def best_candidate(metrics: DataFrame, candidates: list[str]) -> DataFrame:
    """``(model, mean)`` of the candidate with the greatest mean accuracy; of equal ones the one listed first."""
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model"))
    means = metrics.filter(F.col("metric") == "accuracy").groupBy("model").agg(F.avg("value").alias("mean"))
    return means.orderBy(F.desc(F.round("mean", 12)), place).limit(1)


def tuned_knn(folded: DataFrame, test: DataFrame, key: str, cols, label: str, fold: str, ks) -> DataFrame:
    """Choose k on the folds, smaller on ties, then vote over all training rows: ``(key, k, predicted)``."""
    ks = list(ks)
    chosen = best_candidate(knn_cv(folded, key, cols, label, fold, ks), [f"knn k={k}" for k in ks]).first()
    k = int(chosen["model"].split("=")[1])
    return knn_classify(folded, test, key, cols, label, [k])


def tuned_predict(folded: DataFrame, test: DataFrame, key: str, cols, label: str, fold: str, grid: dict) -> DataFrame:
    """Choose a candidate of the grid on the folds, refit it on all training rows: ``(key, model, predicted)``."""
    chosen = best_candidate(tune_grid(folded, key, cols, label, fold, grid), list(grid)).first()["model"]
    kind, settings = grid[chosen]
    model, classes = fit_classifier(folded, cols, label, kind, **settings)
    return predict(model, classes, test, key, cols).withColumn("model", F.lit(chosen)).select(key, "model", "predicted")


def network_metrics(folded: DataFrame, cols, label: str, fold: str, grid: dict, **settings) -> DataFrame:
    """Accuracy and kappa of every size and decay per fold, all fits in shared passes: ``(model, fold, metric, value)``."""
    classes = class_codes(folded, label)
    return metrics_from_cells(cut(network.network_cv(folded, cols, label, classes, fold, grid, **settings)))


def tuned_network(folded: DataFrame, test: DataFrame, key: str, cols, label: str, fold: str, grid: dict, **settings) -> DataFrame:
    """Choose size and decay on the folds, refit on all training rows: ``(key, model, predicted)``."""
    chosen = best_candidate(network_metrics(folded, cols, label, fold, grid, **settings), list(grid)).first()["model"]
    classes = class_codes(folded, label)
    fitted = network.fit_networks(folded, cols, label, classes, [network.Network(chosen, *grid[chosen])], **settings)
    out = network.network_predict(fitted[0], classes, test, key, cols)
    return out.withColumn("model", F.lit(chosen)).select(key, "model", "predicted")


def compare_models(metrics: DataFrame) -> DataFrame:
    """Six-number summary of every metric per model over the folds."""
    by = ["model", "metric"]
    middle = quantiles_wide(metrics, ["value"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by).drop("column")
    ends = metrics.groupBy(*by).agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max")
    )
    return ends.join(middle, by).select(*by, "min", "q1", "median", "mean", "q3", "max")


def _margins(cells: DataFrame) -> DataFrame:
    everything = Window.partitionBy(F.lit(1))
    # the grid has one row per pair of classes
    return cells.select(
        "predicted", "actual", "n",
        F.sum("n").over(Window.partitionBy("predicted")).alias("n_predicted"),
        F.sum("n").over(Window.partitionBy("actual")).alias("n_actual"),
        F.sum("n").over(everything).alias("total"),
    )


def confusion_overall(df: DataFrame, predicted: str, actual: str, classes) -> DataFrame:
    """One row: counts, accuracy, no-information rate, kappa and McNemar's statistic."""
    renamed = df.select(F.col(predicted).alias("predicted"), F.col(actual).alias("actual"))
    grid = confusion_matrix(renamed, "predicted", "actual", classes)
    cells = _margins(grid)
    diagonal = F.col("predicted") == F.col("actual")
    base = cells.agg(
        F.max("total").alias("n"),
        F.sum(F.when(diagonal, F.col("n"))).alias("right"),
        F.max("n_actual").alias("largest"),
        F.sum(F.when(diagonal, F.col("n_actual").cast("double") * F.col("n_predicted"))).alias("by_chance"),
    )
    swapped = grid.select(F.col("predicted").alias("actual"), F.col("actual").alias("predicted"), F.col("n").alias("m"))
    pairs = grid.join(swapped, ["predicted", "actual"]).filter(F.col("predicted") < F.col("actual"))
    difference = F.col("n").cast("double") - F.col("m")
    # with two classes the statistic carries the continuity correction
    step = F.greatest(F.abs(difference) - 1, F.lit(0.0)) if len(list(classes)) == 2 else difference
    mcnemar = pairs.agg(F.sum(ratio(step * step, F.col("n") + F.col("m"))).alias("m")).scalar()
    accuracy = ratio("right", "n")
    expected = ratio("by_chance", F.col("n").cast("double") * F.col("n"))
    return base.select(
        "n", "right", accuracy.alias("accuracy"), ratio("largest", "n").alias("no_information_rate"),
        ratio(accuracy - expected, 1 - expected).alias("kappa"), mcnemar.alias("mcnemar"),
    )


def confusion_tests(df: DataFrame, predicted: str, actual: str, classes) -> DataFrame:
    """Exact interval of the accuracy, its test against the no-information rate, McNemar p: one row."""
    classes = list(classes)
    row = confusion_overall(df, predicted, actual, classes).first()
    low, high = special.binomial_interval(row["right"], row["n"])
    better = special.binomial_upper_tail(row["right"], row["n"], row["no_information_rate"])
    freedom = len(classes) * (len(classes) - 1) / 2
    unequal = None if row["mcnemar"] is None else float(special.chi_squared_tail(row["mcnemar"], freedom))
    names = ["accuracy", "accuracy_low", "accuracy_high", "p_above_no_information", "p_mcnemar"]
    return literal_frame(
        df.sparkSession, [(row["accuracy"], float(low), float(high), float(better), unequal)], names
    )


def confusion_by_class(df: DataFrame, predicted: str, actual: str, classes) -> DataFrame:
    """Per class: sensitivity, specificity, predictive values, prevalence, detection rates, balanced accuracy."""
    renamed = df.select(F.col(predicted).alias("predicted"), F.col(actual).alias("actual"))
    cells = _margins(confusion_matrix(renamed, "predicted", "actual", classes))
    own = cells.filter(F.col("predicted") == F.col("actual"))
    tp, n = F.col("n"), F.col("total")
    fp, fn = F.col("n_predicted") - tp, F.col("n_actual") - tp
    tn = n - tp - fp - fn
    sensitivity, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    prevalence = ratio("n_actual", n)
    return own.select(
        F.col("actual").alias("class"),
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        ratio(sensitivity * prevalence, sensitivity * prevalence + (1 - specificity) * (1 - prevalence)).alias("ppv"),
        ratio(specificity * (1 - prevalence), (1 - sensitivity) * prevalence + specificity * (1 - prevalence)).alias("npv"),
        prevalence.alias("prevalence"),
        ratio(tp, n).alias("detection_rate"),
        ratio("n_predicted", n).alias("detection_prevalence"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
    )


