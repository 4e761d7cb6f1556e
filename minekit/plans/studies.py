"""The three end-to-end studies: explore, cluster, classify. Each returns named lazy frames."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from minekit.functions.expr import bands
from minekit.functions.names import strip_suffix
from minekit.lineage import cut
from minekit.operators import classify, clean, cluster, corr, joins, profile, rank, trend, validate
from minekit.sources.sink import write_table


def rate_map(entities: DataFrame, boundary: DataFrame, name: str, suffix: str, floor: int) -> DataFrame:
    """Rates of the entities above a case floor, on every vertex of their boundary.

    ``entities`` has cases, deaths, population; ``boundary`` has a ``place`` column to meet the normalised name.
    """
    kept = entities.filter(F.col("cases") > floor)
    rated = clean.rates(
        kept,
        {
            "cases_per_1000": ("cases", "population", 1000),
            "deaths_per_1000": ("deaths", "population", 1000),
            "death_per_case": ("deaths", "cases", 1),
        },
    )
    metrics = rated.select(
        strip_suffix(name, suffix).alias("place"), "cases_per_1000", "deaths_per_1000", "death_per_case"
    )
    return joins.natural_join(boundary, metrics)


def explore(entities: DataFrame, boundary: DataFrame, key: str, name: str, suffix: str, floor: int, n: int = 5):
    """Profile, rates, correlation, map layer, ranking and trend."""
    kept = entities.filter(F.col("cases") > floor)
    rated = clean.rates(
        kept,
        {
            "cases_per_1000": ("cases", "population", 1000),
            "deaths_per_1000": ("deaths", "population", 1000),
            "death_per_case": ("deaths", "cases", 1),
        },
    )
    rates = ["cases_per_1000", "deaths_per_1000", "death_per_case"]
    return {
        "profile": profile.profile_intro(entities),
        "rates": rated,
        "correlation": corr.correlation_test(rated, ["cases", "deaths", "population", *rates]),
        "map": rate_map(entities, boundary, name, suffix, floor),
        "ranking": rank.best_worst(rated, key, rates, n),
        "trend": trend.linear_trend(rated, "cases_per_1000", "deaths_per_1000"),
        "labels": profile.filter_above_quantile(rated, "deaths_per_1000", 0.95).select(key, "deaths_per_1000"),
    }


def _together(spark: SparkSession, *fits: Callable[[], DataFrame]) -> list[DataFrame]:
    """Frames that do not need each other, built at the same time: a chain of small jobs alone leaves most cores idle."""
    with ThreadPoolExecutor(len(fits)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(fit)) for fit in fits]
        return [fit.result() for fit in running]


def cluster_study(df: DataFrame, key: str, features, outcome: str, k: int, cuts, levels, eps: float, min_pts: int):
    """Clean, scale, reduce, cluster three ways, validate inside and against outcome bands."""
    # written, as the checks, the moments and the rows each read it, and it may stand on large joins
    complete = cut(clean.drop_incomplete(df.select(key, outcome, *features)))
    dropped = {r["name"] for r in corr.collinear_columns(complete, features).collect()}
    used = [c for c in features if c not in dropped]
    scaled = cut(corr.standardise(complete, used).select(key, outcome, *used))
    km, hc, sl, db = _together(
        df.sparkSession,
        lambda: cut(cluster.kmeans_assign(scaled, key, used, k).withColumnRenamed("cluster", "kmeans")),
        lambda: cut(cluster.complete_linkage(scaled, key, used, k).withColumnRenamed("cluster", "complete")),
        lambda: cut(cluster.single_linkage(scaled, key, used, k).withColumnRenamed("cluster", "single")),
        lambda: cut(cluster.dbscan(scaled, key, used, eps, min_pts).select(key, F.col("cluster").alias("dbscan"))),
    )
    labels = cut(reduce(lambda a, b: a.join(b, key), [scaled, km, hc, sl, db]))
    truth = corr.standardise(scaled, [outcome]).select(key, bands(outcome, cuts, levels).alias("truth"))
    size = max(k, max(levels))
    internal, external = _together(
        df.sparkSession,
        lambda: validate.compare_labelings(labels, key, used, ["kmeans", "complete", "single"]),
        lambda: validate.external_validation(labels, truth, key, ["kmeans", "complete"], size),
    )
    return {
        "labels": labels.select(key, "kmeans", "complete", "single", "dbscan"),
        "internal": internal,
        "external": external,
        "profile": cluster.cluster_profile(labels, used, "kmeans"),
        "risk": profile.group_means(labels, "kmeans", [outcome]),
    }


def classify_study(df: DataFrame, key: str, group: str, held_out, features, label: str, n_features: int, ks=(5,)):
    """Hold out groups, rank features, fit three models on the best, and evaluate them on the held-out groups."""
    rows = cut(clean.drop_incomplete(df.select(key, group, label, *features)))
    train, test = classify.group_holdout(rows, group, held_out)
    ranking = cut(classify.rank_features(train, label, features))
    best = [r["feature"] for r in ranking.orderBy(F.desc("v"), "feature").limit(n_features).collect()]
    predictions = cut(classify.predict_all(train, test, key, best, label, ks[0]))
    classes = classify.class_codes(rows, label)
    parts = []
    for model in ("forest", "mlp", "knn"):
        overall = classify.confusion_overall(predictions, f"predicted_{model}", "actual", classes)
        parts.append(overall.select(F.lit(model).alias("model"), "n", "accuracy", "no_information_rate", "kappa"))
    return {
        "balance": profile.value_counts(rows, label),
        "ranking": ranking,
        "predictions": predictions,
        "evaluation": reduce(DataFrame.unionByName, parts),
    }


def save(frames: dict[str, DataFrame], folder: str) -> None:
    """Write every frame of a study as a table under a shared folder."""
    for name, frame in frames.items():
        write_table(frame, f"{folder.rstrip('/')}/{name}")


