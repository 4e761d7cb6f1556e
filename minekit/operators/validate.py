"""Cluster validation given labels.

Mean distances need every pair, so blocks of places meet as arrays inside tasks and each place gives
back one partial sum per block; pairs are rows only where they are listed. Everything based on squares is linear instead.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from minekit.functions.expr import bands, literal_frame, ratio
from minekit.lineage import cut, number_rows, steady_layout
from minekit.operators import cluster as clusterers
from minekit.operators import extremes, space
from minekit.operators.clean import drop_incomplete
from minekit.operators.corr import standardise
from minekit.operators.joins import first_rows
from minekit.operators.profile import contingency_table

BLOCK = 4096


# ---------------------------------------------------------------- distances between labelled places


def labelled_places(df: DataFrame, key: str, cols, labels=("cluster",)) -> DataFrame:
    """One row per (place, labels) with its number of copies; rows without a label are left out."""
    wide = space.double_columns(df.select(key, *labels, *cols), cols).na.drop(subset=list(labels))
    return wide.groupBy(*cols, *[F.col(c).cast("long").alias(c) for c in labels]).agg(
        F.min(key).alias("pid"), F.count(F.lit(1)).alias("weight")
    )


#: Places of a strip at most, and at least where that gives a task to every core; a strip meets ``BLOCK_PLACES`` at once.
STRIP_PLACES, LEAST_STRIP, STRIPS, BLOCK_PLACES = 16_384, 256, 32, 262_144
#: Distances of a tile, few enough for a core's cache, and sums that a strip gives back per block.
TILE_ROWS, TILE_PLACES, SUMS_AT_ONCE = 32, 1_024, 1_000_000
#: Rows of a block whose pairs are listed; a join keeps so few matches of a row in memory.
PAIR_BLOCK = 2_048
#: Up to this many clusters of all labelings together, a product with their marks adds up the distances.
MARKED = 256


def _tile_distances(a: np.ndarray, b: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``space.distances`` between columns of ``a`` and rows of ``b`` into a table that is used again for every tile."""
    np.subtract(a[:, 0, None], b[0], out=out)
    np.multiply(out, out, out=out)
    for j in range(1, len(b)):
        np.subtract(a[:, j, None], b[j], out=spare)
        np.multiply(spare, spare, out=spare)
        out += spare
    return np.sqrt(out, out=out)


def _strip_sums(cols, labels, ends: bool):
    names = list(cols)

    def work(mine: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["labeling", "pid", "own", "weight", "other", "total", "near", "far"]
        if len(mine) == 0 or len(block) == 0:
            return pd.DataFrame(columns=columns)
        # clusters of the first labeling lie together, so that its sums need no copies
        block = block.sort_values(labels[0], kind="stable")
        a, b, w = mine[names].to_numpy(float), block[names].to_numpy(float), block["weight"].to_numpy(float)
        found, codes = zip(*[np.unique(block[name].to_numpy(), return_inverse=True) for name in labels])
        first = np.cumsum([0, *[len(f) for f in found]])
        total, near, far = np.zeros((len(a), first[-1])), np.full((len(a), first[-1]), np.inf), np.full((len(a), first[-1]), -np.inf)
        table, spare = np.empty(TILE_ROWS * TILE_PLACES), np.empty(TILE_ROWS * TILE_PLACES)
        for at in range(0, len(b), TILE_PLACES):
            tile = slice(at, at + TILE_PLACES)
            there, weight = np.ascontiguousarray(b[tile].T), w[tile]
            single = bool((weight == 1).all())
            orders = [np.argsort(c[tile], kind="stable") for c in codes]
            groups = [np.unique(c[tile][o], return_index=True) for c, o in zip(codes, orders)]
            here = [slice(first[i] + g[0], first[i] + g[-1] + 1) if i == 0 else first[i] + g for i, (g, _) in enumerate(groups)]
            marks = None
            if len(labels) > 1 and first[-1] <= MARKED:
                marks = np.zeros((len(weight), first[-1]))
                for i, c in enumerate(codes):
                    marks[np.arange(len(weight)), first[i] + c[tile]] = weight
            for start in range(0, len(a), TILE_ROWS):
                rows = slice(start, start + TILE_ROWS)
                shape = (len(a[rows]), len(weight))
                size = shape[0] * shape[1]
                other = spare[:size].reshape(shape)
                d = _tile_distances(a[rows], there, table[:size].reshape(shape), other)
                product = d @ marks if marks is not None else None
                if product is not None and np.isfinite(product).all():
                    total[rows] += product
                else:
                    # clusters apart: a distance that is no number stays in its own cluster's sum
                    weighted = d if single else np.multiply(d, weight, out=other)
                    for i, (order, (_, starts)) in enumerate(zip(orders, groups)):
                        total[rows, here[i]] += np.add.reduceat(weighted if i == 0 else weighted[:, order], starts, axis=1)
                if ends:
                    for i, (order, (_, starts)) in enumerate(zip(orders, groups)):
                        part = d if i == 0 else d[:, order]
                        near[rows, here[i]] = np.fmin(near[rows, here[i]], np.minimum.reduceat(part, starts, axis=1))
                        far[rows, here[i]] = np.fmax(far[rows, here[i]], np.maximum.reduceat(part, starts, axis=1))
        parts = []
        for i, name in enumerate(labels):
            k, columns_of = len(found[i]), slice(first[i], first[i + 1])
            table = {
                "labeling": name, "pid": mine["pid"].repeat(k).to_numpy(), "own": mine[name].repeat(k).to_numpy(),
                "weight": mine["weight"].repeat(k).to_numpy(), "other": np.tile(found[i], len(mine)), "total": total[:, columns_of].ravel(),
            }
            table["near"], table["far"] = (near[:, columns_of].ravel(), far[:, columns_of].ravel()) if ends else (None, None)
            parts.append(pd.DataFrame(table, columns=columns))
        return pd.concat(parts)

    return work


def _strip_meeting(places: DataFrame, block: int, clusters: int):
    """Two grouped copies of the places, so that every hashed strip meets every block of places in a task."""
    n = places.count()
    blocks = max(1, math.ceil(n / max(block, 1)))
    most = max(1, min(STRIP_PLACES, block, SUMS_AT_ONCE // max(clusters, 1)))
    strips = max(1, math.ceil(n / most), min(STRIPS, math.ceil(n / LEAST_STRIP)))
    number = F.xxhash64(*places.columns)
    strip, part = F.pmod(number, F.lit(strips)).cast("int"), F.pmod(F.shiftrightunsigned(number, 32), F.lit(blocks)).cast("int")
    left = places.withColumn("strip", strip).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fresh = places.select(*[F.col(c).alias(c) for c in places.columns])
    right = fresh.withColumn("part", part).withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    return left.groupBy("strip", "part").cogroup(right.groupBy("strip", "part"))


def _block_meeting(places: DataFrame, block: int):
    """Two grouped copies of the places, so that every hashed block meets every other one in a task."""
    parts = max(1, math.ceil(places.count() / block))
    number = F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = places.withColumn("strip", number).withColumn("part", every)
    fresh = places.select(*[F.col(c).alias(c) for c in places.columns])
    right = fresh.withColumn("part", number).withColumn("strip", every)
    return left.groupBy("strip", "part").cogroup(right.groupBy("strip", "part"))


def place_sums(places: DataFrame, cols, labels=("cluster",), block: int = BLOCK_PLACES, *, ends: bool = False) -> DataFrame:
    """``(labeling, pid, own, weight, other, n_other, total, near, far)``: from a place to each cluster.

    A strip of places meets a block of at most about ``block`` of them in a task and gives back one sum per
    place and cluster, so neither a large cluster nor a busy place makes a large task, and the distances are
    computed once for all the label columns. ``near`` and ``far`` are filled where ``ends`` asks for them.
    """
    cols, labels = list(cols), list(labels)
    # one row per cluster, written so that its size is known to the planner
    sizes = cut(
        places.select("weight", *labels)
        .unpivot(["weight"], labels, "labeling", "other")
        .groupBy("labeling", "other")
        .agg(F.sum("weight").alias("n_other"))
    )
    found = _strip_meeting(places, block, sizes.count()).applyInPandas(
        _strip_sums(cols, labels, ends),
        "labeling string, pid bigint, own bigint, weight bigint, other bigint, total double, near double, far double",
    )
    summed = found.groupBy("labeling", "pid", "own", "weight", "other").agg(
        F.sum("total").alias("total"), F.min("near").alias("near"), F.max("far").alias("far")
    )
    return summed.join(sizes, ["labeling", "other"])


def pair_distances(df: DataFrame, key: str, cols, block: int = PAIR_BLOCK) -> DataFrame:
    """``(key, other, distance)``: every pair of rows of different keys once, the lower key first.

    Blocks of about ``block`` rows meet in tasks and the rows of a pair are streamed, so a task holds one block, whatever
    the number of pairs. A missing coordinate makes a missing distance.
    """
    cols = list(cols)
    places = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    rows = cut(df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), *places))
    blocks = max(1, math.ceil(rows.count() / block))
    # dealt by row, not by key, so that a key of many rows makes no large block; written, as a number may change where it is computed again
    rows = cut(rows.withColumn("own", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")))
    a, b = ([F.col(c).alias(f"{c}_{side}") for c in rows.columns] for side in "ab")
    left = rows.select(*a, F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("j"))
    right = rows.select(*b, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    tasks = blocks * (blocks + 1) // 2
    left, right = space.dealt(left, tasks, "i", "j"), space.dealt(right, tasks, "i", "j")
    once = F.when(F.col("i") == F.col("j"), F.col("id_a") < F.col("id_b")).otherwise(F.col("id_a") != F.col("id_b"))
    squares = [(F.col(f"c{i}_a") - F.col(f"c{i}_b")) * (F.col(f"c{i}_a") - F.col(f"c{i}_b")) for i in range(len(cols))]
    return left.join(right, ["i", "j"]).filter(once).select(
        F.least("id_a", "id_b").alias(key), F.greatest("id_a", "id_b").alias("other"), F.sqrt(sum(squares[1:], squares[0])).alias("distance")
    )


def silhouette(df: DataFrame, key: str, cols, cluster: str = "cluster") -> DataFrame:
    """Plain-Euclidean silhouette of every row: ``(key, cluster, neighbour, width)``; 0 in a singleton."""
    cols = list(cols)
    rows = space.double_columns(df.select(key, F.col(cluster).cast("long").alias("cluster"), *cols), cols)
    places = cut(labelled_places(rows, key, cols))
    widths = _place_widths(place_sums(places, cols))
    per_place = places.join(widths, "pid").select(*cols, "cluster", "neighbour", "width")
    return rows.join(per_place, [*cols, "cluster"]).select(key, "cluster", "neighbour", "width")


def _place_widths(sums: DataFrame) -> DataFrame:
    inside = F.col("own") == F.col("other")
    per = sums.groupBy("labeling", "pid", "own", "weight").agg(
        F.max(F.when(inside, ratio("total", F.col("n_other") - 1))).alias("a"),
        F.min(F.when(~inside, F.struct(ratio("total", "n_other").alias("d"), F.col("other")))).alias("b"),
        F.max(F.when(inside, F.col("n_other"))).alias("n_own"),
    )
    width = ratio(F.col("b.d") - F.col("a"), F.greatest("a", "b.d"))
    return per.select(
        "labeling", "pid", "own", "weight", F.col("b.other").alias("neighbour"),
        F.when(F.col("n_own") == 1, 0.0).otherwise(F.coalesce(width, F.lit(0.0))).alias("width"),
    )


def silhouette_fast(df: DataFrame, key: str, cols, cluster: str = "cluster") -> DataFrame:
    """Squared-Euclidean silhouette in linear time, from cluster means and variances."""
    cols = list(cols)
    rows = space.double_columns(df.select(key, F.col(cluster).cast("long").alias("cluster"), *cols), cols)
    stats = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("mean"),
        reduce(lambda a, b: a + b, [F.var_pop(c) for c in cols]).alias("spread"),
    )
    # one struct per cluster, read once as a scalar
    table = stats.agg(F.collect_list(F.struct("cluster", "n", "mean", "spread")).alias("t")).scalar()
    wide = rows.withColumn("t", table)
    squares = F.array(*[F.col(c) for c in cols])
    mean_square = F.transform(
        "t",
        lambda t: F.struct(
            (
                F.aggregate(
                    F.zip_with(squares, t["mean"], lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, v: s + v
                )
                + t["spread"]
            ).alias("d"),
            t["cluster"].alias("cluster"),
            t["n"].alias("n"),
        ),
    )
    wide = wide.withColumn("d", mean_square)
    own = F.filter("d", lambda e: e["cluster"] == F.col("cluster"))[0]
    other = F.array_min(F.transform(F.filter("d", lambda e: e["cluster"] != F.col("cluster")), lambda e: e["d"]))
    wide = wide.select(key, "cluster", own.alias("own"), other.alias("b"))
    a = ratio(F.col("own.d") * F.col("own.n"), F.col("own.n") - 1)
    return wide.select(
        key, "cluster", F.when(F.col("own.n") == 1, 0.0).otherwise(ratio(F.col("b") - a, F.greatest(a, F.col("b")))).alias("width")
    )


def cluster_pairs(sums: DataFrame) -> DataFrame:
    """Per ordered cluster pair: distance sum over pairs of rows, least, greatest, number of pairs, mean."""
    pairs = sums.groupBy(F.col("own").alias("cluster_i"), F.col("other").alias("cluster_j")).agg(
        F.sum(F.col("weight") * F.col("total")).alias("total"),
        F.min("near").alias("near"),
        F.max("far").alias("far"),
        F.sum("weight").alias("n_i"),
        F.first("n_other").alias("n_j"),
    )
    same = F.col("cluster_i") == F.col("cluster_j")
    count = F.when(same, F.col("n_i") * (F.col("n_i") - 1)).otherwise(F.col("n_i") * F.col("n_j"))
    return pairs.withColumn("n_pairs", count).withColumn("mean", ratio("total", "n_pairs"))


def cluster_separation(df: DataFrame, key: str, cols, cluster: str = "cluster") -> DataFrame:
    """Separation and mean-distance matrices, long form over ordered pairs of different clusters."""
    places = cut(labelled_places(df.select(key, F.col(cluster).alias("cluster"), *cols), key, cols))
    pairs = cluster_pairs(place_sums(places, cols, ends=True))
    return pairs.filter(F.col("cluster_i") != F.col("cluster_j")).select(
        "cluster_i", "cluster_j", F.col("near").alias("separation"), F.col("mean").alias("average_between")
    )


def block_dissimilarity(df: DataFrame, key: str, cols, cluster: str = "cluster") -> DataFrame:
    """Mean distance per cluster pair, the shading of a distance matrix ordered by cluster."""
    places = cut(labelled_places(df.select(key, F.col(cluster).alias("cluster"), *cols), key, cols))
    return cluster_pairs(place_sums(places, cols)).select("cluster_i", "cluster_j", F.col("mean").alias("mean_distance"))


def cluster_stats(df: DataFrame, key: str, cols, cluster: str = "cluster", noise: int = 0) -> DataFrame:
    """Internal validation measures, long form ``(metric, cluster, value)``; overall rows have no cluster.

    Rows of the cluster ``noise`` belong to none: they are counted and left out of all other measures.
    """
    cols = list(cols)
    n_noise = df.agg(F.count_if(F.col(cluster) == noise).cast("double")).scalar()
    df = df.filter(F.col(cluster) != noise)
    places = cut(labelled_places(df.select(key, F.col(cluster).alias("cluster"), *cols), key, cols))
    sums = cut(place_sums(places, cols, ends=True))
    pairs = cut(cluster_pairs(sums))
    widths = _place_widths(sums)
    same = F.col("cluster_i") == F.col("cluster_j")

    per = pairs.groupBy(F.col("cluster_i").alias("cluster")).agg(
        F.max(F.when(same, F.col("n_i"))).cast("double").alias("size"),
        F.max(F.when(same, F.col("far"))).alias("diameter"),
        F.max(F.when(same, F.col("mean"))).alias("average_distance"),
        F.min(F.when(~same, F.col("near"))).alias("separation"),
        ratio(F.sum(F.when(~same, F.col("total"))), F.sum(F.when(~same, F.col("n_pairs")))).alias("average_toother"),
    )
    mean_width = widths.groupBy(F.col("own").alias("cluster")).agg(
        ratio(F.sum(F.col("weight") * F.col("width")), F.sum("weight")).alias("silhouette")
    )
    rows = space.double_columns(df.select(F.col(cluster).cast("long").alias("cluster"), *cols), cols)
    rows = rows.filter(F.col("cluster").isNotNull())
    squares = rows.groupBy("cluster").agg(_squares(cols).alias("within_ss"))
    per = cut(per.join(mean_width, "cluster").join(squares, "cluster"))
    names = ["size", "diameter", "average_distance", "separation", "average_toother", "silhouette", "within_ss"]
    by_cluster = per.unpivot(["cluster"], names, "metric", "value")

    total = rows.agg(_squares(cols).alias("total_ss")).scalar()
    between_total = F.sum(F.when(~same, F.col("total")))
    between_count = F.sum(F.when(~same, F.col("n_pairs")))
    across = pairs.agg(
        ratio(between_total, between_count).alias("average_between"),
        F.min(F.when(~same, F.col("mean"))).alias("least_mean"),
        F.min(F.when(~same, F.col("near"))).alias("min_separation"),
        F.max(F.when(same, F.col("far"))).alias("max_diameter"),
        F.max(F.when(same, F.col("mean"))).alias("greatest_mean"),
        (F.sum("total") / 2).alias("sum_d"),
        (between_total / 2).alias("sum_between"),
        (between_count / 2).alias("n_between"),
    )
    share = ratio("size", F.col("all_rows"))
    n_rows = per.agg(F.sum("size")).scalar()
    inside = per.withColumn("all_rows", n_rows).agg(
        F.max("all_rows").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.min("size").alias("min_cluster_size"),
        F.sum("within_ss").alias("within_ss"),
        ratio(
            F.sum(F.when(F.col("average_distance").isNotNull(), F.col("size") * F.col("average_distance"))),
            F.sum(F.when(F.col("average_distance").isNotNull(), F.col("size"))),
        ).alias("average_within"),
        ratio(F.sum(F.col("size") * F.col("silhouette")), F.sum("size")).alias("avg_silhouette"),
        F.sum(-share * F.log(share)).alias("entropy"),
    )
    row = (
        across.withColumn("g", F.lit(1))
        .join(inside.withColumn("g", F.lit(1)), "g")
        .withColumn("total_ss", total)
        .withColumn("noise", n_noise)
    )
    n_all = F.col("n") * (F.col("n") - 1) / 2
    # distances against a 0/1 mark of different clusters; the sum of squared distances is n times the total SS
    cov = ratio("sum_between", n_all) - ratio("sum_d", n_all) * ratio("n_between", n_all)
    var_d = ratio(F.col("n") * F.col("total_ss"), n_all) - F.pow(ratio("sum_d", n_all), 2)
    p = ratio("n_between", n_all)
    overall = row.select(
        F.col("average_between"), F.col("average_within"), F.col("max_diameter"), F.col("min_separation"),
        F.col("within_ss").alias("total_within_ss"), F.col("avg_silhouette"),
        ratio("min_separation", "max_diameter").alias("dunn"),
        ratio("least_mean", "greatest_mean").alias("dunn2"),
        F.col("entropy"), ratio("average_within", "average_between").alias("wb_ratio"),
        ratio(ratio(F.col("total_ss") - F.col("within_ss"), F.col("k") - 1), ratio("within_ss", F.col("n") - F.col("k"))).alias("ch"),
        ratio(cov, F.sqrt(var_d * p * (1 - p))).alias("pearson_gamma"),
        F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("cluster_number"),
        F.col("min_cluster_size").cast("double").alias("min_cluster_size"), F.col("noise"),
    )
    whole = overall.unpivot([], overall.columns, "metric", "value")
    return by_cluster.select("metric", "cluster", "value").unionByName(
        whole.select("metric", F.lit(None).cast("long").alias("cluster"), "value")
    )


def _squares(cols):
    return F.count(F.lit(1)) * reduce(lambda a, b: a + b, [F.var_pop(c) for c in cols])


#: Places of a block whose box bounds the farthest pairs.
BOX_PLACES = 256


def _diameters(places: DataFrame, cols, leaf_points: int) -> DataFrame:
    placed = space.place(places, cols, space.plant(places, cols, leaf_points))
    blocks = extremes.blocks_of(placed, cols, "cluster")
    own = blocks.select(F.col("comp").alias("a"), F.col("comp").alias("b")).distinct()
    return extremes.farthest(own, blocks, len(cols)).select(F.col("a").alias("cluster"), F.col("d").alias("diameter"))


def cluster_diameter(df: DataFrame, key: str, cols, cluster: str = "cluster", leaf_points: int = BOX_PLACES) -> DataFrame:
    """Greatest distance inside each cluster: ``(cluster, diameter)``, 0 for a single place."""
    cols = list(cols)
    places = cut(labelled_places(df.select(key, F.col(cluster).alias("cluster"), *cols), key, cols))
    return _diameters(places, cols, leaf_points)


def _least_separation(places: DataFrame, cols, leaf_points: int) -> DataFrame:
    """One row: the least distance between places of different clusters; null with fewer than two clusters.

    Leaves that hold several clusters give a first bound; only places that have a foreign leaf inside it look further.
    """
    leaves = space.plant(places, cols, leaf_points)
    marked = places.select("pid", *cols, F.col("cluster").alias("comp"))
    labelled = cut(space.place(marked, cols, leaves).withColumn("radius", F.lit(0.0)))
    work = clusterers.nearest_foreign(cols)
    home = cut(space.meet(labelled, labelled, work, clusterers.EDGE, "pid"))
    bound = home.agg(F.min("height")).first()[0]
    if bound is None and not leaves.depth:
        return home.agg(F.min("height").alias("min_separation"))
    if bound is None:
        # every leaf holds one cluster: the distance between some places of two of them is a bound
        some = labelled.groupBy("comp").agg(F.min(F.struct("pid", *cols)).alias("s")).orderBy("comp").limit(2).collect()
        if len(some) < 2:
            return home.agg(F.min("height").alias("min_separation"))
        bound = math.dist(*[[r["s"][c] for c in cols] for r in some])
    asking = labelled.withColumn("radius", F.lit(float(bound)))
    away = space.meet(space.visits(asking, cols, leaves, "radius", True), labelled, work, clusterers.EDGE, "pid")
    return home.unionByName(away).agg(F.min("height").alias("min_separation"))


def dunn_index(df: DataFrame, key: str, cols, cluster: str = "cluster", leaf_points: int = BOX_PLACES) -> DataFrame:
    """Least separation over greatest diameter, without a table of all pairs."""
    cols = list(cols)
    places = cut(labelled_places(df.select(key, F.col(cluster).alias("cluster"), *cols), key, cols))
    widest = _diameters(places, cols, leaf_points).agg(F.max("diameter").alias("max_diameter"))
    least = cut(_least_separation(places, cols, space.LEAF_POINTS))
    row = least.withColumn("g", F.lit(1)).join(widest.withColumn("g", F.lit(1)), "g").drop("g")
    return row.withColumn("dunn", ratio("min_separation", "max_diameter"))


def _least_between(cols, labels):
    """Per labeling, the least distance between visitors and residents of different clusters."""
    names, labels = list(cols), list(labels)

    def work(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        best = {}
        if len(visitors) and len(residents):
            a, b = visitors[names].to_numpy(float), residents[names].to_numpy(float)
            for part in space.strips(len(a), len(b)):
                d = space.distances(a[part], b)
                for name in labels:
                    apart = visitors[name].to_numpy()[part, None] != residents[name].to_numpy()[None, :]
                    least = np.min(d, where=apart, initial=np.inf)
                    if least < best.get(name, np.inf):
                        best[name] = least
        return pd.DataFrame({"labeling": pd.Series(list(best), dtype=object), "height": pd.Series(list(best.values()), dtype=float)})

    return work


def _least_separations(places: DataFrame, cols, labels, leaf_points: int) -> DataFrame:
    """``(labeling, min_separation)``: as ``_least_separation``, the distances computed once for all the label columns."""
    leaves = space.plant(places, cols, leaf_points)
    placed = cut(space.place(places, cols, leaves).withColumn("radius", F.lit(0.0)))
    work, schema = _least_between(cols, labels), "labeling string, height double"
    home = cut(space.meet(placed, placed, work, schema, "pid"))
    least = F.min("height").alias("min_separation")
    if leaves.depth == 0:
        return home.groupBy("labeling").agg(least)
    # one number per labeling
    bounds = {r["labeling"]: r["min_separation"] for r in home.groupBy("labeling").agg(least).collect()}
    for name in labels:
        if name not in bounds:
            # every leaf holds one cluster: the distance between some places of two of them is a bound
            some = placed.groupBy(name).agg(F.min(F.struct("pid", *cols)).alias("s")).orderBy(name).limit(2).collect()
            if len(some) == 2:
                bounds[name] = math.dist(*[[r["s"][c] for c in cols] for r in some])
    if not bounds:
        return home.groupBy("labeling").agg(least)
    asking = placed.withColumn("radius", F.lit(float(max(bounds.values()))))
    away = space.meet(space.visits(asking, cols, leaves, "radius", True), placed, work, schema, "pid")
    return home.unionByName(away).groupBy("labeling").agg(least)


def _dunn_indices(places: DataFrame, cols, labels, leaf_points: int = BOX_PLACES) -> DataFrame:
    """``(labeling, value)``: the Dunn index of several label columns, without a table of all pairs."""
    cols, labels = list(cols), list(labels)
    placed = space.place(places, cols, space.plant(places, cols, leaf_points))
    group = F.concat_ws(":", "labeling", "cluster").alias("group")
    long = placed.unpivot([*cols, "leaf"], labels, "labeling", "cluster").select(*cols, "leaf", group)
    blocks = extremes.blocks_of(long, cols, "group")
    own = blocks.select(F.col("comp").alias("a"), F.col("comp").alias("b")).distinct()
    diameters = extremes.farthest(own, blocks, len(cols)).select(F.substring_index("a", ":", 1).alias("labeling"), "d")
    widest = cut(diameters.groupBy("labeling").agg(F.max("d").alias("max_diameter")))
    least = cut(_least_separations(places, cols, labels, space.LEAF_POINTS))
    return widest.join(least, "labeling", "left").select("labeling", ratio("min_separation", "max_diameter").alias("value"))


def _mean_width() -> Column:
    return ratio(F.sum(F.col("weight") * F.col("width")), F.sum("weight"))


def _longest_edge(cols):
    names = list(cols)

    def work(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        x = members[names].to_numpy(float)
        edges = clusterers.dense_tree(x) if len(x) > 1 else []
        return pd.DataFrame({"cluster": [key[0]], "widest_gap": [max((e[2] for e in edges), default=None)]})

    return work


def widest_gap(df: DataFrame, key: str, cols, cluster: str = "cluster", leaf_points: int = space.LEAF_POINTS) -> DataFrame:
    """Per cluster, the longest edge of its own spanning tree: the widest gap inside the cluster.

    Clusters that fit a leaf are done together, a task each; the larger ones take the distributed forest, together too.
    """
    rows = df.select(key, F.col(cluster).alias("cluster"), *cols)
    places = cut(labelled_places(rows, key, cols))
    sizes = cut(places.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_places")))
    small = sizes.filter(F.col("n_places") <= leaf_points).select("cluster")
    alone = space.dealt(places.join(small, "cluster"), small.count(), "cluster")
    out = alone.groupBy("cluster").applyInPandas(_longest_edge(cols), "cluster bigint, widest_gap double")
    # at most (number of places / leaf_points) clusters are large
    large = sizes.filter(F.col("n_places") > leaf_points)
    if large.isEmpty():
        return out
    parts = cut(number_rows(large.select("cluster"), ["cluster"], name="part"))
    points = places.join(parts, "cluster").select("part", F.monotonically_increasing_id().alias("pid"), *cols)
    points = cut(points)
    leaves = space.plant(points, cols, leaf_points)
    placed = space.place(points, cols, leaves).withColumn("radius", F.lit(0.0))
    placed = cut(placed.withColumn("leaf", F.col("leaf") + F.col("part") * 2**leaves.depth))
    forest = clusterers.spanning_forest(placed, cols, leaves)
    longest = forest.groupBy("part").agg(F.max("height").alias("widest_gap"))
    return out.unionByName(longest.join(parts, "part").select("cluster", "widest_gap"))


HISTOGRAM = 1024


def _distance_histogram(cols, targets):
    """Per target (cluster, low, high): counts, least and greatest distance in each of the even bins."""
    names = list(cols)

    def work(mine: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        tables: dict = {}
        for target, (label, low, high) in targets.items():
            a, b = mine[mine["cluster"] == label], block[block["cluster"] == label]
            if len(a) == 0 or len(b) == 0:
                continue
            xa, xb = a[names].to_numpy(float), b[names].to_numpy(float)
            wa, wb = a["weight"].to_numpy(float), b["weight"].to_numpy(float)
            table = tables.setdefault(target, (np.zeros(HISTOGRAM), np.full(HISTOGRAM, np.inf), np.full(HISTOGRAM, -np.inf)))
            for part in space.strips(len(xa), len(xb)):
                d = space.distances(xa[part], xb)
                # pairs of rows: copies of one place pair with each other, a row not with itself
                pairs = wa[part, None] * wb[None, :]
                pairs -= wa[part, None] * (a["pid"].to_numpy()[part, None] == b["pid"].to_numpy()[None, :])
                here = (d >= low) & (d <= high) & (pairs > 0)
                v = d[here]
                at = np.minimum(((v - low) / max(high - low, 1e-300) * HISTOGRAM).astype(int), HISTOGRAM - 1)
                table[0][:] += np.bincount(at, weights=pairs[here], minlength=HISTOGRAM)
                np.minimum.at(table[1], at, v)
                np.maximum.at(table[2], at, v)
        out = [(t, i, n[i], lo[i], hi[i]) for t, (n, lo, hi) in tables.items() for i in np.nonzero(n)[0]]
        return pd.DataFrame(out, columns=["target", "bin", "n", "low", "high"])

    return work


def median_distance(df: DataFrame, key: str, cols, cluster: str = "cluster", block: int = BLOCK) -> DataFrame:
    """Exact median of the distances inside each cluster: ``(cluster, median_distance)``.

    Pairs are only counted: each pass narrows the two middle ranks of every cluster to one of 1,024
    bins, down to the distances found in it, until a bin holds one value.
    """
    cols = list(cols)
    places = cut(labelled_places(df.select(key, F.col(cluster).alias("cluster"), *cols), key, cols))
    # one row per cluster: its size and the diagonal of its bounding box
    extent = [(F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in cols]
    boxes = places.groupBy("cluster").agg(
        F.sum("weight").alias("n"), F.sqrt(reduce(lambda a, b: a + b, extent)).alias("diagonal")
    ).collect()
    open_targets, rank, found = {}, {}, {}
    for i, box in enumerate(boxes):
        pairs = box["n"] * (box["n"] - 1)
        for side in (0, 1):
            if pairs:
                open_targets[2 * i + side] = (box["cluster"], 0.0, box["diagonal"] * (1 + 1e-9))
                rank[2 * i + side] = pairs // 2 - 1 + side
    while open_targets:
        counted = _block_meeting(places, block).applyInPandas(
            _distance_histogram(cols, dict(open_targets)), "target int, bin int, n double, low double, high double"
        )
        bins = counted.groupBy("target", "bin").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        ).collect()
        tables: dict = {}
        for r in bins:
            tables.setdefault(r["target"], []).append((r["bin"], r["n"], r["low"], r["high"]))
        following = {}
        for target, table in tables.items():
            for _, n, low, high in sorted(table):
                if rank[target] < n:
                    if low == high:
                        found[target] = low
                    else:
                        following[target] = (open_targets[target][0], low, high)
                    break
                rank[target] -= n
        open_targets = following
    rows = [(box["cluster"], (found[2 * i] + found[2 * i + 1]) / 2) for i, box in enumerate(boxes) if 2 * i in found]
    return literal_frame(df.sparkSession, rows, ["cluster", "median_distance"])


def compare_labelings(df: DataFrame, key: str, cols, labelings: list[str]) -> DataFrame:
    """Within sum of squares and mean silhouette of several label columns, from one pass over the pairs."""
    cols = list(cols)
    places = cut(labelled_places(df, key, cols, labelings))
    widths = _place_widths(place_sums(places, cols, labelings)).groupBy(F.col("labeling").alias("method"))
    rows = space.double_columns(df.select(*labelings, *cols), cols).na.drop(subset=list(labelings))
    long = rows.unpivot(cols, list(labelings), "method", "cluster")
    within = long.groupBy("method", "cluster").agg(_squares(cols).alias("w"))
    totals = within.groupBy("method").agg(F.sum("w").alias("within_ss"))
    return totals.join(widths.agg(_mean_width().alias("avg_silhouette")), "method")


# ---------------------------------------------------------------- choosing k


def sweep(df: DataFrame, key: str, cols, ks=range(2, 11), starts: int = 5, seed: int = 1234,
          measures=("wcss", "silhouette", "dunn")) -> DataFrame:
    """Cost, mean silhouette and Dunn index for each k, all from the same fits: ``(k, metric, value)``."""
    ks = list(ks)
    labelled, costs = clusterers.kmeans_sweep(df, key, cols, ks, starts, seed)
    parts = []
    if "wcss" in measures:
        parts.append(literal_frame(df.sparkSession, [(k, "wcss", float(costs[k])) for k in ks], ["k", "metric", "value"]))
    wanted = [m for m in measures if m != "wcss"]
    if wanted:
        names = [f"k{k}" for k in ks]
        places = cut(labelled_places(labelled, key, cols, names))
        found = {}
        if "silhouette" in wanted:
            found["silhouette"] = _place_widths(place_sums(places, cols, names)).groupBy("labeling").agg(_mean_width().alias("value"))
        if "dunn" in wanted:
            found["dunn"] = _dunn_indices(places, cols, names)
        number = F.substring("labeling", 2, 9).cast("int").alias("k")
        parts += [found[m].select(number, F.lit(m).alias("metric"), "value") for m in wanted]
    return reduce(DataFrame.unionByName, parts)


def best_k(swept: DataFrame) -> DataFrame:
    """``(metric, k, value)`` where the silhouette or Dunn index of a sweep is greatest; the smaller k on ties."""
    judged = swept.filter(F.col("metric").isin("silhouette", "dunn")).filter(F.col("value").isNotNull())
    best = F.max(F.struct("value", (-F.col("k")).alias("minus_k"))).alias("best")
    return judged.groupBy("metric").agg(best).select("metric", (-F.col("best.minus_k")).alias("k"), F.col("best.value").alias("value"))


def hash_uniform(seed: int, key: str) -> Column:
    """A draw from [0, 1) that depends on the seed and the key alone, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**53)).cast("double") / F.lit(float(2**53))


def gap_statistic(df: DataFrame, key: str, cols, ks=range(1, 11), b: int = 10, seed: int = 1234) -> DataFrame:
    """Gap of log within-dispersion against uniform reference sets drawn in the rotated bounding box.

    Reference rows are made by Spark, as many as the data has, and rotated back before clustering.
    """
    cols, ks = list(cols), list(ks)
    rows = drop_incomplete(df.select(key, *cols))
    # rotation from the covariance of the centred columns, as many numbers as columns squared
    moments = rows.agg(
        F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[F.array(*[F.covar_samp(a, c) for c in cols]) for a in cols]).alias("cov"),
    ).first()
    mean, vectors = np.array(moments["mean"]), np.linalg.eigh(np.array(moments["cov"]))[1]
    rotated = [_dot([F.col(c) - F.lit(float(m)) for c, m in zip(cols, mean)], vectors[:, a]) for a in range(len(cols))]
    box = rows.select(*[r.alias(f"r{a}") for a, r in enumerate(rotated)]).agg(
        *[F.min(f"r{a}").alias(f"lo{a}") for a in range(len(cols))], *[F.max(f"r{a}").alias(f"hi{a}") for a in range(len(cols))]
    ).first()
    low = [box[f"lo{a}"] for a in range(len(cols))]
    high = [box[f"hi{a}"] for a in range(len(cols))]

    def reference(i: int) -> DataFrame:
        uniform = [
            F.lit(lo) + hash_uniform(seed + 101 * i + a, key) * F.lit(hi - lo) for a, (lo, hi) in enumerate(zip(low, high))
        ]
        made = rows.select(key, *[u.alias(f"u{a}") for a, u in enumerate(uniform)])
        axes = [F.col(f"u{a}") for a in range(len(cols))]
        back = [(_dot(axes, vectors[j, :]) + F.lit(float(mean[j]))).alias(c) for j, c in enumerate(cols)]
        return made.select(key, *back)

    # set 0 is the data, sets 1..b the references
    sets = [rows.withColumn("part", F.lit(0))] + [reference(i).withColumn("part", F.lit(i)) for i in range(1, b + 1)]
    together = steady_layout(reduce(DataFrame.unionByName, sets), key).persist()
    order = F.xxhash64(F.lit(seed), F.col(key))
    drawn = first_rows(together, ["part"], [order, F.col(key)], max(ks))
    spots: dict[int, list] = {}
    for r in drawn.orderBy("part", "rank").collect():
        spots.setdefault(r["part"], []).append(tuple(r[c] for c in cols))
    tasks = [(p, k) for p in range(b + 1) for k in ks if k > 1]
    fits = clusterers.kmeans_together(together, cols, "part", {i: (p, spots[p][:k]) for i, (p, k) in enumerate(tasks)})
    spread = reduce(lambda x, y: x + y, [F.var_pop(c) for c in cols])
    whole = together.groupBy("part").agg((F.count(F.lit(1)) * spread).alias("w")).collect()
    log_w = {(r["part"], 1): math.log(r["w"]) for r in whole}
    log_w.update({task: math.log(fits[i][1]) for i, task in enumerate(tasks)})
    together.unpersist()
    table = []
    for k in ks:
        draws = np.array([log_w[(p, k)] for p in range(1, b + 1)])
        mine = log_w[(0, k)]
        table.append((k, mine, float(draws.mean()), float(draws.mean() - mine), float(draws.std() * math.sqrt(1 + 1 / b))))
    return literal_frame(df.sparkSession, table, ["k", "log_w", "e_log_w", "gap", "se"])


def _dot(columns, weights):
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights)])


# ---------------------------------------------------------------- against given classes


# Cuts on a standardised outcome and the classes of the bands they make, lowest band first
FIVE_BANDS = ([-0.66, -0.3, 0.2, 0.45], [5, 4, 3, 2, 1])
THREE_BANDS = ([-0.3, 1.20], [3, 1, 2])


def truth_bands(df: DataFrame, column: str, cuts, labels):
    """Class per row from bands of a standardised column."""
    return standardise(df, [column]).withColumn("truth", bands(column, cuts, labels))


def _cells(df: DataFrame, cluster: str, truth: str, k: int) -> DataFrame:
    """The k x k grid of counts with its margins; k is the number of levels."""
    both = df.select(F.col(cluster).cast("long").alias("c"), F.col(truth).cast("long").alias("t")).na.drop()
    grid = contingency_table(both, "c", "t", range(1, k + 1))
    by_c, by_t, everything = Window.partitionBy("c"), Window.partitionBy("t"), Window.partitionBy(F.lit(1))
    return grid.select(
        "c", "t", "n", F.sum("n").over(by_c).alias("n_c"), F.sum("n").over(by_t).alias("n_t"),
        F.sum("n").over(everything).alias("total"),
    )


def _row_measure(df: DataFrame, cluster: str, truth: str, k: int, mode: str, what: str) -> DataFrame:
    cells = _cells(df, cluster, truth, k)
    row, size = ("c", "n_c") if mode == "by_cluster" else ("t", "n_t")
    p = F.coalesce(ratio("n", size), F.lit(0.0))
    per_row = cells.groupBy(row).agg(
        F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).alias("entropy"),
        F.max(p).alias("purity"),
        F.first(size).alias("size"),
        F.first("total").alias("total"),
    )
    if mode == "index_weighted":
        # the weight of row i is the share of cluster i
        share = cells.select(F.col("c").alias("t"), F.col("n_c").alias("weight")).distinct()
        per_row = per_row.join(share, "t")
    else:
        per_row = per_row.withColumn("weight", F.col("size"))
    return per_row.agg(F.sum(ratio("weight", "total") * F.col(what)).alias("value"))


def external_entropy(df: DataFrame, cluster: str, truth: str, k: int, mode: str = "standard") -> DataFrame:
    """Entropy in bits of the clusters inside each truth class, averaged over rows.

    ``standard`` weights a class by its own share; ``index_weighted`` weights class i by the share of
    cluster i; ``by_cluster`` takes the classes inside each cluster instead.
    """
    return _row_measure(df, cluster, truth, k, mode, "entropy")


def external_purity(df: DataFrame, cluster: str, truth: str, k: int, mode: str = "standard") -> DataFrame:
    """Greatest share inside each truth class, averaged in the same modes."""
    return _row_measure(df, cluster, truth, k, mode, "purity")


def adjusted_rand(df: DataFrame, cluster: str, truth: str, k: int) -> DataFrame:
    cells = _cells(df, cluster, truth, k)

    def choose(n):
        return n.cast("double") * (n - 1) / 2

    sums = cells.agg(
        F.sum(choose(F.col("n"))).alias("both"),
        F.sum(choose(F.col("n_c")) / k).alias("a"),
        F.sum(choose(F.col("n_t")) / k).alias("b"),
        choose(F.first("total")).alias("pairs"),
    )
    expected = ratio(F.col("a") * F.col("b"), "pairs")
    return sums.select(ratio(F.col("both") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("value"))


def variation_of_information(df: DataFrame, cluster: str, truth: str, k: int) -> DataFrame:
    """-sum p log(p^2 / (p_c p_t)), in nats."""
    p = ratio("n", "total")
    term = p * F.log(ratio(F.col("n").cast("double") * F.col("n"), F.col("n_c").cast("double") * F.col("n_t")))
    return _cells(df, cluster, truth, k).agg((-F.sum(F.when(F.col("n") > 0, term))).alias("value"))


def external_validation(labels: DataFrame, truth: DataFrame, key: str, methods, k: int, mode: str = "standard") -> DataFrame:
    """All external measures per labelling, compared by key: ``(method, metric, value)``."""
    both = labels.join(truth, key)
    parts = []
    for method in methods:
        measures = {
            "corrected_rand": adjusted_rand(both, method, "truth", k),
            "vi": variation_of_information(both, method, "truth", k),
            "entropy": external_entropy(both, method, "truth", k, mode),
            "purity": external_purity(both, method, "truth", k, mode),
        }
        parts += [
            df.select(F.lit(method).alias("method"), F.lit(name).alias("metric"), "value") for name, df in measures.items()
        ]
    return reduce(DataFrame.unionByName, parts)


