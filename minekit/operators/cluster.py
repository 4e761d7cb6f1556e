"""Clusterers. Labels are keyed by entity and numbered in a reproducible way."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from minekit.lineage import cut, number_rows, steady_layout
from minekit.operators import extremes, space
from minekit.operators.clean import unpivot_measures
from minekit.operators.reduce import pca_fit

#: Distinct places of a leaf in linkage by farthest pairs: a table of their distances is 32 MB.
LINKAGE_LEAF = 2048
#: Places that a hall of clusters holds, for each cluster that it may hold.
PLACES_PER_CLUSTER = 16
#: Chosen pairs are measured after a round that merged less than one in so many clusters, and all pairs once a leaf
#: could hold so many times the clusters.
LEAST_SHARE, FEW_LEFT = 8, 8
#: The table of the last clusters comes from at least so many blocks of them.
LEAST_BLOCKS = 8
#: Distinct places of a leaf in linkage by nearest pairs, whose tree needs no table of distances.
TREE_LEAF = 16_384


# ---------------------------------------------------------------- k-means


def fit_rows(df: DataFrame, key: str, cols) -> DataFrame:
    """Key and feature vector, in a layout that does not depend on the input's partitioning."""
    ordered = steady_layout(space.double_columns(df.select(key, *cols), cols), key)
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(ordered).select(key, "features", *cols)


def fit_kmeans(rows: DataFrame, k: int, seed: int):
    return KMeans(k=k, seed=seed, initMode="k-means||", maxIter=50, tol=1e-6).fit(rows)


def random_starts(rows: DataFrame, key: str, cols, size: int, seed: int) -> list[tuple]:
    """``size`` random distinct places, drawn by a hash of the key so that partitioning has no say."""
    places = rows.groupBy(*cols).agg(F.min(key).alias("pid"))
    drawn = places.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(size)
    return [tuple(r[c] for c in cols) for r in drawn.collect()]


def _centre_sums(cols, members: str, models):
    """Per task: count, coordinate sums and cost of every cluster of every model."""
    names = list(cols)

    def run(batches):
        totals: dict = {}
        for batch in batches:
            x_all, belongs = batch[names].to_numpy(float), batch[members].to_numpy()
            for part in np.unique(belongs):
                x = x_all[belongs == part]
                for model, (owner, centres) in models.items():
                    if owner != part:
                        continue
                    square = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
                    at = square.argmin(axis=1)
                    table = totals.setdefault(model, np.zeros((len(centres), len(names) + 2)))
                    table[:, 0] += np.bincount(at, minlength=len(centres))
                    table[:, 1] += np.bincount(at, weights=square[np.arange(len(x)), at], minlength=len(centres))
                    for j in range(len(names)):
                        table[:, 2 + j] += np.bincount(at, weights=x[:, j], minlength=len(centres))
        out = [(m, c, list(map(float, row))) for m, table in totals.items() for c, row in enumerate(table)]
        yield pd.DataFrame(out, columns=["model", "cluster", "sums"])

    return run


def kmeans_together(rows: DataFrame, cols, members: str, starts: dict, max_iter: int = 50, tol: float = 1e-6) -> dict:
    """Fit many k-means models in the same passes: ``{model: (centres, cost)}``.

    ``starts`` maps a model number to (value of ``members`` it is fitted on, first centres). Fitting
    them one by one would read the data once per model and iteration; here an iteration reads it once
    for all, and a task gives back a few sums per cluster. Models that have settled drop out.
    """
    active = {m: (part, np.array(c, dtype=float)) for m, (part, c) in starts.items()}
    settled: dict = {}
    for step in range(max_iter + 1):
        if not active:
            break
        partial = rows.mapInPandas(_centre_sums(cols, members, active), "model int, cluster int, sums array<double>")
        summed = (
            partial.select("model", "cluster", F.posexplode("sums"))
            .groupBy("model", "cluster", "pos")
            .agg(F.sum("col").alias("value"))
            .collect()
        )
        tables = {m: np.zeros((len(c), len(cols) + 2)) for m, (_, c) in active.items()}
        for r in summed:
            tables[r["model"]][r["cluster"], r["pos"]] = r["value"]
        moved = {}
        for m, (part, centres) in active.items():
            n, cost = tables[m][:, :1], float(tables[m][:, 1].sum())
            # an empty cluster keeps its centre
            new = np.where(n > 0, tables[m][:, 2:] / np.maximum(n, 1), centres)
            if step == max_iter or np.abs(new - centres).max() <= tol:
                settled[m] = (centres, cost)
            else:
                moved[m] = (part, new)
        active = moved
    return settled


def ordered_centres(centres) -> np.ndarray:
    """Centres in lexicographic order, so that cluster ids do not depend on the draw."""
    centres = np.array(list(centres))
    return centres[np.lexsort(centres.T[::-1])]


def nearest_centre(df: DataFrame, cols, centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """Number the nearest centre from 1; ties take the lower number. Plain Column arithmetic."""
    squares = [
        sum(
            ((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols[1:], centre[1:])),
            (F.col(cols[0]) - F.lit(float(centre[0]))) * (F.col(cols[0]) - F.lit(float(centre[0]))),
        )
        for centre in centres
    ]
    return (
        df.withColumn("_d", F.array(*squares))
        .withColumn(name, F.array_position("_d", F.array_min("_d")).cast("int"))
        .drop("_d")
    )


def kmeans_assign(df: DataFrame, key: str, cols, k: int, seed: int = 1234) -> DataFrame:
    rows = fit_rows(df, key, cols)
    model = fit_kmeans(rows, k, seed)
    labelled = nearest_centre(rows.select(key, *cols), list(cols), ordered_centres(model.clusterCenters()))
    return labelled.select(key, "cluster")


def kmeans_best_of(df: DataFrame, key: str, cols, k: int, starts: int = 5, seed: int = 1234) -> DataFrame:
    """The random start with the least total within-cluster sum of squares."""
    labelled, _ = kmeans_sweep(df, key, cols, [k], starts, seed)
    return labelled.select(key, F.col(f"k{k}").alias("cluster"))


def kmeans_sweep(df: DataFrame, key: str, cols, ks, starts: int = 5, seed: int = 1234):
    """Best of ``starts`` random starts for each k: labels ``(key, cols..., k<k>)`` and the costs.

    All fits share their passes, and every criterion reads these labels, so no criterion refits.
    """
    cols, ks = list(cols), list(ks)
    rows = steady_layout(space.double_columns(df.select(key, *cols), cols), key).withColumn("part", F.lit(0)).persist()
    draws = [random_starts(rows, key, cols, max(ks), seed + s) for s in range(starts)]
    if len(draws[0]) < max(ks):
        raise ValueError("more clusters than distinct points")
    tasks = [(k, s) for k in ks for s in range(starts)]
    fits = kmeans_together(rows, cols, "part", {i: (0, draws[s][:k]) for i, (k, s) in enumerate(tasks)})
    labelled, costs = rows.select(key, *cols), {}
    for k in ks:
        best = min((i for i, task in enumerate(tasks) if task[0] == k), key=lambda i: (fits[i][1], i))
        costs[k] = fits[best][1]
        labelled = nearest_centre(labelled, cols, ordered_centres(fits[best][0]), f"k{k}")
    rows.unpersist()
    return labelled, costs


def bisecting_assign(df: DataFrame, key: str, cols, k: int, seed: int = 1234) -> DataFrame:
    """Divisive hierarchical clustering, the linear-time built-in alternative to linkage."""
    rows = fit_rows(df, key, cols)
    model = BisectingKMeans(k=k, seed=seed).fit(rows)
    return model.transform(rows).select(key, (F.col("prediction") + 1).alias("cluster"))


def cluster_profile(df: DataFrame, cols, cluster: str = "cluster") -> DataFrame:
    """Centres in long form ``(cluster, name, value)``."""
    centres = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols])
    return unpivot_measures(centres, [cluster], list(cols), "name", "value")


def cluster_ss(df: DataFrame, cols, cluster: str = "cluster") -> DataFrame:
    """Size and within sum of squares per cluster, with total and between sums of squares.

    Squares come from counts and variances, so one aggregate serves all.
    """
    per = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.var_pop(c).alias(f"v_{c}") for c in cols],
    )
    within = F.col("n") * sum((F.col(f"v_{c}") for c in cols[1:]), F.col(f"v_{cols[0]}"))
    total_var = [F.var_pop(c) for c in cols]
    total = df.agg((F.count(F.lit(1)) * sum(total_var[1:], total_var[0])).alias("t")).scalar()
    everywhere = Window.partitionBy(F.lit(1))
    return (
        per.select(cluster, "n", within.alias("within_ss"))
        .withColumn("total_ss", total)
        # one row per cluster
        .withColumn("between_ss", F.col("total_ss") - F.sum("within_ss").over(everywhere))
    )


def cluster_projection(df: DataFrame, key: str, cols, cluster: str = "cluster") -> DataFrame:
    """Two-axis projection of the rows, with centroid and 2 x 2 covariance of each cluster."""
    scores = projection_scores(df, key, cols, cluster)
    return scores.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("axis_1").alias("centre_1"),
        F.avg("axis_2").alias("centre_2"),
        F.var_samp("axis_1").alias("var_1"),
        F.var_samp("axis_2").alias("var_2"),
        F.covar_samp("axis_1", "axis_2").alias("cov_12"),
    )


def projection_scores(df: DataFrame, key: str, cols, cluster: str = "cluster") -> DataFrame:
    scores = pca_fit(df, cols).scores(df, key)
    return scores.join(df.select(key, cluster), key)


# ---------------------------------------------------------------- neighbours and density


def knn_distance(df: DataFrame, key: str, cols, k: int, leaf_points: int = space.LEAF_POINTS) -> DataFrame:
    """The k nearest other rows of every row: ``(key, rank, neighbour, d)``; ties go to the lower key."""
    cols = list(cols)
    rows = cut(space.double_columns(df.select(key, *cols), cols))
    places = space.distinct_points(rows, key, cols).select(F.col("pid").alias("qid"), *cols)
    found = space.knn_join(places, rows, key, cols, k + 1, leaf_points)
    # rows sharing a place share its neighbours, less themselves
    placed = places.join(found, "qid").drop("qid")
    others = F.filter("found", lambda f: f["key"] != F.col(key))
    listed = rows.join(placed, cols).select(key, F.posexplode(F.slice(others, 1, k)).alias("pos", "f"))
    return listed.select(key, (F.col("pos") + 1).alias("rank"), F.col("f.key").alias("neighbour"), F.col("f.d").alias("d"))


def knn_curve(df: DataFrame, key: str, cols, k: int) -> DataFrame:
    """Distance to the k-th neighbour, with its position in ascending order."""
    last = knn_distance(df, key, cols, k).filter(F.col("rank") == k).select(key, "d")
    return number_rows(last, ["d", key]).select(key, "d", "position")


def _count_within(cols, eps: float):
    names = list(cols)

    def work(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if len(visitors) == 0 or len(residents) == 0:
            return pd.DataFrame({"pid": [], "near": []})
        b, weight = residents[names].to_numpy(float), residents["weight"].to_numpy()
        a = visitors[names].to_numpy(float)
        near = np.concatenate(
            [(space.distances(a[part], b) <= eps) @ weight for part in space.strips(len(a), len(b))]
        )
        return pd.DataFrame({"pid": visitors["pid"].to_numpy(), "near": near})

    return work


def _count_at_home(cols, eps: float):
    names = list(cols)

    def work(block: pd.DataFrame) -> pd.DataFrame:
        x, weight = block[names].to_numpy(float), block["weight"].to_numpy()
        near = [(space.distances(x[part], x) <= eps) @ weight for part in space.strips(len(x), len(x))]
        return block.assign(near=np.concatenate(near))

    return work


def joined_within(x: np.ndarray, eps: float) -> np.ndarray:
    """Least member index of each component of the rows linked by distances up to ``eps``.

    What is reached looks only among the rows not reached yet, so rows that lie close together take few distances.
    """
    label, left = np.arange(len(x)), np.arange(len(x))
    while len(left):
        seed, front, left, size = left[0], left[:1], left[1:], 1
        while len(front) and len(left):
            size = max(1, min(size, space.DISTANCES_AT_ONCE // len(left)))
            met = (space.distances(x[front[:size]], x[left]) <= eps).any(axis=0)
            front, left, size = np.concatenate([front[size:], left[met]]), left[~met], 2 * size
            label[front] = seed
    return label


def _core_components(cols, eps: float):
    names = list(cols)

    def work(core: pd.DataFrame) -> pd.DataFrame:
        core = core.sort_values("pid")
        ids = core["pid"].to_numpy()
        return core.assign(local=ids[joined_within(core[names].to_numpy(float), eps)])

    return work


def _narrow_nodes(core: DataFrame, cols, leaves: space.Leaves, eps: float) -> DataFrame:
    """``(leaf, local)`` of the leaves below a node whose core places all lie within ``eps`` of each other."""
    ends = [F.min("local").alias("local"), F.array(*[F.min(c) for c in cols]).alias("low"), F.array(*[F.max(c) for c in cols]).alias("high")]
    # one row per leaf, as many as the cutting planes
    table = core.groupBy("leaf").agg(*ends).toPandas().sort_values("leaf")
    leaf, local = table["leaf"].to_numpy().astype("int64"), table["local"].to_numpy().astype("int64")
    low, high = (np.array(table[c].to_list(), dtype=float).reshape(len(table), len(cols)) for c in ("low", "high"))
    low, high = leaves.node_ends(leaf, low, high, (np.inf, -np.inf))
    least, _ = leaves.node_ends(leaf, local, local, space.Marks.NOTHING)
    with np.errstate(invalid="ignore"):
        wide = np.where(high >= low, high - low, 0.0)
        # the same sums as of two places, so that no distance inside exceeds the diagonal
        diagonal = np.sqrt(sum((wide[:, j] ** 2 for j in range(1, len(cols))), wide[:, 0] ** 2))
    narrow = diagonal <= eps
    for node in range(2**leaves.depth - 1):
        if narrow[node]:
            below = slice(2 * node + 1, 2 * node + 3)
            narrow[below], least[below] = True, least[node]
    at = leaf + 2**leaves.depth - 1
    kept = pd.DataFrame({"leaf": leaf[narrow[at]], "clump": least[at][narrow[at]]})
    return core.sparkSession.createDataFrame(kept, "leaf bigint, clump bigint")


def _joined_cores(core: DataFrame, cols, leaves: space.Leaves, eps: float, leaf_points: int) -> DataFrame:
    """Add the least key of its component over all leaves to core places that are joined inside their leaves.

    Leaves below a narrow node are joined without a distance, then components by one place of each. Whatever is linked
    beyond that has a side that is not in the largest component, so only such places look, and only where others are.
    """
    def relabelled(frame: DataFrame, labels: DataFrame) -> DataFrame:
        named = labels.select(F.col("node").alias("local"), F.col("label").alias("top"))
        return cut(frame.join(named, "local").withColumn("local", F.col("top")).drop("top"))

    def linked(asking: DataFrame, residents: DataFrame) -> DataFrame:
        return space.meet(asking, residents, _touched(cols, eps), "a bigint, b bigint", "pid").distinct()

    clumps = cut(_narrow_nodes(core, cols, leaves, eps))
    core = cut(core.join(clumps, "leaf", "left").withColumn("local", F.coalesce("clump", "local")).drop("clump"))
    # the place with the least key of a component has it as its label
    one = cut(core.filter("pid = local").drop("leaf"))
    few = space.plant(one, cols, leaf_points)
    one = cut(space.place(one, cols, few).select(core.columns))
    asking = space.visits(one, cols, few, "radius", False, space.Marks(one, "local", few) if few.depth else None, "local")
    core = relabelled(core, space.connected_components(one.select(F.col("local").alias("node")), linked(asking, one)))
    sizes = core.groupBy("local").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.orderBy(F.desc("n"), "local").first()
    if largest is None:
        return core
    asking = space.visits(core.filter(F.col("local") != largest["local"]), cols, leaves, "radius", False, space.Marks(core, "local", leaves), "local")
    return relabelled(core, space.connected_components(sizes.select(F.col("local").alias("node")), linked(asking, core)))


def _touched(cols, eps: float):
    names = list(cols)

    def work(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if len(visitors) == 0 or len(residents) == 0:
            return pd.DataFrame({"a": [], "b": []})
        a, b = visitors[names].to_numpy(float), residents[names].to_numpy(float)
        own, mine = np.unique(visitors["local"].to_numpy(), return_inverse=True)
        label, theirs = np.unique(residents["local"].to_numpy(), return_inverse=True)
        met = np.zeros((len(own), len(label)), dtype=bool)
        for part in space.strips(len(a), len(b)):
            i, j = np.nonzero(space.distances(a[part], b) <= eps)
            met[mine[part][i], theirs[j]] = True
        i, j = np.nonzero(met & (own[:, None] != label[None, :]))
        return pd.DataFrame({"a": own[i], "b": label[j]})

    return work


def _least_label(cols, eps: float):
    names = list(cols)

    def work(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if len(visitors) == 0 or len(residents) == 0:
            return pd.DataFrame({"pid": [], "label": []})
        residents = residents.sort_values("label")
        b, label = residents[names].to_numpy(float), residents["label"].to_numpy()
        a, ids, out = visitors[names].to_numpy(float), visitors["pid"].to_numpy(), []
        for part in space.strips(len(a), len(b)):
            near = space.distances(a[part], b) <= eps
            hit = near.any(axis=1)
            first = near.argmax(axis=1)
            out.append(pd.DataFrame({"pid": ids[part][hit], "label": label[first[hit]]}))
        return pd.concat(out)

    return work


def dbscan(df: DataFrame, key: str, cols, eps: float, min_pts: int, leaf_points: int = space.LEAF_POINTS) -> DataFrame:
    """Density clustering: ``(key, cluster, role)``; noise is cluster 0.

    A row is core with at least ``min_pts`` rows within ``eps``, itself included. Clusters are numbered
    by their least core key; a border row takes the lowest-numbered adjacent cluster. Links between
    core rows are never listed: a leaf reports joined labels only.
    """
    cols = list(cols)
    rows = cut(space.double_columns(df.select(key, *cols), cols))
    points = cut(space.distinct_points(rows, key, cols))
    leaves = space.plant(points, cols, leaf_points)
    placed = cut(space.place(points, cols, leaves).withColumn("radius", F.lit(float(eps))))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    # a row that has its neighbours in its own leaf need not look further
    placed = cut(space.by_leaf(placed, leaves, leaf_points, _count_at_home(cols, eps), f"{fields}, near bigint"))
    if leaves.depth:
        asking = space.visits(placed.filter(F.col("near") < min_pts).drop("near"), cols, leaves, "radius", True)
        counts = space.meet(asking, placed.drop("near"), _count_within(cols, eps), "pid bigint, near bigint", "pid")
        more = counts.groupBy("pid").agg(F.sum("near").alias("more"))
        placed = cut(placed.join(more, "pid", "left").withColumn("near", F.col("near") + F.coalesce("more", F.lit(0))).drop("more"))
    # places without a key count as neighbours only
    placed = placed.filter(F.col("pid").isNotNull()).withColumn("core", F.col("near") >= min_pts).drop("near")

    core = placed.filter("core").drop("core")
    core = cut(space.by_leaf(core, leaves, leaf_points, _core_components(cols, eps), f"{fields}, local bigint"))
    if leaves.depth:
        core = _joined_cores(core, cols, leaves, eps, leaf_points)
    core = core.withColumnRenamed("local", "label")
    others = placed.filter(~F.col("core")).drop("core")
    border = space.meet(
        space.visits(others, cols, leaves, "radius", False, space.Marks(core, "label", leaves) if leaves.depth else None),
        core, _least_label(cols, eps), "pid bigint, label bigint", "pid",
    ).groupBy("pid").agg(F.min("label").alias("label"))

    numbers = number_rows(core.select("label").distinct(), ["label"], name="number")
    labelled = (
        core.select("pid", "label", F.lit("core").alias("role"))
        .unionByName(border.select("pid", "label", F.lit("border").alias("role")))
        .join(numbers, "label")
    )
    per_place = points.join(labelled, "pid", "left").select(
        *cols,
        F.coalesce(F.col("number") + 1, F.lit(0)).cast("int").alias("cluster"),
        F.coalesce("role", F.lit("noise")).alias("role"),
    )
    return rows.join(per_place, cols).select(key, "cluster", "role")


# ---------------------------------------------------------------- linkage


def dense_tree(x: np.ndarray):
    """Edges (i, j, height) of the minimum spanning tree of a small point set, ties by (i, j)."""
    n = len(x)
    axes = np.ascontiguousarray(x.T)
    # points of the tree have no way that could get shorter, and are never the next one
    best, outside = np.full(n, np.inf), np.full(n, np.inf)
    rank = np.full(n, n * n, dtype=np.int64)
    source = np.zeros(n, dtype=int)
    edges, current = [], 0
    for _ in range(n - 1):
        best[current], outside[current] = -np.inf, np.inf
        d = np.zeros(n)
        for axis in axes:
            gap = axis - axis[current]
            d += gap * gap
        np.sqrt(d, out=d)
        near = np.flatnonzero(d <= best)
        order = np.minimum(current, near) * n + np.maximum(current, near)
        closer = (d[near] < best[near]) | (order < rank[near])
        near, order = near[closer], order[closer]
        best[near] = outside[near] = d[near]
        rank[near], source[near] = order, current
        current = int(outside.argmin())
        ties = np.flatnonzero(outside == outside[current])
        if len(ties) > 1:
            # endless ways do not count as long as one point is still outside
            ties = ties[best[ties] > -np.inf]
            current = int(ties[np.argmin(rank[ties])])
        edges.append((int(source[current]), current, float(best[current])))
    return edges


def _certain_edges(cols, leaves: space.Leaves):
    """Tree edges of one leaf that no point outside the leaf could undercut."""
    names = list(cols)

    def work(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pid")
        x, ids = block[names].to_numpy(float), block["pid"].to_numpy()
        room = leaves.to_edge(x, int(block["leaf"].iloc[0]) % 2**leaves.depth)
        part = int(block["part"].iloc[0])
        parent = list(range(len(x)))

        def top(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for i, j, height in sorted(dense_tree(x), key=lambda e: (e[2], min(e[:2]), max(e[:2]))):
            a, b = top(i), top(j)
            if max(room[a], room[b]) > height:
                low, high = min(a, b), max(a, b)
                parent[high] = low
                room[low] = min(room[a], room[b])
                out.append((part, min(ids[i], ids[j]), max(ids[i], ids[j]), height))
        return pd.DataFrame(out, columns=["part", "a", "b", "height"])

    return work


#: Residents of a leaf that are all met, and places of a box where there are more.
MET_AT_ONCE, IN_BOX = 1_024, 128


def _least_ways(a, a_id, own, b, b_id, b_comp):
    """Per row of ``a`` the least distance to another component, and frames of the pairs that have it."""
    nearest, frames = np.full(len(a), np.inf), []
    for part in space.strips(len(a), len(b)):
        d = space.distances(a[part], b)
        d[own[part, None] == b_comp[None, :]] = np.inf
        least = nearest[part] = d.min(axis=1)
        rows, at = np.nonzero((d == least[:, None]) & np.isfinite(d))
        mine, theirs = a_id[part.start + rows], b_id[at]
        frames.append(
            pd.DataFrame(
                {
                    "comp": own[part.start + rows], "height": d[rows, at], "a": np.minimum(mine, theirs),
                    "b": np.maximum(mine, theirs), "other": b_comp[at],
                }
            )
        )
    return nearest, frames


def _ways_by_boxes(a, a_id, own, b, b_id, b_comp):
    """Frames with the least ways of each component, met only in boxes that can be as near as a way known to exist."""
    leaves = space.Leaves.build(b, math.ceil(math.log2(len(b) / IN_BOX)), b.shape[1])
    cell = leaves.leaf_of(b)
    boxes = [np.flatnonzero(cell == c) for c in np.unique(cell)]
    comps, code = np.unique(own, return_inverse=True)
    best = np.full(len(comps), np.inf)
    # two places of each box, of different components if it holds several
    some = np.array([box[at] for box in boxes for at in (b_comp[box].argmin(), b_comp[box].argmax())])
    for part in space.strips(len(a), len(some)):
        d = space.distances(a[part], b[some])
        d[(own[part, None] == b_comp[None, some]) | np.isnan(d)] = np.inf
        np.minimum.at(best, code[part], d.min(axis=1))
    home, found = leaves.leaf_of(a), []
    for inside in (True, False):
        for box in boxes:
            foreign = (own != b_comp[box].min()) | (own != b_comp[box].max())
            at = np.flatnonzero(foreign & ((home == cell[box[0]]) == inside))
            if not inside and len(at):
                gap = np.maximum(0, np.maximum(b[box].min(axis=0) - a[at], a[at] - b[box].max(axis=0)))
                # slack for rounding: a box too many is harmless, a missing one is not
                at = at[np.sqrt((gap**2).sum(axis=1)) <= best[code[at]] * (1 + 1e-9)]
            if len(at):
                nearest, frames = _least_ways(a[at], a_id[at], own[at], b[box], b_id[box], b_comp[box])
                np.fmin.at(best, code[at], nearest)
                found += [f[f["height"].to_numpy() <= best[np.searchsorted(comps, f["comp"].to_numpy())]] for f in frames]
    return found


def nearest_foreign(cols):
    names = list(cols)

    def work(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"comp": [], "height": [], "a": [], "b": [], "other": []})
        if len(visitors) == 0 or len(residents) == 0:
            return empty
        residents = residents.sort_values("pid")
        b, b_id, b_comp = (residents[names].to_numpy(float), residents["pid"].to_numpy(), residents["comp"].to_numpy())
        a, a_id, a_comp = (visitors[names].to_numpy(float), visitors["pid"].to_numpy(), visitors["comp"].to_numpy())
        if len(b) > MET_AT_ONCE:
            parts = _ways_by_boxes(a, a_id, a_comp, b, b_id, b_comp)
        else:
            parts = _least_ways(a, a_id, a_comp, b, b_id, b_comp)[1]
        if not parts:
            return empty
        found = pd.concat(parts)
        return found.sort_values(["comp", "height", "a", "b"]).drop_duplicates("comp")

    return work


EDGE = "comp bigint, height double, a bigint, b bigint, other bigint"


def spanning_tree(placed: DataFrame, cols, leaves: space.Leaves) -> DataFrame:
    """Minimum spanning tree ``(a, b, height)`` of placed points, by merging components."""
    return spanning_forest(placed.withColumn("part", F.lit(0).cast("long")), cols, leaves).drop("part")


def spanning_forest(placed: DataFrame, cols, leaves: space.Leaves) -> DataFrame:
    """Minimum spanning tree ``(part, a, b, height)`` of each part of placed points, all in the same rounds.

    Parts are numbered; the leaves of part p have numbers from p times the number of leaves on. Each leaf first
    fixes every edge that its own border proves right. The rest goes in rounds: each component finds its shortest
    way out, looking only into leaves nearer than the best known way. The largest component of a part need not look:
    each other one finds its edge, and one of them leads to it. A part that is one component drops out.
    """
    cols = list(cols)
    tree = space.dealt(placed, space.tasks_for(placed, leaves), "part", "leaf").groupBy("part", "leaf").applyInPandas(
        _certain_edges(cols, leaves), "part bigint, a bigint, b bigint, height double"
    )
    tree = cut(tree)
    if leaves.depth == 0:
        return tree
    parts = space.leaf_components(placed, tree.select("a", "b"))
    labelled = cut(placed.join(parts, F.col("pid") == F.col("node")).withColumnRenamed("label", "comp").drop("node"))
    shortest = F.min(F.struct("height", "a", "b", "other")).alias("e")
    spot = F.struct("comp", *cols)
    while True:
        # a component that fills its leaves is bounded by its distance to one point of another one
        ends = labelled.filter("pid = comp").groupBy("part").agg(F.min(spot).alias("one"), F.max(spot).alias("two"))
        ends = cut(ends.filter("one.comp <> two.comp"))
        if ends.isEmpty():
            return tree
        sizes = labelled.groupBy("part", "comp").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("part").agg(F.max(F.struct("n", "comp")).alias("largest"))
        held = cut(labelled.join(ends, "part").join(largest, "part").withColumn("asks", F.col("comp") != F.col("largest.comp")).drop("largest"))
        asked = held.filter("asks").drop("asks")
        labelled = held.drop("one", "two", "asks")
        mixed = labelled.groupBy("leaf").agg(F.min("comp").alias("one"), F.max("comp").alias("two")).filter("one <> two")
        mixed = cut(held.drop("one", "two").join(mixed.select("leaf"), "leaf"))
        home = space.meet(mixed.filter("asks").drop("asks"), mixed.drop("asks"), nearest_foreign(cols), EDGE, "pid")
        home = cut(home.groupBy("comp").agg(shortest))

        def away(end):
            squares = [(F.col(c) - F.col(f"{end}.{c}")) * (F.col(c) - F.col(f"{end}.{c}")) for c in cols]
            return F.sqrt(sum(squares[1:], squares[0]))

        to_end = F.when(F.col("comp") == F.col("one.comp"), away("two")).otherwise(away("one"))
        reach = asked.groupBy("comp").agg(F.min(to_end).alias("far"))
        reach = reach.join(home.select("comp", F.col("e.height").alias("near")), "comp", "left").select(
            "comp", F.coalesce("near", "far").alias("reach")
        )
        asking = asked.join(cut(reach), "comp").withColumn("radius", F.col("reach")).select(labelled.columns)
        outside = space.meet(
            space.visits(asking, cols, leaves, "radius", True), labelled, nearest_foreign(cols), EDGE, "pid"
        )
        both = home.select("comp", "e.*").unionByName(outside)
        chosen = cut(both.groupBy("comp").agg(shortest).select("comp", "e.*"))
        comps = cut(labelled.select("part", "comp").distinct())
        tree = cut(tree.unionByName(chosen.join(comps, "comp").select("part", "a", "b", "height").distinct()))
        joined = space.connected_components(
            comps.select(F.col("comp").alias("node")), chosen.select(F.col("comp").alias("a"), F.col("other").alias("b"))
        )
        labelled = cut(
            labelled.join(joined, F.col("comp") == F.col("node")).withColumn("comp", F.col("label")).drop("node", "label")
        )


def single_linkage(df: DataFrame, key: str, cols, k: int, leaf_points: int = TREE_LEAF) -> DataFrame:
    """Nearest-pair linkage cut into ``k`` clusters, numbered by least key: ``(key, cluster)``."""
    cols = list(cols)
    rows = cut(space.double_columns(df.select(key, *cols), cols))
    points = cut(space.distinct_points(rows, key, cols))
    leaves = space.plant(points, cols, leaf_points)
    placed = cut(space.place(points, cols, leaves).withColumn("radius", F.lit(0.0)))
    tree = spanning_tree(placed, cols, leaves)
    # the k - 1 longest edges are cut; k is a parameter, so these are few rows
    order = [F.desc("height"), F.desc("a"), F.desc("b")]
    longest = tree.orderBy(*order).limit(k - 1)
    if k - 1 > tree.count():
        raise ValueError("more clusters than distinct points")
    kept = tree.join(longest, ["a", "b"], "left_anti").select("a", "b")
    parts = space.leaf_components(placed, kept)
    numbers = number_rows(parts.select("label").distinct(), ["label"], name="number")
    per_place = (
        points.join(parts, F.col("pid") == F.col("node"))
        .join(numbers, "label")
        .select(*cols, (F.col("number") + 1).cast("int").alias("cluster"))
    )
    return rows.join(per_place, cols).select(key, "cluster")


def merge_heights(df: DataFrame, key: str, cols, leaf_points: int = TREE_LEAF) -> DataFrame:
    """Single-link dendrogram: spanning-tree edges in merge order ``(step, a, b, height)``."""
    cols = list(cols)
    points = cut(space.distinct_points(df, key, cols))
    leaves = space.plant(points, cols, leaf_points)
    placed = cut(space.place(points, cols, leaves).withColumn("radius", F.lit(0.0)))
    tree = spanning_tree(placed, cols, leaves)
    return number_rows(tree, ["height", "a", "b"], name="step").select("step", "a", "b", "height")


def _merge_table(gap: np.ndarray, room: np.ndarray):
    """Merge by a table of distances what is each other's nearest and nearer than the room of both.

    Returns the cluster of each item, and for absorbed ones the cluster that took them and the height.
    """
    n = len(gap)
    np.fill_diagonal(gap, np.inf)
    owner, into, height = np.arange(n), np.full(n, -1), np.full(n, np.nan)
    # the first of equal distances is the one with the least key
    near = gap.argmin(axis=1)
    best = gap[np.arange(n), near]
    while True:
        live = np.flatnonzero(into < 0)
        low = live[(near[near[live]] == live) & (live < near[live])]
        low = low[best[low] < np.minimum(room[low], room[near[low]])]
        if not len(low):
            return owner, into, height
        gone = near[low]
        for i, j in zip(low.tolist(), gone.tolist()):
            into[j], height[j] = i, best[i]
            gap[i] = np.maximum(gap[i], gap[j])
            gap[i, i] = gap[i, j] = np.inf
            gap[:, i] = gap[i]
            gap[j], gap[:, j] = np.inf, np.inf
            room[i] = max(room[i], room[j])
            owner[owner == j] = i
        touched = np.isin(near, np.concatenate([low, gone])) & (into < 0)
        touched[low] = True
        near[touched] = gap[touched].argmin(axis=1)
        best[touched] = gap[np.flatnonzero(touched), near[touched]]


def _certain_merges(cols, leaves: space.Leaves):
    """Farthest-pair merges of one leaf that no place outside it could forestall.

    Two clusters that are each other's nearest merge if their distance is less than the way to the leaf's
    border from some member of either: any cluster outside is farther than that.
    """
    names = list(cols)

    def work(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pid")
        x, ids = block[names].to_numpy(float), block["pid"].to_numpy()
        room = leaves.to_edge(x, int(block["leaf"].iloc[0])) if leaves.depth else np.full(len(x), np.inf)
        owner, into, height = _merge_table(space.distances(x, x), room)
        merged = into >= 0
        return pd.DataFrame(
            {"pid": ids, "comp": ids[owner], "into": pd.Series(ids[np.where(merged, into, 0)], dtype="Int64").where(merged), "height": height}
        )

    return work


def _merges_of_all(pairs: pd.DataFrame) -> pd.DataFrame:
    """All merges of clusters whose distances are all known."""
    ids = np.unique(pairs[["a", "b"]].to_numpy())
    a, b = np.searchsorted(ids, pairs["a"].to_numpy()), np.searchsorted(ids, pairs["b"].to_numpy())
    gap = np.full((len(ids), len(ids)), np.inf)
    gap[a, b] = gap[b, a] = pairs["d"].to_numpy()
    _, into, height = _merge_table(gap, np.full(len(ids), np.inf))
    gone = np.flatnonzero(into >= 0)
    return pd.DataFrame({"a": ids[into[gone]], "b": ids[gone], "height": height[gone]})


def _proved_reach(cols):
    """Per visiting cluster, a distance that the nearest cluster of the leaf is within, by means and radii."""
    names = list(cols)

    def work(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"comp": np.zeros(0, dtype="int64"), "reach": np.zeros(0)})]
        if len(visitors) and len(residents):
            a, b = visitors[names].to_numpy(float), residents[names].to_numpy(float)
            a_id, b_id = visitors["comp"].to_numpy(), residents["comp"].to_numpy()
            for part in space.strips(len(a), len(b)):
                most = space.distances(a[part], b) + visitors["far"].to_numpy()[part, None] + residents["far"].to_numpy()[None, :]
                most[a_id[part, None] == b_id[None, :]] = np.inf
                out.append(pd.DataFrame({"comp": a_id[part], "reach": most.min(axis=1)}))
        found = pd.concat(out)
        return found[np.isfinite(found["reach"])]

    return work


def _within_reach(cols):
    """(comp, other): no farthest pair is nearer than the root of the mean squared distance between two clusters."""
    names = list(cols)

    def work(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"comp": np.zeros(0, dtype="int64"), "other": np.zeros(0, dtype="int64")})]
        if len(visitors) and len(residents):
            a, b = visitors[names].to_numpy(float), residents[names].to_numpy(float)
            a_id, b_id = visitors["comp"].to_numpy(), residents["comp"].to_numpy()
            a_spread, b_spread, reach = visitors["spread"].to_numpy(), residents["spread"].to_numpy(), visitors["radius"].to_numpy(float)
            for part in space.strips(len(a), len(b)):
                bound = np.sqrt(space.distances(a[part], b) ** 2 + a_spread[part, None] + b_spread[None, :])
                bound[a_id[part, None] == b_id[None, :]] = np.inf
                rows, at = np.nonzero(np.isfinite(bound) & (bound <= reach[part, None] * (1 + 1e-9)))
                parts.append(pd.DataFrame({"comp": a_id[part][rows], "other": b_id[at]}))
        return pd.concat(parts)

    return work


def _turn(width: int, number: int) -> np.ndarray:
    """A turn of the axes; each round has its own, so that no place stays at a border."""
    return np.linalg.qr(np.random.default_rng(number).normal(size=(width, width)))[0]


def _hall_merges(cols, halls: space.Leaves, turn: np.ndarray):
    """Farthest-pair merges among the clusters of a hall that no cluster outside it could forestall.

    A cluster elsewhere has its mean beyond the hall's border, and no farthest pair is nearer than the way from a
    member to the other's mean, nor than the root of the mean squared distance. Of a cluster too large to come
    whole only the mean is there, and a row that stands for it bounds the others.
    """
    names = list(cols)

    def work(block: pd.DataFrame) -> pd.DataFrame:
        large = block[~block["whole"].to_numpy(bool)]
        block = block[block["whole"].to_numpy(bool)].sort_values("comp", kind="stable")
        if len(block) == 0:
            return pd.DataFrame({"comp": [], "to": [], "into": pd.Series([], dtype="Int64"), "height": []})
        x = block[names].to_numpy(float)
        ids, first, sizes = np.unique(block["comp"].to_numpy(), return_index=True, return_counts=True)
        mean = np.add.reduceat(x, first) / sizes[:, None]
        spread = np.add.reduceat(((x - mean.repeat(sizes, axis=0)) ** 2).sum(axis=1), first) / sizes
        room = np.full(len(ids), np.inf)
        if halls.depth:
            leaf = int(block["leaf"].iloc[0])
            inner = np.maximum.reduceat(halls.to_edge(x @ turn, leaf), first)
            room = np.maximum(inner, np.sqrt(np.maximum(halls.to_edge(mean @ turn, leaf), 0) ** 2 + spread))
        if len(large):
            apart = space.distances(mean, large[names].to_numpy(float)) ** 2 + large["spread"].to_numpy(float)
            room = np.minimum(room, np.sqrt(apart.min(axis=1) + spread))
        # slack for rounding in means and turns: a merge left for later is harmless, a wrong one is not
        room = room * (1 - 1e-9) - 1e-11 * np.abs(x).max()
        owner, into, height = _merge_table(extremes.greatest_between(x, first), room)
        merged = into >= 0
        into = pd.Series(ids[np.where(merged, into, 0)], dtype="Int64").where(merged)
        return pd.DataFrame({"comp": ids, "to": ids[owner], "into": into, "height": height})

    return work


def _merges_in_halls(state: DataFrame, means: DataFrame, cols, places: int, halls: space.Leaves, turn: np.ndarray) -> DataFrame:
    """``(comp, to, into, height)`` of the clusters in halls by turned means; a hall holds about ``places`` places."""
    turned = [f"turned{i}" for i in range(len(cols))]
    clusters = space.place(means, turned, halls).withColumn("whole", (F.col("n") <= places // 4) | F.lit(halls.depth == 0))
    # a hall that came out far too full is left for the rounds that measure chosen pairs
    full = F.sum(F.when(F.col("whole"), F.col("n")).otherwise(1)).over(Window.partitionBy("leaf"))
    many = F.count(F.lit(1)).over(Window.partitionBy("leaf"))
    clusters = cut(clusters.withColumn("full", full).withColumn("many", many))
    if halls.depth:
        clusters = clusters.filter((F.col("full") <= 2 * places) & (F.col("many") <= places // PLACES_PER_CLUSTER * 2))
    members = state.drop("leaf").join(clusters.filter("whole").select("comp", "leaf"), "comp").select(
        "leaf", "comp", *cols, F.lit(0.0).alias("spread"), F.lit(True).alias("whole")
    )
    rows = members.unionByName(clusters.filter("not whole").select("leaf", "comp", *cols, "spread", "whole"))
    rows = space.dealt(rows, 2**halls.depth, "leaf")
    return cut(rows.groupBy("leaf").applyInPandas(_hall_merges(cols, halls, turn), "comp bigint, to bigint, into bigint, height double"))


def _block_tables(cols):
    """Per cluster of one block, its distances to the clusters of the other."""
    width = len(cols)

    def arrays(block: pd.DataFrame):
        xs = [np.asarray(v, dtype=float).reshape(-1, width) for v in block["xs"]]
        return np.concatenate(xs), np.cumsum([0, *map(len, xs[:-1])])

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"a": [], "b": [], "d": []})
        table = extremes.greatest_between(*arrays(left), *arrays(right))
        return pd.DataFrame({"a": left["comp"].to_numpy(), "b": [right["comp"].to_numpy()] * len(left), "d": list(table)})

    return work


def _whole_table(state: DataFrame, cols, blocks: int) -> DataFrame:
    """``(a, b, d)``: per cluster, lists of clusters and of its distances to them; each pair comes from one task at least."""
    rows = state.groupBy("comp").agg(F.flatten(F.collect_list(F.array(*cols))).alias("xs"))
    rows = cut(rows.withColumn("own", F.pmod(F.xxhash64("comp"), F.lit(blocks)).cast("int")))
    left = rows.select("comp", "xs", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("j"))
    # fresh column ids, as both sides are the same frame
    fresh = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    right = fresh.select("comp", "xs", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    n = blocks * (blocks + 1) // 2
    left, right = space.dealt(left, n, "i", "j"), space.dealt(right, n, "i", "j")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_block_tables(cols), "a bigint, b array<bigint>, d array<double>")


def _merges_of_table(rows: pd.DataFrame) -> pd.DataFrame:
    """All merges of clusters by lists of their distances."""
    ids = np.unique(np.concatenate([rows["a"].to_numpy(), *rows["b"]]))
    gap = np.full((len(ids), len(ids)), np.inf)
    for a, b, d in zip(np.searchsorted(ids, rows["a"].to_numpy()), rows["b"], rows["d"]):
        at = np.searchsorted(ids, b)
        gap[a, at] = gap[at, a] = d
    _, into, height = _merge_table(gap, np.full(len(ids), np.inf))
    gone = np.flatnonzero(into >= 0)
    return pd.DataFrame({"a": ids[into[gone]], "b": ids[gone], "height": height[gone]})


def _tree_of(merges: DataFrame) -> DataFrame:
    return merges.filter(F.col("into").isNotNull()).select(F.col("into").alias("a"), F.col("comp").alias("b"), "height")


def _measured_pairs(state: DataFrame, means: DataFrame, cols, leaf_points: int, every: bool) -> DataFrame:
    """``(a, b, d)``: the distances of all pairs of clusters, or of those that can be the nearest of either."""
    clusters = means.select("comp", *cols, "spread", "far")
    halls = space.undivided(len(cols)) if every else space.plant(clusters, cols, leaf_points)
    clusters = cut(space.place(clusters, cols, halls).withColumn("radius", F.lit(float("inf"))))
    asking = clusters
    if not every:
        proved = space.meet(clusters, clusters, _proved_reach(cols), "comp bigint, reach double", "comp")
        # a cluster that is alone in its leaf is within reach of one of the first two
        one, two = means.orderBy("comp").limit(2).collect()
        lone = F.when(F.col("comp") == one["comp"], _to_mean(two, cols)).otherwise(_to_mean(one, cols))
        reach = F.coalesce("reach", lone)
        asking = clusters.join(proved, "comp", "left").withColumn("radius", reach).select(clusters.columns)
        asking = space.visits(asking, cols, halls, "radius", False)
    found = space.meet(asking, clusters, _within_reach(cols), "comp bigint, other bigint", "comp")
    pairs = cut(found.select(F.least("comp", "other").alias("a"), F.greatest("comp", "other").alias("b")).distinct())
    return extremes.farthest(pairs, extremes.blocks_of(state, cols), len(cols))


def complete_tree(placed: DataFrame, cols, leaves: space.Leaves, leaf_points: int) -> DataFrame:
    """All farthest-pair merges ``(a, b, height)`` of placed points; a cluster is named by its least key.

    Farthest-pair distances never shrink by a merge, so clusters that are each other's nearest may merge in
    any order, many at a time. Each leaf first makes the merges that its own border proves right; then clusters
    are dealt to halls by their means, along other axes each time, and a hall makes all the merges that its border
    proves right. Where that merges few, means and radii prove a distance within which a cluster's nearest one lies,
    the clusters whose mean is inside it are measured exactly, and what is nearest both ways merges. The clusters
    that are left are merged by the table of their distances: in one hall where their places fit it, else from
    blocks of clusters that meet in tasks, or, with a cluster too large to come whole, when few are left.
    """
    cols = list(cols)
    inside = cut(space.dealt(placed, space.tasks_for(placed, leaves), "leaf").groupBy("leaf").applyInPandas(_certain_merges(cols, leaves), "pid bigint, comp bigint, into bigint, height double"))
    tree = inside.filter(F.col("into").isNotNull()).select(F.least("into", "pid").alias("a"), F.greatest("into", "pid").alias("b"), "height")
    if leaves.depth == 0:
        return tree
    state = cut(placed.select("pid", "leaf", *cols).join(inside.select("pid", "comp"), "pid"))
    n, places, number = state.count(), leaf_points * PLACES_PER_CLUSTER, 0
    while True:
        number += 1
        turn = _turn(len(cols), number)
        means = cut(_cluster_means(state, cols, turn))
        left = means.count()
        if left <= leaf_points and n <= places:
            # all that is left fits one hall
            return tree.unionByName(_tree_of(_merges_in_halls(state, means, cols, places, space.undivided(len(cols)), turn)))
        if left <= 2 * leaf_points and means.agg(F.max("n")).first()[0] <= places:
            table = _whole_table(state, cols, max(LEAST_BLOCKS, math.ceil(n / places)))
            return tree.unionByName(table.groupBy(F.lit(0).alias("g")).applyInPandas(_merges_of_table, "a bigint, b bigint, height double"))
        if left <= leaf_points // FEW_LEFT:
            exact = _measured_pairs(state, means, cols, leaf_points, True)
            return tree.unionByName(exact.groupBy(F.lit(0).alias("g")).applyInPandas(_merges_of_all, "a bigint, b bigint, height double"))
        in_hall = max(2, min(leaf_points, left * places // n))
        halls = space.plant(means, [f"turned{i}" for i in range(len(cols))], in_hall)
        merges = _merges_in_halls(state, means, cols, places, halls, turn)
        found = _tree_of(merges)
        merged = found.count()
        if merged:
            tree = tree.unionByName(found)
            moved = merges.filter(F.col("comp") != F.col("to")).select("comp", "to")
            state = cut(state.join(moved, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to"))
        if merged * LEAST_SHARE < left and left - merged > 1:
            means = cut(_cluster_means(state, cols, turn))
            exact = cut(_measured_pairs(state, means, cols, leaf_points, False))
            sides = F.explode(F.array("a", "b")).alias("comp")
            nearest = exact.select(sides, F.struct("d", "a", "b").alias("e")).groupBy("comp").agg(F.min("e").alias("e")).select("e.*")
            mutual = cut(nearest.groupBy("a", "b", F.col("d").alias("height")).count().filter("count = 2").drop("count"))
            tree = tree.unionByName(mutual)
            moved = mutual.select(F.col("b").alias("comp"), F.col("a").alias("to"))
            state = cut(state.join(moved, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to"))


def _cluster_means(state: DataFrame, cols, turn: np.ndarray) -> DataFrame:
    """Per cluster its size, its mean, also on turned axes, its variance summed over the axes, and a distance from the mean that no member exceeds."""
    spread = sum((F.var_pop(c) for c in cols[1:]), F.var_pop(cols[0]))
    sums = state.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols], spread.alias("spread"), F.array(*[F.min(c) for c in cols]).alias("low"), F.array(*[F.max(c) for c in cols]).alias("high")
    )
    sides = [F.greatest(F.col("high")[i] - F.col(c), F.col(c) - F.col("low")[i]) for i, c in enumerate(cols)]
    parts = [[F.col(c) * F.lit(float(turn[i, j])) for i, c in enumerate(cols)] for j in range(len(cols))]
    sums = sums.withColumns({f"turned{j}": sum(p[1:], p[0]) for j, p in enumerate(parts)})
    return sums.withColumn("far", F.sqrt(sum((s * s for s in sides[1:]), sides[0] * sides[0]))).drop("low", "high")


def _to_mean(spot, cols):
    squares = [(F.col(c) - F.lit(spot[c])) * (F.col(c) - F.lit(spot[c])) for c in cols]
    return F.sqrt(sum(squares[1:], squares[0])) + F.col("far") + F.lit(spot["far"])


def complete_linkage(df: DataFrame, key: str, cols, k: int, leaf_points: int = LINKAGE_LEAF) -> DataFrame:
    """Farthest-pair linkage cut into ``k`` clusters, numbered by least key: ``(key, cluster)``.

    Exact at any size. Of equal distances the pair with the least keys merges first.
    """
    cols = list(cols)
    rows = cut(space.double_columns(df.select(key, *cols), cols))
    points = cut(space.distinct_points(rows, key, cols))
    leaves = space.plant(points, cols, leaf_points)
    placed = cut(space.place(points, cols, leaves))
    tree = cut(complete_tree(placed, cols, leaves, leaf_points))
    if k - 1 > tree.count():
        raise ValueError("more clusters than distinct points")
    # the k - 1 last merges are undone; k is a parameter, so these are few rows
    last = tree.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(k - 1)
    kept = tree.join(last, ["a", "b"], "left_anti").select("a", "b")
    parts = space.leaf_components(placed, kept)
    numbers = number_rows(parts.select("label").distinct(), ["label"], name="number")
    per_place = (
        points.join(parts, F.col("pid") == F.col("node"))
        .join(numbers, "label")
        .select(*cols, (F.col("number") + 1).cast("int").alias("cluster"))
    )
    return rows.join(per_place, cols).select(key, "cluster")
