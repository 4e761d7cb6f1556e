"""Neighbour operators against brute force, with leaves so small that many are needed."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from minekit.lineage import cut
from minekit.operators import cluster, extremes, space, validate
from minekit.plans import cluster_queries, studies, views


def brute(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.fixture(scope="module")
def cloud():
    """Two blobs, a bridge point, a far point, and a third of the rows in one place."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (70, 2)), rng.normal(5, 1, (60, 2)), [[2.5, 2.5]], [[30.0, 30.0]]])
    x = np.round(np.concatenate([x, np.repeat(x[:1], 66, axis=0)]), 2)
    return x, pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]})


@pytest.mark.parametrize("leaf_points", [24, 4096])
def test_knn(spark, cloud, leaf_points):
    x, pdf = cloud
    got = cluster.knn_distance(spark.createDataFrame(pdf).repartition(5), "id", ["x", "y"], 4, leaf_points)
    got = got.toPandas().sort_values(["id", "rank"])
    d = brute(x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got["neighbour"].to_numpy().reshape(-1, 4) == order).all()
    assert np.allclose(got["d"].to_numpy().reshape(-1, 4), np.take_along_axis(d, order, 1))


def test_all_pairs_are_listed(spark, cloud):
    """Every pair of rows with different keys once, over several blocks, also for keys that come twice."""
    x, pdf = cloud
    pdf = pdf.assign(id=np.where(pdf["id"] == 7, 6, pdf["id"]))
    got = validate.pair_distances(spark.createDataFrame(pdf).repartition(5), "id", ["x", "y"], 30).collect()
    ids, d = pdf["id"].to_numpy(), brute(x)
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j]), d[i, j]) for i in range(len(x)) for j in range(i) if ids[i] != ids[j])
    got = sorted(tuple(r) for r in got)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want])


def test_pairwise_distance_lists_each_pair(spark, sf):
    rows = cluster_queries.q_pairwise_distance(spark, sf)
    n = rows.select("vec_id").distinct().count()
    pairs = rows.filter("other is not null")
    assert pairs.filter("vec_id < other and distance is not null").select("vec_id", "other").distinct().count() == n * (n - 1) // 2
    assert pairs.count() + rows.filter("total_distance is not null").count() == n * (n - 1) // 2 + n


def brute_dbscan(x, eps, min_pts):
    near = brute(x) <= eps
    core = near.sum(axis=1) >= min_pts
    label = np.full(len(x), -1)
    for i in np.nonzero(core)[0]:
        if label[i] < 0:
            label[i], queue = i, [i]
            while queue:
                for j in np.nonzero(near[queue.pop()] & core)[0]:
                    if label[j] < 0:
                        label[j] = i
                        queue.append(j)
    tops = sorted(set(label[core]))
    number = {t: i + 1 for i, t in enumerate(tops)}
    out = []
    for i in range(len(x)):
        touching = [number[label[j]] for j in np.nonzero(near[i] & core)[0]]
        out.append(number[label[i]] if core[i] else min(touching, default=0))
    return np.array(out)


@pytest.mark.parametrize("leaf_points", [24, 4096])
def test_dbscan(spark, cloud, leaf_points):
    x, pdf = cloud
    got = cluster.dbscan(spark.createDataFrame(pdf).repartition(3), "id", ["x", "y"], 0.7, 5, leaf_points)
    got = got.toPandas().sort_values("id")
    assert (got["cluster"].to_numpy() == brute_dbscan(x, 0.7, 5)).all()
    assert set(got["role"]) == {"core", "border", "noise"}


def test_dbscan_of_wide_balls_visits_few_leaves(spark, monkeypatch):
    """Balls that reach most of the leaves: what is settled by a leaf or a narrow box does not travel."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), rng.normal(9, 0.4, (80, 2)), rng.uniform(-30, 40, (20, 2))])
    pdf = pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]})
    visitors, meet = [], space.meet
    monkeypatch.setattr(space, "meet", lambda a, b, *rest: visitors.append(a.count()) or meet(a, b, *rest))
    got = cluster.dbscan(spark.createDataFrame(pdf).repartition(3), "id", ["x", "y"], 1.2, 5, 16).toPandas().sort_values("id")
    assert (got["cluster"].to_numpy() == brute_dbscan(x, 1.2, 5)).all()
    assert sum(visitors) < 2 * len(x)


def test_visits_leave_a_task_in_small_frames(monkeypatch):
    class Points:
        schema = None

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(space, "VISITS_AT_ONCE", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    leaves = space.Leaves.build(x, 5, 2)
    batch = pd.DataFrame({"id": np.arange(500), "x": x[:, 0], "y": x[:, 1], "leaf": leaves.leaf_of(x), "radius": 0.9})
    frames = list(space.visits(Points(), ["x", "y"], leaves, "radius", True)(iter([batch])))
    row, leaf = leaves.reached(x, np.full(500, 0.9))
    away = leaf != leaves.leaf_of(x)[row]
    found = pd.concat(frames)
    assert max(map(len, frames)) <= 100
    assert set(zip(found["id"], found["leaf"])) == set(zip(row[away], leaf[away])) and len(found) == away.sum()


def test_components_of_rows_within_a_distance():
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, (300, 2))
    i, j = np.nonzero(space.distances(x, x) <= 0.6)
    assert (cluster.joined_within(x, 0.6) == space.union_labels(len(x), i, j)).all()


@pytest.mark.parametrize("grid", [False, True])
def test_shortest_ways_of_a_large_leaf_by_boxes(monkeypatch, grid):
    """The same ways, ties included, as from all pairs, with far fewer distances."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    x = np.unique(np.rint(x * 6), axis=0) if grid else x
    pdf = pd.DataFrame({"pid": rng.permutation(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})
    # many small components in a large one
    pdf["comp"] = np.where(rng.random(len(x)) < 0.3, pdf["pid"], np.where(x[:, 0] < 0.5, -1, -2))
    visitors, taken, distances = pdf[pdf["comp"] != -1], [], space.distances
    monkeypatch.setattr(space, "distances", lambda a, b: taken.append(len(a) * len(b)) or distances(a, b))
    got = cluster.nearest_foreign(["x", "y", "z"])(visitors, pdf).reset_index(drop=True)
    assert sum(taken) < len(visitors) * len(pdf) / 2
    monkeypatch.setattr(cluster, "MET_AT_ONCE", len(pdf))
    pd.testing.assert_frame_equal(got, cluster.nearest_foreign(["x", "y", "z"])(visitors, pdf).reset_index(drop=True))


def test_work_that_is_done_at_the_same_time(spark):
    """Two frames that wait for each other are only built if they are built together."""
    both = threading.Barrier(2, timeout=60)

    def fit(n):
        both.wait()
        return spark.range(n)

    assert [f.count() for f in studies._together(spark, lambda: fit(3), lambda: fit(5))] == [3, 5]


def test_whole_hundredths_are_rounded_as_by_round(spark):
    values = [0.125, 0.135, 1.005, -0.125, -0.005, 2.675, 0.0049999999999999994, 901.0, 104949.5, 33333.335, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r[0] == r[1] for r in df.select(views.hundredths("v"), F.round(F.col("v") * 100).cast("long")).collect())


def brute_linkage(x, k, join):
    """Agglomerate distinct places; clusters numbered by first member."""
    _, first, back = np.unique(x, axis=0, return_index=True, return_inverse=True)
    places = x[first]
    d = brute(places)
    groups = [[i] for i in range(len(places))]
    while len(groups) > k:
        pairs = [(join(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    least = {min(first[m] for m in g): g for g in groups}
    label = np.zeros(len(places), dtype=int)
    for number, start in enumerate(sorted(least)):
        label[least[start]] = number + 1
    return label[back.ravel()]


@pytest.mark.parametrize("leaf_points", [40, 4096])
def test_single_linkage(spark, cloud, leaf_points):
    x, pdf = cloud
    got = cluster.single_linkage(spark.createDataFrame(pdf), "id", ["x", "y"], 4, leaf_points).toPandas().sort_values("id")
    assert (got["cluster"].to_numpy() == brute_linkage(x, 4, np.min)).all()


@pytest.mark.parametrize("leaf_points", [60, 2048])
def test_complete_linkage(spark, cloud, leaf_points):
    x, pdf = cloud
    got = cluster.complete_linkage(spark.createDataFrame(pdf), "id", ["x", "y"], 4, leaf_points).toPandas().sort_values("id")
    assert (got["cluster"].to_numpy() == brute_linkage(x, 4, np.max)).all()


def greedy_merges(x):
    """All farthest-pair merges, the least (distance, keys) first, on one table of distances."""
    gap = space.distances(x, x)
    np.fill_diagonal(gap, np.inf)
    out = []
    for _ in range(len(x) - 1):
        i, j = divmod(int(gap.argmin()), len(x))
        out.append((min(i, j), max(i, j), gap[i, j]))
        i, j = min(i, j), max(i, j)
        gap[i] = np.maximum(gap[i], gap[j])
        gap[:, i] = gap[i]
        gap[i, i] = np.inf
        gap[j], gap[:, j] = np.inf, np.inf
    return out


@pytest.mark.parametrize(("n", "leaf_points", "grid"), [(300, 90, False), (250, 60, True), (1500, 700, False), (1500, 2048, True)])
def test_complete_tree_equals_greedy_merging(spark, n, leaf_points, grid):
    """The same merges and heights over several leaves as by merging one pair after another, ties included."""
    rng = np.random.default_rng(n + leaf_points)
    x = rng.normal(size=(n, 3)) * [3, 1, 1]
    if grid:
        x = np.unique(np.rint(x * 4), axis=0)
    pdf = pd.DataFrame({"pid": np.arange(len(x)), "weight": 1, "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})
    points = cut(spark.createDataFrame(pdf))
    leaves = space.plant(points, ["x", "y", "z"], leaf_points)
    assert (leaves.depth > 0) == (len(x) > leaf_points)
    tree = cluster.complete_tree(space.place(points, ["x", "y", "z"], leaves), ["x", "y", "z"], leaves, leaf_points)
    got = sorted((r["a"], r["b"], round(r["height"], 9)) for r in tree.collect())
    assert got == sorted((a, b, round(float(h), 9)) for a, b, h in greedy_merges(x))


@pytest.mark.parametrize("leaf_points", [20, 4096])
def test_diameters_and_dunn_index(spark, leaf_points):
    rng = np.random.default_rng(4)
    x, group = rng.normal(size=(500, 2)), rng.integers(1, 6, size=500)
    x[group == 5] = x[group == 5] * 0.1 + 9
    x, group = np.concatenate([x, [[50.0, 50.0]]]), np.append(group, 7)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "cluster": group, "x": x[:, 0], "y": x[:, 1]}))
    want = {c: space.distances(x[group == c], x[group == c]).max() for c in np.unique(group)}
    got = {r["cluster"]: r["diameter"] for r in validate.cluster_diameter(df, "id", ["x", "y"], leaf_points=leaf_points).collect()}
    assert got == want
    d = space.distances(x, x)
    row = validate.dunn_index(df, "id", ["x", "y"], leaf_points=leaf_points).first()
    assert row["min_separation"] == d[group[:, None] != group[None, :]].min() and row["max_diameter"] == max(want.values())


def test_separation_of_clusters_that_share_no_leaf(spark):
    x = np.concatenate([np.random.default_rng(c).normal(20 * c, 1, size=(60, 2)) for c in range(3)])
    group = np.repeat([1, 2, 3], 60)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(180), "cluster": group, "x": x[:, 0], "y": x[:, 1]}))
    places = cut(validate.labelled_places(df, "id", ["x", "y"]))
    d = space.distances(x, x)
    got = validate._least_separation(places, ["x", "y"], 20).first()["min_separation"]
    assert got == d[group[:, None] != group[None, :]].min()
    alone = cut(validate.labelled_places(df.filter("cluster = 1"), "id", ["x", "y"]))
    assert validate._least_separation(alone, ["x", "y"], 20).first()["min_separation"] is None


def test_connected_components_large_path(spark, monkeypatch):
    monkeypatch.setattr(space, "SMALL_GRAPH", 0)
    nodes = spark.range(12).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6), (8, 7), (8, 9)], "a long, b long")
    got = {r["node"]: r["label"] for r in space.connected_components(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11}


def brute_silhouette(x, label):
    d, out = brute(x), []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_silhouette_over_many_blocks(spark, cloud, monkeypatch):
    x, pdf = cloud
    label = np.where(x[:, 0] > 20, 3, np.where(x[:, 0] > 2.5, 2, 1))
    monkeypatch.setattr(validate.place_sums, "__defaults__", (("cluster",), 16))
    df = spark.createDataFrame(pdf.assign(cluster=label))
    got = validate.silhouette(df, "id", ["x", "y"]).toPandas().sort_values("id")
    assert np.allclose(got["width"], brute_silhouette(x, label))


def test_kmeans_does_not_depend_on_partitions(spark, cloud):
    _, pdf = cloud
    one = cluster.kmeans_assign(spark.createDataFrame(pdf).coalesce(1), "id", ["x", "y"], 3)
    many = cluster.kmeans_assign(spark.createDataFrame(pdf).repartition(8), "id", ["x", "y"], 3)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_sweep_cost_falls_with_k(spark, cloud):
    _, pdf = cloud
    rows = validate.sweep(spark.createDataFrame(pdf), "id", ["x", "y"], range(2, 6), starts=3).collect()
    by = {(r["metric"], r["k"]): r["value"] for r in rows}
    costs = [by["wcss", k] for k in range(2, 6)]
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))
    assert all(-1 <= by["silhouette", k] <= 1 for k in range(2, 6))


def test_widest_gap_small_and_large_clusters_agree(spark, cloud):
    x, pdf = cloud
    df = spark.createDataFrame(pdf.assign(cluster=np.where(x[:, 0] > 2.5, 2, 1)))
    whole = {r["cluster"]: r["widest_gap"] for r in validate.widest_gap(df, "id", ["x", "y"]).collect()}
    split = {r["cluster"]: r["widest_gap"] for r in validate.widest_gap(df, "id", ["x", "y"], leaf_points=50).collect()}
    assert whole == pytest.approx(split)


def test_median_distance_counts_copies(spark, cloud):
    x, pdf = cloud
    label = np.where(x[:, 0] > 20, 3, np.where(x[:, 0] > 2.5, 2, 1))
    df = spark.createDataFrame(pdf.assign(cluster=label))
    got = {r["cluster"]: r["median_distance"] for r in validate.median_distance(df, "id", ["x", "y"], block=40).collect()}
    for c in (1, 2):
        d = brute(x[label == c])
        assert got[c] == pytest.approx(np.median(d[np.triu_indices(len(d), 1)]))
    assert 3 not in got


def test_cuts_leave_rows_on_both_sides():
    """Half the places at the top of a capped axis, or on a two-valued one, still fill all leaves."""
    rng = np.random.default_rng(9)
    capped = np.minimum(rng.normal(size=(4000, 3)), [0.0, 9.0, 9.0])
    flags = np.column_stack([rng.random(4000) < 0.7, rng.normal(size=4000) * 0.01, rng.normal(size=4000) * 0.01]).astype(float)
    for places in (capped, flags):
        leaves = space.Leaves.build(places, 5, 3)
        sizes = np.bincount(leaves.leaf_of(places), minlength=32)
        assert sizes.min() > 0 and sizes.max() <= 2 * 4000 / 32 * 1.5


def test_equal_places_are_one_leaf():
    leaves = space.Leaves.build(np.ones((50, 2)), 2, 2)
    assert len(set(leaves.leaf_of(np.ones((7, 2))).tolist())) == 1


def test_strip_sums_of_several_labelings_with_copies_and_an_endless_place(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 2)), [[np.inf, 0.0]]])
    frame = pd.DataFrame({"x": x[:, 0], "y": x[:, 1], "pid": np.arange(151), "weight": rng.integers(1, 4, 151)})
    frame["k3"], frame["k9"] = np.append(rng.integers(1, 4, 150), 7), np.append(rng.integers(1, 10, 150), 7)
    monkeypatch.setattr(validate, "TILE_ROWS", 7)
    monkeypatch.setattr(validate, "TILE_PLACES", 16)
    with np.errstate(invalid="ignore"):
        got = validate._strip_sums(["x", "y"], ["k3", "k9"], True)(frame.iloc[:40], frame)
        d = space.distances(x[:40], x)
    assert len(got) == 40 * (frame["k3"].nunique() + frame["k9"].nunique())
    for r in got.sample(200, random_state=1).itertuples():
        here = (frame[r.labeling] == r.other).to_numpy()
        assert r.total == pytest.approx((d[r.pid, here] * frame["weight"][here]).sum())
        assert (r.near, r.far) == (d[r.pid, here].min(), d[r.pid, here].max())


def test_strips_give_back_few_sums(spark):
    """One row per place and cluster and block of places, not one per small block that it meets."""
    df = spark.range(6000).selectExpr("id", "rand(1) AS x", "rand(2) AS y", "id % 2 AS cluster")
    places = cut(validate.labelled_places(df, "id", ["x", "y"]))
    found = validate._strip_meeting(places, validate.BLOCK_PLACES, 2).applyInPandas(
        validate._strip_sums(["x", "y"], ["cluster"], False),
        "labeling string, pid bigint, own bigint, weight bigint, other bigint, total double, near double, far double",
    )
    assert found.count() == 2 * 6000


def test_sweep_takes_the_dunn_index_without_all_pairs(spark, cloud, monkeypatch):
    x, pdf = cloud

    def refused(*args, **kwargs):
        raise AssertionError("all pairs")

    monkeypatch.setattr(validate, "place_sums", refused)
    df = spark.createDataFrame(pdf)
    rows = validate.sweep(df, "id", ["x", "y"], range(2, 5), starts=2, measures=["dunn"]).collect()
    labelled, _ = cluster.kmeans_sweep(df, "id", ["x", "y"], range(2, 5), 2, 1234)
    labels = labelled.toPandas().sort_values("id")
    d = brute(x)
    for r in rows:
        k = labels[f"k{r['k']}"].to_numpy()
        same = k[:, None] == k[None, :]
        assert r["value"] == pytest.approx(d[~same].min() / d[same].max())
    small = cut(validate.labelled_places(labelled, "id", ["x", "y"], ["k2", "k3"]))
    many = {r["labeling"]: r["min_separation"] for r in validate._least_separations(small, ["x", "y"], ["k2", "k3"], 16).collect()}
    assert many == pytest.approx({n: d[labels[n].to_numpy()[:, None] != labels[n].to_numpy()[None, :]].min() for n in ("k2", "k3")})
