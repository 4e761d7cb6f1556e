"""Work that is shared between parts, folds and fits, and dealt to tasks by its cost."""

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext

from minekit.operators import classify, cluster, extremes, network, space, validate
from minekit.plans import classify_queries


def test_large_clusters_take_one_forest(spark, monkeypatch):
    g = np.random.default_rng(3)
    x = g.normal(size=(240, 2))
    label = g.integers(1, 5, 240)
    monkeypatch.setattr(cluster, "merge_heights", None)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(240), "x": x[:, 0], "y": x[:, 1], "cluster": label}))
    got = {r["cluster"]: r["widest_gap"] for r in validate.widest_gap(df, "id", ["x", "y"], leaf_points=30).collect()}
    want = {c: max(e[2] for e in cluster.dense_tree(x[label == c])) for c in range(1, 5)}
    assert got == pytest.approx(want)


def test_meetings_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(space, "POINTS_TOGETHER", 20)
    df = spark.createDataFrame(pd.DataFrame({"pid": np.arange(160), "leaf": np.arange(160) // 10}))

    def work(visitors, residents):
        assert visitors["leaf"].nunique() == 1 and set(visitors["leaf"]) == set(residents["leaf"])
        return pd.DataFrame({"pid": visitors["pid"], "task": TaskContext.get().partitionId()})

    rows = space.meet(df, df, work, "pid bigint, task bigint", "pid").collect()
    assert sorted(r["pid"] for r in rows) == list(range(160))
    assert len({r["task"] for r in rows}) > 2


def test_nearest_by_arrays_with_ties_and_limits():
    residents = pd.DataFrame({"key": [9, 4, 7, 1], "x": [1.0, -1.0, 1.0, 5.0]})
    visitors = pd.DataFrame({"qid": [0, 1], "x": [0.0, 4.0], "radius": [np.inf, 2.0]})
    out = space._nearest(["x"], 2, "key")(visitors, residents)
    assert [list(v) for v in out["near"]] == [[4, 7], [1]]
    assert [list(v) for v in out["d"]] == [[1.0, 1.0], [1.0]]


def test_planes_are_cut_on_a_small_sample(spark, monkeypatch):
    seen, build = [], space.Leaves.build.__func__
    monkeypatch.setattr(space.Leaves, "build", classmethod(lambda cls, sample, *a: seen.append(len(sample)) or build(cls, sample, *a)))
    points = spark.range(50_000).selectExpr("cast(id as double) as x")
    leaves = space.plant(points, ["x"], 4096)
    assert seen[0] < 12_000
    sizes = np.bincount(leaves.leaf_of(np.arange(50_000.0)[:, None]))
    assert len(sizes) == 16 and sizes.max() < 2 * 4096


def test_a_fold_is_laid_out_once_for_all_candidates(spark, monkeypatch):
    g = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(90), "a": g.normal(size=90), "b": g.normal(size=90), "fold": np.arange(90) % 3})
    pdf["risk"] = np.where(pdf["a"] > 0, "high", "low")
    laid_out, layout = [], classify.steady_layout
    monkeypatch.setattr(classify, "steady_layout", lambda df, *key: laid_out.append(1) or layout(df, *key))
    grid = {f"tree depth={d}": ("tree", {"maxDepth": d}) for d in (1, 2, 3)}
    rows = classify.tune_grid(spark.createDataFrame(pdf), "id", ["a", "b"], "risk", "fold", grid).collect()
    assert len(laid_out) == 4
    assert {(r["model"], r["fold"]) for r in rows} == {(m, f) for m in grid for f in range(3)}
    assert all(r["value"] > 0.9 for r in rows if r["metric"] == "accuracy")


def test_split_reads_a_written_view(spark, sf):
    for part in classify_queries.split(spark, sf):
        assert part.inputFiles() and all("minekit-" in f for f in part.inputFiles())


def test_rows_are_scaled_once_a_fold(monkeypatch):
    g = np.random.default_rng(7)
    nets = [network.Network(n, h, d, f) for n, (h, d) in network.network_grid((1, 2), (0.0, 0.1)).items() for f in (0, 1)]
    for net in nets:
        net.start(2, 2, 1)
        net.shift, net.scale = np.zeros(2), np.ones(2)
    seen, scaled = [], network.Network.scaled
    monkeypatch.setattr(network.Network, "scaled", lambda self, x: seen.append(self.fold) or scaled(self, x))
    batch = pd.DataFrame(g.normal(size=(20, 2)), columns=["a", "b"]).assign(_code=g.integers(0, 2, 20), _fold=np.arange(20) % 2)
    trials = {m: net.weights for m, net in enumerate(nets)}
    (sums,) = network.partial_sums(nets, trials, ["a", "b"], 2)(iter([batch]))
    assert sorted(seen) == [0, 1] and len(sums) == len(nets)


def test_greatest_distances_between_groups(monkeypatch):
    g = np.random.default_rng(8)
    x, y = g.normal(size=(1500, 3)), g.normal(size=(700, 3)) + 1
    first, last = np.array([0, 1, 40, 41, 900, 1300]), np.array([0, 350, 351])
    d = space.distances(x, y)
    want = np.maximum.reduceat(np.maximum.reduceat(d, first, axis=0), last, axis=1)
    inside = np.maximum.reduceat(np.maximum.reduceat(space.distances(x, x), first, axis=0), first, axis=1)
    for many in (1, 10**9):
        monkeypatch.setattr(extremes, "MANY_PAIRS", many)
        assert np.array_equal(extremes.greatest_between(x, first, y, last), want)
        assert np.array_equal(extremes.greatest_between(x, first), inside)


def merges_and_want(spark, x, leaf_points):
    names = ["x", "y", "z"][: x.shape[1]]
    points = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(x)), "weight": 1, **dict(zip(names, x.T))}))
    leaves = space.plant(points, names, leaf_points)
    tree = cluster.complete_tree(space.place(points, names, leaves), names, leaves, leaf_points)
    _, into, height = cluster._merge_table(space.distances(x, x), np.full(len(x), np.inf))
    want = [(int(into[j]), int(j), round(float(height[j]), 9)) for j in np.flatnonzero(into >= 0)]
    return sorted((r["a"], r["b"], round(r["height"], 9)) for r in tree.collect()), sorted(want)


def test_complete_linkage_in_halls_without_measured_pairs(spark, monkeypatch):
    monkeypatch.setattr(extremes, "farthest", None)
    got, want = merges_and_want(spark, np.random.default_rng(5).normal(size=(1600, 2)), 200)
    assert got == want


def test_complete_linkage_by_blocks_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PLACES_PER_CLUSTER", 4)
    monkeypatch.setattr(extremes, "farthest", None)
    got, want = merges_and_want(spark, np.random.default_rng(6).normal(size=(1200, 2)), 150)
    assert got == want


def test_complete_linkage_with_a_cluster_too_large_for_a_hall(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PLACES_PER_CLUSTER", 2)
    g = np.random.default_rng(7)
    got, want = merges_and_want(spark, np.concatenate([g.normal(size=(110, 2)) * 1e-4, g.normal(size=(110, 2))]), 40)
    assert got == want


def test_nearest_pairs_in_one_leaf_up_to_its_bound(spark, monkeypatch):
    monkeypatch.setattr(space, "visits", None)
    x = np.random.default_rng(9).normal(size=(5000, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(5000), "x": x[:, 0], "y": x[:, 1]}))
    got = [r["height"] for r in cluster.merge_heights(df, "id", ["x", "y"]).orderBy("step").collect()]
    assert got == sorted(e[2] for e in cluster.dense_tree(x))
