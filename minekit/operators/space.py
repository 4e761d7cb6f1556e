"""Nearness over keyed points without forming all pairs as rows.

Equal coordinates are one weighted point. A small tree of cutting planes, built on a bounded sample,
places every point in a leaf; a leaf holds a bounded number of distinct points. A query visits only
the leaves its ball reaches, and a task meets one leaf with one chunk of visitors as arrays, giving
back one row per visitor. The sample decides only how even the leaves are, never a result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from minekit.lineage import cut
from minekit.operators.joins import first_rows

LEAF_POINTS = 4096
VISITORS_PER_TASK = 8192
# small neighbouring leaves meet in one task up to so many visitors and residents; they are dealt out in blocks of so many leaves
POINTS_TOGETHER, LEAVES_IN_BLOCK = 2048, 1024
MOST_TASKS = 4000
# the sample grows with the number of leaves up to a bound on what the driver holds; beyond that bound
# leaves grow instead
SAMPLE_PER_LEAF = 32
LEAST_SAMPLE, MOST_SAMPLE = 10_000, 4_000_000
DISTANCES_AT_ONCE = 4_000_000
# rows that a task hands on at once where points visit leaves, and points that it begins with
VISITS_AT_ONCE, FIRST_VISITORS = 100_000, 16
SMALL_GRAPH = 200_000


class Leaves:
    """Axis-parallel cutting planes of a complete binary tree."""

    def __init__(self, axis: np.ndarray, at: np.ndarray, depth: int, width: int):
        self.axis, self.at, self.depth, self.width = axis, at, depth, width

    @classmethod
    def build(cls, sample: np.ndarray, depth: int, width: int) -> "Leaves":
        inner = 2**depth - 1
        axis, at = np.zeros(inner, dtype=int), np.zeros(inner)
        rows = {0: sample}
        for node in range(inner):
            x = rows.pop(node)
            if len(x):
                axis[node], at[node] = cls.plane(x)
            right = x[:, axis[node]] > at[node]
            rows[2 * node + 1], rows[2 * node + 2] = x[~right], x[right]
        return cls(axis, at, depth, width)

    @staticmethod
    def plane(x: np.ndarray) -> tuple[int, float]:
        """Axis and place of a cut that leaves rows on both sides wherever two places differ.

        The widest axis is taken if its median leaves a quarter on either side, else the most even one. A median
        that is the axis's greatest value moves to the value below it.
        """
        best = (-1.0, 0, 0.0)
        for a in np.argsort(x.min(axis=0) - x.max(axis=0), kind="stable"):
            v = x[:, a]
            top, middle = v.max(), np.median(v)
            if middle >= top:
                below = v[v < top]
                middle = below.max() if len(below) else top
            share = float((v <= middle).mean())
            even = min(share, 1 - share)
            if even > best[0]:
                best = (even, int(a), float(middle))
            if even >= 0.25:
                break
        return best[1], best[2]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.at[node])
        return node - (2**self.depth - 1)

    def reached(self, x: np.ndarray, radius: np.ndarray, wanted=None):
        """(row, leaf) for every leaf whose cell meets the closed ball around a row.

        ``wanted(row, node)`` may tell where nothing below a node matters to a row.
        """
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=int)
        gap = np.zeros((len(x), self.width))
        limit = np.where(np.isfinite(radius), radius, np.inf) ** 2
        # slack for rounding in the squares: an extra leaf is harmless, a missing one is not
        limit = limit * (1 + 1e-12) + 1e-300
        for _ in range(self.depth):
            axis = self.axis[node]
            offset = x[row, axis] - self.at[node]
            near = 2 * node + 1 + (offset > 0)
            far = 2 * node + 1 + (offset <= 0)
            far_gap = gap.copy()
            far_gap[np.arange(len(row)), axis] = np.maximum(np.abs(offset), far_gap[np.arange(len(row)), axis])
            keep = (far_gap**2).sum(axis=1) <= limit[row]
            row = np.concatenate([row, row[keep]])
            node = np.concatenate([near, far[keep]])
            gap = np.concatenate([gap, far_gap[keep]])
            if wanted is not None:
                keep = wanted(row, node)
                row, node, gap = row[keep], node[keep], gap[keep]
        return row, node - (2**self.depth - 1)

    def node_ends(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray, nothing) -> tuple[np.ndarray, np.ndarray]:
        """Per node, the least of ``low`` and the greatest of ``high`` over its leaves; ``nothing`` is what an empty leaf has."""
        shape = (2 ** (self.depth + 1) - 1, *low.shape[1:])
        lows, highs = np.full(shape, nothing[0], dtype=low.dtype), np.full(shape, nothing[1], dtype=high.dtype)
        first = 2**self.depth - 1
        lows[first + leaf], highs[first + leaf] = low, high
        for level in range(self.depth - 1, -1, -1):
            at, below = slice(2**level - 1, 2 ** (level + 1) - 1), slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
            lows[at], highs[at] = np.minimum(lows[below][::2], lows[below][1::2]), np.maximum(highs[below][::2], highs[below][1::2])
        return lows, highs

    def to_edge(self, x: np.ndarray, leaf: int) -> np.ndarray:
        """Distance of points of a leaf to the border of its cell."""
        low, high = np.full(self.width, -np.inf), np.full(self.width, np.inf)
        node = leaf + 2**self.depth - 1
        while node > 0:
            parent = (node - 1) // 2
            if node == 2 * parent + 1:
                high[self.axis[parent]] = min(high[self.axis[parent]], self.at[parent])
            else:
                low[self.axis[parent]] = max(low[self.axis[parent]], self.at[parent])
            node = parent
        return np.minimum(x - low, high - x).min(axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two small arrays, by plain differences."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def strips(n_rows: int, n_against: int):
    """Row ranges whose distance tables stay within a fixed size."""
    step = max(1, DISTANCES_AT_ONCE // max(n_against, 1))
    return [slice(start, min(start + step, n_rows)) for start in range(0, n_rows, step)]


def double_columns(df: DataFrame, cols) -> DataFrame:
    """Coordinates as doubles; rows with a missing coordinate have no place and are dropped."""
    keep = [c for c in df.columns if c not in cols]
    out = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return out.na.drop(subset=list(cols))


def distinct_points(df: DataFrame, key: str, cols) -> DataFrame:
    """One row per distinct place: least key ``pid``, number of copies ``weight``."""
    return (
        double_columns(df.select(key, *cols), cols)
        .groupBy(*cols)
        .agg(F.min(key).alias("pid"), F.count(F.lit(1)).alias("weight"))
    )


def plant(points: DataFrame, cols, leaf_points: int = LEAF_POINTS) -> Leaves:
    """Cutting planes for a materialised table of points."""
    n = points.count()
    most_leaves = max(2, MOST_SAMPLE // SAMPLE_PER_LEAF)
    depth = max(0, math.ceil(math.log2(min(max(n, 1) / leaf_points, most_leaves))))
    if depth == 0:
        return undivided(len(cols))
    wanted = min(max(LEAST_SAMPLE, SAMPLE_PER_LEAF * 2**depth), MOST_SAMPLE)
    sample = points.select(*cols)
    if wanted < n:
        sample = sample.sample(wanted / n, seed=7)
    # about MOST_SAMPLE rows at most, whatever the table holds
    return Leaves.build(np.column_stack([c.to_numpy() for c in sample.toArrow().columns]).astype(float), depth, len(cols))


def undivided(width: int) -> Leaves:
    """One leaf that holds everything."""
    return Leaves(np.zeros(0, dtype=int), np.zeros(0), 0, width)


def place(points: DataFrame, cols, leaves: Leaves) -> DataFrame:
    """Add the ``leaf`` of every row."""
    if leaves.depth == 0:
        return points.withColumn("leaf", F.lit(0).cast("long"))
    names = list(cols)

    def run(batches):
        for batch in batches:
            yield batch.assign(leaf=leaves.leaf_of(batch[names].to_numpy(float)).astype("int64"))

    return points.mapInPandas(run, schema=_with_long(points, "leaf"))


class Marks:
    """Least and greatest mark among the residents of every node; a node without any has them the other way round."""

    NOTHING = (np.iinfo(np.int64).max, np.iinfo(np.int64).min)

    def __init__(self, residents: DataFrame, mark: str, leaves: Leaves):
        # one row per leaf, as many as the cutting planes
        table = residents.groupBy("leaf").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).toArrow()
        leaf, low, high = (table.column(c).to_numpy().astype("int64") for c in ("leaf", "low", "high"))
        self.low, self.high = leaves.node_ends(leaf, low, high, self.NOTHING)

    def foreign(self, own: np.ndarray):
        """Where a node has a mark other than a row's own."""
        return lambda row, node: (self.low[node] <= self.high[node]) & ((self.low[node] != own[row]) | (self.high[node] != own[row]))

    def held(self):
        """Where a node has any resident."""
        return lambda row, node: self.low[node] <= self.high[node]


def visits(points: DataFrame, cols, leaves: Leaves, radius: str, skip_home: bool, marks: Marks | None = None, own: str | None = None) -> DataFrame:
    """One row per (point, leaf in reach); ``leaf`` of the input is the home leaf.

    With ``marks`` only leaves that hold anything are visited, with ``own`` only those with a mark other than the point's.
    """
    if leaves.depth == 0:
        return points.limit(0) if skip_home else points
    names = list(cols)

    def run(batches):
        for batch in batches:
            x, reach, home = batch[names].to_numpy(float), batch[radius].to_numpy(float), batch["leaf"].to_numpy()
            start, size = 0, FIRST_VISITORS
            # a ball may reach every leaf, so few rows at first, and as many as their visits allow afterwards
            while start < len(batch):
                part = slice(start, start + size)
                wanted = None
                if marks is not None:
                    wanted = marks.held() if own is None else marks.foreign(batch[own].to_numpy()[part])
                row, leaf = leaves.reached(x[part], reach[part], wanted)
                # leaves of several parts are numbered one part after another
                leaf = leaf.astype("int64") + (home[part] - home[part] % 2**leaves.depth)[row]
                if skip_home:
                    away = leaf != home[part][row]
                    row, leaf = row[away], leaf[away]
                for at in range(0, len(row), VISITS_AT_ONCE):
                    yield batch.iloc[start + row[at : at + VISITS_AT_ONCE]].assign(leaf=leaf[at : at + VISITS_AT_ONCE])
                start += size
                size = max(1, min(4 * size, VISITS_AT_ONCE * size // max(len(row), 1)))

    return points.mapInPandas(run, schema=points.schema)


def dealt(df: DataFrame, tasks: int, *key: str) -> DataFrame:
    """``df`` over a fixed number of tasks by ``key``: work on arrays is long where rows are few, and Spark would join such tasks."""
    return df.repartition(max(1, min(int(tasks), MOST_TASKS)), *key)


def tasks_for(placed: DataFrame, leaves: Leaves) -> int:
    """Tasks for work inside the leaves: a large leaf each, small ones together."""
    return min(2**leaves.depth, math.ceil(placed.count() / POINTS_TOGETHER)) if leaves.depth else 1


def by_leaf(placed: DataFrame, leaves: Leaves, leaf_points: int, work, schema: str) -> DataFrame:
    """``work`` on the rows of each leaf, small neighbouring leaves together in a task's frame."""
    together = max(1, LEAF_POINTS // leaf_points)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([work(part) for _, part in block.groupby("leaf", sort=True)])

    bundle = F.floor(F.col("leaf") / together)
    tasks = min(math.ceil(2**leaves.depth / together), tasks_for(placed, leaves))
    return dealt(placed.withColumn("bundle", bundle), tasks, "bundle").groupBy("bundle").applyInPandas(lambda block: run(block.drop(columns="bundle")), schema)


def _leaf_by_leaf(work):
    """``work`` on each leaf of a task's visitors and residents."""

    def run(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(visitors["leaf"].to_numpy())
        if len(ids) < 2 or len(residents) == 0:
            return work(visitors, residents)
        visitors, residents = visitors.sort_values("leaf", kind="stable"), residents.sort_values("leaf", kind="stable")
        a, b = visitors["leaf"].to_numpy(), residents["leaf"].to_numpy()
        ends = [np.searchsorted(leaf, ids, side).tolist() for leaf in (a, b) for side in ("left", "right")]
        parts = [work(visitors.iloc[i:j], residents.iloc[k:m]) for i, j, k, m in zip(*ends) if k < m]
        parts = [p for p in parts if len(p)]
        return pd.concat(parts) if parts else work(visitors.iloc[:0], residents.iloc[:0])

    return run


def meet(visitors: DataFrame, residents: DataFrame, work, schema: str, spread_by: str) -> DataFrame:
    """Run ``work(visitors, residents)`` per leaf, a busy leaf split over several tasks, small ones together in one."""
    both = visitors.select("leaf", F.lit(1).alias("v")).unionByName(residents.select("leaf", F.lit(0).alias("v")))
    sizes = both.groupBy("leaf").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")).filter("v > 0")
    block = F.floor(F.col("leaf") / LEAVES_IN_BLOCK).alias("block")
    earlier = Window.partitionBy("block").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    bundle = F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / POINTS_TOGETHER)
    # one row per leaf, written so that the planner sees it is small and does not shuffle the visitors by leaf
    sizes = cut(
        sizes.select("leaf", "n", block, F.ceil(F.col("v") / VISITORS_PER_TASK).cast("int").alias("chunks"))
        .select("leaf", "block", bundle.alias("bundle"), "chunks")
    )
    chunk = F.pmod(F.xxhash64(spread_by), F.col("chunks")).cast("int")
    left = visitors.join(sizes, "leaf").withColumn("chunk", chunk).drop("chunks")
    # fresh column ids, as visitors and residents may be the same frame
    fresh, again = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (residents, sizes))
    right = (
        fresh.join(again, "leaf")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .drop("chunks")
    )
    task = ["block", "bundle", "chunk"]
    n = sizes.agg((F.count_distinct("block", "bundle") + F.coalesce(F.sum(F.col("chunks") - 1), F.lit(0))).alias("n")).first()["n"]
    left, right = dealt(left, n, *task), dealt(right, n, *task)
    return left.groupBy(*task).cogroup(right.groupBy(*task)).applyInPandas(_leaf_by_leaf(work), schema)


def _with_long(df: DataFrame, name: str):
    return T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])


def _nearest(cols, k: int, base_key: str):
    names = list(cols)

    def work(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if len(visitors) == 0 or len(residents) == 0:
            return pd.DataFrame({"qid": [], "d": [], "near": []})
        block = residents.sort_values(base_key)
        b, keys = block[names].to_numpy(float), block[base_key].to_numpy()
        a, limit = visitors[names].to_numpy(float), visitors["radius"].to_numpy(float)
        wide = min(k, len(b))
        found_d, found_key = [], []
        for part in strips(len(a), len(b)):
            d = distances(a[part], b)
            bound = np.partition(d, wide - 1, axis=1)[:, wide - 1]
            within = d <= bound[:, None]
            n_within = within.sum(axis=1)
            # without a bound, as between endless coordinates, nothing is near
            lost = n_within < wide
            within[lost, :wide] = True
            for i in np.flatnonzero(n_within > wide):
                # residents are in key order, so a stable sort breaks ties by key
                order = np.flatnonzero(within[i])
                within[i, order[np.argsort(d[i, order], kind="stable")][wide:]] = False
            at = np.nonzero(within)[1].reshape(-1, wide)
            near = np.take_along_axis(d, at, axis=1)
            order = np.argsort(near, axis=1, kind="stable")
            near, at = np.take_along_axis(near, order, axis=1), np.take_along_axis(at, order, axis=1)
            kept = np.where(lost, 0, (near <= limit[part, None]).sum(axis=1))
            found_d += [row[:n] for row, n in zip(near, kept.tolist())]
            found_key += [row[:n] for row, n in zip(keys[at], kept.tolist())]
        return pd.DataFrame({"qid": visitors["qid"].to_numpy(), "d": found_d, "near": found_key})

    return work


def knn_join(queries: DataFrame, base: DataFrame, key: str, cols, k: int, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Exact k nearest base rows of every query: ``(qid, found)``, ``found`` sorted by (d, key).

    ``queries`` holds ``qid`` and the coordinates; ``base`` holds an integer ``key`` and the coordinates.
    Of equal base places only the k least keys can matter, so the rest never travel. The home leaf
    gives an upper bound of the k-th distance; only leaves inside that bound are visited.
    """
    cols = list(cols)
    slim = first_rows(double_columns(base.select(key, *cols), cols), cols, [key], k).drop("rank")
    slim = cut(slim)
    leaves = plant(slim, cols, leaf_points)
    residents = cut(place(slim, cols, leaves))
    asked = place(double_columns(queries.select("qid", *cols), cols), cols, leaves).withColumn(
        "radius", F.lit(float("inf"))
    )
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, d array<double>, near array<bigint>"
    work = _nearest(cols, k, key)
    found = F.zip_with("d", "near", lambda d, n: F.struct(d.alias("d"), n.alias("key"))).alias("found")
    home = meet(asked, residents, work, schema, "qid").select("qid", found)
    if leaves.depth == 0:
        return home
    asked, home = cut(asked), cut(home)
    bound = F.when(F.size("found") >= k, F.element_at("found", -1)["d"]).otherwise(F.lit(float("inf")))
    bounds = home.select("qid", bound.alias("bound"))
    wide = asked.join(bounds, "qid", "left").withColumn("radius", F.coalesce("bound", "radius")).drop("bound")
    away = meet(visits(wide, cols, leaves, "radius", True), residents, work, schema, "qid").select("qid", found)
    merged = home.unionByName(away).groupBy("qid").agg(F.flatten(F.collect_list("found")).alias("found"))
    return merged.select("qid", F.slice(F.array_sort("found"), 1, k).alias("found"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of each component.

    A graph checked to be small is joined in one task; a larger one by label spreading with pointer jumps.
    """
    nodes, edges = cut(nodes.select("node")), cut(edges.select("a", "b").distinct())
    if max(nodes.count(), edges.count()) <= SMALL_GRAPH:
        return _components_in_one_task(nodes, edges)
    both = cut(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .distinct()
    )
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        seen = (
            both.join(labels.withColumnsRenamed({"node": "dst"}), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        spread = labels.join(seen, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut(
            spread.join(jump, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
            )
        )
        labels = moved.select("node", "label")
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def _components_in_one_task(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def work(members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(members["node"].to_numpy())
        a, b = (np.searchsorted(ids, links[c].to_numpy()) for c in ("a", "b"))
        return pd.DataFrame({"node": ids, "label": ids[union_labels(len(ids), a, b)]})

    together = F.lit(0).alias("g")
    return (
        nodes.groupBy(together).cogroup(edges.groupBy(together)).applyInPandas(work, "node bigint, label bigint")
    )


def leaf_components(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of a graph on placed points: joined inside each leaf first, then across leaves.

    ``points`` has ``pid, leaf``; ``edges`` has ``a, b``. Only edges between leaves enter the rounds.
    """
    where = points.select("pid", "leaf")
    located = edges.join(where.withColumnsRenamed({"pid": "a", "leaf": "leaf_a"}), "a").join(
        where.withColumnsRenamed({"pid": "b", "leaf": "leaf_b"}), "b"
    )
    located = cut(located.select("a", "b", "leaf_a", "leaf_b"))
    inside = located.filter(F.col("leaf_a") == F.col("leaf_b")).select(F.col("leaf_a").alias("leaf"), "a", "b")
    # several leaves go together, as no edge inside one reaches another
    n = max(1, math.ceil(points.count() / VISITORS_PER_TASK))
    bundle = F.pmod(F.xxhash64("leaf"), F.lit(n)).alias("bundle")
    members, links = dealt(where.select("pid", bundle), n, "bundle"), dealt(inside.select("a", "b", bundle), n, "bundle")

    def work(members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(members["pid"].to_numpy())
        label = union_labels(
            len(ids), np.searchsorted(ids, links["a"].to_numpy()), np.searchsorted(ids, links["b"].to_numpy())
        )
        return pd.DataFrame({"pid": ids, "local": ids[label]})

    local = members.groupBy("bundle").cogroup(links.groupBy("bundle")).applyInPandas(work, "pid bigint, local bigint")
    across = located.filter(F.col("leaf_a") != F.col("leaf_b"))
    if across.isEmpty():
        return local.select(F.col("pid").alias("node"), F.col("local").alias("label"))
    local = cut(local)
    linked = (
        across.join(local.withColumnsRenamed({"pid": "a", "local": "la"}), "a")
        .join(local.withColumnsRenamed({"pid": "b", "local": "lb"}), "b")
        .select(F.col("la").alias("a"), F.col("lb").alias("b"))
        .distinct()
    )
    top = connected_components(local.select(F.col("local").alias("node")).distinct(), linked)
    return local.join(top, F.col("local") == F.col("node")).select(F.col("pid").alias("node"), "label")


def union_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member index of each component of a small graph."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
