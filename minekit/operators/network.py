"""A one-hidden-layer softmax network with weight decay; all settings and folds are fitted in shared passes.

The loss of a network is its summed cross-entropy plus ``decay`` times the sum of its squared weights, biases
included. A pass over the rows gives the loss and the gradient of every network that is still moving: a task
sends one vector per network, and Spark adds these up. The driver holds weights only, whose number follows from
the settings, folds, columns and classes. Each network takes quasi-Newton steps of its own, shortened until its
loss falls, so one that needs another trial does not hold up the rest.

Defined cases: rows with a missing feature or label are left out; a column that is constant in the training rows
counts as 0; a network without training rows keeps its starting weights; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from minekit.lineage import steady_layout
from minekit.operators.clean import drop_incomplete

#: Steps remembered for the curvature, and the share of the expected fall that a step must bring.
REMEMBERED, SUFFICIENT = 8, 1e-4
PASSES, TOLERANCE = 100, 1e-6


@dataclass
class Network:
    """One setting, fitted on the rows outside ``fold``, or on all rows where that is None."""

    name: str
    hidden: int
    decay: float
    fold: int | None = None
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def start(self, n_columns: int, n_classes: int, seed: int) -> None:
        n = (n_columns + 1) * self.hidden + (self.hidden + 1) * n_classes
        self.weights = np.random.default_rng(seed + self.hidden).uniform(-0.7, 0.7, n)

    def layers(self, weights: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights into the hidden layer and out of it; the first row of each is the bias."""
        split = len(weights) - (self.hidden + 1) * n_classes
        return weights[:split].reshape(-1, self.hidden), weights[split:].reshape(-1, n_classes)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) * self.scale


def forward(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of the hidden layer and log probabilities of the classes."""
    inner = x @ first[1:]
    inner += first[0]
    np.clip(inner, -500, 500, out=inner)
    np.negative(inner, out=inner)
    np.exp(inner, out=inner)
    inner += 1
    np.divide(1, inner, out=inner)
    out = inner @ second[1:]
    out += second[0]
    # classes are few: a row each, so that the loops run along the many
    by_class = np.ascontiguousarray(out.T)
    by_class -= by_class.max(axis=0)
    by_class -= np.log(np.exp(by_class).sum(axis=0))
    return inner, np.ascontiguousarray(by_class.T)


def loss_and_gradient(network: Network, weights: np.ndarray, x: np.ndarray, y: np.ndarray, n_classes: int) -> np.ndarray:
    """Summed cross-entropy of scaled rows, then its gradient, as one vector; the decay is not in it."""
    first, second = network.layers(weights, n_classes)
    inner, logs = forward(x, first, second)
    at = np.arange(len(y))
    error = np.exp(logs)
    error[at, y] -= 1
    back = error @ second[1:].T
    back *= inner
    back *= 1 - inner
    parts = [back.sum(axis=0)[None], x.T @ back, error.sum(axis=0)[None], inner.T @ error]
    return np.concatenate([[-logs[at, y].sum()], *[p.ravel() for p in parts]])


def partial_sums(networks: list[Network], trials: dict[int, np.ndarray], cols: list[str], n_classes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = batch[cols].to_numpy(dtype=float), batch["_code"].to_numpy(), batch["_fold"].to_numpy()
            # the networks of a fold have the same rows and scales
            training: dict[int | None, tuple[np.ndarray, np.ndarray]] = {}
            for m, weights in trials.items():
                network = networks[m]
                if network.fold not in training:
                    mine = np.ones(len(y), dtype=bool) if network.fold is None else fold != network.fold
                    training[network.fold] = network.scaled(x[mine]), y[mine]
                scaled, codes = training[network.fold]
                if len(codes):
                    part = loss_and_gradient(network, weights, scaled, codes, n_classes)
                    sums[m] = sums[m] + part if m in sums else part
        if sums:
            yield pd.DataFrame({"network": list(sums), "part": [s.tolist() for s in sums.values()]})

    return run


def summed(rows: DataFrame, networks: list[Network], trials: dict[int, np.ndarray], cols: list[str], n_classes: int) -> dict[int, np.ndarray]:
    """Loss and gradient of each trial, decay included."""
    parts = rows.mapInPandas(partial_sums(networks, trials, cols, n_classes), "network int, part array<double>")
    total = parts.groupBy("network").agg(Summarizer.sum(array_to_vector("part")).alias("total"))
    # one row per network
    found = {r.network: np.array(r.total) for r in total.select("network", vector_to_array("total").alias("total")).collect()}
    out = {}
    for m, weights in trials.items():
        value = found.get(m, np.zeros(len(weights) + 1))
        decay = networks[m].decay
        out[m] = np.concatenate([[value[0] + decay * weights @ weights], value[1:] + 2 * decay * weights])
    return out


@dataclass
class Descent:
    """Where one network stands: the accepted point, the way it goes, and the steps it remembers."""

    point: np.ndarray
    loss: float = np.inf
    slope: np.ndarray | None = None
    way: np.ndarray | None = None
    length: float = 1.0
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.point if self.way is None else self.point + self.length * self.way

    def take(self, value: np.ndarray, tolerance: float) -> None:
        """Accept or shorten the trial, given its loss and gradient."""
        loss, slope, tried = float(value[0]), value[1:], self.trial()
        if self.way is not None:
            expected = self.length * float(self.slope @ self.way)
            if not loss <= self.loss + SUFFICIENT * expected:
                self.length /= 4
                self.done = self.length < 1e-8
                return
            step, bend = tried - self.point, slope - self.slope
            if step @ bend > 1e-12 * (bend @ bend):
                self.steps = [*self.steps, (step, bend)][-REMEMBERED:]
            self.done = self.loss - loss <= tolerance * max(abs(loss), 1)
        self.point, self.loss, self.slope = tried, loss, slope
        self.way, self.length = self.descent(), 1.0
        if not self.steps:
            self.length = min(1.0, 1 / max(np.abs(slope).sum(), 1e-12))
        self.done = self.done or not np.abs(slope).max() > 1e-9

    def descent(self) -> np.ndarray:
        """Minus the gradient, bent by the curvature along the remembered steps."""
        way, shares = -self.slope, []
        for step, bend in reversed(self.steps):
            share = (step @ way) / (step @ bend)
            way = way - share * bend
            shares.append(share)
        if self.steps:
            step, bend = self.steps[-1]
            way = way * (step @ bend) / (bend @ bend)
        for (step, bend), share in zip(self.steps, reversed(shares)):
            way = way + (share - (bend @ way) / (step @ bend)) * step
        return way


def set_scales(rows: DataFrame, networks: list[Network], cols: list[str]) -> None:
    """Mean and spread of each network's own training rows, from one row of moments per fold."""
    columns = [f(c).alias(f"{name}_{c}") for c in cols for name, f in (("m", F.avg), ("v", F.var_pop))]
    moments = rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), *columns).orderBy("_fold").collect()
    for network in networks:
        mine = [r for r in moments if network.fold is None or r["_fold"] != network.fold]
        n = np.array([r.n for r in mine], dtype=float)[:, None]
        mean = np.array([[r[f"m_{c}"] for c in cols] for r in mine], dtype=float).reshape(-1, len(cols))
        var = np.array([[r[f"v_{c}"] for c in cols] for r in mine], dtype=float).reshape(-1, len(cols))
        total = max(n.sum(), 1.0)
        network.shift = (n * mean).sum(axis=0) / total
        spread = np.sqrt((n * (var + (mean - network.shift) ** 2)).sum(axis=0) / total)
        # a spread within the rounding of the mean is that of a constant column
        real = spread > 1e-9 * np.abs(network.shift)
        network.scale = np.where(real, 1 / np.where(real, spread, 1.0), 0.0)


def training_rows(df: DataFrame, cols: list[str], label: str, classes: list[str], fold: str | None) -> DataFrame:
    """Complete rows as features, class position and fold, in a layout that depends on them alone."""
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    place = F.lit(0) if fold is None else F.col(fold)
    rows = drop_incomplete(df.select(*cols, label, *([fold] if fold else [])))
    return steady_layout(rows.select(*cols, code.cast("int").alias("_code"), place.cast("int").alias("_fold")).filter("_code >= 0"))


def fit_networks(
    df: DataFrame, cols, label: str, classes, networks: list[Network], fold: str | None = None,
    passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 1000,
) -> list[Network]:
    """Set the weights of all ``networks``; at most ``passes`` passes over the rows, whatever their number."""
    cols, classes = list(cols), list(classes)
    rows = training_rows(df, cols, label, classes, fold).persist()
    set_scales(rows, networks, cols)
    for network in networks:
        network.start(len(cols), len(classes), seed)
    descents = [Descent(n.weights) for n in networks]
    for _ in range(passes):
        trials = {m: d.trial() for m, d in enumerate(descents) if not d.done}
        if not trials:
            break
        for m, value in summed(rows, networks, trials, cols, len(classes)).items():
            descents[m].take(value, tolerance)
    rows.unpersist()
    for network, descent in zip(networks, descents):
        network.weights = descent.point
    return networks


def predicted_code(network: Network, cols: list[str], n_classes: int):
    @pandas_udf("int")
    def run(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        return pd.Series(forward(network.scaled(x), *network.layers(network.weights, n_classes))[1].argmax(axis=1).astype("int32"))

    return run(*cols)


def network_predict(network: Network, classes, df: DataFrame, key: str, cols) -> DataFrame:
    """``(key, predicted)`` for the rows with complete features; of equal classes the first."""
    classes, cols = list(classes), list(cols)
    rows = drop_incomplete(df.select(key, *cols))
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), predicted_code(network, cols, len(classes)) + 1)
    return rows.select(key, name.alias("predicted"))


def held_out_cells(df: DataFrame, cols, label: str, classes, fold: str, networks: list[Network]) -> DataFrame:
    """Counts of (actual, predicted) per network and held-out fold, all networks in one pass."""
    cols, classes = list(cols), list(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y, place = batch[cols].to_numpy(dtype=float), batch["_code"].to_numpy(), batch["_fold"].to_numpy()
            for network in networks:
                mine = place == network.fold
                if mine.any():
                    logs = forward(network.scaled(x[mine]), *network.layers(network.weights, len(classes)))[1]
                    pairs, n = np.unique(y[mine] * len(classes) + logs.argmax(axis=1), return_counts=True)
                    yield pd.DataFrame({
                        "model": network.name, "fold": network.fold, "n": n,
                        "actual": [classes[p // len(classes)] for p in pairs], "predicted": [classes[p % len(classes)] for p in pairs],
                    })

    rows = training_rows(df, cols, label, classes, fold)
    cells = rows.mapInPandas(run, "model string, fold int, n long, actual string, predicted string")
    return cells.groupBy("model", "fold", "actual", "predicted").agg(F.sum("n").alias("n"))


def network_grid(sizes, decays) -> dict[str, tuple[int, float]]:
    return {f"network size={h} decay={d:g}": (h, d) for h in sizes for d in decays}


def network_cv(df: DataFrame, cols, label: str, classes, fold: str, grid: dict[str, tuple[int, float]], **settings) -> DataFrame:
    """Confusion counts of every candidate on every fold, from fits in shared passes."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    networks = [Network(name, h, d, f) for name, (h, d) in grid.items() for f in folds]
    fit_networks(df, cols, label, classes, networks, fold, **settings)
    return held_out_cells(df, cols, label, classes, fold, networks)
