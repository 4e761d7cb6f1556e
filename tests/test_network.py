import numpy as np
import pandas as pd
import pytest

from minekit.operators import classify, network
from minekit.operators.network import Network

COLS, CLASSES = ["a", "b", "c"], ["high", "low", "middle"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(240, 3)) * [1, 50, 0.01] + [0, 900, 5], columns=COLS)
    score = pdf.a + (pdf.b - 900) / 50 * (pdf.c - 5) * 100 + rng.normal(size=240) / 4
    pdf["y"] = np.select([score > 0.6, score < -0.6], ["high", "low"], "middle")
    pdf["id"], pdf["f"] = np.arange(240), np.arange(240) % 3
    return pdf


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 4)), rng.integers(0, 3, 20)
    net = Network("n", 3, 0.0)
    net.start(4, 3, 7)
    value = network.loss_and_gradient(net, net.weights, x, y, 3)
    for k in range(len(net.weights)):
        step = np.zeros(len(net.weights))
        step[k] = 1e-5
        up, down = (network.loss_and_gradient(net, net.weights + s, x, y, 3)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - value[k + 1]) < 1e-6


def plain_loss(net, weights, pdf):
    x = pdf[COLS].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = pdf.y.map(CLASSES.index).to_numpy()
    value = network.loss_and_gradient(net, weights, x, y, 3)
    return value[0] + net.decay * weights @ weights, value[1:] + 2 * net.decay * weights


def test_fits_reach_a_point_without_slope_and_do_not_depend_on_partitions(spark, rows):
    df, guesses = spark.createDataFrame(rows), []
    for parts in (1, 7):
        nets = [Network("x", 2, 1.0), Network("y", 4, 0.5, fold=1)]
        network.fit_networks(df.repartition(parts), COLS, "y", CLASSES, nets, "f", tolerance=1e-10)
        for net, own in zip(nets, (rows, rows[rows.f != 1])):
            loss, slope = plain_loss(net, net.weights, own)
            start = Network("s", net.hidden, net.decay)
            start.start(3, 3, 1000)
            assert loss < plain_loss(net, start.weights, own)[0] and np.abs(slope).max() < 0.05
        guesses.append([n.weights for n in nets])
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(*guesses))


def test_decay_shrinks_and_shared_fits_equal_single_ones(spark, rows):
    df = spark.createDataFrame(rows)
    together = [Network("a", 3, 0.01), Network("b", 3, 10.0), Network("c", 3, 1.0, fold=0)]
    network.fit_networks(df, COLS, "y", CLASSES, together, "f")
    assert together[1].weights @ together[1].weights < together[0].weights @ together[0].weights
    alone = network.fit_networks(df, COLS, "y", CLASSES, [Network("c", 3, 1.0, fold=0)], "f")[0]
    assert np.allclose(alone.weights, together[2].weights, atol=1e-9)


def test_held_out_counts_equal_a_plain_recount(spark, rows):
    df = spark.createDataFrame(rows)
    nets = [Network("n", 3, 0.1, fold=k) for k in range(3)]
    network.fit_networks(df, COLS, "y", CLASSES, nets, "f")
    cells = {(r.fold, r.actual, r.predicted): r.n for r in network.held_out_cells(df, COLS, "y", CLASSES, "f", nets).collect()}
    want = {}
    for net in nets:
        held = rows[rows.f == net.fold]
        logs = network.forward(net.scaled(held[COLS].to_numpy()), *net.layers(net.weights, 3))[1]
        for actual, code in zip(held.y, logs.argmax(axis=1)):
            at = (net.fold, actual, CLASSES[code])
            want[at] = want.get(at, 0) + 1
    assert cells == want


def test_tuned_network_and_edges(spark, rows):
    pdf = rows.copy()
    pdf["flat"] = 3.0
    gaps = pd.DataFrame([dict(a=None, b=1.0, c=1.0, y="high", id=900, f=0, flat=3.0), dict(a=1.0, b=1.0, c=1.0, y=None, id=901, f=0, flat=3.0)])
    df = spark.createDataFrame(pd.concat([pdf, gaps]).astype({"y": object}).where(lambda t: t.notna(), None), "a double, b double, c double, y string, id long, f long, flat double")
    grid = network.network_grid((1, 4), (0.1,))
    out = classify.tuned_network(df, df, "id", [*COLS, "flat"], "y", "f", grid).collect()
    assert len(out) == 241 and {r.model for r in out} == {"network size=4 decay=0.1"}
    truth = dict(zip(rows.id, rows.y))
    assert np.mean([truth.get(r.id) == r.predicted for r in out]) > 0.7
    assert classify.network_metrics(df.limit(0), COLS, "y", "f", grid).count() == 0
