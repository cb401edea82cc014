"""The network: gradients against numeric ones and one process against many tasks, learning, early stop, odd input, prediction and pooling."""

import numpy as np
import pytest

from affinis.operators import evidence, network

ROWS = "id long, v array<double>, b array<int>"


def data(n, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5))
    y = np.stack([x[:, 0] > 0, x[:, 1] * x[:, 2] > 0, x[:, 3] > 1.5], axis=1).astype(int)
    return [(i, list(map(float, a)), list(map(int, b))) for i, (a, b) in enumerate(zip(x, y, strict=True))]


@pytest.mark.parametrize(("hidden", "dropout"), [((6, 4), 0.0), ((7,), 0.4), ((), 0.0)])
def test_gradients_are_the_numeric_ones(hidden, dropout):
    r = np.random.default_rng(1)
    net = network.Network.new(5, hidden, 3, dropout, 2)
    net.weights = [w + 0.1 * r.normal(size=w.shape) for w in net.weights]
    x, y, weight, names = r.normal(size=(9, 5)), r.integers(0, 2, (9, 3)).astype(float), np.array([1.0, 3.0, 0.5]), r.integers(-(2**62), 2**62, 9)
    loss = lambda: network.loss_of(net.forward(x, names, 3)[0], y, weight)[0].sum()
    logits, kept = net.forward(x, names, 3)
    grads = net.backward(kept, network.loss_of(logits, y, weight)[1])
    assert len(grads) == len(net.weights)
    for w, g in zip(net.weights, grads, strict=True):
        for i in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
            old = w[i]
            w[i] = old + 1e-5
            up = loss()
            w[i] = old - 1e-5
            down = loss()
            w[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6 * (1 + abs(g[i]))


def test_tasks_sum_the_gradient_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(network, "CHUNK", 10)
    rows = data(300)
    net = network.Network.new(5, (8,), 3, 0.3, 0)
    x, y, names = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float), np.arange(300) * 7919
    frame = spark.createDataFrame([(int(n), v, [float(z) for z in b]) for n, (_, v, b) in zip(names, rows, strict=True)], "name long, v array<double>, b array<double>")
    logits, kept = net.forward(x, names, 5)
    loss, g = network.loss_of(logits, y, np.ones(3))
    want = net.backward(kept, g)
    for parts in (1, 7):
        got = network.gradient(net, frame.repartition(parts), np.ones(3), 5)
        assert got[1] == 300 and np.isclose(got[0], loss.sum()) and all(np.allclose(a, b) for a, b in zip(got[2], want, strict=True))
    share = (network.dropped(names, 400, 1, 0.3) == 0).mean()
    assert 0.28 < share < 0.32 and not (network.dropped(names, 400, 1, 0.3) == network.dropped(names, 400, 2, 0.3)).all()


def test_learning_and_early_stop(spark):
    rows, rest = spark.createDataFrame(data(1500), ROWS).repartition(3), data(400, 9)
    net = network.fit(rows, "id", "v", "b", hidden=(24,), dropout=0.05, epochs=25, batches=3, rate=0.03, patience=3)
    early = [e for _, e in net.history]
    assert early[-1] < 0.5 * early[0] or min(early) < 0.35
    p = {r.id: r.p for r in net.predict(spark.createDataFrame(rest, ROWS), "id", "v").collect()}
    right = np.mean([[(a > 0.5) == (b > 0) for a, b in zip(p[i], y, strict=True)] for i, _, y in rest])
    assert right > 0.85
    stopped = network.fit(rows, "id", "v", "b", hidden=(4,), epochs=40, batches=1, rate=3.0, patience=2)
    assert len(stopped.history) < 40 and min(range(len(stopped.history)), key=lambda i: stopped.history[i][1]) == len(stopped.history) - 3


def test_odd_input(spark):
    rows = [*data(200), (900, None, [1, 0, 0]), (901, [float("nan"), None, 1.0, float("inf"), 0.0], [0, 0, 1]), (902, [0.0] * 5, None)]
    net = network.fit(spark.createDataFrame(rows, ROWS), "id", "v", "b", hidden=(3,), epochs=2)
    out = net.predict(spark.createDataFrame([(1, None, None), (1, [1.0] * 5, None), (None, [float("nan")] * 5, None)], ROWS), "id", "v")
    got = out.collect()
    assert len(got) == 3 and all(len(r.p) == 3 and all(0 <= x <= 1 for x in r.p) for r in got) and np.allclose(got[0].p, got[2].p)
    assert evidence.pooled(out, "id", "p", weighted=True).count() == 6
    assert net.predict(spark.createDataFrame([], ROWS), "id", "v").count() == 0
    for bad in ([], [(1, [1.0], None)], [(1, [1.0], [1])]):
        with pytest.raises(ValueError, match="held out|hold out"):
            network.fit(spark.createDataFrame(bad, ROWS), "id", "v", "b")
    with pytest.raises(Exception, match="numbers among"):
        net.predict(spark.createDataFrame([(1, [1.0], None)], ROWS), "id", "v").collect()
