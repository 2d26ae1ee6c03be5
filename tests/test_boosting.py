"""Boosted trees against a plain version that looks at every split of every node."""

import math

import numpy as np
import pytest

from touchline.plans import boosting as b


def rows_of(loss, n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n), rng.random(n)])
    lean = 0.8 * x[:, 0] + (x[:, 1] == 2)
    if loss == "softmax":
        y = np.clip(np.round(lean + rng.normal(size=n) * 0.4 + 1), 0, 2)
    elif loss == "poisson":
        y = rng.poisson(np.exp(lean / 2))
    else:
        y = lean + rng.normal(size=n) * 0.1
    return x, y.astype(float)


def frame(spark, x, y):
    rows = [(k, [float(v) for v in r], float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "key long, features array<double>, label double")


def plain_fit(s, bins, y, key_hash, base):
    """Margins after all rounds, by loops over nodes, inputs and bins."""
    margins = np.tile(base, (len(y), 1)).astype(float)
    for turn in range(s.rounds):
        rng = np.random.default_rng([s.seed, turn])
        n = bins.shape[1]
        inputs = [np.sort(rng.permutation(n)[: max(1, math.ceil(s.inputs * n))]) for _ in range(s.classes)]
        some = b.taken(s, key_hash, turn)
        if s.loss == "poisson":
            g, h = np.exp(margins) - y[:, None], np.exp(margins + s.most_step)
        elif s.loss == "softmax":
            p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
            g, h = p - np.eye(s.classes)[y.astype(int)], 2 * p * (1 - p)
        else:
            g, h = margins - y[:, None], np.ones_like(margins)
        step = np.zeros_like(margins)
        for k in range(s.classes):
            def split(rows, depth, k=k):
                here = rows & some
                G, H = g[here, k].sum(), h[here, k].sum()
                best = (s.least_gain, None)
                if depth:
                    for f in inputs[k]:
                        for cut in range(s.bins - 1):
                            left, right = here & (bins[:, f] <= cut), here & (bins[:, f] > cut)
                            HL, HR = h[left, k].sum(), h[right, k].sum()
                            if min(HL, HR) < max(s.least_weight, 1e-12):
                                continue
                            gain = g[left, k].sum() ** 2 / (HL + s.penalty) + g[right, k].sum() ** 2 / (HR + s.penalty) - G * G / (H + s.penalty)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut))
                if best[1]:
                    f, cut = best[1]
                    split(rows & (bins[:, f] <= cut), depth - 1)
                    split(rows & (bins[:, f] > cut), depth - 1)
                elif H > 0:
                    value = -G / (H + s.penalty)
                    step[rows, k] = s.rate * (np.clip(value, -s.most_step, s.most_step) if s.most_step else value)

            split(np.ones(len(y), dtype=bool), s.depth)
        margins += step
    return margins


@pytest.mark.parametrize("loss, classes", [("poisson", 1), ("softmax", 3), ("squared", 1)])
def test_fit_equals_the_plain_version(spark, loss, classes):
    x, y = rows_of(loss)
    s = b.Settings(loss, classes, rounds=4, depth=2 if loss == "softmax" else 3, rate=0.3, bins=16, most_step=0.7 if loss == "poisson" else 0.0)
    df = frame(spark, x, y)
    model = b.fit(df.repartition(3), s)
    hashes = {r.key: r.h for r in df.selectExpr("key", "xxhash64(key) as h").collect()}
    expected = plain_fit(s, model.binned(x), y, np.array([hashes[k] for k in range(len(y))]), model.base)
    np.testing.assert_allclose(model.margins(model.binned(x)), expected, rtol=1e-8, atol=1e-9)
    names = [f"p{k}" for k in range(classes)]
    scored = {r.key: r for r in b.predict(df, model, names).collect()}
    wanted = model.predictions(expected)
    np.testing.assert_allclose([[scored[k][n] for n in names] for k in range(len(y))], wanted, rtol=1e-8)
    assert model.gains[0] > model.gains[2]


def test_partitions_and_margin_cuts_don_t_change_the_fit(spark, monkeypatch):
    x, y = rows_of("poisson", 300)
    s = b.Settings("poisson", rounds=5, rate=0.2)
    one = b.fit(frame(spark, x, y).coalesce(1), s)
    monkeypatch.setattr(b, "CUT", 2)
    monkeypatch.setattr(b, "DIRECT", 0)  # sums in Spark
    many = b.fit(frame(spark, x, y).repartition(5), s)
    np.testing.assert_allclose(one.margins(one.binned(x)), many.margins(many.binned(x)), rtol=1e-9)


def test_full_rounds_beat_a_constant_by_their_own_loss(spark):
    x, y = rows_of("poisson", 400, 9)
    model = b.fit(frame(spark, x, y), b.Settings("poisson", rounds=30, rate=0.1, most_step=0.7))
    fresh, goal = rows_of("poisson", 400, 10)
    mean = model.predictions(model.margins(model.binned(fresh)))[:, 0]
    loss = lambda m: (m - goal * np.log(m)).mean()
    assert loss(mean) < loss(np.full(400, y.mean())) - 0.05


def test_empty_and_constant_tables(spark):
    none = spark.createDataFrame([], "key long, features array<double>, label double")
    model = b.fit(none, b.Settings("poisson", rounds=3))
    assert model.trees == [] and b.predict(none, model, ["p"]).collect() == []
    same = frame(spark, np.ones((20, 2)), np.full(20, 3.0))
    model = b.fit(same, b.Settings("poisson", rounds=3))
    assert [round(r.p, 9) for r in b.predict(same, model, ["p"]).collect()] == [3.0] * 20
