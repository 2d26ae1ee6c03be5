import math

import numpy as np

from touchline.llm import ranker, toxicity


def _score(row, w, b):
    return 1 / (1 + math.exp(-(sum(x * v for x, v in zip(row, w, strict=True)) + b)))


def _risk(positive, unlabelled, prior, w, b):
    """The risk that a step goes down, by loops, and whether its corrected part is negative."""
    sp = sum(_score(row, w, b) for row in positive) / len(positive)
    su = sum(_score(row, w, b) for row in unlabelled) / len(unlabelled)
    corrected = su - prior * sp
    return (prior * (1 - sp) + corrected, False) if corrected >= 0 else (-corrected, True)


def test_the_risk_and_its_gradient_by_loops_and_differences():
    rng = np.random.default_rng(2)
    positive = (rng.random((20, 4)) < [0.9, 0.8, 0.2, 0.5]).astype(np.float32)
    unlabelled = (rng.random((30, 4)) < [0.1, 0.1, 0.6, 0.5]).astype(np.float32)
    prior, steps, h = 0.6, 40, 1e-5
    at = np.array([0.0, 0.0, 0.0, 0.0, -1.0])
    slope, square, signs = np.zeros(5), np.zeros(5), set()
    rows, others = positive.tolist(), unlabelled.tolist()
    for step in range(1, steps + 1):
        signs.add(_risk(rows, others, prior, at[:4], at[4])[1])
        gradient = np.zeros(5)
        for k in range(5):
            up, down = at.copy(), at.copy()
            up[k], down[k] = at[k] + h, at[k] - h
            gradient[k] = (_risk(rows, others, prior, up[:4], up[4])[0] - _risk(rows, others, prior, down[:4], down[4])[0]) / (2 * h)
        gradient[:4] += 1e-5 * at[:4]
        slope, square = 0.9 * slope + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        at = at - 0.05 * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    w, b = toxicity.fit(positive, unlabelled, prior, steps=steps)
    assert signs == {False, True}
    assert np.allclose(np.append(w, b), at, atol=1e-3)


def test_pair_loss_against_newton_over_all_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3)) * [1, 5, 0.2] + [0, 10, 1]
    good = x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=40) > 1
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    z = np.column_stack([z, z**2])
    difference = np.array([z[a] - z[b] for a in np.flatnonzero(good) for b in np.flatnonzero(~good)])

    def loss(w):
        return np.log1p(np.exp(-difference @ w)).mean() + 0.5e-3 * w @ w

    best = np.zeros(6)
    for _ in range(30):
        chance = 1 / (1 + np.exp(difference @ best))
        gradient = -(difference * chance[:, None]).mean(axis=0) + 1e-3 * best
        curvature = (difference * (chance * (1 - chance))[:, None]).T @ difference / len(difference) + 1e-3 * np.eye(6)
        best = best - np.linalg.solve(curvature, gradient)
    assert np.abs(gradient).max() < 1e-8
    weights, offset = ranker.fit(x, good, 0.3)
    scores = x @ weights[:3] + x**2 @ weights[3:] + offset
    found = np.linalg.lstsq(np.column_stack([z, np.ones(40)]), scores, rcond=None)[0][:6]
    assert np.allclose(np.column_stack([z, np.ones(40)]) @ np.append(found, (scores - z @ found).mean()), scores)
    assert loss(found) < loss(best) + 0.01
    assert np.corrcoef(z @ best, scores)[0, 1] > 0.995
