"""Penalties against a plain solver, and the edge cases of the model plans."""

import datetime as dt

import numpy as np
import pytest

from touchline.plans import models as m


def test_poisson_penalty_against_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = rng.poisson(np.exp(2.3 + 0.5 * x))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, goals int")
    model = m.fit_rate(df, ["x"], "goals")
    z = np.column_stack([np.ones(400), (x - x.mean()) / x.std(ddof=1)])
    w, penalty = np.array([np.log(y.mean()), 0.0]), np.diag([0.0, m.POISSON_ALPHA])
    for _ in range(50):  # minimise mean(mu - y log mu) + alpha / 2 * slope^2
        mu = np.exp(z @ w)
        w -= np.linalg.solve((z.T * mu) @ z / 400 + penalty, z.T @ (mu - y) / 400 + penalty @ w)
    assert model.stages[-1].coefficients[0] == pytest.approx(w[1], rel=2e-3)
    assert model.stages[-1].intercept == pytest.approx(w[0], rel=2e-3)


@pytest.fixture(scope="module")
def season(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        form = float(rng.normal())
        result = ["loss", "draw", "win"][int(np.clip(round(form + rng.normal() * 0.5 + 1), 0, 2))]
        rows.append((i, dt.datetime(2010, 1, 1) + dt.timedelta(days=3 * i), form, "abc"[i % 3], result, "world_cup"))
    return spark.createDataFrame(
        rows, "event_id bigint, kickoff_utc timestamp_ntz, form double, kind string, result string, competition_type string"
    ).cache()


def test_backtests_skip_years_without_matches(season):
    years = m.yearly_backtests(season, ["form"], [2011, 2013, 2050])
    assert sorted(r["year"] for r in years.collect()) == [2011, 2013]
    assert m.yearly_backtests(season, ["form"], [1990]).count() == 0


def test_importances_name_every_input(season):
    model = m.fit_tree_outcome(season, ["form", "kind"], trees=5)
    got = {r["feature"]: r["importance"] for r in m.feature_importances(model, season, ["form", "kind"]).collect()}
    assert set(got) == {"form", "kind=a", "kind=b", "kind=c", "kind=(other)"}
    assert sum(got.values()) == pytest.approx(1) and got["form"] > 0.5


def test_boosted_outcome_beats_the_shares(season):
    scored = m.score_boosted(m.fit_boosted_outcome(season, ["form", "kind"], rounds=5), season, ["form", "kind"])
    rows = scored.collect()
    assert all(abs(r["boosted_loss"] + r["boosted_draw"] + r["boosted_win"] - 1) < 1e-9 for r in rows)
    assert np.mean([r[f"boosted_{r['result']}"] for r in rows]) > 0.5
