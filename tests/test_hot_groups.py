"""The sliced plans for hot groups give exactly what the plain windows give.

One team holds most rows and the slices are few, so every primitive has to
cut the group and carry state over slice boundaries.
"""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators.drift import drift_report
from touchline.operators.aggregates import spearman
from touchline.operators.ewm import ewm_features
from touchline.operators.history import count_recent, prior_count, prior_within_days, rolling_features
from touchline.operators.joins import asof_latest, count_between
from touchline.operators.ordered import exact_quantiles, row_positions
from touchline.operators.ratings import fold_ratings
from touchline.functions.scalars import unix_micros



@pytest.fixture(scope="module")
def history():
    rng = np.random.default_rng(7)
    n = 700
    frame = pd.DataFrame(
        {
            "event_id": np.arange(n),
            "team_id": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdefgh"), n)),
            "kickoff_utc": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="D"),
            "x": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n).round(3)),
        }
    )
    # A long stretch without values has to be bridged by the carried state.
    hot = frame.index[frame["team_id"] == "hot"]
    by_time = frame.loc[hot].sort_values(["kickoff_utc", "event_id"]).index
    frame.loc[by_time[100:260], "x"] = np.nan
    return frame


@pytest.fixture(scope="module")
def rows(spark, history):
    schema = "event_id bigint, team_id string, kickoff_utc timestamp_ntz, x double"
    data = [
        (int(r.event_id), r.team_id, r.kickoff_utc.to_pydatetime(), None if pd.isna(r.x) else float(r.x))
        for r in history.itertuples()
    ]
    return spark.createDataFrame(data, schema)


def by_event(df, columns):
    return df.select("event_id", *columns).toPandas().sort_values("event_id").reset_index(drop=True)


def same(left, right):
    pd.testing.assert_frame_equal(left, right, check_dtype=False, atol=1e-9)


ORDER = ["kickoff_utc", "event_id"]


@pytest.mark.parametrize("bounded", [True, False])
def test_rolling_matches_pandas(rows, history, bounded):
    out = rolling_features(rows, ["x"], means=(3, 10), bounded=bounded)
    got = by_event(out, ["rolling_x_3", "rolling_x_10", "rolling_std_x_5", "rest_days"])
    ordered = history.sort_values(["team_id", *ORDER], kind="stable")
    teams = ordered.groupby("team_id", sort=False)
    for n in (3, 10):
        ordered[f"rolling_x_{n}"] = teams["x"].transform(lambda s: s.shift(1).rolling(n, min_periods=1).mean())
    ordered["rolling_std_x_5"] = teams["x"].transform(lambda s: s.shift(1).rolling(5, min_periods=2).std())
    ordered["rest_days"] = teams["kickoff_utc"].diff().dt.total_seconds() / 86400
    same(got, ordered.sort_values("event_id").reset_index(drop=True)[got.columns])


@pytest.mark.parametrize("bounded", [True, False])
def test_ewm_matches_pandas(rows, history, bounded):
    out = ewm_features(rows, ["x"], row_key=["event_id"], bounded=bounded)
    got = by_event(out, ["ewm_x_5"])
    ordered = history.sort_values(["team_id", *ORDER], kind="stable")
    ordered["ewm_x_5"] = ordered.groupby("team_id", sort=False)["x"].transform(
        lambda s: s.shift(1).ewm(span=5, adjust=False).mean()
    )
    same(got, ordered.sort_values("event_id").reset_index(drop=True)[got.columns])


def test_ewm_state_crosses_arrow_batches(spark, rows, history):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        test_ewm_matches_pandas(rows, history, True)
        test_ewm_matches_pandas(rows, history, False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prior_and_recent_counts(rows, history):
    plain = prior_count(rows, "team_id", ORDER, bounded=True)
    plain = count_recent(plain, "team_id", "kickoff_utc", 14, "recent", ["event_id"], bounded=True)
    plain = prior_within_days(plain, "team_id", ORDER, (30,), ["event_id"], bounded=True)
    cut = prior_count(rows, "team_id", ORDER)
    cut = count_recent(cut, "team_id", "kickoff_utc", 14, "recent", ["event_id"])
    cut = prior_within_days(cut, "team_id", ORDER, (30,), ["event_id"])
    columns = ["prior_match_count", "recent", "matches_last_30_days"]
    same(by_event(plain, columns), by_event(cut, columns))
    brute = []
    for row in history.itertuples():
        mine = history[history.team_id == row.team_id]
        start = row.kickoff_utc - pd.Timedelta(days=14)
        brute.append(((mine.kickoff_utc < row.kickoff_utc) & (mine.kickoff_utc >= start)).sum())
    assert by_event(plain, ["recent"])["recent"].tolist() == brute


def test_global_positions(rows, history):
    got = row_positions(rows, ORDER).toPandas().sort_values("position")
    want = history.sort_values(ORDER, kind="stable")
    assert got["event_id"].tolist() == want["event_id"].tolist()
    assert got["position"].tolist() == list(range(1, len(want) + 1))


@pytest.mark.parametrize("bounded", [False, True])
def test_exact_quantiles(rows, history, bounded):
    probs = [0.0, 0.1, 0.5, 0.83, 1.0]
    got = {r["team_id"]: r["quantiles"] for r in exact_quantiles(rows, ["team_id"], "x", probs, bounded=bounded).collect()}
    for team, part in history.dropna(subset=["x"]).groupby("team_id"):
        assert np.allclose(got[team], np.quantile(part["x"], probs))


@pytest.mark.parametrize("bounded", [False, True])
def test_spearman(rows, history, bounded):
    frame = history.assign(y=(history["x"] * 2).round(0) + history["event_id"] % 3)
    df = rows.withColumn("y", F.rint(F.col("x") * 2) + F.col("event_id") % 3)
    got = spearman(df, "x", "y", bounded=bounded).first()
    part = frame.dropna()
    ranks = part[["x", "y"]].rank()
    assert got["n"] == len(part)
    assert got["spearman"] == pytest.approx(ranks["x"].corr(ranks["y"]))


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("exclude", [None, "skip"])
def test_asof_against_brute_force(rows, history, bounded, exclude):
    probes = rows.select(
        F.col("event_id").alias("probe_id"), F.col("team_id").alias("who"),
        (F.col("kickoff_utc") + F.expr("interval 3 days")).alias("at"), F.col("event_id").alias("skip"),
    )
    got = asof_latest(
        probes, rows, key=("who", "team_id"), at="at", time="kickoff_utc", tie="event_id",
        columns={"event_id": "found", "x": "found_x"}, exclude=exclude, bounded=bounded,
    ).toPandas().sort_values("probe_id")
    want = []
    for row in history.sort_values("event_id").itertuples():
        past = history[(history.team_id == row.team_id) & (history.kickoff_utc < row.kickoff_utc + pd.Timedelta(days=3))]
        if exclude:
            past = past[past.event_id != row.event_id]
        past = past.sort_values(ORDER)
        want.append(past["event_id"].iloc[-1] if len(past) else None)
    found = [None if pd.isna(v) else int(v) for v in got["found"]]
    assert found == [None if v is None else int(v) for v in want]


@pytest.mark.parametrize("bounded", [False, True])
def test_count_between(rows, history, bounded):
    at = unix_micros("kickoff_utc")
    day = 86_400_000_000
    got = count_between(
        rows, rows, probe_id=["event_id"], key=("team_id", "team_id"), low=at - 20 * day, high=at + day,
        time=at, name="n", bounded=bounded,
    ).toPandas().sort_values("event_id")
    want = []
    for row in history.itertuples():
        mine = history[history.team_id == row.team_id].kickoff_utc
        lo, hi = row.kickoff_utc - pd.Timedelta(days=20), row.kickoff_utc + pd.Timedelta(days=1)
        want.append(((mine >= lo) & (mine < hi)).sum())
    assert got["n"].tolist() == want


def test_drift_cut_equals_plain(rows):
    plain = drift_report(rows, ["x"], least=10, bounded=True).toPandas()
    cut = drift_report(rows, ["x"], least=10).toPandas()
    pd.testing.assert_frame_equal(plain, cut, atol=1e-12)


def test_ratings_fold_each_pool_in_order(spark):
    rng = np.random.default_rng(3)
    n = 300
    home = rng.integers(0, 9, n)
    data = [
        (
            "p" if i % 5 else "q", int(i), dt.datetime(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, 90))),
            f"t{home[i]}", f"t{(home[i] + 1 + int(rng.integers(0, 7))) % 9}", 55.0 if i % 2 else 0.0,
            None if i % 7 == 0 else 20.0, float(rng.choice([0.0, 0.5, 1.0])),
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(
        data, "pool string, event_id bigint, kickoff timestamp_ntz, home string, away string, advantage double, k double, actual double"
    )
    one = fold_ratings(df).toPandas().sort_values("event_id").reset_index(drop=True)
    ratings = {}
    for row in sorted(data, key=lambda x: (x[2], x[1])):
        pool, event, _, h, a, adv, k, actual = row
        hp, ap = ratings.get((pool, h), 1500.0), ratings.get((pool, a), 1500.0)
        got = one[one.event_id == event].iloc[0]
        assert got.home_pre == pytest.approx(hp) and got.away_pre == pytest.approx(ap)
        if k is not None:
            d = k * (actual - 1 / (1 + 10 ** ((ap - hp - adv) / 400)))
            ratings[(pool, h)], ratings[(pool, a)] = hp + d, ap - d


@pytest.mark.parametrize("bounded", [True, False])
def test_ewm_over_a_long_gap(spark, bounded):
    """A gap of thousands of rows decays as in pandas, over several Arrow batches."""
    n = 6_000
    x = [1.0 if i == 0 else 3.0 if i > 5_000 else None for i in range(n)]
    data = [("t", i, dt.datetime(2000, 1, 1) + dt.timedelta(hours=i), x[i]) for i in range(n)]
    df = spark.createDataFrame(data, "team_id string, event_id bigint, kickoff_utc timestamp_ntz, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        out = ewm_features(df, ["x"], span=2001, row_key=["event_id"], bounded=bounded).toPandas().sort_values("event_id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = pd.Series(x, dtype="float64").ewm(span=2001, adjust=False).mean().shift(1)
    np.testing.assert_allclose(out["ewm_x_2001"].astype(float).to_numpy(), want.to_numpy(), rtol=1e-9)
