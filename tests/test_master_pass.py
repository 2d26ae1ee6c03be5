"""The feature master's one pass over slices gives what plain windows give, wherever rows lie."""

import contextlib
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.catalog.base import rounded
from touchline.operators import history
from touchline.operators.joins import CardinalityError
from touchline.operators.ordered import cut
from touchline.plans import features

TEAM_ROWS = (
    "event_id long, side string, kickoff_utc timestamp_ntz, status_type string, training_eligible boolean, team_id long, opponent_id long, "
    "goals_for int, goals_against int, goal_difference int"
)


@contextlib.contextmanager
def settings(spark, **values):
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def played(spark, matches=400):
    """Team rows, one team in most of them, with days that repeat and unknown scores; and statistics of some."""
    rng = random.Random(60)
    rows, stats = [], []
    for event in range(matches):
        day = dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(60))
        home = 0 if rng.random() < 0.7 else rng.randrange(1, 6)
        away = rng.choice([t for t in range(6) if t != home])
        known = rng.random() < 0.7
        a, b = (rng.randrange(5), rng.randrange(5)) if known else (None, None)
        for side, team, other, x, y in (("home", home, away, a, b), ("away", away, home, b, a)):
            rows.append((event, side, day, "finished" if known else "notstarted", known, None if team == 5 else team, other, x, y, x - y if known else None))
            if rng.random() < 0.8:
                stats.append((event, side, rng.choice([None, 0.1 * rng.randrange(50)]), float(rng.randrange(9)), True))
    return (
        spark.createDataFrame(rows, TEAM_ROWS).repartition(5),
        spark.createDataFrame(stats, "event_id long, side string, `ALL_Total shots` double, `ALL_x` double, has_statistics boolean").repartition(3),
    )


def table(df):
    return df.toPandas().sort_values(["event_id", "side"]).reset_index(drop=True)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_master_of_slices_is_the_master_of_plain_windows(spark, batch):
    rows, stats = played(spark)
    # Joins by shuffles, as for large tables: rows no longer lie by slices after them.
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__coalescePartitions__enabled="false", execution__arrow__maxRecordsPerBatch=batch):
        plain, sliced = (features.feature_master(rows, None, stats, bounded=bounded) for bounded in (True, False))
        assert sliced.columns == plain.columns and sliced.dtypes == plain.dtypes
        want, got = table(plain), table(sliced)
    assert len(got) == 800 and got["ewm_ALL_x_5"].notna().sum() > 700 and got["opponent_ewm_goals_for_5"].notna().sum() > 500
    pd.testing.assert_frame_equal(got, want, atol=1e-9, rtol=1e-9)


def test_no_window_is_left_over_wide_rows_and_statistics_are_made_once(spark, monkeypatch):
    rows, stats = played(spark, 40)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def no_window(*_, **__):
        raise AssertionError("a window over every column")

    monkeypatch.setattr(features, "rolling_features", no_window)
    assert features.feature_master(rows, None, stats.mapInArrow(count, stats.schema)).count() == 80
    assert made.value == stats.count()
    with pytest.raises(CardinalityError):
        features.feature_master(rows, None, stats.union(stats.limit(1)))


def test_columns_are_finished_before_they_are_paired(spark):
    rows, stats = played(spark, 60)
    plain = features.feature_master(rows, None, stats)
    done = table(features.feature_master(rows, None, stats, finish=lambda c: F.round(F.col(f"`{c}`"), 2)))
    names = [c for c in plain.columns if c.startswith(("rolling_", "trend_", "ewm_", "opponent_")) and c != "opponent_id"]
    pd.testing.assert_frame_equal(done, table(plain.select(*[F.round(F.col(f"`{c}`"), 2).alias(c) if c in names else F.col(f"`{c}`") for c in plain.columns])))


def test_weighted_means_of_rows_that_no_longer_lie_by_slices(spark):
    rows, _ = played(spark)
    base = rows.select("event_id", "side", "team_id", "kickoff_utc", "goals_for")
    from touchline.operators.ewm import ewm_features

    order = ["kickoff_utc", "event_id"]
    dealt = cut(base, ["team_id"], order).repartition(7, "event_id")
    key = ["event_id", "side"]
    got, want = (ewm_features(x, ["goals_for"], order=order, bounded=b).select(*key, "ewm_goals_for_5") for x, b in ((dealt, False), (base, True)))
    pd.testing.assert_frame_equal(table(got), table(want), atol=1e-9)


def test_quick_rounding_is_rounding(spark):
    rng = np.random.default_rng(61)
    numbers = np.concatenate([
        rng.normal(size=3000) * 10.0 ** rng.integers(-8, 12, 3000), np.round(rng.normal(size=3000), 6), rng.integers(-10**6, 10**6, 3000) / 10**5 + 5e-6,
        rng.integers(-200, 200, 500) / 64, [0.0, -0.0, -1e-9, 0.000005, -0.000005, 1.000015, 2.675, 1e300, np.inf, -np.inf],
    ])
    df = spark.createDataFrame([(float(x),) for x in numbers] + [(None,), (float("nan"),)], "x double")
    wrong = df.select("x", rounded("x", 5).alias("a"), F.round("x", 5).alias("b")).where(
        "not (a <=> b) or cast(a as string) != cast(b as string)"
    )
    assert wrong.collect() == []


def test_counts_of_recent_rows_by_key(spark):
    rows, _ = played(spark)
    got = table(history.count_recent(rows, "team_id", "kickoff_utc", 14, "recent", ["event_id", "side"]))
    want = table(history.count_recent(rows, "team_id", "kickoff_utc", 14, "recent", ["event_id", "side"], bounded=True))
    assert got["recent"].tolist() == want["recent"].tolist()


def test_home_comes_before_away_when_both_teams_are_unknown(spark):
    rows, stats = played(spark, 100)
    rows = rows.withColumn("team_id", F.lit(None).cast("long")).withColumn("opponent_id", F.lit(None).cast("long"))
    rows = rows.withColumn("is_away", F.when(F.col("side") == "away", 1).otherwise(0))
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__coalescePartitions__enabled="false"):
        got = table(features.feature_master(rows, None, stats).select("event_id", "side", "kickoff_utc", "goals_for", "prior_match_count", "ewm_goals_for_5"))
    got = got.sort_values(["kickoff_utc", "event_id", "side"], ascending=[True, True, False])
    assert got["prior_match_count"].tolist() == list(range(200))
    want = got["goals_for"].shift(1).ewm(span=5, adjust=False).mean()
    np.testing.assert_allclose(got["ewm_goals_for_5"], want, atol=1e-9)
