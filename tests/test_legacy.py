"""The exploratory feature set end to end on a small season."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from touchline.operators.sets import present
from touchline.plans.features import MODEL_FEATURES_LEGACY, model_features_legacy, targets_legacy
from touchline.plans.legacy import advanced_features
from touchline.sources.seeds import confederation_table, host_table


def test_advanced_features(spark):
    names = ["Brazil", "Germany", "USA", "Atlantis"]
    data = []
    for i in range(24):
        home, away = names[i % 4], names[(i + 1 + i // 8) % 4]
        if home == away:
            continue
        hs, as_ = i % 4, i % 3
        for side, me, other, gf, ga in (("home", home, away, hs, as_), ("away", away, home, as_, hs)):
            data.append((i, dt.datetime(2014, 1, 1) + dt.timedelta(days=9 * i), side, me, other, home, away, hs, as_,
                         "Brazil" if i % 3 else None, "World Cup, Knockout", float(i % 5) if i % 6 else None, gf, ga, gf - ga))
    rows = spark.createDataFrame(
        data, "event_id bigint, date timestamp_ntz, side string, team string, opponent string, home_team string, "
        "away_team string, home_score int, away_score int, venue_country string, tournament string, "
        "`ALL_Total shots` double, goals_for int, goals_against int, goal_diff int",
    )
    out = advanced_features(rows, confederation_table(spark), host_table(spark))
    assert out.count() == len(data)
    got = out.toPandas().sort_values(["team", "date", "event_id"]).reset_index(drop=True)
    teams = got.groupby("team", sort=False)
    want = teams["goals_for"].transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean())
    np.testing.assert_allclose(got["rolling_goals_for_5"].astype(float), want)
    want = teams["ALL_Total shots"].transform(lambda s: s.shift(1).ewm(span=5, adjust=False).mean())
    np.testing.assert_allclose(got["ewm_ALL_Total shots_5"].astype(float), want)
    assert set(got.loc[got.team == "Brazil", "team_is_host_country"]) == {1}
    assert set(got.loc[got.team == "Germany", "team_is_host_country"]) == {0}
    assert got.loc[got.team == "Atlantis", "team_confederation"].isna().all()
    mirrored = got.merge(got, left_on=["event_id", "team"], right_on=["event_id", "opponent"])
    pd.testing.assert_series_equal(
        mirrored["opponent_rolling_goals_for_5_y"], mirrored["rolling_goals_for_5_x"], check_names=False
    )
    assert set(model_features_legacy(out).columns) >= set(present(out, MODEL_FEATURES_LEGACY))
    assert "result_90" in targets_legacy(out).columns


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="venue_country"):
        advanced_features(spark.createDataFrame([(1,)], "event_id bigint"), None, None)
