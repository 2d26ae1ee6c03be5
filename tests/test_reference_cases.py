"""Literal cases of the operators: small inputs with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.functions.odds import decimal_odds, expected_value
from touchline.functions.payloads import envelope, link_event_id, link_problem
from touchline.functions.scoreline import live_probabilities, score_matrix, with_markets
from touchline.operators.aggregates import group_sizes, rank_group, share_in_group, standings
from touchline.operators.drift import population_stability
from touchline.operators.flatten import flatten_statistics, prematch_context
from touchline.operators.history import assert_rolling_excludes_current, rolling_features
from touchline.operators.joins import CardinalityError, checked_join, first_available, round_robin, with_opponent
from touchline.operators.perspective import regulation_scores, team_matches
from touchline.operators.quality import DataQualityError, enforce, match_rules, validate_team_stats
from touchline.operators.reshape import coverage_flags, quarantine, statistics_wide
from touchline.plans.marts import finished_without_score
from touchline.plans.odds import edges, normalize_odds

STATS = """{"statistics":[{"period":"ALL","groups":[{"groupName":"Passing","statisticsItems":[
 {"name":"Ball possession","home":"55%","away":"45%"},
 {"name":"Crosses","home":"4/10 (40%)","away":"2/8 (25%)"}]}]}]}"""


def test_statistics_flatten_and_split(spark):
    payloads = spark.createDataFrame([(42, STATS)], "event_id bigint, payload string")
    long = flatten_statistics(payloads)
    assert long.count() == 2
    wide = coverage_flags(statistics_wide(long))
    home = wide.where("side = 'home'").first().asDict()
    assert home["ALL_Ball possession"] == pytest.approx(0.55)
    assert (home["ALL_Crosses_won"], home["ALL_Crosses_total"], home["ALL_Crosses_pct"]) == (4, 10, pytest.approx(0.4))
    assert home["has_statistics"] is True and home["has_xg"] is False
    assert wide.count() == 2


def test_quarantine(spark):
    wide = spark.createDataFrame(
        [(1, "home", 2.0, 0.0), (1, "away", 0.5, 0.0)],
        "event_id bigint, side string, `ALL_Dribbles_pct` double, `ALL_Ball possession` double",
    )
    clean, issues = quarantine(wide)
    home = clean.where("side = 'home'").first()
    assert home["ALL_Dribbles_pct"] is None
    assert clean.where("`ALL_Ball possession` is not null").count() == 0
    assert issues.count() == 2
    assert clean.where("side = 'away'").first()["ALL_Dribbles_pct"] == 0.5


def one_match(spark):
    return spark.createDataFrame(
        [(1, dt.datetime(2020, 1, 1), "alpha", "beta", "finished", 2, 1)],
        "event_id bigint, kickoff_utc timestamp_ntz, home_team_id string, away_team_id string, status_type string, "
        "home_score int, away_score int",
    )


def test_one_match_becomes_two_rows(spark):
    rows = team_matches(regulation_scores(one_match(spark)), ["event_id", "kickoff_utc", "status_type", "training_eligible"])
    got = {r["side"]: r for r in rows.collect()}
    assert {r["result"] for r in got.values()} == {"win", "loss"}
    assert sum(r["goals_for"] for r in got.values()) == sum(r["goals_against"] for r in got.values()) == 3
    assert got["home"]["points"] == 3 and got["away"]["points"] == 0


def test_unknown_scores_stay_unknown(spark):
    m = one_match(spark).withColumns({"home_score": F.lit(None).cast("int"), "status_type": F.lit("notstarted")})
    rows = team_matches(regulation_scores(m), ["event_id", "training_eligible"]).collect()
    assert all(r["result"] is None and r["points"] is None and r["team_scored"] is None for r in rows)


def test_negative_goals_and_duplicates_are_rejected(spark):
    bad = spark.createDataFrame([(1, -1, 0)], "event_id bigint, home_score int, away_score int")
    with pytest.raises(DataQualityError, match="negative"):
        enforce(bad, match_rules())
    twice = spark.createDataFrame([(1, "home"), (1, "home")], "event_id bigint, side string")
    with pytest.raises(DataQualityError, match="not unique"):
        validate_team_stats(twice)


def test_rolling_excludes_the_current_row(spark):
    data = [("A", 1, 10), ("A", 2, 20), ("A", 3, 30), ("B", 4, 5), ("B", 5, 7)]
    rows = spark.createDataFrame(data, "team string, n int, shots int")
    out = rolling_features(rows, ["shots"], team="team", order=["n"], means=(2,), spread=None, trend=None, rest=None)
    assert [r["rolling_shots_2"] for r in out.orderBy("n").collect()] == [None, 10, 15, None, 5]
    assert_rolling_excludes_current(out, "shots", "rolling_shots_2", 2, order=["n"])
    with pytest.raises(ValueError):
        assert_rolling_excludes_current(out.withColumn("bad", F.col("shots")), "shots", "bad", 2, order=["n"])


def test_odds(spark):
    rows = spark.createDataFrame(
        [("150", "american"), ("-200", "American"), ("5/2", "fractional"), ("2.2", "decimal")], "o string, f string"
    )
    got = [r[0] for r in rows.select(decimal_odds("o", "f")).collect()]
    assert got == pytest.approx([2.5, 1.5, 3.5, 2.2])
    market = spark.createDataFrame([(1, 2.0), (1, 3.5), (1, 4.0)], "event_id int, price double")
    shares = share_in_group(market, ["event_id"], 1 / F.col("price"), "p")
    assert shares.agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert spark.range(1).select(expected_value(F.lit(0.5), F.lit(2.2))).first()[0] == pytest.approx(0.1)
    with pytest.raises(Exception, match="Unsupported odds format"):
        spark.createDataFrame([("1", "x")], "o string, f string").select(decimal_odds("o", "f")).collect()


def test_edges_need_unique_predictions(spark):
    at = dt.datetime(2024, 1, 1)
    quotes = spark.createDataFrame(
        [(1, "b", "m", "home", "2.0", "decimal", at, at + dt.timedelta(days=1), 1),
         (1, "b", "m", "home", "2.5", "decimal", at, at + dt.timedelta(days=1), 2),
         (1, "b", "m", "away", "2.0", "decimal", at, at + dt.timedelta(days=1), 3)],
        "event_id bigint, bookmaker string, market string, selection string, odds string, odds_format string, "
        "snapshot_utc timestamp, kickoff_utc timestamp, seq int",
    )
    normal = normalize_odds(quotes, ["seq"])
    assert normal.where("selection = 'home'").first()["decimal_odds"] == 2.5
    p = spark.createDataFrame([(1, "m", "home", 0.5)], "event_id bigint, market string, selection string, model_probability double")
    got = edges(normal, p).first()
    assert got["fair_odds"] == 2 and got["expected_value"] == pytest.approx(0.25)
    with pytest.raises(CardinalityError):
        edges(normal, p.unionAll(p))


def test_score_matrix_and_markets(spark):
    rates = spark.createDataFrame([(1.6, 1.1)], "home_xg double, away_xg double")
    assert score_matrix(rates).agg(F.sum("probability")).first()[0] == pytest.approx(1)
    m = with_markets(rates, top_score=True).first().asDict()
    assert m["home_win"] + m["draw"] + m["away_win"] == pytest.approx(1)
    assert m["over_1_5"] >= m["over_2_5"] >= m["over_3_5"]
    assert m["most_likely_correct_score"] == "1-1"


def test_stability_of_identical_samples_is_zero(spark):
    x = spark.range(100).select(F.lit("x").alias("feature"), F.col("id").cast("double").alias("value"))
    both = x.withColumn("is_current", F.explode(F.array(F.lit(True), F.lit(False))))
    assert population_stability(both).first()["psi"] == pytest.approx(0)


def test_message_ids_do_not_depend_on_time_or_key_order(spark):
    rows = spark.createDataFrame(
        [(1, '{"x":2,"y":{"b":1,"a":2}}', "2024-01-01"), (1, '{ "y": {"a":2, "b":1}, "x": 2}', "2024-01-02")],
        "event_id bigint, payload string, at string",
    )
    ids = rows.select(envelope("event_id", "payload", "at")["message_id"].alias("m")).distinct().collect()
    assert len(ids) == 1 and ids[0]["m"].startswith("1:")


def test_live_probabilities_sum_to_one(spark):
    parts = live_probabilities(F.lit(1), F.lit(0), F.lit(60))
    got = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert sum(got) == pytest.approx(1)


def test_round_robin(spark):
    teams = spark.createDataFrame([(f"t{i}", "AB"[i // 4]) for i in range(8)], "team_id string, grp string")
    pairs = round_robin(teams, "grp", "team_id")
    assert {(r["group"], r["fixtures"], r["teams"]) for r in group_sizes(pairs).collect()} == {("A", 6, 4), ("B", 6, 4)}
    assert sorted(r["fixture_id"] for r in pairs.collect()) == [f"G{i:03d}" for i in range(1, 13)]


def test_group_ranking_is_stable(spark):
    games = [("a", "b", 1, 0), ("a", "c", 0, 0), ("a", "d", 0, 0), ("b", "c", 0, 0), ("b", "d", 0, 0), ("c", "d", 0, 0)]
    m = spark.createDataFrame(
        [(i, h, a, "finished", x, y) for i, (h, a, x, y) in enumerate(games)],
        "event_id bigint, home_team_id string, away_team_id string, status_type string, home_score int, away_score int",
    )
    rows = team_matches(regulation_scores(m), ["event_id", "training_eligible"]).withColumn("group", F.lit("A"))
    ranked = rank_group(standings(rows)).orderBy("position").collect()
    assert [r["team_id"] for r in ranked] == ["a", "c", "d", "b"]


def test_link_ids(spark):
    hosts = ["scores.example.com"]
    rows = spark.createDataFrame(
        [("https://scores.example.com/canada-mexico/abc#id:12345678",), ("https://elsewhere.example.com/x#id:1",),
         ("https://scores.example.com/canada-mexico/abc",), ("not a url",)],
        "url string",
    )
    got = [(r[0], r[1]) for r in rows.select(link_event_id("url", hosts), link_problem("url", hosts)).collect()]
    assert got[0] == (12345678, None)
    assert all(event is None and problem for event, problem in got[1:])


EVENT = """{"event":{"id":7,"startTimestamp":1780336800,"homeTeam":{"id":1,"name":"Canada","ranking":40},
 "awayTeam":{"id":2,"name":"Mexico"},"tournament":{"name":"x","uniqueTournament":{"name":"World Cup"}},
 "roundInfo":{"round":1,"name":"Group A"},"venue":{"name":"Example Stadium","country":{"name":"%s"}}}}"""


def test_prematch_context(spark):
    rows = spark.createDataFrame(
        [(7, EVENT % "USA", "Canada", "Mexico"), (8, EVENT % "Canada", "Canada", "Mexico"), (9, "{}", None, None)],
        "event_id bigint, payload string, home_country string, away_country string",
    )
    got = {r["event_id"]: r for r in prematch_context(rows).collect()}
    assert (got[7]["competition_type"], got[7]["round_name"], got[7]["venue_name"]) == ("world_cup", "Group A", "Example Stadium")
    assert got[7]["neutral_site"] == 1 and got[8]["neutral_site"] == 0
    assert got[7]["home_displayed_ranking"] == 40
    assert got[9]["reject_reason"] == "event does not contain two teams"


def test_finished_without_score_minus_exceptions(spark):
    m = spark.createDataFrame([(907233, "finished", None, None), (5, "finished", None, 1)],
                              "event_id bigint, status_type string, home_score int, away_score int")
    listed = spark.createDataFrame([(907233, "finished_missing_score", "-")], "event_id bigint, exception_type string, reason string")
    assert [r["event_id"] for r in finished_without_score(m, listed).collect()] == [5]


def test_cached_payload_fallback(spark):
    live = spark.createDataFrame([(1, None), (2, "live")], "event_id bigint, payload string")
    cache = spark.createDataFrame([(1, "cached")], "event_id bigint, payload string")
    got = {r["event_id"]: (r["payload"], r["source"]) for r in first_available(live, cache, "event_id", "payload").collect()}
    assert got == {1: ("cached", "cache"), 2: ("live", "live")}


@pytest.mark.parametrize("lazy", [True, False])
def test_checked_join_rejects_duplicates(spark, lazy):
    left = spark.createDataFrame([(1, "a")], "k int, x string")
    right = spark.createDataFrame([(1, "b"), (1, "c")], "k int, y string")
    with pytest.raises(Exception, match="not unique"):
        checked_join(left, right, ["k"], validate="many_to_one", lazy=lazy).collect()
    assert checked_join(left, right, ["k"], validate="one_to_many", lazy=lazy).count() == 2


def test_paired_opponent_equals_self_join(spark):
    m = spark.createDataFrame([(i, f"t{i % 5}", f"t{(i + 1) % 5}", "finished", i % 4, i % 3) for i in range(40)],
                              "event_id bigint, home_team_id string, away_team_id string, status_type string, home_score int, away_score int")
    rows = team_matches(regulation_scores(m), ["event_id", "training_eligible"])
    key = ["event_id", "side"]
    a = with_opponent(rows, ["goals_for", "points"], paired=True).orderBy(*key).collect()
    b = with_opponent(rows, ["goals_for", "points"]).select(*with_opponent(rows, ["goals_for", "points"], paired=True).columns).orderBy(*key).collect()
    assert a == b
