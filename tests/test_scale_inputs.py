"""Inputs of fits are computed once, and their work is dealt over the cores."""

import numpy as np

from touchline.catalog import models
from touchline.plans import boosting


def test_boosting_uses_every_core_it_has_rows_for(spark, monkeypatch):
    seen, summed = [], boosting._summed

    def watched(blocks, *rest):
        seen.append(blocks.getNumPartitions())
        return summed(blocks, *rest)

    monkeypatch.setattr(boosting, "_summed", watched)
    monkeypatch.setattr(boosting, "TASK_ROWS", 1_000)
    rows = spark.range(3_000).selectExpr("id as key", "array(cast(id % 7 as double)) as features", "cast(id % 2 as double) as label")
    boosting.fit(rows, boosting.Settings("squared", rounds=1))
    assert set(seen) == {min(3, spark.sparkContext.defaultParallelism)}


def test_places_by_columns_are_those_by_rows():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 64, (500, 4)).astype(np.uint8)
    tree = boosting.Tree(np.array([2, -1, 0, 1, 3, -1, 2]), rng.integers(0, 64, 7), np.zeros(8))
    for depth in range(4):
        plain = []
        for row in bins:
            node = 0
            for _ in range(depth):
                node = 2 * node + 1 + int(tree.feature[node] >= 0 and row[tree.feature[node]] > tree.cut[node])
            plain.append(node)
        assert tree.nodes(np.asfortranarray(bins), depth).tolist() == plain


def test_model_queries_fit_on_fixed_rows(spark, sf_dir, monkeypatch):
    """A fit goes over its rows many times; their history must not be worked out each time."""
    plans = []

    def watched(rows, *_):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(models.m, "yearly_backtests", watched)
    monkeypatch.setattr(models.m, "fit_tree_outcome", watched)
    monkeypatch.setattr(models.m, "feature_importances", lambda model, rows, features: rows)
    models.yearly_backtests(spark, sf_dir)
    models.feature_importances(spark, sf_dir)
    assert len(plans) == 2
    assert all("Exchange" not in plan and "Window" not in plan for plan in plans)


def test_most_likely_score_needs_no_list_of_cells(spark):
    """The lowest of the best cells, as by looking at every one; unknown rates give the first cell without a chance."""
    from touchline.functions.scoreline import score_matrix, with_markets

    rates = [(k, h / 4, a / 4) for k, (h, a) in enumerate((h, a) for h in range(1, 18, 3) for a in range(2, 17, 2))]
    rows = spark.createDataFrame([*rates, (999, None, 1.0)], "id int, home_xg double, away_xg double")
    found = with_markets(rows, top_score=True)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: r for r in found.collect()}
    assert (found[999]["most_likely_correct_score"], found[999]["most_likely_correct_score_probability"]) == ("0-0", None)
    cells = {}
    for r in score_matrix(rows.where("id < 999")).collect():
        cells.setdefault(r["id"], []).append((-r["probability"], r["home_goals"], r["away_goals"]))
    for number, own in cells.items():
        p, home, away = min(own)
        assert found[number]["most_likely_correct_score"] == f"{home}-{away}"
        assert found[number]["most_likely_correct_score_probability"] == -p


def test_weighted_means_summarise_only_teams_over_several_slices(spark):
    from touchline.operators import ewm
    from touchline.operators.ordered import SLICE

    small = spark.range(600).selectExpr("id div 3 as team", "id as at", "1.0D as v", f"cast(id div 150 as int) as {SLICE}")
    large = spark.range(600, 640).selectExpr("200L as team", "id as at", "2.0D as v", f"cast(4 + id div 620 as int) as {SLICE}")
    out = ewm._slice_starts(small.union(large), "team", ["v"], 5)
    assert "LeftSemi" in out._jdf.queryExecution().analyzed().toString()
    started = {r["team"] for r in out.where("s_m_v is not null").collect()}
    assert started == {200}


def test_fixture_features_work_out_the_history_once(spark, monkeypatch):
    from touchline.operators import joins
    from touchline.plans.serving import fixture_features

    calls, recent = [], joins.over_recent

    def watched(*args, **options):
        calls.append(1)
        return recent(*args, **options)

    monkeypatch.setattr(joins, "over_recent", watched)
    master = spark.createDataFrame([(1, t, k, 10.0 * t + k) for t in (1, 2) for k in range(3)], "side int, team_id long, event_id long, x double")
    master = master.selectExpr("team_id", "event_id", "x", "timestamp_seconds(event_id * 86400) as kickoff_utc")
    coming = spark.sql("select 2L as event_id, timestamp_seconds(5 * 86400) as kickoff_utc, 1L as home_team_id, 2L as away_team_id")
    row = fixture_features(coming, master, ["x", "opponent_x", "rest_days"]).first()
    assert (row["x"], row["opponent_x"], row["rest_days"], row["has_history"]) == (11.0, 21.0, 4.0, True)
    assert len(calls) == 1
