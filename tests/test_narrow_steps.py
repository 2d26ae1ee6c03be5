from pyspark.sql import Row

from touchline.catalog import all_queries
from touchline.operators.joins import with_opponent
from touchline.operators.reshape import melt_clean
from touchline.streaming import keyed


def test_ids_alone_go_to_the_id_store(spark, sf_dir, monkeypatch):
    seen = []
    first_by_id = keyed.first_by_id

    def watched(updates, *args, **kwargs):
        seen.append(updates.columns)
        return first_by_id(updates, *args, **kwargs)

    monkeypatch.setattr(keyed, "first_by_id", watched)
    rows = all_queries()["stream_dedupe_ids"](spark, sf_dir)
    assert rows.columns == ["message_id", "times"] and rows.where("times != 3").count() == 0 < rows.count()
    assert seen == [["message_id"]]


def test_the_other_sides_columns_are_packed_after_the_shuffle(spark):
    rows = spark.createDataFrame(
        [(1, 10, 20, 1.0), (1, 20, 10, 2.0), (2, 10, 30, 3.0), (2, 30, 99, 4.0), (3, 10, 20, None)], "event_id int, team_id int, opponent_id int, x double"
    )
    both = with_opponent(rows, ["x"], paired=True)
    assert sorted((r["event_id"], r["team_id"], r["opponent_x"]) for r in both.collect()) == [(1, 10, 2.0), (1, 20, 1.0), (2, 10, 4.0), (2, 30, None), (3, 10, None)]
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and plan.index("AS _mine") < plan.index("Exchange")


def test_cells_travel_narrow_to_the_row_that_they_become(spark):
    rows = [(1, "p", 1, "5%", None), (1, "p", 2, "9%", "7"), (1, "f", 1, "3/4 (75%)", "x"), (1, "t", 1, "n/a", "50%"), (None, "p", 1, "", "1e1"), (2, "q", 1, None, "NaN")]
    clean = melt_clean(spark.createDataFrame(rows, "event_id int, stat_col string, ordinal int, home string, away string"), names=["p", "f", "t", "none"])
    assert sorted(map(str, clean.toLocalIterator())) == sorted(map(str, [
        Row(event_id=1, side="home", p="0.05", f_won=3.0, f_total=4.0, f_pct=0.75, t="n/a", none=None),
        Row(event_id=1, side="away", p="7", f_won=None, f_total=None, f_pct=None, t="0.5", none=None),
        Row(event_id=None, side="home", p="", f_won=None, f_total=None, f_pct=None, t=None, none=None),
        Row(event_id=None, side="away", p="1e1", f_won=None, f_total=None, f_pct=None, t=None, none=None),
        *[Row(event_id=2, side=s, p=None, f_won=None, f_total=None, f_pct=None, t=None, none=None) for s in ("home", "away")],
    ]))
    plan = clean._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange"):]
