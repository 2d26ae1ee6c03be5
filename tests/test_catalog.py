"""The registry keeps its contract and inverse facts hold on the given tables."""

import __spark_entry__ as entry
from pyspark.sql import functions as F


def test_registry_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100
    assert set(oracles) <= set(queries)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["event_id", "side", "team_id", "opponent_id"]
    assert df.count() > 0


def test_perspective_conserves_goals(spark, sf_dir):
    rows = entry.queries()["team_perspective"](spark, sf_dir)
    total = rows.agg(F.sum("goals_for").alias("a"), F.sum("goals_against").alias("b")).first()
    assert total["a"] == total["b"]


def test_dedupe_prunes_hot_keys_before_the_shuffle(spark, sf_dir):
    plan = entry.queries()["dedupe_keep_last"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = entry.queries()["advancing_team"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "o_orderdate" not in read and "o_orderpriority" not in read


def test_streams_equal_batch(spark, sf_dir):
    queries = entry.queries()
    split = queries["validate_split"](spark, sf_dir).where("error is null").count()
    assert queries["stream_dedupe_messages"](spark, sf_dir).count() == split
    assert queries["stream_dedupe"](spark, sf_dir).count() == 2 * split


def test_models_give_probabilities(spark, sf_dir):
    scored = entry.queries()["score_fixtures"](spark, sf_dir)
    total = sum(F.col(f"probability_{n}") for n in ("loss", "draw", "win"))
    assert scored.where(F.abs(total - 1) > 1e-6).count() == 0
    assert scored.count() > 0
