"""State merged run by run, and the run log."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from touchline.operators.aggregates import merge_high_water
from touchline.session import fresh_path
from touchline.sources import io
from touchline.sources.tables import merge_run

SCHEMA = "team_id int, latest_match_date date, history_complete boolean, updated_at int"
DAY = dt.date(2024, 1, 1)


def _rows(df):
    return sorted((r["team_id"], r["latest_match_date"].day if r["latest_match_date"] else None, r["history_complete"], r["updated_at"]) for r in df.collect())


def test_repeated_and_late_runs_change_nothing(spark):
    schema = f"state_{uuid.uuid4().hex}"
    spark.sql(f"create schema {schema} location '{fresh_path(spark, 'state')}'")
    first = spark.createDataFrame([(1, DAY, True, 1), (2, DAY, None, 1)], SCHEMA)
    second = spark.createDataFrame([(2, DAY.replace(day=5), True, 2), (3, None, False, 2)], SCHEMA)
    assert _rows(merge_run(spark, schema, "marks", first, merge_high_water)) == [(1, 1, True, 1), (2, 1, False, 1)]
    want = [(1, 1, True, 1), (2, 5, True, 2), (3, None, False, 2)]
    for run in (second, second, first):
        assert _rows(merge_run(spark, schema, "marks", run, merge_high_water)) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert _rows(merge_run(spark, schema, "marks", empty, merge_high_water)) == want
    left = [r["tableName"] for r in spark.sql(f"show tables in {schema}").collect() if r["tableName"].startswith("marks__")]
    assert len(left) == 1


def test_a_failed_merge_leaves_the_state(spark):
    schema = f"state_{uuid.uuid4().hex}"
    spark.sql(f"create schema {schema} location '{fresh_path(spark, 'state')}'")
    first = spark.createDataFrame([(1, DAY, True, 1)], SCHEMA)
    merge_run(spark, schema, "marks", first, merge_high_water)
    try:
        merge_run(spark, schema, "marks", first, lambda state, run: state.withColumn("updated_at", F.raise_error(F.lit("no")).cast("int")))
    except Exception as error:
        assert "no" in str(error)
    else:
        raise AssertionError("the merge must fail")
    assert _rows(spark.table(f"{schema}.marks")) == [(1, 1, True, 1)]


def test_latest_run_of_a_log(spark):
    path = fresh_path(spark, "runs")
    rows = spark.range(10)
    for hour, run in ((3, "c"), (1, "a"), (2, "b")):
        at = F.lit(dt.datetime(2024, 1, 1, hour))
        bad = F.col("id") % 2 == 0 if run == "c" else F.lit(False)
        io.record_run(rows, path, run, at, at, errors=F.count_if(bad), succeeded=F.count_if(~bad))
    assert spark.read.parquet(path).count() == 3
    last = io.latest_run(spark, path).collect()
    assert [(r["run_id"], r["errors"], r["succeeded"], r["status"]) for r in last] == [("c", 5, 5, "partial_success")]
