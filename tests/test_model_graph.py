"""Models run after their inputs, are published as a whole, and only when all of them pass."""

import uuid

import pytest
from pyspark.sql import functions as F

from touchline.operators.quality import not_null, unique
from touchline.plans.graph import SOURCES, Model, ModelError, ordered, run_models, upstream, warehouse_models
from touchline.session import fresh_path


@pytest.fixture
def schema(spark):
    name = f"graph_{uuid.uuid4().hex}"
    spark.sql(f"create schema {name} location '{fresh_path(spark, 'graph')}'")
    return name


def _models(times, rules=()):
    return [
        Model("second", ("first", "stg"), lambda a, b: a.join(b.select("id"), "id"), True),
        Model("first", ("stg",), lambda a: a.withColumn("x", F.col("id") * times), True, rules),
        Model("stg", ("raw",), lambda a: a.where("id > 0")),
    ]


def test_order_missing_inputs_and_cycles(spark):
    assert [m.name for m in ordered(_models(1), ["raw"])] == ["stg", "first", "second"]
    with pytest.raises(ModelError, match="stg needs raw"):
        ordered(_models(1), [])
    loop = [Model("a", ("b",), None), Model("b", ("a",), None)]
    with pytest.raises(ModelError, match="need each other"):
        ordered(loop, [])
    with pytest.raises(ModelError, match="name of its own"):
        ordered([*_models(1), Model("raw", (), None)], ["raw"])
    names = [m.name for m in ordered(warehouse_models(), SOURCES)]
    assert names.index("stg_events") < names.index("fct_matches") < names.index("feat_match_context")
    assert {m.name for m in upstream(warehouse_models(), ["dim_venues"])} == {"stg_events", "stg_event_details", "dim_venues"}


def test_a_run_replaces_all_marts_and_a_failed_one_none(spark, schema):
    raw = spark.range(4)
    run_models(spark, _models(10), {"raw": raw}, schema)
    assert sorted(r["x"] for r in spark.table(f"{schema}.second").collect()) == [10, 20, 30]
    run_models(spark, _models(100), {"raw": raw}, schema)
    assert sorted(r["x"] for r in spark.table(f"{schema}.second").collect()) == [100, 200, 300]
    assert spark.table("stg").count() == 3
    doubled = raw.union(raw)
    with pytest.raises(ModelError, match=r"first: id is not unique \(3\)"):
        run_models(spark, _models(7, [not_null("id"), unique("id")]), {"raw": doubled}, schema)
    broken = [*_models(7), Model("third", ("second",), lambda a: a.select(F.raise_error(F.lit("no"))), True)]
    with pytest.raises(Exception, match="no"):
        run_models(spark, broken, {"raw": raw}, schema)
    for name in ("first", "second"):
        assert sorted(r["x"] for r in spark.table(f"{schema}.{name}").collect()) == [100, 200, 300]
    tables = [r["tableName"] for r in spark.sql(f"show tables in {schema}").where("not isTemporary").collect()]
    assert len(tables) == 4  # two published views and the two tables they read


def test_an_empty_source_gives_empty_marts(spark, schema):
    run_models(spark, _models(1), {"raw": spark.range(0)}, schema)
    assert spark.table(f"{schema}.second").count() == 0
