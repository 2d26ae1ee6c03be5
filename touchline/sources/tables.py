"""Catalog tables that are replaced as a whole, and state that every run is merged into."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def version_name(schema: str, name: str, run: str) -> str:
    """The table that one run writes for a published name."""
    return f"{schema}.{name}__{run}"


def publish(spark: SparkSession, schema: str, written: dict[str, str]):
    """Turn the view of each name to the table just written, then drop the tables that earlier runs left."""
    for name, table in written.items():
        spark.sql(f"create or replace view {schema}.{name} as select * from {table}")
    current = {table.rpartition(".")[2] for table in written.values()}
    for row in spark.sql(f"show tables in {schema} like '*__*'").collect():
        if row["tableName"].rpartition("__")[0] in written and row["tableName"] not in current:
            spark.sql(f"drop table if exists {schema}.{row['tableName']}")


def merge_run(
    spark: SparkSession, schema: str, name: str, run: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """The published state with a run merged into it.

    The first run makes the state by a merge into no rows. The merged rows become a table of their own; only a table that
    is written whole is published, and the one before goes then. ``merge(state, run)`` says which row wins: if it gives
    the same rows for a run that was merged before, a repeated run changes nothing.
    """
    known = spark.catalog.tableExists(f"{schema}.{name}")
    state = spark.table(f"{schema}.{name}") if known else run.limit(0)
    table = version_name(schema, name, uuid.uuid4().hex)
    try:
        merge(state, run).write.format("parquet").saveAsTable(table)
    except Exception:
        spark.sql(f"drop table if exists {table}")
        raise
    publish(spark, schema, {name: table})
    return spark.table(f"{schema}.{name}")
