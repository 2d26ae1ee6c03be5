"""Warehouse loads with an append-only audit trail."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.io import path_exists

AUDIT_SCHEMA = (
    "load_id string, dataset_name string, started_at timestamp, finished_at timestamp, "
    "row_count bigint, status string, error_message string"
)


def _append(spark: SparkSession, path: str, **values):
    row = spark.range(1).select(
        *[
            F.lit(values.get(name)).cast(kind).alias(name)
            if name not in {"started_at", "finished_at"}
            else (F.current_timestamp() if values.get(name) else F.lit(None).cast(kind)).alias(name)
            for name, kind in (part.strip().split(" ") for part in AUDIT_SCHEMA.split(","))
        ]
    )
    row.coalesce(1).write.mode("append").parquet(path)


def latest_loads(audit: DataFrame) -> DataFrame:
    """State of every load: each column's last value, with the running row's start.

    A running load whose dataset was started again counts as interrupted.
    """
    last = F.when(F.col("status") == "running", 0).otherwise(1)
    loads = audit.groupBy("load_id", "dataset_name").agg(
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.max("row_count").alias("row_count"),
        F.max_by("status", last).alias("status"),
        F.max("error_message").alias("error_message"),
    )
    newest = loads.groupBy("dataset_name").agg(F.max("started_at").alias("_newest"))
    stale = (F.col("status") == "running") & (F.col("started_at") < F.col("_newest"))
    return loads.join(newest, "dataset_name").select(
        "load_id", "dataset_name", "started_at",
        F.when(stale, F.col("_newest")).otherwise(F.col("finished_at")).alias("finished_at"),
        "row_count",
        F.when(stale, "interrupted").otherwise(F.col("status")).alias("status"),
        F.when(stale, "superseded by retry").otherwise(F.col("error_message")).alias("error_message"),
    )


def audit_listing(audit: DataFrame) -> DataFrame:
    """Loads, newest first."""
    return latest_loads(audit).orderBy(F.desc("started_at"), "load_id")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], AUDIT_SCHEMA)


def load_table(spark: SparkSession, source: str, target: str, dataset: str, audit: str) -> str:
    """Replace the target with the source and record running, then the outcome."""
    load_id = str(uuid.uuid4())
    _append(spark, audit, load_id=load_id, dataset_name=dataset, started_at=True, status="running")
    try:
        spark.read.parquet(source).write.mode("overwrite").parquet(target)
        rows = spark.read.parquet(target).count()
    except Exception as error:
        _append(
            spark, audit, load_id=load_id, dataset_name=dataset, finished_at=True, status="failed",
            error_message=str(error),
        )
        raise
    _append(
        spark, audit, load_id=load_id, dataset_name=dataset, finished_at=True, status="success", row_count=rows
    )
    return load_id
