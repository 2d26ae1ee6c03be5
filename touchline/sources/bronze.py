"""Raw JSON payload store: content-addressed, append-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from touchline.functions.payloads import canonical_json, payload_hash
from touchline.operators.sets import keep_first
from touchline.sources.io import path_exists


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw payload files with partition columns and their metadata sidecar.

    A payload ``<hash>.json`` may have a ``<hash>.meta.json`` next to it; both
    are read in one scan each and joined on directory and hash.
    """
    files = spark.read.text(path, wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    name = F.regexp_extract("_file", r"([^/]+)$", 1)
    folder = F.regexp_replace("_file", r"/[^/]+$", "")
    tagged = files.select(
        "*", folder.alias("_folder"), F.regexp_replace(name, r"(\.meta)?\.json$", "").alias("payload_hash"),
        name.endswith(".meta.json").alias("_is_meta"),
    )
    payloads = tagged.where(~F.col("_is_meta")).withColumnRenamed("value", "payload")
    metadata = tagged.where("_is_meta").select("_folder", "payload_hash", F.col("value").alias("metadata"))
    return payloads.join(metadata, ["_folder", "payload_hash"], "left").drop("_folder", "_file", "_is_meta")


def new_payloads(arriving: DataFrame, stored: DataFrame | None, payload: str = "payload") -> DataFrame:
    """Arriving payloads whose content is not stored yet, once each."""
    hashed = arriving.select(
        *[c for c in arriving.columns if c != payload],
        canonical_json(payload).alias(payload),
        payload_hash(payload).alias("payload_hash"),
    ).where(F.col("payload_hash").isNotNull())
    once = keep_first(hashed, ["category", "payload_hash"], ["fetched_at"])
    if stored is None:
        return once
    return once.join(stored.select("category", "payload_hash"), ["category", "payload_hash"], "left_anti")


def store_payloads(spark: SparkSession, arriving: DataFrame, path: str, fetch_date: Column) -> int:
    """Append unseen payloads, partitioned by category and fetch date."""
    stored = spark.read.parquet(path) if path_exists(spark, path) else None
    fresh = new_payloads(arriving, stored).withColumn("fetch_date", fetch_date)
    written = Observation()
    counted = fresh.observe(written, F.count(F.lit(1)).alias("n"))
    counted.write.mode("append").partitionBy("category", "fetch_date").parquet(path)
    return written.get["n"]
