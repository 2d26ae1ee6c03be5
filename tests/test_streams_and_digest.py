"""Streams over several files and micro-batches, and the dataset digest."""


from pyspark.sql import functions as F

from touchline.catalog.streams import EVENT_SCHEMA, messages
from touchline.operators.aggregates import dataset_version
from touchline.streaming import live

import __spark_entry__ as entry


def test_streams_read_a_folder_of_part_files(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    queries = entry.queries()
    for name in ("validate_split", "dead_letters", "latest_state"):
        assert queries[name](spark, str(tmp_path)).count() == queries[name](spark, sf_dir).count() > 0


def test_late_and_repeated_rows_over_three_batches(spark, tmp_path):
    source = tmp_path / "in"
    rows = [
        [(5, "2024-01-01 00:00:00"), (6, "2024-01-01 00:10:00")],
        [(6, "2024-01-01 00:10:00"), (7, "2024-01-01 00:20:00")],  # a repeat of the batch before
        [(8, "2024-01-01 00:05:00"), (9, "2024-01-01 00:21:00")],  # the first is late by then
    ]
    out = str(tmp_path / "out")
    for batch in rows:
        df = spark.createDataFrame(batch, "event_id bigint, at string").select(
            "event_id", F.col("at").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("user_id"),
            F.lit("goal").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
        )
        df.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(str(source))
        decoded = live.decode(live.valid_messages(live.with_contract(messages(stream))))
        kept = live.dedupe_observations(decoded).select("message_id")
        writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
        live.run_available(writer.outputMode("append"))
    found = sorted(r["message_id"] for r in spark.read.parquet(out).collect())
    assert found == ["1:5", "1:6", "1:7", "1:9"]


def test_digest_tells_nulls_apart_and_ignores_order(spark):
    def of(*rows):
        return dataset_version(spark.createDataFrame(list(rows), "a string, b string")).first()[0]

    assert of((None, "a")) != of(("a", None))
    assert of(("x", "y"), ("p", None)) == of(("p", None), ("x", "y"))
    assert of(("x", "y")) != of(("x", "y"), ("x", "y"))
