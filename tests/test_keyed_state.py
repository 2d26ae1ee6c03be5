"""Latest rows and seen ids in a state store, over restarts."""

import time

from pyspark.sql import functions as F

from touchline.streaming import keyed

SCHEMA = "message_id string, event_id long, observed_at string, status string, home_score int"


def add(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(folder / name))


def source(spark, folder):
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").json(str(folder))
    return rows.withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def state(spark, checkpoint):
    return {r.event_id: (r.message_id, r.status, r.home_score) for r in keyed.read_state(spark, checkpoint).collect()}


def test_latest_rows_over_three_runs(spark, tmp_path):
    keyed.use_rocksdb(spark)
    folder, checkpoint = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()

    def run(**options):
        changes = keyed.latest_by_key(source(spark, folder), **options)
        out = str(tmp_path / "out")
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        keyed.run_available(spark, writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/{k:03}")))

    add(spark, folder, "a", [("m1", 1, "2024-01-01 10:00:00", "1st", 0), ("m2", 2, "2024-01-01 10:00:00", "1st", None), (None, 4, None, None, 7)])
    run()
    assert state(spark, checkpoint) == {1: ("m1", "1st", 0), 2: ("m2", "1st", None), 4: (None, None, 7)}
    # An older message after a newer one changes nothing; of equal times the later id counts.
    add(spark, folder, "b", [("m0", 1, "2024-01-01 09:00:00", "old", 9), ("m3", 2, "2024-01-01 10:00:00", "2nd", 1), ("m4", 3, "2024-01-01 11:00:00", "1st", 0)])
    run()
    assert state(spark, checkpoint) == {1: ("m1", "1st", 0), 2: ("m3", "2nd", 1), 3: ("m4", "1st", 0), 4: (None, None, 7)}
    # A restart reads new files only: all that came out are the changes, each once.
    run()
    changed = spark.read.parquet(str(tmp_path / "out/*")).collect()
    assert sorted(str(r.message_id) for r in changed) == ["None", "m1", "m2", "m3", "m4"]
    assert all(r.observed_at is not None for r in changed if r.message_id)


def test_finished_events_leave_the_store(spark, tmp_path):
    keyed.use_rocksdb(spark)
    folder, checkpoint = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()

    def run():
        keyed.run_to_state(keyed.latest_by_key(source(spark, folder), keep_finished_ms=1), checkpoint)

    add(spark, folder, "a", [("m1", 1, "2024-01-01 10:00:00", "Ended", 2), ("m2", 2, "2024-01-01 10:00:00", "1st", 0)])
    run()
    assert set(state(spark, checkpoint)) == {1, 2}
    time.sleep(0.1)
    add(spark, folder, "b", [("m3", 3, "2024-01-01 10:05:00", "1st", 0)])
    run()
    assert set(state(spark, checkpoint)) == {2, 3}


def test_a_repeat_after_the_watermark_is_dropped(spark, tmp_path):
    keyed.use_rocksdb(spark)
    folder, checkpoint, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    folder.mkdir()

    def run(keep_ms=10**9):
        first = keyed.first_by_id(source(spark, folder).withWatermark("observed_at", "1 minute"), keep_ms=keep_ms)
        keyed.run_available(spark, first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))

    add(spark, folder, "a", [("m1", 1, "2024-01-01 10:00:00", "x", 0), ("m1", 1, "2024-01-01 10:00:05", "x", 0), ("m2", 1, "2024-01-01 15:00:00", "x", 0)])
    run()
    add(spark, folder, "b", [("m1", 1, "2024-01-02 10:00:00", "x", 0), ("m3", 1, "2024-01-01 08:00:00", "late", 0)])
    run()
    add(spark, folder, "c", [("m3", 1, "2024-01-03 08:00:00", "x", 0), ("m2", 1, "2024-01-03 08:00:00", "x", 0)])
    run()
    assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == ["m1", "m2", "m3"]
    held = spark.read.format("statestore").load(checkpoint)
    assert {r.id: r.times for r in held.select("key.message_id", "value.groupState.times").toDF("id", "times").collect()} == {"m1": 3, "m2": 2, "m3": 2}
