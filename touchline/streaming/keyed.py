"""State kept by key in a state store: the latest row of an event (T8, S22) and ids seen before (T4).

The store is RocksDB: it spills to the executors' disks and is saved to the checkpoint, from which it is read back after a
restart and by ``read_state``; no batch is read twice. Timers run on processing time, so nothing is dropped as late.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_FINISHED_MS = 6 * 3600 * 1000
KEEP_IDS_MS = 7 * 24 * 3600 * 1000
FINISHED = ("Ended", "AET", "AP")


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """Streams started from now on keep their state in RocksDB and save its changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def _plain(value):
    """A cell of a pandas column as a Python value."""
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    return value.item() if hasattr(value, "item") else value


def latest_by_key(
    updates: DataFrame, key: str = "event_id", time: str = "observed_at", tie: str = "message_id", status: str = "status",
    finished: tuple[str, ...] = FINISHED, keep_finished_ms: int = KEEP_FINISHED_MS,
) -> DataFrame:
    """The rows that became the latest of their key, by time and then tie; older ones change nothing.

    A key whose latest status is one of ``finished`` leaves the store ``keep_finished_ms`` after that. Rows without a time
    count as the oldest, rows without a key are one key. The state holds one row for each key.
    """
    names = [c for c in updates.columns if c != time]
    numbered = updates.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp"))).drop(time)
    fields = [numbered.schema[c] for c in [*names, "_at"]]
    whole = {f.name for f in fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))}

    def place(row: tuple) -> tuple:
        at, own = row[-1], row[names.index(tie)]
        return (at is not None, at or 0, own is not None, own or "")

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        best = held
        for batch in batches:
            for row in batch[[*names, "_at"]].itertuples(index=False, name=None):
                row = tuple(_plain(v) for v in row)
                row = tuple(int(v) if v is not None and f.name in whole else v for v, f in zip(row, fields, strict=True))
                if best is None or place(row) > place(best):
                    best = row
        changed = best is not held
        if changed:
            state.update(best)
        if best[names.index(status)] in finished:
            state.setTimeoutDuration(keep_finished_ms)
        if changed:
            yield pd.DataFrame([best], columns=[*names, "_at"], dtype=object)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    changes = numbered.groupBy(key).applyInPandasWithState(step, schema, schema, "update", GroupStateTimeout.ProcessingTimeTimeout)
    return changes.withColumn(time, F.timestamp_micros("_at")).select(updates.columns)


def first_by_id(updates: DataFrame, ident: str = "message_id", keep_ms: int = KEEP_IDS_MS) -> DataFrame:
    """T4: once per id, whatever its time, as long as an id is kept: ``keep_ms`` after it was last seen.

    Rows without an id are one id. The state holds one number for each id; use ``live.dedupe_messages`` where a bound by
    the watermark is enough, which stays in the JVM.
    """
    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        times = state.get[0] if known else 0
        for batch in batches:
            if not known and len(batch):
                yield batch.iloc[:1]
                known = True
            times += len(batch)
        state.update((times,))
        state.setTimeoutDuration(keep_ms)

    return updates.groupBy(ident).applyInPandasWithState(
        step, updates.schema, "times long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_available(spark: SparkSession, writer) -> None:
    """Process what is there now, then stop. Timers go off with a batch of data: a batch for each timer would never end."""
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(NO_DATA, before)


def run_to_state(stream: DataFrame, checkpoint: str, mode: str = "update") -> str:
    """Process what is there now, for the state alone; the next run goes on from it."""
    run_available(stream.sparkSession, stream.writeStream.format("noop").outputMode(mode).option("checkpointLocation", checkpoint))
    return checkpoint


def read_state(spark: SparkSession, checkpoint: str, time: str = "observed_at") -> DataFrame:
    """What the store holds by the last finished batch: one row for each key."""
    held = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    return held.withColumn(time, F.timestamp_micros("_at")).drop("_at") if "_at" in held.columns else held
