"""Live match updates on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.payloads import MESSAGE_VERSION, json_path
from touchline.functions.scoreline import live_probabilities

# Fixed values of the message contract.
ENVELOPE_KEYS = ["schema_version", "message_id", "event_id", "observed_at", "payload"]
ENVELOPE_SCHEMA = (
    "schema_version string, message_id string, event_id bigint, observed_at string, payload string"
)
WATERMARK = "2 minutes"
STATUS_PATH = "event.status.description"
SCORE_PATHS = {"home_score": "event.homeScore.current", "away_score": "event.awayScore.current"}


def kafka_source(spark: SparkSession, servers: str, topic: str, offsets: str = "earliest") -> DataFrame:
    """Topic as a stream, ``value`` as text."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", offsets)
        .load()
    )
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def kafka_sink(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "event_id"):
    """Rows as JSON to a topic, append mode, checkpointed."""
    return (
        stream.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def replay_source(spark: SparkSession, path: str) -> DataFrame:
    """Replay a directory of JSON-lines files, ``value`` as text."""
    return spark.readStream.text(path)


def replay_sink(stream: DataFrame, path: str, checkpoint: str, value: str = "value"):
    """Append raw messages to a JSON-lines replay log."""
    return (
        stream.select(F.col(value).alias("value"))
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def contract_error(value: str = "value") -> Column:
    """Why a message breaks the contract, null for a valid one.

    All keys, no others, the fixed version, and the type of every field; the
    time text is not checked for its format.
    """
    text = F.col(value)
    # With a fixed version and known types, malformed JSON has no keys at all.
    keys = F.json_object_keys(text)
    expected = F.array(*[F.lit(k) for k in ENVELOPE_KEYS])
    parsed = F.try_parse_json(text)

    def kind(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))

    integral = kind("event_id").isin("BIGINT") | (
        kind("event_id").startswith("DECIMAL")
        & (F.try_variant_get(parsed, "$.event_id", "double") % 1 == 0)
    )
    missing = F.array_except(expected, keys)
    extra = F.array_except(keys, expected)
    return (
        F.when(parsed.isNull() | keys.isNull(), "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
        .when(F.size(extra) > 0, F.concat(F.lit("unexpected: "), F.array_join(extra, ",")))
        .when(
            (kind("schema_version") != "STRING")
            | (F.try_variant_get(parsed, "$.schema_version", "string") != MESSAGE_VERSION),
            "schema_version is not supported",
        )
        .when(kind("message_id") != "STRING", "message_id is not a string")
        .when(~F.coalesce(integral, F.lit(False)), "event_id is not an integer")
        .when(kind("observed_at") != "STRING", "observed_at is not a string")
        .when(~kind("payload").startswith("OBJECT"), "payload is not an object")
    )


def with_contract(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages with an ``error`` column; null marks a valid one."""
    return messages.withColumn("error", contract_error(value))


def valid_messages(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull()).drop("error")


def dead_letters(checked: DataFrame, value: str = "value") -> DataFrame:
    """``{error, raw}`` rows of the messages that broke the contract."""
    return checked.where(F.col("error").isNotNull()).select("error", F.col(value).alias("raw"))


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns; ``payload`` stays JSON text, times become timestamps."""
    parsed = messages.select(F.from_json(value, ENVELOPE_SCHEMA).alias("m")).select("m.*")
    return parsed.withColumn("observed_at", F.try_to_timestamp("observed_at"))


def dedupe_observations(updates: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Once per (message id, observation time); late rows are dropped."""
    return updates.withWatermark("observed_at", watermark).dropDuplicates(["message_id", "observed_at"])


def dedupe_messages(updates: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """T4: once per message id, state bounded by the watermark."""
    return updates.withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(["message_id"])


def live_features(updates: DataFrame) -> DataFrame:
    """T5: status and score of each update."""
    return updates.select(
        "message_id",
        "event_id",
        "observed_at",
        json_path("payload", STATUS_PATH).alias("status"),
        *[json_path("payload", path, "int").alias(name) for name, path in SCORE_PATHS.items()],
    )


def score_live(features: DataFrame, minute: Column | None = None, now: Column | None = None) -> DataFrame:
    """Probabilities, prediction time and latency of each update."""
    minute = F.lit(0) if minute is None else minute
    now = F.current_timestamp() if now is None else now
    probabilities = live_probabilities("home_score", "away_score", minute)
    latency = (F.unix_micros(now) - F.unix_micros("observed_at")) / 1_000_000
    return features.select(
        "*",
        *[c.alias(n) for n, c in probabilities.items()],
        now.alias("prediction_timestamp"),
        latency.alias("latency_seconds"),
    )


def latency_report(scored: DataFrame, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Latency percentiles, in bounded memory."""
    return scored.agg(
        F.count("latency_seconds").alias("updates"),
        F.avg("latency_seconds").alias("mean_latency"),
        *[
            F.approx_percentile("latency_seconds", F.lit(float(q)), F.lit(10_000)).alias(f"p{round(q * 100)}")
            for q in quantiles
        ],
    )


def latest_state_sink(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", time: str = "observed_at"):
    """Keyed latest state as an idempotent table.

    Every micro-batch writes the newest row per key under its batch number, and
    a repeated batch replaces its own output; ``read_latest_state`` merges them.
    """

    def write(batch: DataFrame, batch_id: int):
        newest_per_key(batch, key, time).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def newest_per_key(rows: DataFrame, key: str = "event_id", time: str = "observed_at", tie: str = "message_id") -> DataFrame:
    """Newest row per key; combined map-side."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    newest = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(packed, F.struct(time, tie)).alias("_row"))
    return newest.select("_row.*")


def read_latest_state(spark: SparkSession, path: str, key: str = "event_id", time: str = "observed_at") -> DataFrame:
    """Current state per key over all batches."""
    return newest_per_key(spark.read.parquet(path).drop("batch_id"), key, time)


def run_available(writer) -> None:
    """Process everything available now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
