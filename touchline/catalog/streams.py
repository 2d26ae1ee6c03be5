"""Live-stream queries: the events table read as a stream, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import query, r
from touchline.functions.payloads import payload_hash
from touchline.session import configure, fresh_path
from touchline.streaming import keyed, live

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf):
    configure(spark)
    return spark.readStream.schema(EVENT_SCHEMA).parquet(f"{sf}/events.parquet*")


def messages(stream):
    """Envelope texts of the events; five kinds of broken ones mixed in."""
    payload = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.col("event_type").alias("description")).alias("status"),
                F.struct((F.col("event_id") % 4).alias("current")).alias("homeScore"),
                F.struct((F.col("event_id") % 3).alias("current")).alias("awayScore"),
            ).alias("event")
        )
    )
    seen = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ident = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string"))
    kind = F.col("event_id") % 10
    text = F.concat(
        F.lit('{"schema_version":"'), F.when(kind == 2, "2.0").otherwise("1.0"), F.lit('","message_id":"'), ident,
        F.lit('","event_id":'),
        F.when(kind == 3, F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.col("user_id").cast("string")),
        F.when(kind == 0, "").otherwise(F.concat(F.lit(',"observed_at":"'), seen, F.lit('"'))),
        F.lit(',"payload":'), payload, F.when(kind == 1, ',"extra":1').otherwise(""), F.when(kind == 4, "").otherwise("}"),
    )
    return stream.select("event_id", "ts", text.alias("value"))


def ran(spark, stream, name):
    """Run a stream to its end into a table of the shared folder and read it."""
    out = fresh_path(spark, name)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
    live.run_available(writer.outputMode("append"))
    return spark.read.schema(stream.schema).parquet(out)


KIND = """case event_id % 10 when 0 then 'missing: observed_at' when 1 then 'unexpected: extra'
  when 2 then 'schema_version is not supported' when 3 then 'event_id is not an integer' when 4 then 'not a JSON object' end"""


@query("validate_split", f"select event_id, {KIND} as error from events")
def validate_split(spark, sf):
    checked = live.with_contract(messages(event_stream(spark, sf)))
    return ran(spark, checked.select("event_id", "error"), "validated")


@query(
    "dead_letters",
    f"select {KIND} as error, count(*) as messages from events where {KIND} is not null group by 1",
)
def dead_letters(spark, sf):
    checked = live.with_contract(messages(event_stream(spark, sf)))
    rejected = ran(spark, live.dead_letters(checked), "dead")
    return rejected.groupBy("error").agg(F.count("raw").alias("messages"))


VALID = "event_id % 10 >= 5"


def updates(spark, sf, copies: int = 1):
    """Decoded valid messages, each ``copies`` times, the last copy a second later."""
    stream = messages(event_stream(spark, sf))
    decoded = live.decode(live.valid_messages(live.with_contract(stream)))
    if copies == 1:
        return decoded
    repeated = decoded.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    later = F.when(F.col("copy") == copies, F.expr("interval 1 second")).otherwise(F.expr("interval 0 second"))
    return repeated.withColumn("observed_at", F.col("observed_at") + later).drop("copy")


@query(
    "stream_dedupe",
    f"""select cast(user_id as varchar) || ':' || cast(event_id as varchar) as message_id, user_id as event_id,
      ts + to_seconds(s) as observed_at from events, (values (0), (1)) t(s) where {VALID}""",
)
def stream_dedupe(spark, sf):
    kept = live.dedupe_observations(updates(spark, sf, 3))
    out = ran(spark, kept.select("message_id", "event_id", "observed_at"), "observations")
    return out.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


@query(
    "stream_dedupe_messages",
    f"""select cast(user_id as varchar) || ':' || cast(event_id as varchar) as message_id from events where {VALID}""",
)
def stream_dedupe_messages(spark, sf):
    return ran(spark, live.dedupe_messages(updates(spark, sf, 3)).select("message_id"), "messages")


LIVE = """lv as (select event_id, user_id, event_type, ts, event_id % 4 as hs, event_id % 3 as aws, 0 as minute from events
    where event_id % 10 >= 5),
  v as (select *, greatest(0, 90 - minute) as rest, hs - aws as gap from lv),
  p as (select *, 1 / (1 + exp(-(gap * 1.35 + rest / 180))) as h, exp(-abs(gap) * 1.4) * (rest / 90) * 0.32 as d from v),
  q as (select *, greatest(0, 1 - h - d) as a from p)"""


@query(
    "live_scoring",
    f"""with {LIVE} select cast(user_id as varchar) || ':' || cast(event_id as varchar) as message_id, user_id as event_id,
      event_type as status, cast(hs as int) as home_score, cast(aws as int) as away_score,
      round(h / (h + d + a), 6) as home_win, round(d / (h + d + a), 6) as draw, round(a / (h + d + a), 6) as away_win from q""",
)
def live_scoring(spark, sf):
    scored = ran(spark, live.score_live(live.live_features(updates(spark, sf))), "scored")
    return scored.select(
        "message_id", "event_id", "status", "home_score", "away_score",
        *[r(c).alias(c) for c in ("home_win", "draw", "away_win")],
    )


@query(
    "latest_state",
    """select user_id as event_id, cast(user_id as varchar) || ':' || cast(event_id as varchar) as message_id, event_type as status
    from (select *, row_number() over (partition by user_id order by ts desc, cast(user_id as varchar) || ':' || cast(event_id as varchar) desc)
      as place from events where event_id % 10 >= 5) where place = 1""",
)
def latest_state(spark, sf):
    """Read back from the state store, which holds one row for each event."""
    changes = keyed.latest_by_key(live.live_features(updates(keyed.use_rocksdb(spark), sf)), finished=())
    checkpoint = keyed.run_to_state(changes, fresh_path(spark, "latest-state"))
    return keyed.read_state(spark, checkpoint).select("event_id", "message_id", "status")


@query(
    "stream_dedupe_ids",
    f"""select cast(user_id as varchar) || ':' || cast(event_id as varchar) as message_id, 3 as times from events where {VALID}""",
)
def stream_dedupe_ids(spark, sf):
    """Ids kept in a state store without a bound by the watermark, with how often each was seen."""
    # The whole messages stay in the JVM: an id is a pandas frame of its own, which costs time by the column.
    first = keyed.first_by_id(updates(keyed.use_rocksdb(spark), sf, 3).select("message_id"))
    checkpoint = fresh_path(spark, "seen-ids") + "-state"
    out = fresh_path(spark, "ids")
    keyed.run_available(spark, first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    seen = spark.read.format("statestore").load(checkpoint).select("key.message_id", F.col("value.groupState.times").cast("int").alias("times"))
    return spark.read.schema("message_id string").parquet(out).join(seen, "message_id")


@query(
    "stream_latency",
    """select count(*) as updates, round(avg(event_id % 61), 6) as mean_latency,
      quantile_disc(cast(event_id % 61 as double), 0.5) as p50, quantile_disc(cast(event_id % 61 as double), 0.95) as p95,
      quantile_disc(cast(event_id % 61 as double), 0.99) as p99 from events where event_id % 10 >= 5""",
)
def stream_latency(spark, sf):
    features = live.live_features(updates(spark, sf))
    # The clock is derived from the message so that the result is repeatable.
    number = F.split_part("message_id", F.lit(":"), F.lit(2)).cast("bigint")
    clock = F.timestamp_micros(F.unix_micros("observed_at") + (number % 61) * 1_000_000)
    scored = ran(spark, live.score_live(features, now=clock), "latency")
    return live.latency_report(scored).select("updates", r("mean_latency").alias("mean_latency"), "p50", "p95", "p99")


@query(
    "replay_log",
    """select sha256('{"k":' || json_extract_string(props, '$.k') || '}') as hash, count(*) as messages from events group by 1""",
)
def replay_log(spark, sf):
    """Messages written to a JSON-lines log and replayed from it."""
    log = fresh_path(spark, "replay")
    live.run_available(live.replay_sink(event_stream(spark, sf), log, log + "-state", value="props"))
    replayed = ran(spark, live.replay_source(spark, log), "replayed")
    return replayed.groupBy(payload_hash("value").alias("hash")).agg(F.count(F.lit(1)).alias("messages"))
