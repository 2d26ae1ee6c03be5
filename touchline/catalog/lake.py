"""Sources and sinks over the given tables: written to the shared folder, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.catalog.base import query, table
from touchline.operators.aggregates import high_water, merge_high_water
from touchline.session import fresh_path
from touchline.sources import audit, io
from touchline.sources.bronze import store_payloads
from touchline.sources.tables import merge_run

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
NAMES = ORDERS.split(", ")
SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus",
        F.col("o_totalprice").cast("double"), "o_orderpriority",
    )


CAST = """select cast(o_orderkey as bigint) as o_orderkey, cast(o_custkey as bigint) as o_custkey, o_orderstatus,
  cast(o_totalprice as double) as o_totalprice, o_orderpriority from orders"""


@query("csv_round_trip", CAST)
def csv_round_trip(spark, sf):
    """A CSV report read back under its schema."""
    path = fresh_path(spark, "report")
    io.write_report(orders(spark, sf), path)
    return io.read_by_suffix(spark, path, SCHEMA)


@query("layer_round_trip", CAST + " where o_orderstatus = 'F'")
def layer_round_trip(spark, sf):
    """A partitioned lake layer; one partition is read back."""
    base = fresh_path(spark, "lake")
    io.write_layer(orders(spark, sf), base, "silver", "orders", ["o_orderstatus"])
    io.materialise_layers({("gold", "orders"): io.read_layer(spark, base, "silver", "orders")}, base)
    return io.read_layer(spark, base, "gold", "orders").where("o_orderstatus = 'F'").select(*NAMES)


@query("extract_round_trip", "select o_orderkey, o_orderstatus from orders")
def extract_round_trip(spark, sf):
    """The compact extract, read as an optional dataset."""
    path = fresh_path(spark, "extract")
    io.write_extract(orders(spark, sf).select("o_orderkey", "o_orderstatus"), path, ["o_orderkey", "o_orderstatus", "absent"])
    return io.read_optional(spark, path, "o_orderkey bigint")


@query(
    "mart_round_trip",
    """select a.o_orderstatus, count(*) as n, count(b.o_custkey) as customers from orders a
    join orders b on a.o_orderkey = b.o_orderkey group by 1""",
)
def mart_round_trip(spark, sf):
    """Two marts from one frame, joined again."""
    base = fresh_path(spark, "marts")
    io.write_marts(orders(spark, sf), base, {"status": ["o_orderkey", "o_orderstatus"], "customer": ["o_orderkey", "o_custkey"]})
    status, customer = (spark.read.parquet(f"{base}/{name}") for name in ("status", "customer"))
    return status.join(customer, "o_orderkey").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_custkey").alias("customers")
    )


@query(
    "audited_load",
    """select 'success' as status, count(*) as row_count, null::boolean as has_error from orders
    union all select 'failed', null, true""",
)
def audited_load(spark, sf):
    """A load that succeeds and one whose source is missing."""
    base = fresh_path(spark, "audit")
    orders(spark, sf).write.parquet(f"{base}/source")
    log = f"{base}/log"
    audit.load_table(spark, f"{base}/source", f"{base}/target", "orders", log)
    try:
        audit.load_table(spark, f"{base}/missing", f"{base}/target", "orders", log)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    loads = audit.audit_listing(audit.read_audit(spark, log))
    return loads.select("status", "row_count", F.when(F.length("error_message") > 0, True).alias("has_error"))


@query(
    "run_record",
    """select count(*) as events, count_if(event_id % 10 = 0)::bigint as errors, count_if(event_id % 10 <> 0)::bigint as succeeded,
    case when count_if(event_id % 10 = 0) > 0 then 'partial_success' else 'success' end as status from events""",
)
def run_record(spark, sf):
    """The counters and the status of a run."""
    failed = F.col("event_id") % 10 == 0
    return io.run_metrics(
        table(spark, sf, "events"), events=F.count(F.lit(1)), errors=F.count_if(failed), succeeded=F.count_if(~failed)
    )


@query(
    "latest_run",
    """select 'run-' || event_type as run_id, max(ts)::timestamp as finished_at, count(*) as events,
      count_if(event_id % 10 = 0)::bigint as errors, count_if(event_id % 10 <> 0)::bigint as succeeded,
      case when count_if(event_id % 10 = 0) > 0 and count_if(event_id % 10 <> 0) = 0 then 'failed'
        when count_if(event_id % 10 = 0) > 0 then 'partial_success' else 'success' end as status
    from events where event_type in ('click', 'view', 'purchase') group by event_type
    order by finished_at desc, run_id desc limit 1""",
)
def latest_run(spark, sf):
    """A run for each of three kinds of events in the log; the one that finished last."""
    path = fresh_path(spark, "runs")
    failed = F.col("event_id") % 10 == 0
    for kind in ("click", "view", "purchase"):
        part = table(spark, sf, "events").where(F.col("event_type") == kind)
        ended = part.agg(F.max("ts").cast("timestamp")).first()[0]
        if ended is not None:
            io.record_run(
                part, path, f"run-{kind}", F.lit(ended), F.lit(ended), events=F.count(F.lit(1)), errors=F.count_if(failed),
                succeeded=F.count_if(~failed),
            )
    return io.latest_run(spark, path).drop("started_at").withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))


@query(
    "high_water_merge",
    """with r as (select o_custkey % 48 as team_id, o_orderkey % 3 as run, max(o_orderdate) as d,
        bool_or(o_orderstatus = 'P' and o_custkey % 5 = 0) as c from orders group by 1, 2)
    select team_id, max_by(d, run) as latest_match_date, coalesce(bool_or(c), false) as history_complete, max(run) as updated_at
    from r group by 1""",
)
def high_water_merge(spark, sf):
    """Three runs merged into the state, the second one twice and the first one again at the end."""
    schema = f"touchline_{uuid.uuid4().hex}"
    spark.sql(f"create schema {schema} location '{fresh_path(spark, 'state')}'")
    events = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 48).alias("team_id"), F.col("o_orderdate").alias("match_date"), "o_orderkey",
        ((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 5 == 0)).alias("complete"),
    )
    for run in (0, 1, 1, 2, 0):
        part = events.where(F.col("o_orderkey") % 3 == run)
        state = merge_run(spark, schema, "high_water", high_water(part, F.col("complete"), F.col("o_orderkey") % 3), merge_high_water)
    return state


@query(
    "bronze_store",
    """select event_type as category, count(distinct json_extract_string(props, '$.k')) as payloads, 0::bigint as second_run
    from events group by 1""",
)
def bronze_store(spark, sf):
    """The payload store filled twice from the same events; the second run adds nothing."""
    path = fresh_path(spark, "bronze")
    arriving = table(spark, sf, "events").select(
        F.col("event_type").alias("category"), F.col("props").alias("payload"), F.col("ts").alias("fetched_at")
    )
    day = F.to_date("fetched_at")
    store_payloads(spark, arriving, path, day)
    again = store_payloads(spark, arriving, path, day)
    stored = spark.read.parquet(path)
    return stored.groupBy("category").agg(
        F.countDistinct("payload_hash").alias("payloads"), F.lit(again).cast("long").alias("second_run")
    )
