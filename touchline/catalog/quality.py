"""Quality rules, deduplication, upserts, audit and warehouse-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import FX, MT, TM, fixtures, matches, query, r, table, team_rows
from touchline.operators import quality as q
from touchline.operators.sets import keep_first, keep_last, union_all, upsert
from touchline.plans.marts import grain_rules, match_context
from touchline.sources.audit import latest_loads
from touchline.sources.io import run_status


def broken_fixtures(spark, sf):
    e = F.col("event_id")
    return fixtures(spark, sf).select(
        F.when(e % 50 != 0, e - F.when(e % 40 == 1, 1).otherwise(0)).alias("event_id"), (e % 48).alias("registry_team_id"),
        F.col("kickoff_utc").alias("match_date"), "status_type",
        F.when(e % 30 == 0, -1).otherwise(F.col("home_score")).alias("home_score"), "away_score",
    )


BROKEN = """bk as (select case when event_id % 50 <> 0 then event_id - case when event_id % 40 = 1 then 1 else 0 end end as event_id,
  event_id % 48 as registry_team_id, kickoff_utc as match_date, status_type,
  case when event_id % 30 = 0 then -1 else home_score end as home_score, away_score from fx)"""


def surplus(keys: str) -> str:
    return f"(select coalesce(cast(sum(c - 1) as bigint), 0) from (select count(*) as c from bk group by {keys} having count(*) > 1))"


@query(
    "quality_report",
    f"""with {FX}, {BROKEN}
    select 'event_id contains nulls' as rule, count(*) filter (event_id is null) as violations from bk
    union all select 'event_id is not unique', {surplus('event_id')}
    union all select 'home_score contains negative values', count(*) filter (home_score < 0) from bk
    union all select 'away_score contains negative values', count(*) filter (away_score < 0) from bk""",
)
def quality_report(spark, sf):
    return q.violations(broken_fixtures(spark, sf), q.match_rules())


@query(
    "team_event_quality",
    f"""with {FX}, {BROKEN}
    select 'event_id contains nulls' as rule, count(*) filter (event_id is null) as violations from bk
    union all select 'registry_team_id + event_id is not unique', {surplus('registry_team_id, event_id')}
    union all select 'non-scheduled event has a future match date',
      count(*) filter (match_date > timestamp '2000-01-01' and status_type <> 'notstarted') from bk""",
)
def team_event_quality(spark, sf):
    today = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return q.violations(broken_fixtures(spark, sf), q.team_event_rules(today))


@query(
    "team_stats_quality",
    f"""with {TM}, s as (select event_id, case when event_id % 60 = 0 then 'both' else side end as side,
        case when event_id % 45 = 0 then 1.5 else (event_id % 10) / 10.0 end as p from tm)
    select 'event_id + side is not unique' as rule, (select coalesce(cast(sum(c - 1) as bigint), 0) from
        (select count(*) as c from s group by event_id, side having count(*) > 1)) as violations
    union all select 'side contains other values than home/away', count(*) filter (side not in ('home', 'away')) from s
    union all select 'ALL_Passes_pct is outside [0, 1]', count(*) filter (not (p between 0 and 1)) from s""",
)
def team_stats_quality(spark, sf):
    e = F.col("event_id")
    rows = team_rows(spark, sf).select(
        "event_id", F.when(e % 60 == 0, "both").otherwise(F.col("side")).alias("side"),
        F.when(e % 45 == 0, 1.5).otherwise((e % 10) / 10).alias("ALL_Passes_pct"),
    )
    return q.violations(rows, q.team_stat_rules(rows.columns))


@query(
    "mart_grain",
    f"""with {TM}, bad as (select case when event_id % 50 <> 0 then event_id - case when event_id % 40 = 1 then 1 else 0 end end as event_id,
      case when event_id % 60 = 7 then 'both' when event_id % 70 <> 9 then side end as side from tm)
    select 'event_id contains nulls' as rule, count(*) filter (event_id is null) as violations from bad
    union all select 'side contains other values than home/away', count(*) filter (coalesce(side not in ('home', 'away'), true)) from bad
    union all select 'event_id + side is not unique', coalesce(cast(sum(c - 1) as bigint), 0)
      from (select count(*) as c from bad group by event_id, side having count(*) > 1)""",
)
def mart_grain(spark, sf):
    """Rows with planted errors: nulls, another side and repeated keys."""
    e = F.col("event_id")
    side = F.when(e % 60 == 7, "both").when(e % 70 != 9, F.col("side"))
    key = F.when(e % 50 != 0, e - F.when(e % 40 == 1, 1).otherwise(0))
    return q.violations(team_rows(spark, sf).withColumns({"side": side, "event_id": key}), grain_rules("fct_team_matches"))


@query(
    "unexpected_values",
    """select distinct event_type from events where event_type not in ('click', 'view', 'purchase')""",
)
def unexpected_values(spark, sf):
    return q.unexpected_values(table(spark, sf, "events"), "event_type", ["click", "view", "purchase"])


@query(
    "grain_parity",
    """with l as (select distinct l_orderkey from lineitem)
    select (select count(*) from orders) as left_rows, (select count(*) from lineitem) as right_rows,
      (select count(distinct o_orderkey) from orders) as left_keys, (select count(*) from l) as right_keys,
      (select count(*) from orders full join l on o_orderkey = l_orderkey where o_orderkey is null or l_orderkey is null)
        as unmatched_keys""",
)
def grain_parity(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"))
    right = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"))
    return q.grain_parity(left, right, ["event_id"])


@query(
    "stage_mass",
    """with s as (select o_custkey % 48 as team, count(*) filter (o_orderstatus = 'F') / (select count(*) from orders) as f,
        count(*) filter (o_orderstatus <> 'F') / (select count(*) from orders) as nf from orders group by 1)
    select 'final' as stage, round(sum(f), 6) as total, 1.0::double as expected, abs(sum(f) - 1) <= 1e-9 as reconciles from s
    union all select 'all', round(sum(f + nf), 6), 1.0, abs(sum(f + nf) - 1) <= 1e-9 from s""",
)
def stage_mass(spark, sf):
    orders = table(spark, sf, "orders")
    n = orders.count()
    done = F.count_if(F.col("o_orderstatus") == "F")
    shares = orders.groupBy((F.col("o_custkey") % 48).alias("team")).agg(
        (done / n).alias("final"), (F.count(F.lit(1)) / n).alias("all")
    )
    return q.stage_mass(shares, {"final": 1.0, "all": 1.0}).withColumn("total", r("total"))


LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def dedupe_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in LINE_ORDER)
    return f"""select * exclude (place) from (select *, row_number() over (partition by l_orderkey, l_linenumber
      order by {order}) as place from lineitem) where place = 1"""


@query("dedupe_keep_first", dedupe_sql("asc"))
def dedupe_keep_first(spark, sf):
    return keep_first(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@query("dedupe_keep_last", dedupe_sql("desc"))
def dedupe_keep_last(spark, sf):
    return keep_last(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@query(
    "incremental_upsert",
    """with ex as (select o_orderkey, o_orderstatus, o_totalprice, 0 as batch from orders where o_orderdate < timestamp '1999-01-01'),
      fe as (select o_orderkey, 'U' as o_orderstatus, o_totalprice + 1 as o_totalprice, 1 as batch from orders
        where o_orderdate >= timestamp '1998-06-01')
    select o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice from (
      select *, row_number() over (partition by o_orderkey order by batch desc) as place
      from (select * from ex union all select * from fe)) where place = 1""",
)
def incremental_upsert(spark, sf):
    o = table(spark, sf, "orders")
    existing = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    fetched = o.where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).withColumns(
        {"o_orderstatus": F.lit("U"), "o_totalprice": F.col("o_totalprice") + 1}
    )
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    out = upsert(existing.select(*columns), fetched.select(*columns), ["o_orderkey"], ["o_totalprice"])
    return out.withColumn("o_totalprice", r("o_totalprice", 2))


@query(
    "union_missing_cols",
    """select c_custkey as id, c_name as name, c_mktsegment as segment, null::double as balance from customer
    union all select s_suppkey, s_name, null, s_acctbal from supplier""",
)
def union_missing_cols(spark, sf):
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    b = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return union_all(a, b)


@query(
    "audit_log",
    """with loads as (select o_orderkey, 'ds' || cast(o_custkey as varchar) as dataset_name, o_orderdate, o_orderstatus,
        max(o_orderdate) over (partition by o_custkey) as newest, cast(floor(o_totalprice) as bigint) as row_count from orders)
    select cast(o_orderkey as varchar) as load_id, dataset_name, o_orderdate as started_at,
      case when o_orderstatus <> 'P' then o_orderdate + interval 1 hour when o_orderdate < newest then newest end as finished_at,
      case when o_orderstatus = 'F' then row_count end as row_count,
      case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else
        case when o_orderdate < newest then 'interrupted' else 'running' end end as status,
      case when o_orderstatus = 'O' then 'boom' when o_orderstatus = 'P' and o_orderdate < newest then 'superseded by retry' end
        as error_message from loads""",
)
def audit_log(spark, sf):
    """Load events derived from orders: each load starts, most also finish."""
    o = table(spark, sf, "orders")
    ids = [F.col("o_orderkey").cast("string").alias("load_id"), F.concat(F.lit("ds"), F.col("o_custkey").cast("string")).alias("dataset_name")]
    none = F.lit(None)
    started = o.select(
        *ids, F.col("o_orderdate").alias("started_at"), none.cast("timestamp_ntz").alias("finished_at"),
        none.cast("bigint").alias("row_count"), F.lit("running").alias("status"), none.cast("string").alias("error_message"),
    )
    good = F.col("o_orderstatus") == "F"
    ended = o.where(F.col("o_orderstatus") != "P").select(
        *ids, none.cast("timestamp_ntz").alias("started_at"),
        (F.col("o_orderdate") + F.expr("interval 1 hour")).alias("finished_at"),
        F.when(good, F.floor("o_totalprice")).alias("row_count"), F.when(good, "success").otherwise("failed").alias("status"),
        F.when(~good, "boom").alias("error_message"),
    )
    return latest_loads(started.unionByName(ended))


@query(
    "run_status",
    """select o_custkey, count(*) filter (o_orderstatus = 'O') as errors, count(*) filter (o_orderstatus = 'F') as succeeded,
      case when count(*) filter (o_orderstatus = 'O') > 0 and count(*) filter (o_orderstatus = 'F') = 0 then 'failed'
        when count(*) filter (o_orderstatus = 'O') > 0 then 'partial_success' else 'success' end as status
    from orders group by 1""",
)
def run_status_query(spark, sf):
    runs = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("errors"), F.count_if(F.col("o_orderstatus") == "F").alias("succeeded")
    )
    return runs.withColumn("status", run_status(F.col("errors"), F.col("succeeded")))


@query(
    "failure_extract",
    """select o_orderkey as event_id, 'event detail unavailable' as error_message from orders
    where o_orderkey not in (select l_orderkey from lineitem)""",
)
def failure_extract(spark, sf):
    fetched = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id")).distinct()
    events = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"))
    joined = events.join(fetched.withColumn("details_fetched", F.lit(True)), "event_id", "left")
    return joined.where(~F.coalesce("details_fetched", F.lit(False))).select(
        "event_id", F.lit("event detail unavailable").alias("error_message")
    )


@query(
    "match_context",
    f"""with {MT} select event_id, kickoff_utc, home_team_id, away_team_id, neutral_site, competition_type, round_name,
      home_team_id * 2 - away_team_id as ranking_difference from mt""",
)
def match_context_query(spark, sf):
    ranked = matches(spark, sf).select(
        "*", (F.col("home_team_id") * 2).alias("home_displayed_ranking"), F.col("away_team_id").alias("away_displayed_ranking")
    )
    return match_context(ranked)
