"""JSON, hash, link and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import query, table
from touchline.functions.payloads import (
    envelope,
    json_path,
    link_event_id,
    link_problem,
    match_link,
    message_id,
    payload_hash,
    row_json,
)
from touchline.functions.scalars import epoch_to_timestamp, is_stale, parse_day, to_number
from touchline.operators.flatten import choose_search_hit, flatten_details, flatten_events, prematch_context, states_to_rows

HOSTS = ["scores.example.com", "www.scores.example.com"]


@query(
    "json_path",
    """select event_id, cast(json_extract_string(props, '$.k') as int) as k,
      coalesce(json_extract_string(props, '$.missing.deep'), 'none') as deep from events""",
)
def json_path_query(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", json_path("props", "k", "int").alias("k"), json_path("props", "missing.deep", default="none").alias("deep")
    )


@query(
    "payload_hash",
    """select event_id, sha256('{"a":' || cast(event_id % 3 as varchar) || ',"k":' || json_extract_string(props, '$.k') || '}')
        as payload_hash,
      cast(event_id as varchar) || ':' || sha256('{"k":' || json_extract_string(props, '$.k') || '}') as message_id
    from events""",
)
def payload_hash_query(spark, sf):
    # The two keys arrive in the "wrong" order and with spaces.
    unsorted = F.concat(
        F.lit('{ "k": '), json_path("props", "k"), F.lit(', "a": '), (F.col("event_id") % 3).cast("string"), F.lit("}")
    )
    return table(spark, sf, "events").select(
        "event_id", payload_hash(unsorted).alias("payload_hash"), message_id("event_id", "props").alias("message_id")
    )


@query(
    "message_envelope",
    """select event_id, '1.0' as schema_version, cast(event_id as varchar) || ':' ||
        sha256('{"k":' || json_extract_string(props, '$.k') || '}') as message_id, props as payload,
      '{"event_id":' || cast(event_id as varchar) || ',"event_type":"' || event_type || '"}' as row_json from events""",
)
def message_envelope(spark, sf):
    out = table(spark, sf, "events").select(
        envelope("event_id", "props", "ts").alias("m"), row_json("event_id", "event_type").alias("row_json")
    )
    return out.select("m.event_id", "m.schema_version", "m.message_id", "m.payload", "row_json")


LINKS = """links as (select event_id, case event_id % 8
    when 0 then 'https://www.scores.example.com/a-b/xy#id:' || cast(event_id as varchar)
    when 1 then 'http://scores.example.com/match?eventId=' || cast(event_id as varchar) || '&x=1'
    when 2 then 'https://scores.example.com/event/' || cast(event_id as varchar) || '/lineups'
    when 3 then 'https://scores.example.com/a-b/xy#tab=1&id=' || cast(event_id as varchar)
    when 4 then 'https://other.example.net/event/' || cast(event_id as varchar)
    when 5 then 'ftp://scores.example.com/event/' || cast(event_id as varchar)
    when 6 then 'https://SCORES.example.com/EVENT/' || cast(event_id as varchar) || '?id=abc'
    else 'https://scores.example.com/a-b/xy' end as url from events)"""


def links(spark, sf):
    e = F.col("event_id").cast("string")
    at = F.col("event_id") % 8
    url = (
        F.when(at == 0, F.concat(F.lit("https://www.scores.example.com/a-b/xy#id:"), e))
        .when(at == 1, F.concat(F.lit("http://scores.example.com/match?eventId="), e, F.lit("&x=1")))
        .when(at == 2, F.concat(F.lit("https://scores.example.com/event/"), e, F.lit("/lineups")))
        .when(at == 3, F.concat(F.lit("https://scores.example.com/a-b/xy#tab=1&id="), e))
        .when(at == 4, F.concat(F.lit("https://other.example.net/event/"), e))
        .when(at == 5, F.concat(F.lit("ftp://scores.example.com/event/"), e))
        .when(at == 6, F.concat(F.lit("https://SCORES.example.com/EVENT/"), e, F.lit("?id=abc")))
        .otherwise("https://scores.example.com/a-b/xy")
    )
    return table(spark, sf, "events").select("event_id", url.alias("url"))


@query(
    "link_event_id",
    f"""with {LINKS} select event_id, case when event_id % 8 in (0, 1, 2, 3, 6) then event_id end as found,
      case when event_id % 8 in (4, 5) then 'not a supported match link'
        when event_id % 8 = 7 then 'link has no event id' end as problem from links""",
)
def link_event_id_query(spark, sf):
    return links(spark, sf).select(
        "event_id", link_event_id("url", HOSTS).alias("found"), link_problem("url", HOSTS).alias("problem")
    )


@query(
    "page_links",
    """select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host,
      case when regexp_matches(url, '[?&]id=(\\d+)(&|#|$)') then try_cast(regexp_extract(url, '[?&]id=(\\d+)(&|#|$)', 1) as bigint)
      end as found, 'https://scores.example.com/' || 'page/' || cast(page_id as varchar) || '#id:' || cast(page_id as varchar) as link
    from pages""",
)
def page_links(spark, sf):
    pages = table(spark, sf, "pages")
    host = F.try_parse_url("url", F.lit("HOST"))
    own = pages.select("page_id", "url", host.alias("host"))
    # Every page's own host is allowed, so only the id decides.
    on_one_host = F.regexp_replace("url", r"^(https?://)[^/]+", "$1scores.example.com")
    return own.select(
        "page_id", "host", link_event_id(on_one_host, HOSTS).alias("found"),
        match_link(F.lit("page"), F.col("page_id").cast("string"), "page_id", "https://scores.example.com").alias("link"),
    )


@query(
    "epoch_and_dates",
    """select event_id, make_timestamp((epoch_us(ts) // 1000000) * 1000000) as seconds_ts,
      make_timestamp((epoch_us(ts) // 1000) * 1000) as millis_ts,
      case when event_id % 5 = 0 then null else cast(ts as date) end as day, epoch_us(ts) < epoch_us(timestamp '2024-01-20') - 60000000 as stale
    from events""",
)
def epoch_and_dates(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 5 == 0, "31-31-2024").otherwise(F.date_format("ts", "dd-MM-yyyy"))
    return table(spark, sf, "events").select(
        "event_id", epoch_to_timestamp(F.floor(micros / 1_000_000)).cast("timestamp_ntz").alias("seconds_ts"),
        epoch_to_timestamp(F.floor(micros / 1_000)).cast("timestamp_ntz").alias("millis_ts"),
        parse_day(text).alias("day"), is_stale("ts", F.lit("2024-01-20 00:00:00")).alias("stale"),
    )


def event_payload(e, start, home, away):
    """Nested event JSON derived from a row's columns."""
    return F.struct(
        e.alias("id"), start.alias("startTimestamp"),
        F.struct(home.alias("id"), F.concat(F.lit("Team "), home.cast("string")).alias("name"), (home + 1).cast("string").alias("ranking")).alias("homeTeam"),
        F.struct(away.alias("id"), F.concat(F.lit("Team "), away.cast("string")).alias("name")).alias("awayTeam"),
        F.when(e % 2 == 0, F.struct((e % 5).cast("int").alias("current"), (e % 4).cast("int").alias("normaltime"))).alias("homeScore"),
        F.struct((e % 3).cast("int").alias("current")).alias("awayScore"),
        F.struct(F.when(e % 2 == 0, "finished").otherwise("notstarted").alias("type")).alias("status"),
        F.struct(F.lit("Int. Friendly Games").alias("name"), F.when(e % 3 == 0, F.struct(F.lit("World Cup").alias("name"))).alias("uniqueTournament")).alias("tournament"),
        F.when(e % 4 == 0, F.struct((e % 9).cast("int").alias("round"), F.when(e % 8 == 0, "Final").alias("name"))).alias("roundInfo"),
        F.when(e % 5 != 0, F.struct(F.struct(F.concat(F.lit("Team "), home.cast("string")).alias("name")).alias("country"))).alias("venue"),
        F.when(e % 7 == 0, e % 2 == 0).alias("neutralGround"),
    )


def payload_rows(spark, sf):
    o = table(spark, sf, "orders")
    e = F.col("o_orderkey")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    start = F.when(e % 2 == 0, start * 1000).otherwise(start)
    return o.select(e.alias("event_id"), event_payload(e, start, F.col("o_custkey") % 48, F.col("o_custkey") % 47).alias("event"))


EVENTS_SQL = """ev as (select o_orderkey as e, o_orderdate as dt, o_custkey % 48 as h, o_custkey % 47 as a from orders)"""


@query(
    "event_flatten",
    f"""with {EVENTS_SQL} select e % 48 as registry_team_id, e as event_id,
      case when epoch_us(dt) // 1000000 > 10000000000 then null else dt end as match_date,
      h as home_source_id, 'Team ' || cast(h as varchar) as home_team_name,
      cast(case when e % 2 = 0 then e % 5 end as int) as home_score, cast(case when e % 2 = 0 then e % 4 end as int) as home_score_90,
      cast(e % 3 as int) as away_score, case when e % 2 = 0 then 'finished' else 'notstarted' end as status_type,
      case when e % 3 = 0 then 'World Cup' end as unique_tournament_name,
      cast(case when e % 4 = 0 then e % 9 end as int) as round_number from ev""",
)
def event_flatten(spark, sf):
    # One page per event: pages of one team must not be gathered in one row.
    pages = payload_rows(spark, sf).select(
        (F.col("event_id") % 48).alias("registry_team_id"), F.to_json(F.struct(F.array("event").alias("events"))).alias("payload")
    )
    return flatten_events(pages).select(
        "registry_team_id", "event_id", "match_date", "home_source_id", "home_team_name", "home_score", "home_score_90",
        "away_score", "status_type", "unique_tournament_name", "round_number",
    )


@query(
    "prematch_context",
    f"""with {EVENTS_SQL} select e as event_id, dt as kickoff_utc, h as home_source_id, a as away_source_id,
      case when e % 3 = 0 then 'world_cup' else 'friendly' end as competition_type,
      case when e % 8 = 0 then 'Final' when e % 4 = 0 then 'Round ' || cast(e % 9 as varchar) else 'fixture' end as round_name,
      case when e % 5 <> 0 then 'Team ' || cast(h as varchar) end as venue_country,
      case when e % 7 = 0 then cast(e % 2 = 0 as int) when e % 5 <> 0 then cast(h <> h + e % 2 and h <> a as int) end as neutral_site,
      cast(h + 1 as double) as home_displayed_ranking from ev""",
)
def prematch_context_query(spark, sf):
    rows = payload_rows(spark, sf).select(
        "event_id",
        # Wrapped and bare payloads both occur.
        F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct("event"))).otherwise(F.to_json("event")).alias("payload"),
        F.concat(F.lit("team "), (F.col("event.homeTeam.id") + F.col("event_id") % 2).cast("string")).alias("home_country"),
        F.concat(F.lit("TEAM "), F.col("event.awayTeam.id").cast("string")).alias("away_country"),
    )
    out = prematch_context(rows)
    return out.select(
        "event_id", F.col("kickoff_utc").cast("timestamp_ntz").alias("kickoff_utc"), "home_source_id", "away_source_id",
        "competition_type", "round_name", "venue_country", "neutral_site", "home_displayed_ranking",
    )


@query(
    "detail_flatten",
    f"""with {EVENTS_SQL} select e as event_id, case when e % 5 <> 0 then 'Team ' || cast(h as varchar) end as venue_country,
      cast(h + 1 as double) as home_displayed_ranking, cast(null as double) as away_displayed_ranking from ev""",
)
def detail_flatten(spark, sf):
    rows = payload_rows(spark, sf).select("event_id", F.to_json(F.struct("event")).alias("payload"))
    return flatten_details(rows).select("event_id", "venue_country", "home_displayed_ranking", "away_displayed_ranking")


@query(
    "state_to_rows",
    """select event_id, event_type as status, case when event_type = 'error' then props end as error from events""",
)
def state_to_rows(spark, sf):
    state = F.struct(F.col("event_type").alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    documents = table(spark, sf, "events").select(
        F.to_json(F.create_map(F.col("event_id").cast("string"), state)).alias("document")
    )
    return states_to_rows(documents).select("event_id", "status", "error")


@query(
    "name_match",
    """select c_custkey, lower(c_name) as search_name, case when c_custkey % 3 = 2 then null when c_custkey % 3 = 0
      then c_custkey + 2 else c_custkey + 1 end as source_team_id from customer""",
)
def name_match(spark, sf):
    key = F.col("c_custkey")

    def hit(add, name, gender="M", slug="football"):
        return F.struct(
            F.lit("team").alias("type"),
            F.struct(
                (key + add).alias("id"), name.alias("name"), F.lit(True).alias("national"), F.lit(gender).alias("gender"),
                F.struct(F.lit(slug).alias("slug")).alias("sport"),
            ).alias("entity"),
        )

    other = F.concat(F.col("c_name"), F.lit(" B"))
    women, first, exact = hit(0, F.col("c_name"), "F"), hit(1, other), hit(2, F.upper("c_name"))
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.lower("c_name").alias("search_name"),
        F.to_json(
            F.struct(
                F.when(key % 3 == 0, F.array(women, first, exact)).when(key % 3 == 1, F.array(women, first))
                .otherwise(F.array(women, hit(3, other, slug="rugby"))).alias("results")
            )
        ).alias("payload"),
    )
    chosen = choose_search_hit(rows).select("search_name", "source_team_id")
    return rows.select("c_custkey", "search_name").join(chosen, "search_name", "left").select(
        "c_custkey", "search_name", "source_team_id"
    )


@query(
    "coerce_numbers",
    """select event_id, try_cast(case when event_id % 4 = 0 then event_type else json_extract_string(props, '$.k') end as double) as n
    from events""",
)
def coerce_numbers(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(json_path("props", "k"))
    return table(spark, sf, "events").select("event_id", to_number(raw).alias("n"))
