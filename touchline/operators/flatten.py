"""Nested payloads to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import (
    _col,
    classify_competition,
    epoch_to_timestamp,
    normalize_country,
    normalize_period,
    to_number,
)

NAMED = "struct<id:bigint,name:string>"
SCORE = "struct<current:int,normaltime:int,overtime:int,penalties:int>"
TOURNAMENT = f"struct<id:bigint,name:string,uniqueTournament:{NAMED}>"
TEAM = "struct<id:bigint,name:string,ranking:string>"
VENUE = (
    "struct<id:bigint,name:string,city:struct<name:string>,country:struct<name:string>,"
    "capacity:int,venueCoordinates:struct<latitude:double,longitude:double>>"
)
EVENT = (
    f"struct<id:bigint,startTimestamp:double,homeTeam:{TEAM},awayTeam:{TEAM},homeScore:{SCORE},"
    f"awayScore:{SCORE},status:struct<type:string,description:string>,tournament:{TOURNAMENT},"
    f"season:{NAMED},roundInfo:struct<round:int,name:string>,slug:string,customId:string,"
    f"venue:{VENUE},neutralGround:boolean>"
)
EVENT_LIST = f"struct<events:array<{EVENT}>>"
STATISTICS = (
    "struct<statistics:array<struct<period:string,groups:array<struct<groupName:string,"
    "statisticsItems:array<struct<name:string,key:string,home:string,away:string,homeValue:double,"
    "awayValue:double,homeTotal:double,awayTotal:double,valueType:string>>>>>>>"
)
STATES = "map<string,struct<status:string,fetched_at:string,error:string>>"
SEARCH = (
    "struct<results:array<struct<type:string,entity:struct<id:bigint,name:string,slug:string,"
    "national:boolean,gender:string,sport:struct<slug:string>>>>>"
)


def unwrap_event(payload) -> Column:
    """The event object of a payload, whether or not it is wrapped in ``event``."""
    text = _col(payload)
    wrapped = F.from_json(text, f"struct<event:{EVENT}>")["event"]
    return F.coalesce(wrapped, F.from_json(text, EVENT))


def _event_columns(e: str) -> list[Column]:
    start = epoch_to_timestamp(f"{e}.startTimestamp")
    columns = [
        F.col(f"{e}.id").alias("event_id"),
        start.cast("timestamp_ntz").alias("match_date"),
        start.alias("kickoff_timestamp"),
    ]
    for side in ("home", "away"):
        columns += [
            F.col(f"{e}.{side}Team.id").alias(f"{side}_source_id"),
            F.col(f"{e}.{side}Team.name").alias(f"{side}_team_name"),
            F.col(f"{e}.{side}Score.current").alias(f"{side}_score"),
            F.col(f"{e}.{side}Score.normaltime").alias(f"{side}_score_90"),
            F.col(f"{e}.{side}Score.overtime").alias(f"{side}_score_after_extra_time"),
            F.col(f"{e}.{side}Score.penalties").alias(f"{side}_penalties"),
        ]
    named = {
        "status_type": "status.type",
        "status_description": "status.description",
        "tournament_id": "tournament.id",
        "tournament_name": "tournament.name",
        "unique_tournament_id": "tournament.uniqueTournament.id",
        "unique_tournament_name": "tournament.uniqueTournament.name",
        "season_id": "season.id",
        "season_name": "season.name",
        "round_number": "roundInfo.round",
        "round_name": "roundInfo.name",
        "slug": "slug",
        "custom_id": "customId",
    }
    return columns + [F.col(f"{e}.{path}").alias(name) for name, path in named.items()]


def flatten_events(pages: DataFrame, payload: str = "payload", team: str = "registry_team_id") -> DataFrame:
    """Event-list pages to one row per event."""
    events = pages.select(team, F.explode(F.from_json(payload, EVENT_LIST)["events"]).alias("_e"))
    return events.select(team, *_event_columns("_e"))


def flatten_details(details: DataFrame, payload: str = "payload") -> DataFrame:
    """Event detail payloads to venue and ranking columns."""
    parsed = details.select("event_id", unwrap_event(payload).alias("_e"))
    return parsed.select(
        "event_id",
        F.col("_e.venue.id").alias("venue_id"),
        F.col("_e.venue.name").alias("venue_name"),
        F.col("_e.venue.city.name").alias("venue_city"),
        F.col("_e.venue.country.name").alias("venue_country"),
        F.col("_e.venue.capacity").alias("venue_capacity"),
        F.col("_e.venue.venueCoordinates.latitude").alias("venue_latitude"),
        F.col("_e.venue.venueCoordinates.longitude").alias("venue_longitude"),
        to_number("_e.homeTeam.ranking").alias("home_displayed_ranking"),
        to_number("_e.awayTeam.ranking").alias("away_displayed_ranking"),
    )


def flatten_statistics(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Period / group / item statistics to the long form, one row per item.

    ``payload_hash``, ``fetched_at`` are passed through when present; the item's
    place in the payload is kept as ``ordinal`` to define "first".
    """
    passed = [c for c in ("payload_hash", "fetched_at") if c in payloads.columns]
    periods = payloads.select(
        "event_id", *passed, F.posexplode(F.from_json(payload, STATISTICS)["statistics"]).alias("_pi", "_p")
    )
    groups = periods.select(
        "event_id", *passed, "_pi", F.col("_p.period").alias("_period"),
        F.posexplode("_p.groups").alias("_gi", "_g"),
    )
    items = groups.select(
        "event_id", *passed, "_pi", "_gi", "_period", F.col("_g.groupName").alias("group_name"),
        F.posexplode("_g.statisticsItems").alias("_ii", "_i"),
    )
    return items.select(
        "event_id",
        normalize_period("_period").alias("period"),
        "group_name",
        F.col("_i.name").alias("stat_name"),
        F.col("_i.key").alias("stat_key"),
        F.col("_i.home").alias("home_value_raw"),
        F.col("_i.away").alias("away_value_raw"),
        F.col("_i.homeValue").alias("home_numeric_value"),
        F.col("_i.awayValue").alias("away_numeric_value"),
        F.col("_i.homeTotal").alias("home_total"),
        F.col("_i.awayTotal").alias("away_total"),
        F.col("_i.valueType").alias("value_type"),
        *passed,
        F.struct("_pi", "_gi", "_ii").alias("ordinal"),
    )


def without_overview_repeat(long: DataFrame) -> DataFrame:
    """P5: drop the overview copy of total shots."""
    repeat = (F.col("group_name") == "Match overview") & (F.col("stat_name") == "Total shots")
    return long.where(~F.coalesce(repeat, F.lit(False)))


def prematch_context(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Fixture context of event payloads before kick-off.

    Takes ``event_id``, the payload and optional ``home_country`` /
    ``away_country``. Payloads without two teams get a ``reject_reason``.
    """
    names = payloads.columns
    home_country = F.col("home_country") if "home_country" in names else F.lit(None).cast("string")
    away_country = F.col("away_country") if "away_country" in names else F.lit(None).cast("string")
    kept = [c for c in names if c not in {payload, "home_country", "away_country"}]
    parsed = payloads.select(
        *kept, home_country.alias("_hc"), away_country.alias("_ac"), unwrap_event(payload).alias("_e")
    )
    blank = F.lit("")
    tournament = F.coalesce(
        F.nullif(F.col("_e.tournament.uniqueTournament.name"), blank), F.col("_e.tournament.name")
    )
    venue = F.nullif(F.col("_e.venue.country.name"), blank)
    comparable = venue.isNotNull() & F.nullif("_hc", blank).isNotNull() & F.nullif("_ac", blank).isNotNull()
    away_from_both = (normalize_country(venue) != normalize_country("_hc")) & (
        normalize_country(venue) != normalize_country("_ac")
    )
    side = {s: F.col(f"_e.{s}Team.id") for s in ("home", "away")}
    return parsed.select(
        *kept,
        epoch_to_timestamp("_e.startTimestamp").alias("kickoff_utc"),
        side["home"].alias("home_source_id"),
        side["away"].alias("away_source_id"),
        *[
            F.coalesce(F.nullif(F.col(f"_e.{s}Team.name"), blank), side[s].cast("string")).alias(f"{s}_team_name")
            for s in side
        ],
        tournament.alias("tournament_name"),
        classify_competition(tournament).alias("competition_type"),
        F.coalesce(
            F.nullif(F.col("_e.roundInfo.name"), blank),
            F.concat(F.lit("Round "), F.col("_e.roundInfo.round").cast("string")),
            F.lit("fixture"),
        ).alias("round_name"),
        F.col("_e.venue.name").alias("venue_name"),
        F.col("_e.venue.city.name").alias("venue_city"),
        F.col("_e.venue.country.name").alias("venue_country"),
        F.coalesce(
            F.col("_e.neutralGround").cast("int"), F.when(comparable, away_from_both.cast("int"))
        ).alias("neutral_site"),
        to_number("_e.homeTeam.ranking").alias("home_displayed_ranking"),
        to_number("_e.awayTeam.ranking").alias("away_displayed_ranking"),
        F.when(side["home"].isNull() | side["away"].isNull(), "event does not contain two teams").alias(
            "reject_reason"
        ),
    )


def states_to_rows(documents: DataFrame, document: str = "document") -> DataFrame:
    """Keyed state documents ``id -> {status, fetched_at, error}`` to rows."""
    kept = [c for c in documents.columns if c != document]
    return documents.select(*kept, F.explode(F.from_json(document, STATES)).alias("_id", "_s")).select(
        *kept, F.col("_id").try_cast("bigint").alias("event_id"), "_s.status", "_s.fetched_at", "_s.error"
    )


def matching_name(name) -> Column:
    """Name form in which search hits are compared."""
    return F.replace(F.lower(_col(name)), F.lit("&"), F.lit("and"))


def choose_search_hit(searches: DataFrame, wanted: str = "search_name", payload: str = "payload") -> DataFrame:
    """Best team hit per search: exact name first, then the search order.

    Only men's national football teams count. Searches without one keep a row
    with nulls.
    """
    hits = searches.select(
        wanted, F.posexplode(F.from_json(payload, SEARCH)["results"]).alias("_at", "_hit")
    ).where(
        (F.col("_hit.type") == "team")
        & (F.col("_hit.entity.sport.slug") == "football")
        & F.col("_hit.entity.national")
        & (F.col("_hit.entity.gender").isNull() | (F.col("_hit.entity.gender") == "M"))
    )
    exact = matching_name("_hit.entity.name") == matching_name(wanted)
    order = Window.partitionBy(wanted).orderBy(F.coalesce(exact, F.lit(False)).desc(), "_at")
    best = hits.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    chosen = best.select(
        wanted,
        F.col("_hit.entity.id").alias("source_team_id"),
        F.col("_hit.entity.name").alias("source_team_name"),
        F.col("_hit.entity.slug").alias("source_slug"),
    )
    return searches.select(wanted).distinct().join(chosen, wanted, "left")
