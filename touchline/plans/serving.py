"""Fixture tables in, feature and prediction tables out (J15-J18, F27-F29, L2, M9, §2.13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import goal_rates
from touchline.functions.payloads import link_event_id, link_problem
from touchline.functions.scalars import clip, unix_micros
from touchline.functions.scoreline import with_markets
from touchline.operators.flatten import prematch_context
from touchline.operators.history import DAY_MICROS
from touchline.operators.joins import asof_history, asof_latest, count_between, first_available, split_supported
from touchline.operators.perspective import matchup
from touchline.operators.sets import last_n, present
from touchline.session import cut_lineage

# Defaults of a fixture's context and output columns.
DEFAULT_CONTEXT = {"neutral_site": 1, "competition_type": "world_cup", "round_name": "fixture"}
RATE_FLOOR, RATE_CEILING = 0.05, 6.0
FORM_COLUMNS = [
    "event_id",
    "kickoff_utc",
    "team_id",
    "opponent_id",
    "goals_for",
    "goals_against",
    "result",
    "elo_pre",
    "elo_post",
]
CONTEXT_FIELDS = [
    "event_id",
    "kickoff_utc",
    "tournament_name",
    "competition_type",
    "round_name",
    "venue_name",
    "venue_city",
    "venue_country",
    "neutral_site",
]


def team_form(master: DataFrame, n: int = 5, most: int = 20) -> DataFrame:
    """L2: the latest ``n`` rows per team with the form columns."""
    rows = last_n(master, ["team_id"], ["kickoff_utc", "event_id"], n, most)
    return rows.select(*present(master, FORM_COLUMNS))


def fixture_features(
    fixtures: DataFrame,
    master: DataFrame,
    features: Sequence[str],
    *,
    bounded: bool = False,
) -> DataFrame:
    """One feature row per fixture from both teams' latest earlier rows.

    ``fixtures`` has ``event_id, kickoff_utc, home_team_id, away_team_id`` and
    optional context columns, which win over the defaults; an explicit null
    stays null. ``opponent_x`` is the away team's ``x``.
    """
    own = [c for c in dict.fromkeys(
        [*[f for f in features if not f.startswith("opponent_")],
         *[f.removeprefix("opponent_") for f in features if f.startswith("opponent_")],
         "kickoff_utc", "elo_pre", "elo_post", "team_displayed_ranking", "team_confederation"]
    ) if c in master.columns]
    # Both sides and the count read the same history: it is worked out once.
    master = cut_lineage(master.select("team_id", "event_id", *[F.col(f"`{c}`") for c in own if c not in {"team_id", "event_id"}]))
    past = cut_lineage(asof_history(
        master, key="team_id", time="kickoff_utc", tie="event_id", columns=own, exclude=True, bounded=bounded
    ))
    rows = fixtures
    for side in ("home", "away"):
        rows = asof_latest(
            rows, master,
            key=(f"{side}_team_id", "team_id"), at="kickoff_utc", time="kickoff_utc", tie="event_id",
            columns={c: f"_{side}_{c}" for c in own}, exclude="event_id", bounded=bounded, prepared=past,
        )
    wants_congestion = "fixture_congestion_14d" in features
    if wants_congestion:
        at = unix_micros("kickoff_utc")
        rows = count_between(
            rows, master, probe_id=["event_id"], key=("home_team_id", "team_id"),
            low=at - 14 * DAY_MICROS, high=at, time=at, name="_congestion", bounded=bounded,
        )

    def of(side: str, column: str) -> Column:
        return F.col(f"`_{side}_{column}`") if column in own else F.lit(None)

    def context(name: str) -> Column:
        return F.col(name) if name in fixtures.columns else F.lit(DEFAULT_CONTEXT[name])

    def ranking(side: str) -> Column:
        given = f"{side}_displayed_ranking"
        return F.col(given) if given in fixtures.columns else of(side, "team_displayed_ranking")

    def rating(side: str) -> Column:
        return F.coalesce(of(side, "elo_post"), of(side, "elo_pre"), F.lit(1500.0))

    known = F.col("kickoff_utc").isNotNull()
    rest = (unix_micros("kickoff_utc") - unix_micros(of("home", "kickoff_utc"))) / DAY_MICROS
    special = {
        "elo_difference": rating("home") - rating("away"),
        "ranking_difference": ranking("home") - ranking("away"),
        "neutral_site": context("neutral_site"),
        "competition_type": context("competition_type"),
        "round_name": context("round_name"),
        "confederation_matchup": matchup(of("home", "team_confederation"), of("away", "team_confederation")),
        "rest_days": F.when(known, clip(rest, low=0.0)).otherwise(of("home", "rest_days")),
    }
    if wants_congestion:
        special["fixture_congestion_14d"] = F.when(known, F.coalesce("_congestion", F.lit(0))).otherwise(
            of("home", "fixture_congestion_14d")
        )
    chosen = []
    for name in features:
        if name in special:
            chosen.append(special[name].alias(name))
        elif name.startswith("opponent_"):
            chosen.append(of("away", name.removeprefix("opponent_")).alias(name))
        else:
            chosen.append(of("home", name).alias(name))
    ready = of("home", "kickoff_utc").isNotNull() & of("away", "kickoff_utc").isNotNull()
    return rows.select(
        *[F.col(c) for c in fixtures.columns if c not in set(features)], *chosen, ready.alias("has_history")
    )


def with_prediction_markets(rates: DataFrame, home: str, away: str, **options) -> DataFrame:
    """clipped expected goals and every market of a table of rates."""
    clipped = rates.withColumns(
        {
            "home_expected_goals": clip(F.col(home), RATE_FLOOR, RATE_CEILING),
            "away_expected_goals": clip(F.col(away), RATE_FLOOR, RATE_CEILING),
        }
    )
    return with_markets(clipped, "home_expected_goals", "away_expected_goals", **options)


def pair_parameters(fixtures: DataFrame, home_rating: str, away_rating: str) -> DataFrame:
    """Goal rates and shoot-out probability of each listed pairing."""
    return fixtures.select(
        "*", *[c.alias(n) for n, c in goal_rates(home_rating, away_rating).items()]
    )


def context_struct(df: DataFrame) -> Column:
    """The named context columns that exist, as one struct."""
    return F.struct(*present(df, CONTEXT_FIELDS))


def link_fixtures(
    links: DataFrame,
    payloads: DataFrame,
    cache: DataFrame,
    teams: DataFrame,
    hosts: Sequence[str],
    *,
    newest: str,
    url: str = "url",
) -> tuple[DataFrame, DataFrame]:
    """Match links to fixtures; rejects keep their reason.

    Of several payloads of an event the one with the largest ``newest`` counts.
    """
    parsed = links.select(url, link_event_id(url, hosts).alias("event_id"), link_problem(url, hosts).alias("_problem"))
    known = payloads.groupBy("event_id").agg(F.max_by("payload", F.struct(newest, "payload")).alias("payload"))
    live = parsed.join(known, "event_id", "left")
    found = first_available(live, cache, "event_id", "payload")
    country = teams.select(
        F.col("source_team_id").alias("_sid"), "team_id", F.col("country_name").alias("_country")
    )
    context = prematch_context(found.select("event_id", "payload", url, "_problem", "source"))
    for side in ("home", "away"):
        dim = country.select(
            F.col("_sid").alias(f"{side}_source_id"), F.col("team_id").alias(f"{side}_team_id"),
            F.col("_country").alias(f"{side}_country"),
        )
        context = context.join(dim, f"{side}_source_id", "left")
    names = F.concat_ws(
        ", ",
        F.when(F.col("home_team_id").isNull(), F.col("home_team_name")),
        F.when(F.col("away_team_id").isNull(), F.col("away_team_name")),
    )
    reason = F.coalesce(
        F.col("_problem"),
        F.when(F.col("source").isNull(), "no payload for the event"),
        F.col("reject_reason"),
        F.concat(F.lit("no team history for: "), names),
    )
    usable = F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull() & F.col("_problem").isNull()
    ok, rejected = split_supported(context.withColumn("_reason", reason).drop("reject_reason"), usable, F.col("_reason"))
    # Neutral ground is derived again now that both countries are known.
    return _with_neutral(ok).drop("_problem", "_reason"), rejected.select(url, "event_id", "reject_reason")


def _with_neutral(fixtures: DataFrame) -> DataFrame:
    from touchline.functions.scalars import normalize_country

    venue = normalize_country(F.nullif(F.col("venue_country"), F.lit("")))
    derived = (
        (venue != normalize_country("home_country")) & (venue != normalize_country("away_country"))
    ).cast("int")
    return fixtures.withColumn("neutral_site", F.coalesce("neutral_site", derived)).drop("home_country", "away_country")


def different_teams(fixtures: DataFrame) -> DataFrame:
    """Fixtures of two different teams, the only ones that can be scored."""
    return fixtures.where(F.col("home_team_id") != F.col("away_team_id"))
