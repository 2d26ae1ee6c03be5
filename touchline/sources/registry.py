"""Team registry and alias seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.joins import with_lookup
from touchline.operators.quality import enforce, registry_rules
from touchline.operators.sets import keep_last, require_columns

REGISTRY_SCHEMA = (
    "team_id string, team_name string, fifa_code string, confederation string, world_cup_group string, "
    "host_country_flag boolean, search_name string, source_team_id bigint, source_slug string"
)
# Fields every registry entry has, and the number of entries.
REQUIRED_TEAM_FIELDS = [
    "team_id",
    "team_name",
    "fifa_code",
    "confederation",
    "world_cup_group",
    "host_country_flag",
    "search_name",
]
REGISTRY_SIZE = 48
# Source spellings of team names.
TEAM_ALIASES = {
    "USA": "united_states",
    "United States": "united_states",
    "United States of America": "united_states",
    "South Korea": "south_korea",
    "Korea Republic": "south_korea",
    "Iran": "iran",
    "IR Iran": "iran",
    "Turkey": "turkey",
    "Türkiye": "turkey",
    "Ivory Coast": "ivory_coast",
    "Côte d'Ivoire": "ivory_coast",
    "DR Congo": "dr_congo",
    "Congo DR": "dr_congo",
    "Cape Verde": "cabo_verde",
    "Cabo Verde": "cabo_verde",
    "Curacao": "curacao",
    "Curaçao": "curacao",
    "Czech Republic": "czechia",
    "Czechia": "czechia",
    "Bosnia & Herzegovina": "bosnia_herzegovina",
    "Bosnia and Herzegovina": "bosnia_herzegovina",
}
EXCEPTIONS_SCHEMA = "event_id bigint, exception_type string, reason string"
ALIASES_SCHEMA = "alias string, team_id string"


def check_registry(teams: DataFrame, size: int = REGISTRY_SIZE) -> DataFrame:
    """Checked registry with its constant and empty columns."""
    require_columns(teams, REQUIRED_TEAM_FIELDS)
    found = teams.count()
    if found != size:
        raise ValueError(f"Expected {size} teams, found {found}")
    enforce(teams, registry_rules(REQUIRED_TEAM_FIELDS))
    return teams.select(
        "*",
        F.lit(True).alias("is_registered_team"),
        F.col("team_name").alias("country_name"),
        F.lit(None).cast("timestamp").alias("active_from"),
        F.lit(None).cast("timestamp").alias("active_to"),
    )


def build_aliases(spark: SparkSession, registry: DataFrame) -> DataFrame:
    """source name to team id; a registry name beats a seeded alias."""
    seeds = spark.createDataFrame(
        [(name, team, 0) for name, team in TEAM_ALIASES.items()],
        "source_name string, canonical_team_id string, _rank int",
    )
    own = registry.select(
        F.explode(F.array("team_name", "search_name")).alias("source_name"),
        F.col("team_id").alias("canonical_team_id"),
        F.lit(1).alias("_rank"),
    )
    latest = keep_last(seeds.unionByName(own), ["source_name"], ["_rank", "canonical_team_id"])
    return latest.select("source_name", "canonical_team_id", F.lit("registry").alias("source")).orderBy("source_name")


def resolve_team(rows: DataFrame, aliases: DataFrame, name: str, out: str = "team_id") -> DataFrame:
    """team id of a source name, null when unknown."""
    return with_lookup(
        rows, aliases.select(F.col("source_name").alias("_alias"), "canonical_team_id"), name, "_alias",
        {out: F.col("canonical_team_id")},
    )
