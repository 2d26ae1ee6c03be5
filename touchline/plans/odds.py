"""Odds snapshots: normalisation and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.odds import decimal_odds, expected_value
from touchline.operators.joins import checked_join
from touchline.operators.sets import keep_last, require_columns
from touchline.sources.io import empty_table, read_by_suffix, write_table

# The odds contract.
ODDS_COLUMNS = [
    "event_id",
    "bookmaker",
    "market",
    "selection",
    "odds",
    "odds_format",
    "snapshot_utc",
    "kickoff_utc",
]
ODDS_SCHEMA = (
    "event_id bigint, bookmaker string, market string, selection string, odds string, odds_format string, "
    "snapshot_utc timestamp, kickoff_utc timestamp"
)
SNAPSHOT_KEYS = ["event_id", "bookmaker", "market", "snapshot_utc"]
EXPECTED_VALUE_SCHEMA = (
    "event_id bigint, bookmaker string, market string, selection string, model_probability double, "
    "no_vig_probability double, fair_odds double, edge double, expected_value double"
)


def normalize_odds(odds: DataFrame, order: Sequence[str]) -> DataFrame:
    """Decimal price, prematch flag and no-vig share; the last quote per selection.

    ``order`` ranks repeated quotes of one snapshot and selection. The share is
    taken over every quote of the snapshot, before repeats are dropped.
    """
    require_columns(odds, ODDS_COLUMNS)
    priced = odds.select(
        "*",
        decimal_odds("odds", "odds_format").alias("decimal_odds"),
        (F.col("snapshot_utc") < F.col("kickoff_utc")).alias("is_prematch"),
    )
    # A snapshot is a handful of quotes: one window, whose partitioning also serves the last quote per selection.
    share = F.lit(1.0) / F.col("decimal_odds")
    shared = priced.withColumn("no_vig_probability", share / F.sum(share).over(Window.partitionBy(*SNAPSHOT_KEYS)))
    return keep_last(shared, [*SNAPSHOT_KEYS, "selection"], order)


def edges(odds: DataFrame, predictions: DataFrame) -> DataFrame:
    """Prematch quotes against one prediction per (event, market, selection)."""
    joined = checked_join(
        odds.where("is_prematch"), predictions, ["event_id", "market", "selection"], "inner", "many_to_one"
    )
    p, price = F.col("model_probability"), F.col("decimal_odds")
    return joined.select(
        "*",
        F.try_divide(F.lit(1.0), p).alias("fair_odds"),
        (p - F.col("no_vig_probability")).alias("edge"),
        expected_value(p, price).alias("expected_value"),
    )


def import_odds(spark: SparkSession, source: str, target: str, order: Sequence[str]) -> DataFrame:
    """Read odds by file type, normalise, store the snapshot table.

    ``order`` says which of several quotes for one selection is the last.
    """
    write_table(normalize_odds(read_by_suffix(spark, source, ODDS_SCHEMA), order), target)
    return spark.read.parquet(target)


def empty_expected_value(spark: SparkSession) -> DataFrame:
    """The expected-value contract without rows."""
    return empty_table(spark, EXPECTED_VALUE_SCHEMA)
