"""Chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordered import row_positions

TRAIN_FRACTION, VALIDATION_FRACTION = 0.7, 0.15


def chronological_split(
    df: DataFrame,
    order: Sequence[str] = ("kickoff_utc", "event_id"),
    train: float = TRAIN_FRACTION,
    validation: float = VALIDATION_FRACTION,
) -> DataFrame:
    """Add ``split`` (train, validation, test) by position in time.

    Positions are global, yet no task sees all rows.
    """
    n = df.count()
    train_end = max(1, int(n * train))
    validation_end = max(train_end + 1, int(n * (train + validation)))
    at = row_positions(df, list(order), "_position")
    return at.withColumn(
        "split",
        F.when(F.col("_position") <= train_end, "train")
        .when(F.col("_position") <= validation_end, "validation")
        .otherwise("test"),
    ).drop("_position")
