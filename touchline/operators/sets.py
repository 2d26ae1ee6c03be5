"""Deduplication, upserts and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """Rows ranked at most ``most`` within the key.

    A pure rank filter: Spark keeps only the leading rows of a key before the
    shuffle as well, so a hot key does not travel whole to one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key; ``order`` has to be total within a key."""
    return _ranked(df, keys, [F.col(c).asc_nulls_last() for c in order], 1)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key; ``order`` has to be total within a key."""
    return _ranked(df, keys, [F.col(c).desc_nulls_last() for c in order], 1)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, most: int | None = None) -> DataFrame:
    """L2: the latest ``n`` rows per key, ``n`` limited to 1..``most`` when given."""
    n = max(1, n if most is None else min(n, most))
    return _ranked(df, keys, [F.col(c).desc_nulls_last() for c in order], n)


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def upsert(existing: DataFrame, fetched: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing and fetched rows, the latest per key; fetched wins a tie.

    ``order`` breaks ties inside one batch.
    """
    both = union_all(
        existing.withColumn("_batch", F.lit(0)), fetched.withColumn("_batch", F.lit(1))
    )
    return keep_last(both, keys, ["_batch", *order]).drop("_batch")


def sorted_nulls_last(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """L1: global sort with nulls last; end ``order`` with a unique key."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """L3/L4: first ``k`` rows of a total order, kept per partition before merging."""
    return df.orderBy(*order).limit(k)


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail early when required columns are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Input is missing required columns: {missing}")
    return df


def by_prefix(df: DataFrame, prefixes: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Columns with one of the prefixes or named in ``also``, in frame order."""
    names = [c for c in df.columns if c in set(also) or c.startswith(tuple(prefixes))]
    return df.select(*[F.col(f"`{c}`") for c in names])
