"""Ordered computations per group that stay parallel when one group is huge.

Rows are range-partitioned on (group, order), so that a hot group spreads over
many slices, and what a slice needs from the slices before it (a running total,
the last value seen, the last few rows) is carried over through a per-slice
summary with at most one row per slice boundary.

A plain Spark window sends a whole group to one task. A caller who knows that no
group outgrows a task says ``bounded=True`` and gets that plan; nothing is
counted and nothing switches with the data. Without a group, rows are always
sliced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import cut_lineage

SLICE = "_slice"
HALO = "_halo"


def cut(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition on (group, order), tag each row with its slice, fix it.

    ``order`` must be unique within a group. The session's shuffle partitions say
    how many slices there are. Range bounds are sampled per run, so the tagged
    rows are checkpointed before anything reads them twice.
    """
    ranged = df.repartitionByRange(*group, *order)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def sliced_once(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` itself where ``cut`` has already tagged it for this group and order, else its slices.

    A plan with several steps over one ordering cuts once and drops the tag at its end.
    """
    return df if SLICE in df.columns else cut(df, group, order)


def _carry_join(sliced: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    """Attach per-slice carry columns; ``carry`` has at most one row per slice."""
    renamed = carry.select(
        *[F.col(c).alias(f"_k_{i}") for i, c in enumerate([*group, SLICE])],
        *[F.col(c) for c in carry.columns if c not in {*group, SLICE}],
    )
    condition = F.lit(True)
    for i, name in enumerate([*group, SLICE]):
        condition = condition & F.col(name).eqNullSafe(F.col(f"_k_{i}"))
    joined = sliced.join(renamed, condition, "left")
    return joined.drop(*[f"_k_{i}" for i in range(len(group) + 1)])


def _later_slices(summary: DataFrame, group: Sequence[str]):
    return Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    *,
    bounded: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``totals`` per group in ``order``."""
    group = list(group)
    if bounded and group:
        w = Window.partitionBy(*group).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(e).over(w).alias(n) for n, e in totals.items()])
    sliced = sliced_once(df, group, order)
    summary = sliced.groupBy(*group, SLICE).agg(
        *[F.sum(e).alias(f"_before_{n}") for n, e in totals.items()]
    )
    before = _later_slices(summary, group)
    carry = summary.select(
        *group,
        SLICE,
        *[F.sum(f"_before_{n}").over(before).alias(f"_before_{n}") for n in totals],
        F.count(F.lit(1)).over(before).alias("_earlier"),
    ).where("_earlier > 0").drop("_earlier")
    w = Window.partitionBy(*group, SLICE).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _carry_join(sliced, carry, group)
        .select(
            *df.columns,
            *[
                (F.sum(e).over(w) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n)
                for n, e in totals.items()
            ],
        )
    )


def carry_last(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    bounded: bool = False,
) -> DataFrame:
    """Add the last non-null ``value`` at or before each row of its group."""
    group = list(group)
    if bounded and group:
        w = Window.partitionBy(*group).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    sliced = sliced_once(df.withColumn("_value", value), group, order)
    position = F.struct(*[F.col(c) for c in order])
    summary = sliced.groupBy(*group, SLICE).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), position)).alias("_carried")
    )
    before = _later_slices(summary, group)
    carry = summary.select(
        *group, SLICE, F.last("_carried", ignorenulls=True).over(before).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    w = Window.partitionBy(*group, SLICE).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = F.last("_value", ignorenulls=True).over(w)
    return _carry_join(sliced, carry, group).select(
        *df.columns, F.coalesce(within, F.col("_carried")).alias(name)
    )


def _with_halo(sliced: DataFrame, group: Sequence[str], order: Sequence[str], reach: int):
    """Give each slice the last ``reach`` rows its group has in earlier slices.

    A slice may hold fewer than ``reach`` rows of the group, so a tail row can
    be owed to several later slices: it goes on as long as the rows in between
    do not fill the reach.
    """
    summary = sliced.groupBy(*group, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(1, reach)
    following = summary.select(
        *group, SLICE, F.collect_list(F.struct(F.col(SLICE).alias("to"), "_n")).over(ahead).alias("_ahead")
    ).where(F.size("_ahead") > 0)
    owed = following.select(
        *[F.col(c).alias(f"_k_{i}") for i, c in enumerate([*group, SLICE])],
        F.posexplode("_ahead").alias("_at", "_next"),
        "_ahead",
    ).select(
        *[f"_k_{i}" for i in range(len(group) + 1)],
        F.col("_next.to").alias("_to"),
        F.aggregate(
            F.slice("_ahead", F.lit(1), F.col("_at")), F.lit(0).cast("bigint"), lambda a, x: a + x["_n"]
        ).alias("_between"),
    ).where(F.col("_between") < reach)
    condition = F.lit(True)
    for i, name in enumerate([*group, SLICE]):
        condition = condition & F.col(name).eqNullSafe(F.col(f"_k_{i}"))
    from_end = Window.partitionBy(*group, SLICE).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tails = sliced.withColumn("_from_end", F.row_number().over(from_end)).where(
        F.col("_from_end") <= reach
    )
    halo = (
        tails.join(owed, condition)
        .where(F.col("_from_end") + F.col("_between") <= reach)
        .select(*[F.col("_to").alias(SLICE) if c == SLICE else F.col(c) for c in sliced.columns])
        .withColumn(HALO, F.lit(True))
    )
    return sliced.withColumn(HALO, F.lit(False)).unionByName(halo)


def over_recent(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    reach: int,
    features: Callable[[Callable[[int], object], object], dict[str, Column]],
    *,
    bounded: bool = False,
) -> DataFrame:
    """Add features that look at no more than ``reach`` earlier rows.

    ``features(frame, ordered)`` returns named columns; ``frame(n)`` is the
    frame of the n rows before the current one and ``ordered`` the plain
    ordered window for ``lag``. All features are added in one ``select``.
    """
    group = list(group)
    if bounded and group:
        w = Window.partitionBy(*group).orderBy(*order)
        named = features(lambda n: w.rowsBetween(-n, -1), w)
        return df.select("*", *[c.alias(n) for n, c in named.items()])
    sliced = _with_halo(sliced_once(df, group, order), group, order, reach)
    w = Window.partitionBy(*group, SLICE).orderBy(*order)
    named = features(lambda n: w.rowsBetween(-n, -1), w)
    return (
        sliced.select("*", *[c.alias(n) for n, c in named.items()])
        .where(~F.col(HALO))
        .select(*df.columns, *named)
    )


def row_positions(
    df: DataFrame,
    order: Sequence[str],
    name: str = "position",
    *,
    bounded: bool = False,
) -> DataFrame:
    """Global 1-based position in ``order`` without a one-partition window."""
    return running_totals(df, [], order, {name: F.lit(1).cast("bigint")}, bounded=bounded)


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    *,
    bounded: bool = False,
) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(group…, quantiles, n)``.

    Works on counts per distinct value and running counts, so neither one task
    nor a hash map has to hold a group's values.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return quantiles_of_counts(counts, group, value, "_n", probabilities, bounded=bounded)


def quantiles_of_counts(
    counts: DataFrame,
    group: Sequence[str],
    value: str,
    weight: str,
    probabilities: Sequence[float],
    *,
    bounded: bool = False,
) -> DataFrame:
    """Exact quantiles of values given once each with their number of rows."""
    group = list(group)
    ranked = running_totals(
        counts.select(*group, value, weight), group, [value], {"_upto": F.col(weight)}, bounded=bounded
    )
    if bounded and group:
        ranked = ranked.withColumn("_size", F.max("_upto").over(Window.partitionBy(*group)))
    elif group:
        sizes = ranked.groupBy(*group).agg(F.max("_upto").alias("_size"))
        ranked = ranked.join(sizes, group)
    else:
        ranked = ranked.withColumn("_size", F.lit(ranked.agg(F.max("_upto")).first()[0]))
    picks = []
    for i, p in enumerate(probabilities):
        place = (F.col("_size") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("_upto") > F.floor(place), F.col(value))).alias(f"_lo_{i}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(place), F.col(value))).alias(f"_hi_{i}"))
    picked = ranked.groupBy(*group).agg(F.max("_size").alias("n"), *picks)
    points = []
    for i, p in enumerate(probabilities):
        place = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{i}").cast("double"), F.col(f"_hi_{i}").cast("double")
        points.append(lo + (hi - lo) * (place - F.floor(place)))
    return picked.select(*group, F.array(*points).alias("quantiles"), "n")
