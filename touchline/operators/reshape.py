"""Long/wide reshaping of statistics and their cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import FRACTION_PATTERN, ratio, safe_numeric
from touchline.operators.sets import keep_first
from touchline.session import cut_lineage

POSSESSION_TOLERANCE = 0.03
RELATIVE_TOLERANCE = 1e-5


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def pivot_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of a pivot column: the width of the table they become."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def statistics_values(long: DataFrame, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """R2 first half: ``(event_id, side, feature, value)`` with fractions split.

    The first occurrence of ``(event_id, period, stat_name)`` in ``order`` counts.
    """
    # One shuffle by event serves this step and the pivot after it.
    source = keep_first(long.repartition("event_id"), ["event_id", "period", "stat_name"], list(order))

    def side(name: str) -> Column:
        return F.struct(
            F.lit(name).alias("side"),
            F.col(f"{name}_value_raw").alias("raw"),
            F.col(f"{name}_numeric_value").cast("double").alias("numeric"),
            F.col(f"{name}_total").cast("double").alias("total"),
        )

    rows = source.select(
        "event_id",
        F.concat_ws("_", "period", "stat_name").alias("stat"),
        F.inline(F.array(side("home"), side("away"))),
    )
    # All three numbers of a fraction from one match.
    numbers = F.split(F.regexp_replace("raw", FRACTION_PATTERN, "$1|$2|$3"), r"\|")
    rows = rows.select("*", F.when(F.col("raw").rlike(FRACTION_PATTERN), numbers).alias("_n"))
    has_total = F.col("total").isNotNull() & F.col("numeric").isNotNull()

    def part(suffix: str, value: Column) -> Column:
        return F.struct(F.concat("stat", F.lit(suffix)).alias("feature"), value.alias("value"))

    split = F.array(
        part("_won", F.col("_n")[0].cast("double")),
        part("_total", F.col("_n")[1].cast("double")),
        part("_pct", F.col("_n")[2].cast("double") / 100),
    )
    counted = F.array(
        part("_won", F.col("numeric")),
        part("_total", F.col("total")),
        part("_pct", ratio("numeric", "total")),
    )
    single = F.array(part("", safe_numeric("raw")))
    parts = F.when(F.col("_n").isNotNull(), split).when(has_total, counted).otherwise(single)
    return rows.select("event_id", "side", F.inline(parts))


def statistics_wide(long: DataFrame, order: Sequence[str] = ("ordinal",), features=None) -> DataFrame:
    """One row per (event, side), one numeric column per statistic."""
    values = statistics_values(long, order)
    features = pivot_values(values, "feature") if features is None else list(features)
    # A feature occurs once per row of the result, so its maximum is its value; plain
    # conditional aggregates combine map-side in a hash aggregate.
    return values.groupBy("event_id", "side").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    )


def melt_pivot(
    long: DataFrame, key: str = "event_id", stat: str = "stat_col", order: str = "ordinal", features=None
) -> DataFrame:
    """home/away columns to rows, then statistics to columns (text kept).

    The first non-null value in ``order`` counts.
    """
    tall = long.select(key, stat, order, "home", "away").unpivot(
        [key, stat, order], ["home", "away"], "side", "value"
    )
    features = pivot_values(tall, stat) if features is None else list(features)
    first = F.min_by("value", F.when(F.col("value").isNotNull(), F.col(order)))
    return tall.groupBy(key, "side").pivot(stat, features).agg(first)


# Text forms recognised by the column-wise cleaners.
WIDE_FRACTION = r"^(\d+)/(\d+)\s*\((\d+)%\)$"
WIDE_PERCENT = r"^\s*\d+(\.\d+)?%\s*$"
MAYBE_NUMBER = r"^[^/%]*(\d|(?i:nan|inf))[^/%]*$"  # whatever a cast reads as a double matches


def matching_columns(wide: DataFrame, columns: Sequence[str], pattern: str) -> list[str]:
    """Columns with at least one value of the pattern; one aggregate for all."""
    if not columns:
        return []
    row = wide.agg(*[F.max(F.trim(_q(c)).rlike(pattern)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"m{i}"]]


def split_fraction_columns(wide: DataFrame, keys=("event_id", "side"), columns=None) -> DataFrame:
    """Replace ``a/b (p%)`` text columns by won, total and pct columns."""
    texts = [f.name for f in wide.schema if f.dataType.simpleString() == "string" and f.name not in keys]
    columns = matching_columns(wide, texts, WIDE_FRACTION) if columns is None else list(columns)

    def part(name: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(F.trim(_q(name)), WIDE_FRACTION, i), F.lit("")).try_cast("double")

    added = []
    for name in columns:
        added += [
            part(name, 1).alias(f"{name}_won"),
            part(name, 2).alias(f"{name}_total"),
            (part(name, 3) / 100).alias(f"{name}_pct"),
        ]
    return wide.select(*[_q(c) for c in wide.columns if c not in columns], *added)


def percent_to_decimal(wide: DataFrame, keys=("event_id", "side")) -> DataFrame:
    """``p%`` values of text columns to decimals, other values unchanged."""
    out = []
    for field in wide.schema:
        name = field.name
        if name in keys or field.dataType.simpleString() != "string":
            out.append(_q(name))
            continue
        number = F.replace(_q(name), F.lit("%"), F.lit("")).try_cast("double") / 100
        out.append(F.when(_q(name).rlike(WIDE_PERCENT), number.cast("string")).otherwise(_q(name)).alias(name))
    return wide.select(*out)


def numeric_where_possible(wide: DataFrame, keys=("event_id", "side")) -> DataFrame:
    """Cast a text column to double when every non-null value parses."""
    texts = [f.name for f in wide.schema if f.dataType.simpleString() == "string" and f.name not in keys]
    if not texts:
        return wide
    tests = [
        (F.count(_q(c).try_cast("double")) == F.count(_q(c))).alias(f"t{i}") for i, c in enumerate(texts)
    ]
    row = wide.agg(*tests).first()
    numeric = {c for i, c in enumerate(texts) if row[f"t{i}"]}
    return wide.select(
        *[_q(c).try_cast("double").alias(c) if c in numeric else _q(c) for c in wide.columns]
    )


def _decimal(value: Column) -> Column:
    return F.replace(value, F.lit("%"), F.lit("")).try_cast("double") / 100


def _number(value: Column) -> Column:
    """``p%`` as a decimal, other text as the number it is; texts that can't be one aren't tried, as a failed cast is dear."""
    return F.when(value.rlike(WIDE_PERCENT), _decimal(value)).when(value.rlike(MAYBE_NUMBER), value.try_cast("double"))


def melt_clean(
    long: DataFrame, key: str = "event_id", stat: str = "stat_col", order: str = "ordinal", names: Sequence[str] | None = None
) -> DataFrame:
    """R3 to R6 in one: rows by side, fractions split, percentages as decimals, numbers where every value is one.

    The first value of each cell is fixed once, both sides in one row; one aggregate over these tells each statistic's
    kind. The cells then travel once more, by key and still narrow, and become columns where they arrive: a key has at
    most one row per statistic by then. Without ``names`` the statistics found become columns.
    """
    sides = ("home", "away")
    firsts = [F.min_by(s, F.when(F.col(s).isNotNull(), F.col(order))).alias(s) for s in sides]
    cells = cut_lineage(long.groupBy(key, stat).agg(*firsts))

    def of_any(test) -> Column:
        return F.max(reduce(lambda a, b: a | b, [F.coalesce(test(F.col(s)), F.lit(False)) for s in sides]))

    kinds = {
        r[stat]: r for r in cells.groupBy(stat).agg(
            of_any(lambda v: F.trim(v).rlike(WIDE_FRACTION)).alias("fraction"),
            of_any(lambda v: v.isNotNull() & _number(v).isNull()).alias("text"),
        ).collect()
    }
    names = sorted(kinds) if names is None else list(names)
    if not names:
        return cells.select(key, F.explode(F.array(*map(F.lit, sides))).alias("side")).distinct()
    kind = {name: "fraction" if kinds[name]["fraction"] else "text" if kinds[name]["text"] else "number" for name in names if name in kinds}
    # Each cell is read once, as its statistic's kind says, before it becomes one of many columns.
    both = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in sides]))
    tall = cells.repartition(key).select(key, F.array_position(F.lit(names), F.col(stat)).alias("place"), both)
    value, text = F.col("value"), F.trim("value")

    def has(own: str) -> Column:
        return F.col("place").isin([i for i, name in enumerate(names, 1) if kind.get(name) == own])

    split = F.split(F.regexp_replace(text, WIDE_FRACTION, "$1|$2|$3"), r"\|")
    read = tall.select(
        key, "side", "place", F.when(has("number"), _number(value)).alias("number"),
        F.when(has("text"), F.when(value.rlike(WIDE_PERCENT), _decimal(value).cast("string")).otherwise(value)).alias("text"),
        F.when(has("fraction") & text.rlike(WIDE_FRACTION), split).alias("parts"),
    )
    read = read.select(key, "side", "place", "number", "text", *[F.col("parts")[k].try_cast("double").alias(f"p{k}") for k in range(3)])
    kept = ["number", "text", "p0", "p1", "p2"]  # a cell is alone in its place, so the greatest is it
    wide = read.groupBy(key, "side").pivot("place", list(range(1, len(names) + 1))).agg(*[F.max(c).alias(c) for c in kept])
    columns = []
    for i, name in enumerate(names, 1):
        own = kind.get(name, "number")
        made = {"_won": _q(f"{i}_p0"), "_total": _q(f"{i}_p1"), "_pct": _q(f"{i}_p2") / 100} if own == "fraction" else {"": _q(f"{i}_{own}")}
        columns += [part.alias(f"{name}{suffix}") for suffix, part in made.items()]
    return wide.select(key, "side", *columns)


def pair_by_side(rows: DataFrame, value: str, key: str = "event_id") -> DataFrame:
    """``(event_id, home, away)`` of one value."""
    return rows.groupBy(key).pivot("side", ["home", "away"]).agg(F.first(_q(value), ignorenulls=True))


def with_empty_stats(events: DataFrame, stats: DataFrame, key: str = "event_id") -> DataFrame:
    """Two side rows for every event, nulls where it has no statistics."""
    sides = events.select(key, F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    return sides.join(stats, [key, "side"], "left")


def _any_known(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [_q(c).isNotNull() for c in columns], F.lit(False))


def coverage_flags(wide: DataFrame) -> DataFrame:
    """Row-wise flags telling which families of statistics are present."""
    names = wide.columns
    return wide.select(
        *[_q(c) for c in names],
        F.lit(True).alias("has_statistics"),
        _any_known([c for c in names if "expected goals" in c.lower()]).alias("has_xg"),
        _any_known([c for c in names if c.startswith("1ST_")]).alias("has_first_half_stats"),
        _any_known([c for c in names if c.startswith(("ET_", "ET1_", "ET2_"))]).alias("has_extra_time_stats"),
        _any_known([c for c in names if "distance" in c.lower()]).alias("has_distance_data"),
    )


def off_balance(total: Column) -> Column:
    """Possession shares that do not add up to 1 within the tolerance."""
    return F.abs(total - 1.0) > F.lit(POSSESSION_TOLERANCE + RELATIVE_TOLERANCE)


def quarantine(wide: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Q4: null impossible percentages and unbalanced possession, and list the issues.

    Returns ``(clean, issues)``. Possession pairs are compared after the
    out-of-range values are gone.
    """
    percents = [c for c in wide.columns if c.endswith("_pct")]
    possession = [c for c in wide.columns if c.endswith("Ball possession")]
    inside = wide.select(
        *[
            F.when(_q(c).between(0, 1), _q(c)).alias(c) if c in percents else _q(c)
            for c in wide.columns
        ]
    )
    range_issues = None
    if percents:
        range_issues = (
            wide.select(key, "side", *[_q(c).cast("double").alias(c) for c in percents])
            .unpivot([key, "side"], [_q(c) for c in percents], "field", "raw_normalized_value")
            .where(F.col("raw_normalized_value").isNotNull() & ~F.col("raw_normalized_value").between(0, 1))
            .withColumn("issue", F.lit("percentage outside [0, 1]"))
        )
    issues, clean = range_issues, inside
    if possession:
        # The two rows of an event meet in one window, so the wide table is built once.
        event = Window.partitionBy(key)

        def of(side: str, name: str) -> Column:
            return F.max(F.when(F.col("side") == side, _q(name))).over(event)

        both = inside.select(
            "*",
            *[(of("home", c) + of("away", c)).alias(f"_sum_{i}") for i, c in enumerate(possession)],
            F.row_number().over(event.orderBy("side")).alias("_place"),
        )
        flags = {c: F.coalesce(off_balance(F.col(f"_sum_{i}")), F.lit(False)) for i, c in enumerate(possession)}
        clean = both.select(*[F.when(~flags[c], _q(c)).alias(c) if c in possession else _q(c) for c in wide.columns])
        listed = both.where("_place = 1").select(
            key,
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit("both").alias("side"),
                            F.lit(c).alias("field"),
                            F.when(flags[c], F.col(f"_sum_{i}")).alias("raw_normalized_value"),
                        )
                        for i, c in enumerate(possession)
                    ]
                )
            ),
        ).where(F.col("raw_normalized_value").isNotNull())
        listed = listed.withColumn("issue", F.lit("home and away possession do not sum to 1"))
        issues = listed if issues is None else issues.unionByName(listed)
    if issues is None:
        issues = wide.sparkSession.createDataFrame(
            [], f"{key} bigint, side string, field string, raw_normalized_value double, issue string"
        )
    return clean, issues
