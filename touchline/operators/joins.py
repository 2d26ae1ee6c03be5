"""Checked, opponent, as-of and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import carry_last, over_recent, running_totals

ASOF_ORDER = ["_at", "_kind", "_event", "_ask"]


class CardinalityError(ValueError):
    """A join key that had to be unique is not."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """Fail when ``keys`` do not identify a row; counts combine map-side."""
    clash = duplicate_keys(df, keys).head(1)
    if clash:
        raise CardinalityError(f"{what}: key {list(keys)} is not unique, e.g. {clash[0].asDict()}")
    return df


def _unique_or_fail(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key that raises inside the job when a key has several rows."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row")
    )
    guarded = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.lit(f"join key {list(keys)} is not unique")).cast(packed.schema["_row"].dataType)
    )
    return packed.select(*keys, guarded.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    validate: str = "one_to_one",
    lazy: bool = False,
) -> DataFrame:
    """Equi join that fails unless the keys have the stated cardinality.

    ``validate`` is ``one_to_one``, ``many_to_one`` or ``one_to_many``. The check
    is one small aggregate before the join, or with ``lazy`` part of the join's
    own job.
    """
    if validate not in {"one_to_one", "many_to_one", "one_to_many"}:
        raise ValueError(f"unknown cardinality: {validate}")
    on = list(on)
    guard = _unique_or_fail if lazy else (lambda df, keys: require_unique(df, keys, validate))
    if validate.startswith("one_"):
        left = guard(left, on)
    if validate.endswith("_one"):
        right = guard(right, on)
    return left.join(right, on, how)


def with_opponent(
    rows: DataFrame,
    columns: Sequence[str],
    name=lambda c: f"opponent_{c}",
    *,
    event: str = "event_id",
    team: str = "team_id",
    opponent: str = "opponent_id",
    paired: bool = False,
) -> DataFrame:
    """Attach the opponent's own columns of the same event.

    In general this is a checked self join. ``paired`` rows come straight from
    the two-sided expansion, so an event has exactly two of them: the other one
    is the neighbour within the event, which needs one shuffle instead of two
    and computes the rows once.
    """
    if paired:
        pair = Window.partitionBy(event).orderBy(team)
        mine = F.struct(F.col(team).alias("_team"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
        # Dealt and sorted before the columns are packed, so that they travel once.
        packed = rows.repartition(event).sortWithinPartitions(event, team).select("*", mine.alias("_mine"))
        other = packed.select(
            *[F.col(f"`{c}`") for c in rows.columns],
            F.coalesce(F.lag("_mine").over(pair), F.lead("_mine").over(pair)).alias("_other"),
        )
        meant = F.col("_other._team") == F.col(opponent)
        return other.select(
            *[F.col(f"`{c}`") for c in rows.columns],
            *[F.when(meant, F.col(f"_other.c{i}")).alias(name(c)) for i, c in enumerate(columns)],
        )
    theirs = rows.select(
        F.col(event), F.col(team).alias(opponent), *[F.col(f"`{c}`").alias(name(c)) for c in columns]
    )
    require_unique(theirs.select(event, opponent), [event, opponent], "opponent rows")
    return rows.join(theirs, [event, opponent], "left").select(
        *[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"`{name(c)}`") for c in columns]
    )


def with_lookup(
    rows: DataFrame, dimension: DataFrame, key: str, dimension_key: str, columns: dict[str, Column]
) -> DataFrame:
    """Left-join a dimension; ``columns`` may fall back to row values."""
    right = dimension.withColumnRenamed(dimension_key, "_dimension_key")
    return rows.join(right, rows[key] == right["_dimension_key"], "left").select(
        *[rows[c] for c in rows.columns], *[c.alias(n) for n, c in columns.items()]
    )


def team_dimension(matches: DataFrame, registry: DataFrame, prefix: str = "source_") -> DataFrame:
    """Registered teams plus every other team seen in matches.

    Takes ``home_source_id, home_team_name, away_source_id, away_team_name`` with
    ``kickoff_utc, event_id``; an unregistered team gets ``<prefix><id>`` as its
    id, the last source name seen, and false flags.
    """
    seen = matches.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.col(f"{side}_source_id").alias("source_id"),
                        F.col(f"{side}_team_name").alias("source_name"),
                        F.struct("kickoff_utc", "event_id", F.lit(at)).alias("_order"),
                    )
                    for at, side in enumerate(("home", "away"))
                ]
            )
        )
    )
    teams = seen.groupBy("source_id").agg(F.max_by("source_name", "_order").alias("source_name"))
    known = registry.select(
        F.col("source_team_id").alias("source_id"),
        "team_id", "team_name", "fifa_code", "confederation", "world_cup_group",
        "host_country_flag", F.lit(True).alias("_known"),
    )
    return teams.join(known, "source_id", "left").select(
        F.coalesce("team_id", F.concat(F.lit(prefix), F.col("source_id").cast("string"))).alias("team_id"),
        F.coalesce("team_name", "source_name").alias("team_name"),
        F.col("source_id").alias("source_team_id"),
        "fifa_code",
        "confederation",
        "world_cup_group",
        F.coalesce("_known", F.lit(False)).alias("is_registered_team"),
        F.coalesce("host_country_flag", F.lit(False)).alias("host_country_flag"),
    )


def without_exceptions(rows: DataFrame, exceptions: DataFrame, key: str, kind: str) -> DataFrame:
    """Drop rows listed as exceptions of one kind."""
    listed = exceptions.where(F.col("exception_type") == kind).select(key)
    return rows.join(listed, key, "left_anti")


def only_listed(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return rows.join(keys.select(key), key, "left_semi")


def pending(events: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Distinct keys not done yet; an optional cap for one run's batch."""
    left = events.select(key).where(F.col(key).isNotNull()).distinct().join(done.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def round_robin(teams: DataFrame, group: str, team: str) -> DataFrame:
    """Each unordered pair of one group once, numbered ``G001`` onwards.

    The pairs are the fixtures of the group, so the result is what is asked for.
    """
    home = teams.select(F.col(group).alias("group"), F.col(team).alias("home_team_id"))
    away = teams.select(F.col(group).alias("group"), F.col(team).alias("away_team_id"))
    pairs = home.join(away, "group").where("home_team_id < away_team_id")
    numbered = running_totals(
        pairs, [], ["group", "home_team_id", "away_team_id"], {"_no": F.lit(1).cast("bigint")}
    )
    return numbered.select(
        F.format_string("G%03d", F.col("_no")).alias("fixture_id"),
        F.lit("group").alias("stage"),
        "group",
        "home_team_id",
        "away_team_id",
    )


def asof_history(
    history: DataFrame, *, key: str, time: str, tie: str, columns: Sequence[str], exclude: bool = False, bounded: bool = False
) -> DataFrame:
    """The history side of ``asof_latest``, for several of them over one history."""
    picked = F.struct(F.col(tie).alias("_tie"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    past = history.select(
        F.col(key).alias("_key"), F.col(time).alias("_at"), F.lit(1).alias("_kind"),
        picked.alias("_row"), F.col(tie).alias("_event"), F.lit(None).cast("long").alias("_ask"),
    ).where(F.col("_at").isNotNull())
    if not exclude:
        return past
    # A history row brings the one before it, in case it is the excluded one.
    return over_recent(
        past, ["_key"], ASOF_ORDER, 1, lambda frame, w: {"_prior": F.lag("_row").over(w)},
        bounded=bounded,
    )


def asof_latest(
    probes: DataFrame,
    history: DataFrame,
    *,
    key: tuple[str, str],
    at: str,
    time: str,
    tie: str,
    columns: dict[str, str],
    exclude: str | None = None,
    required: bool = False,
    bounded: bool = False,
    prepared: DataFrame | None = None,
) -> DataFrame:
    """Latest history row of the key strictly before the probe's time.

    ``key`` is (probe column, history column); ``time``/``tie`` order history,
    ``columns`` maps history columns to output names. ``exclude`` names a probe
    column holding a ``tie`` value (an event) that must not be used; the row
    before it is taken then. Probes and history are put in one ordering and the
    last row seen is carried on, so no range join is built. ``prepared`` is the
    result of ``asof_history`` for the same history, columns and ``exclude``.
    """
    past = prepared if prepared is not None else asof_history(
        history, key=key[1], time=time, tie=tie, columns=list(columns), exclude=exclude is not None, bounded=bounded
    )
    numbered = probes.withColumn("_probe", F.struct(*[F.col(f"`{c}`") for c in probes.columns]))
    asked = numbered.select(
        F.col(key[0]).alias("_key"),
        # An unknown time means "as of now": after everything.
        F.coalesce(F.col(at), F.lit("9999-12-31 00:00:00").cast(history.schema[time].dataType)).alias("_at"),
        F.lit(0).alias("_kind"), "_probe",
    )
    # Probes of one instant must be splittable, so their own values end the order.
    asked = asked.withColumn("_ask", F.xxhash64("_probe"))
    past = past.withColumn("_probe", F.lit(None).cast(asked.schema["_probe"].dataType))
    asked = asked.withColumn("_row", F.lit(None).cast(past.schema["_row"].dataType)).withColumn(
        "_event", F.lit(None).cast(past.schema["_event"].dataType)
    )
    carried = F.col("_row") if exclude is None else F.struct("_row", "_prior")
    line = past.unionByName(asked, allowMissingColumns=True)
    seen = carry_last(
        line, ["_key"], ASOF_ORDER, F.when(F.col("_kind") == 1, carried), "_last", bounded=bounded
    )
    chosen = F.col("_last")
    if exclude is not None:
        latest, prior = F.col("_last._row"), F.col("_last._prior")
        chosen = F.when(latest["_tie"] == F.col("_probe")[exclude], prior).otherwise(latest)
    out = seen.where(F.col("_kind") == 0).select("_probe", chosen.alias("_chosen"))
    if required:
        out = out.withColumn(
            "_chosen",
            F.coalesce(
                "_chosen",
                F.raise_error(F.lit("no earlier history for a probe")).cast(
                    out.schema["_chosen"].dataType
                ),
            ),
        )
    return out.select(
        "_probe.*", *[F.col("_chosen")[f"c{i}"].alias(n) for i, n in enumerate(columns.values())]
    )


def count_between(
    probes: DataFrame,
    events: DataFrame,
    *,
    probe_id: Sequence[str],
    key: tuple[str, str],
    low: Column,
    high: Column,
    time: Column,
    name: str,
    bounded: bool = False,
) -> DataFrame:
    """Number of events of the key with ``low <= time < high`` per probe.

    Each probe asks twice how many events lie before an instant; events and
    questions share one ordering and one running count. ``probe_id`` has to be
    unique. Bounds and times are comparable numbers (microseconds).
    """
    totals = totals_between(
        probes, events, probe_id=probe_id, key=key, low=low, high=high, time=time, name=name, bounded=bounded
    )
    return probes.join(totals, list(probe_id), "left")


def totals_between(
    probes: DataFrame,
    events: DataFrame,
    *,
    probe_id: Sequence[str],
    key: tuple[str, str],
    low: Column,
    high: Column,
    time: Column,
    name: str,
    bounded: bool = False,
) -> DataFrame:
    """The counts of ``count_between`` by ``probe_id``, without the probes' other columns."""
    ids = list(probe_id)
    happened = events.select(
        F.col(key[1]).alias("_key"), time.alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_sign"),
    ).where(F.col("_at").isNotNull())
    # Same-instant events are one step of the running count.
    happened = happened.groupBy("_key", "_at", "_kind", "_sign").agg(F.count(F.lit(1)).alias("_n"))
    asked = probes.select(
        F.col(key[0]).alias("_key"), *[F.col(c).alias(f"_id_{i}") for i, c in enumerate(ids)],
        F.inline(F.array(
            F.struct(low.alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).alias("_sign")),
            F.struct(high.alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_sign")),
        )),
    ).withColumn("_n", F.lit(0).cast("bigint"))
    line = happened.unionByName(asked, allowMissingColumns=True)
    order = ["_at", "_kind", *[f"_id_{i}" for i in range(len(ids))], "_sign"]
    counted = running_totals(line, ["_key"], order, {"_before": F.col("_n")}, bounded=bounded)
    return (
        counted.where(F.col("_kind") == 0)
        .groupBy(*[F.col(f"_id_{i}").alias(c) for i, c in enumerate(ids)])
        .agg(F.sum(F.when(F.col("_at").isNotNull(), F.col("_before") * F.col("_sign"))).alias(name))
    )


def first_available(live: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """The live value, else the cached one; ``source`` says which, null = neither."""
    old = cached.select(F.col(key), F.col(value).alias("_cached"))
    return live.join(old, key, "left").select(
        *[F.col(c) for c in live.columns if c != value],
        F.coalesce(F.col(value), F.col("_cached")).alias(value),
        F.when(F.col(value).isNotNull(), "live").when(F.col("_cached").isNotNull(), "cache").alias("source"),
    )


def bracket_teams(slots: DataFrame, ranked: DataFrame, group: str = "group", team: str = "team_id") -> DataFrame:
    """Resolve bracket references such as ``1A`` (place, group) to teams.

    ``slots`` has ``home_ref`` and ``away_ref``; a reference without a team
    stays null.
    """
    out = slots
    for side in ("home", "away"):
        label = F.concat(F.col("position").cast("string"), F.col(group).cast("string"))
        places = ranked.select(label.alias(f"{side}_ref"), F.col(team).alias(f"{side}_team_id"))
        out = out.join(places, f"{side}_ref", "left")
    return out


def split_supported(rows: DataFrame, supported: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejects with a reason."""
    ok = F.coalesce(supported, F.lit(False))
    return rows.where(ok), rows.where(~ok).withColumn("reject_reason", reason)
