"""Coverage, redundancy, ranking and metric aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import _col
from touchline.operators.ordered import running_totals


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def team_coverage(registry: DataFrame, events: DataFrame, now: Column, team: str = "team_id") -> DataFrame:
    """Per registered team the date span and event counts, 0 where none."""
    summary = events.groupBy(F.col(team).alias("_team")).agg(
        F.min("match_date").alias("earliest_match"),
        F.max("match_date").alias("latest_match"),
        F.count_distinct("event_id").alias("event_count"),
        F.count_if(F.col("status_type") == "finished").alias("completed_match_count"),
        F.count_if(F.col("match_date") > now).alias("upcoming_match_count"),
    )
    joined = registry.join(summary, registry[team] == summary["_team"], "left").drop("_team")
    return joined.fillna(0, ["event_count", "completed_match_count", "upcoming_match_count"])


def statistics_coverage(team_events: DataFrame, states: DataFrame, team: str = "team_id") -> DataFrame:
    """A2: per team and year how many matches have, lack or failed statistics."""
    covered = team_events.join(states.select("event_id", "status"), "event_id", "left")
    return (
        covered.groupBy(team, F.year("match_date").alias("year"))
        .agg(
            F.count_distinct("event_id").alias("eligible_matches"),
            F.count_if(F.col("status") == "available").alias("statistics_matches"),
            F.count_if(F.col("status") == "unsupported").alias("unsupported_matches"),
            F.count_if(F.col("status") == "failed").alias("failed_matches"),
        )
        .withColumn("statistics_coverage", F.try_divide("statistics_matches", "eligible_matches"))
    )


def column_coverage(df: DataFrame, columns: Sequence[str] | None = None, label: str = "feature") -> DataFrame:
    """A3: non-null count and share per column, from one pass."""
    columns = list(columns or df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(_q(c)).alias(c) for c in columns])
    tall = counted.unpivot(["_rows"], [_q(c) for c in columns], label, "non_null_count")
    return tall.select(label, "non_null_count", F.try_divide("non_null_count", "_rows").alias("coverage"))


def extended_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A4: per column non-null and non-zero rates, distinct values and warning flags.

    Distinct values are counted in two levels: equal values of a column are
    combined before the shuffle, so neither a wide nor a hot column gathers in
    one task.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"), F.lit(types[c]).alias("dtype"),
                        _q(c).cast("string").alias("value"),
                        _q(c).cast("string").try_cast("double").alias("number"),
                    )
                    for c in columns
                ]
            )
        )
    )
    per_value = cells.groupBy("feature", "dtype", "value", "number").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    numeric = F.col("number").isNotNull()
    summed = per_value.groupBy("feature", "dtype").agg(
        (F.sum(F.when(known, F.col("n")).otherwise(0)) / F.sum("n")).alias("non_null_rate"),
        F.try_divide(
            F.sum(F.when(numeric & (F.col("number") != 0), F.col("n")).otherwise(0)),
            F.sum(F.when(numeric, F.col("n"))),
        ).alias("nonzero_rate_among_available"),
        F.count("value").alias("unique_non_null_values"),
    )
    return summed.select(
        "*",
        (F.col("non_null_rate") < 0.20).alias("low_coverage_below_20pct"),
        (F.col("nonzero_rate_among_available") < 0.01).alias("rare_nonzero_below_1pct"),
    ).orderBy("non_null_rate", "feature")


# Statistic pairs that may carry the same information.
REDUNDANT_PAIRS = [
    ("ALL_Goalkeeper saves", "ALL_Total saves"),
    ("ALL_Tackles", "ALL_Total tackles"),
    ("ALL_Tackles", "ALL_Tackles won"),
    ("ALL_Duels", "ALL_Ground duels_pct"),
]


def redundancy(df: DataFrame, pairs: Sequence[tuple[str, str]] = tuple(REDUNDANT_PAIRS)) -> DataFrame:
    """A5: rows with both, equality rate and correlation per pair, in one pass."""
    pairs = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"),
                        _q(a).cast("string").alias("_l"), _q(b).cast("string").alias("_r"),
                    )
                    for a, b in pairs
                ]
            )
        )
    ).where(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    left, right = F.col("_l").try_cast("double"), F.col("_r").try_cast("double")
    both = left.isNotNull() & right.isNotNull()
    return cells.groupBy("left_feature", "right_feature").agg(
        F.count(F.lit(1)).alias("rows_both_available"),
        F.avg(F.coalesce((left == right), F.lit(False)).cast("double")).alias("equality_rate"),
        F.when(F.count_if(both) > 1, F.corr(F.when(both, left), F.when(both, right))).alias("correlation"),
    )


def spearman(df: DataFrame, left: str, right: str, bounded: bool = False) -> DataFrame:
    """Spearman correlation with tied ranks averaged; null below two rows.

    Ranks come from running counts of distinct values, so no task sorts the
    whole column.
    """
    rows = df.select(F.col(left).alias("_l"), F.col(right).alias("_r")).dropna()

    def ranks(column: str, out: str) -> DataFrame:
        counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        upto = running_totals(counts, [], [column], {"_upto": F.col("_n")}, bounded=bounded)
        return upto.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))

    ranked = rows.groupBy("_l", "_r").agg(F.count(F.lit(1)).alias("_w"))
    ranked = ranked.join(ranks("_l", "_x"), "_l").join(ranks("_r", "_y"), "_r")
    w, x, y = F.col("_w"), F.col("_x"), F.col("_y")
    sums = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
    )
    # Centre first: the sums of squares of raw ranks lose digits at scale.
    n, mx, my = (F.col(c) for c in ("n", "mx", "my"))
    means = sums.select("n", (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"))
    mean = means.first()
    if mean is None or mean["n"] is None or mean["n"] < 2:
        return means.select(F.coalesce(n, F.lit(0)).alias("n"), F.lit(None).cast("double").alias("spearman"))
    dx, dy = x - F.lit(mean["mx"]), y - F.lit(mean["my"])
    return ranked.agg(
        F.sum(w).alias("n"),
        F.try_divide(
            F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy))
        ).alias("spearman"),
    )


def standings(team_rows: DataFrame, group: str = "group", team: str = "team_id") -> DataFrame:
    """Group table from two-sided rows: points, goal difference, goals, wins."""
    return team_rows.groupBy(group, team).agg(
        F.sum("points").alias("points"),
        F.sum(F.col("goals_for") - F.col("goals_against")).alias("gd"),
        F.sum("goals_for").alias("gf"),
        F.count_if(F.col("result") == "win").alias("wins"),
    )


def rank_group(table: DataFrame, group: str = "group", team: str = "team_id") -> DataFrame:
    """Place in the group by points, goal difference, goals, then team id."""
    w = Window.partitionBy(group).orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), F.asc(team))
    return table.withColumn("position", F.row_number().over(w))


def best_thirds(ranked: DataFrame, team: str = "team_id", k: int = 8) -> DataFrame:
    """L3: the best third-placed teams."""
    thirds = ranked.where(F.col("position") == 3)
    return thirds.orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), F.asc(team)).limit(k)


def group_sizes(fixtures: DataFrame, group: str = "group") -> DataFrame:
    """A10: fixtures and teams per group, to be compared with the expected sizes."""
    teams = fixtures.select(group, F.explode(F.array("home_team_id", "away_team_id")).alias("team"))
    return (
        fixtures.groupBy(group).agg(F.count(F.lit(1)).alias("fixtures"))
        .join(teams.groupBy(group).agg(F.count_distinct("team").alias("teams")), group)
    )


def stage_probabilities(
    runs: DataFrame, stages: Sequence[str], team: str = "team_id", run: str = "run_id", stage: str = "stage"
) -> DataFrame:
    """Share of runs in which a team reached each stage."""
    total = runs.agg(F.count_distinct(run).alias("n")).first()["n"]
    counts = runs.groupBy(team).agg(
        *[F.count_if(F.col(stage) == s).alias(s) for s in stages]
    )
    return counts.select(team, *[(F.col(s) / F.lit(total)).alias(f"prob_{s}") for s in stages])


def probability_metrics(
    df: DataFrame, label: str, probabilities: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Log loss, Brier score, accuracy; probabilities clipped and renormalised.

    ``probabilities`` maps each label, in order, to its column.
    """
    clipped = {k: F.least(F.greatest(F.col(c), F.lit(1e-12)), F.lit(1.0)) for k, c in probabilities.items()}
    total = sum(clipped.values(), F.lit(0.0))
    rows = df.select(
        *by, F.col(label).alias("_y"), *[(p / total).alias(f"_p_{k}") for k, p in clipped.items()]
    )
    names = {k: F.col(f"_p_{k}") for k in probabilities}
    truth = F.coalesce(*[F.when(F.col("_y") == k, p) for k, p in names.items()])
    brier = sum(
        (F.pow(p - F.when(F.col("_y") == k, 1.0).otherwise(0.0), F.lit(2.0)) for k, p in names.items()), F.lit(0.0)
    )
    top = F.greatest(*names.values())
    predicted = F.coalesce(*[F.when(p == top, F.lit(k)) for k, p in names.items()])
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(-F.ln(truth)).alias("log_loss"),
        F.avg(brier).alias("brier_score"),
        F.avg((predicted == F.col("_y")).cast("double")).alias("accuracy"),
    )


def count_metrics(df: DataFrame, actual: str, expected: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error and mean Poisson deviance."""
    y, mu = F.col(actual).cast("double"), F.col(expected)
    term = F.when(y == 0, mu).otherwise(y * F.ln(y / mu) - y + mu)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(y - mu)).alias("mae"),
        (F.avg(term) * 2).alias("poisson_deviance"),
    )


def calibration_bins(df: DataFrame, label: str, probabilities: dict[str, str], bins: int = 10) -> DataFrame:
    """Per class and equal-width bin the mean prediction and observed share."""
    tall = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("label"), F.col(c).alias("p"),
                        (F.col(label) == k).cast("double").alias("y"),
                    )
                    for k, c in probabilities.items()
                ]
            )
        )
    )
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col("p") * bins).cast("int"))) - 1
    return tall.groupBy("label", place.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("p").alias("mean_predicted"),
        F.avg("y").alias("observed_share"),
    )


def dispersion(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample variance and negative-binomial dispersion."""
    return (
        df.groupBy(*by)
        .agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
        .withColumn(
            "dispersion",
            F.greatest(
                (F.col("variance") - F.col("mean")) / F.greatest(F.col("mean") * F.col("mean"), F.lit(1e-9)),
                F.lit(1e-6),
            ),
        )
    )


def rank_features(coverage: DataFrame, always: Sequence[str], most: int = 80) -> DataFrame:
    """The always-kept features, then the best covered ones, at most ``most``."""
    first = F.when(F.col("feature").isin(*always), 0).otherwise(1) if always else F.lit(1)
    return coverage.orderBy(first, F.desc("coverage"), F.asc("feature")).limit(most)


def shape_inventory(datasets: dict[str, DataFrame]) -> DataFrame:
    """Row and column count per dataset."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("dataset"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )
        for name, df in datasets.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dataset_version(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """16-hex digest of the content and the ordered column names.

    A row is its JSON text with nulls written out, so a null and its place count.
    Row hashes are summed, so the digest does not depend on row order.
    """
    columns = list(columns or df.columns)
    text = F.to_json(F.struct(*[_q(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sum(row).alias("_sum"), F.count(F.lit(1)).alias("_rows")).select(
        F.substring(
            F.sha2(
                F.concat_ws(
                    "|", F.coalesce(F.col("_sum"), F.lit(0)).cast("string"), F.col("_rows").cast("string"),
                    F.lit(",".join(columns)),
                ),
                256,
            ), 1, 16,
        ).alias("dataset_version")
    )


def enough_values(df: DataFrame, columns: Sequence[str], least: int = 100) -> list[str]:
    """Columns with at least ``least`` values."""
    if not columns:
        return []
    row = df.agg(*[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"n{i}"] >= least]


def high_water(events: DataFrame, complete: Column, updated_at: Column, team: str = "team_id") -> DataFrame:
    """Per team the latest date seen and whether its history is complete."""
    return events.groupBy(team).agg(
        F.max("match_date").alias("latest_match_date"),
        F.coalesce(F.bool_or(complete), F.lit(False)).alias("history_complete"),
        F.max(updated_at).alias("updated_at"),
    )


def merge_high_water(state: DataFrame, run: DataFrame, team: str = "team_id") -> DataFrame:
    """State after a run: the date of the later update counts, completeness stays.

    A run merged again, or after a later one, changes no date. A row without ``updated_at`` is the older one.
    """
    new = run.select(
        F.col(team), F.col("latest_match_date").alias("_date"), F.col("history_complete").alias("_done"),
        F.col("updated_at").alias("_at"), F.lit(True).alias("_run"),
    )
    later = F.col("_run").isNotNull() & F.coalesce(F.col("_at") >= F.col("updated_at"), F.col("updated_at").isNull())
    return state.join(new, team, "full").select(
        team,
        F.when(later, F.col("_date")).otherwise(F.col("latest_match_date")).alias("latest_match_date"),
        (F.coalesce("history_complete", F.lit(False)) | F.coalesce("_done", F.lit(False))).alias("history_complete"),
        F.when(later, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def refetch_cutoff(state: DataFrame, since: Column, days: int = 14) -> Column:
    """Per-team start of the next fetch: an overlap once the history is complete."""
    overlap = F.col("latest_match_date") - F.make_dt_interval(days=F.lit(days))
    return F.when(
        F.col("history_complete") & F.col("latest_match_date").isNotNull(), F.greatest(since, overlap)
    ).otherwise(since)


def share_in_group(df: DataFrame, keys: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Each row's share of its group's total weight.

    The totals are a map-side combined aggregate joined back, so a hot group is
    split by the skew join instead of being one window partition.
    """
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    return df.join(totals, list(keys), "left").select(*df.columns, (weight / F.col("_total")).alias(name))
