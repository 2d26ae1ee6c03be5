"""Population stability and drift of many features at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import unix_micros
from touchline.operators.ordered import exact_quantiles, quantiles_of_counts

# Fixed values of the stability index.
BINS = 10
SHARE_FLOOR = 1e-6
TIME_SPLIT = 0.8
LEAST_VALUES = 100
REVIEW_LEVEL = 0.25


def unpivot_features(df: DataFrame, features: Sequence[str], keep: dict[str, Column]) -> DataFrame:
    """Rows ``(feature, value, …keep)`` of numeric features, nulls left out."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features]
    )
    tall = df.select(*[c.alias(n) for n, c in keep.items()], F.inline(cells))
    return tall.where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(tall: DataFrame) -> DataFrame:
    """Reference and current rows per (feature, value): all later steps need no more."""
    return tall.groupBy("feature", "value").agg(
        F.count_if(F.col("is_current")).alias("c"), F.count_if(~F.col("is_current")).alias("r")
    )


def bin_edges(counts: DataFrame, bins: int = BINS, bounded: bool = False) -> DataFrame:
    """Inner bin edges per feature: distinct quantiles without both ends."""
    # Reading both counts keeps this branch's aggregate equal to the one that is
    # binned later, so Spark shuffles and counts the values once for both.
    seen = counts.where((F.col("r") > 0) & (F.col("c") >= 0))
    quantiles = quantiles_of_counts(
        seen, ["feature"], "value", "r", [i / bins for i in range(bins + 1)],
        bounded=bounded,
    )
    edges = F.array_distinct("quantiles")
    return quantiles.select(
        "feature", F.size(edges).alias("edges"),
        F.when(F.size(edges) >= 3, F.slice(edges, F.lit(2), F.size(edges) - 2))
        .otherwise(F.array().cast("array<double>")).alias("inner"),
    )


def _bin(value: str, bins: int) -> Column:
    """Number of inner edges at or below the value; plain comparisons stay in codegen."""
    at = [F.coalesce((F.get("inner", F.lit(i)) <= F.col(value)).cast("int"), F.lit(0)) for i in range(max(bins - 1, 1))]
    return reduce(lambda a, b: a + b, at)


def feature_stability(
    counts: DataFrame, bins: int = BINS, bounded: bool = False
) -> DataFrame:
    """Per feature the rows, both means and the stability index.

    Fewer than three edges give 0, an empty side gives null. Values are counted
    per bin before the shuffle; what is joined and collected has one row per
    feature and bin.
    """
    edges = bin_edges(counts, bins, bounded)
    binned = counts.join(edges, "feature", "left").select(
        "feature", "value", "c", "r", "edges", F.coalesce(F.size("inner"), F.lit(0)).alias("_inner"),
        _bin("value", bins).alias("bin"),
    )
    per_bin = binned.groupBy("feature", "edges", "_inner", "bin").agg(
        F.sum("c").alias("c"), F.sum("r").alias("r"),
        F.sum(F.col("value") * F.col("c")).alias("_vc"), F.sum(F.col("value") * F.col("r")).alias("_vr"),
    )
    # One row per feature with its full list of bins, empty ones included.
    packed = per_bin.groupBy("feature", "edges", "_inner").agg(
        F.sum("c").alias("_c"), F.sum("r").alias("_r"), F.sum("_vc").alias("_vc"), F.sum("_vr").alias("_vr"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("c", "r").alias("v")))).alias("_bins"),
    )

    def share(field: str, total: str):
        def of(b):
            n = F.coalesce(F.try_element_at("_bins", b)[field], F.lit(0))
            return F.greatest(n / F.col(total), F.lit(SHARE_FLOOR))

        return of

    cur, ref = share("c", "_c"), share("r", "_r")
    terms = F.transform(
        F.sequence(F.lit(0), F.col("_inner")), lambda b: (cur(b) - ref(b)) * F.ln(cur(b) / ref(b))
    )
    index = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return packed.select(
        "feature",
        (F.col("_c") + F.col("_r")).alias("values"),
        F.try_divide("_vr", "_r").alias("reference_mean"),
        F.try_divide("_vc", "_c").alias("current_mean"),
        F.when((F.col("_c") == 0) | (F.col("_r") == 0), F.lit(None).cast("double"))
        .when(F.col("edges") < 3, 0.0)
        .otherwise(index)
        .alias("psi"),
    )


def population_stability(tall: DataFrame, bins: int = BINS, bounded: bool = False) -> DataFrame:
    """Stability index per feature of ``(feature, value, is_current)``."""
    return feature_stability(value_counts(tall), bins, bounded).select("feature", "psi")


def time_cutoff(df: DataFrame, time: str = "kickoff_utc", share: float = TIME_SPLIT) -> float:
    """The ``share`` quantile of the time column in microseconds."""
    micros = df.select(unix_micros(time).alias("_at"))
    row = exact_quantiles(micros, [], "_at", [share]).first()
    return row["quantiles"][0]


def drift_report(
    df: DataFrame,
    features: Sequence[str],
    time: str = "kickoff_utc",
    cutoff: Column | None = None,
    bins: int = BINS,
    least: int = LEAST_VALUES,
    bounded: bool = False,
) -> DataFrame:
    """Means before and after the cutoff and the stability index per feature.

    Features with fewer than ``least`` values are left out (A23). All features
    go through one job.
    """
    at = unix_micros(time)
    edge = F.lit(time_cutoff(df, time)) if cutoff is None else unix_micros(cutoff)
    timed = df.where(at.isNotNull())
    # One pass over the columns says which are worth monitoring and how long they are.
    known = timed.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(features)]).first()
    monitored = [c for i, c in enumerate(features) if known[f"n{i}"] >= least]
    tall = unpivot_features(timed, monitored, {"is_current": at >= edge})
    report = feature_stability(value_counts(tall), bins, bounded)
    return (
        report.where(F.col("values") >= least)
        .select("feature", "reference_mean", "current_mean", "psi")
        .orderBy(F.desc_nulls_last("psi"), "feature")
    )
