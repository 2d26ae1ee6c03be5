"""Statistics reshaping and cleaning queries over formatted line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import query, r, table
from touchline.functions.scalars import FRACTION_PATTERN, fraction_part, normalize_period, ratio, safe_numeric
from touchline.operators.flatten import flatten_statistics, without_overview_repeat
from touchline.operators.reshape import (
    coverage_flags,
    melt_clean,
    off_balance,
    pair_by_side,
    quarantine,
    statistics_wide,
    with_empty_stats,
)

NAMES = {
    1: "Ball possession",
    2: "Crosses",
    3: "Total shots",
    4: "Duels",
    5: "Expected goals",
    6: "Distance covered",
    7: "Passes",
}
# One statistics row per line item: percentages, fractions, counts with totals,
# decimals, thousands and unreadable text, and some impossible percentages.
HOME = {
    1: "{q40}%", 2: "{q}/{b} ({p}%)", 3: "{q}", 4: "x", 5: "{t}.{u}", 6: "1,{h}", 7: "{q}/{b} ({q}0%)",
}
ORDINAL = [
    "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag",
    "l_linestatus",
]

LONG = f"""raw as (
  select l_orderkey as event_id, l_linenumber as n, cast(l_quantity as bigint) as q, l_partkey,
    case l_returnflag when 'A' then 'all' when 'N' then '1ST' else 'EXTRA' end as period_raw,
    case l_returnflag when 'A' then 'ALL' when 'N' then '1ST' else 'ET' end as period,
    {', '.join(ORDINAL[1:])} from lineitem),
long as (
  select *, case n {' '.join(f"when {k} then '{v}'" for k, v in NAMES.items())} end as stat_name,
    case n when 1 then cast(40 + q % 20 as varchar) || '%'
      when 2 then cast(q as varchar) || '/' || cast(q + 10 as varchar) || ' (' || cast(100 * q // (q + 10) as varchar) || '%)'
      when 3 then cast(q as varchar) when 4 then 'x' when 5 then cast(q // 10 as varchar) || '.' || cast(q % 10 as varchar)
      when 6 then '1,' || cast(100 + q as varchar)
      else cast(q as varchar) || '/' || cast(q + 10 as varchar) || ' (' || cast(q * 10 as varchar) || '%)' end as home_raw,
    case n when 1 then cast(60 - q % 20 + case when l_partkey % 10 = 0 then 7 else 0 end as varchar) || '%'
      when 2 then case when q % 3 <> 0 then cast(q % 5 as varchar) || '/' || cast(q + 10 as varchar) || ' (' ||
        cast(100 * (q % 5) // (q + 10) as varchar) || '%)' end
      when 3 then '' when 4 then cast(q + 1 as varchar) when 5 then cast(q as varchar) when 6 then 'n/a'
      else cast(q as varchar) || '/' || cast(q + 10 as varchar) || ' (' || cast(q as varchar) || '%)' end as away_raw,
    case when n = 4 then cast(q as double) end as home_num,
    case when n = 4 then cast(case when q % 9 = 0 then 0 else q + 10 end as double) end as home_tot from raw),
firsts as (select * exclude (place) from (select *, row_number() over (partition by event_id, period, stat_name
  order by {', '.join(ORDINAL)}) as place from long) where place = 1),
sided as (
  select event_id, 'home' as side, period || '_' || stat_name as stat, home_raw as raw, home_num as num, home_tot as tot from firsts
  union all
  select event_id, 'away', period || '_' || stat_name, away_raw, null, null from firsts),
parsed as (select *, regexp_extract(coalesce(raw, ''), '^\\s*(-?\\d+(?:\\.\\d+)?)\\s*/\\s*(-?\\d+(?:\\.\\d+)?)\\s*\\((-?\\d+(?:\\.\\d+)?)%\\)\\s*$', ['w', 't', 'p']) as m from sided),
vals as (
  select event_id, side, stat || '_won' as feature, cast(m.w as double) as value from parsed where m.w <> ''
  union all select event_id, side, stat || '_total', cast(m.t as double) from parsed where m.w <> ''
  union all select event_id, side, stat || '_pct', cast(m.p as double) / 100 from parsed where m.w <> ''
  union all select event_id, side, stat || '_won', num from parsed where m.w = '' and num is not null and tot is not null
  union all select event_id, side, stat || '_total', tot from parsed where m.w = '' and num is not null and tot is not null
  union all select event_id, side, stat || '_pct', num / nullif(tot, 0) from parsed where m.w = '' and num is not null and tot is not null
  union all select event_id, side, stat, case when regexp_matches(raw, '^\\s*-?\\d+(\\.\\d+)?%\\s*$')
      then cast(rtrim(trim(raw), '%') as double) / 100 else try_cast(replace(trim(raw), ',', '') as double) end
    from parsed where m.w = '' and not (num is not null and tot is not null))"""

FEATURES = [
    f"{period}_{name}{suffix}"
    for period in ("1ST", "ALL", "ET")
    for name, suffixes in (
        ("Ball possession", [""]), ("Crosses", ["", "_won", "_total", "_pct"]), ("Total shots", [""]),
        ("Duels", ["", "_won", "_total", "_pct"]), ("Expected goals", [""]), ("Distance covered", [""]),
        ("Passes", ["_won", "_total", "_pct"]),
    )
    for suffix in suffixes
]
WIDE = LONG + f""", wide as (select event_id, side, {', '.join(
    f"max(case when feature = '{f}' then value end) as \"{f}\"" for f in FEATURES)} from vals group by 1, 2)"""


def long_stats(spark, sf):
    lines = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    n = F.col("l_linenumber")

    def text(value):
        return value.cast("string")

    def fraction(a, b, p):
        return F.concat(text(a), F.lit("/"), text(b), F.lit(" ("), text(p), F.lit("%)"))

    home = (
        F.when(n == 1, F.concat(text(q % 20 + 40), F.lit("%")))
        .when(n == 2, fraction(q, q + 10, F.floor(q * 100 / (q + 10))))
        .when(n == 3, text(q))
        .when(n == 4, "x")
        .when(n == 5, F.concat(text(F.floor(q / 10)), F.lit("."), text(q % 10)))
        .when(n == 6, F.concat(F.lit("1,"), text(q + 100)))
        .otherwise(fraction(q, q + 10, q * 10))
    )
    away = (
        F.when(n == 1, F.concat(text(F.lit(60) - q % 20 + F.when(F.col("l_partkey") % 10 == 0, 7).otherwise(0)), F.lit("%")))
        .when(n == 2, F.when(q % 3 != 0, fraction(q % 5, q + 10, F.floor((q % 5) * 100 / (q + 10)))))
        .when(n == 3, "")
        .when(n == 4, text(q + 1))
        .when(n == 5, text(q))
        .when(n == 6, "n/a")
        .otherwise(fraction(q, q + 10, q))
    )
    period = F.when(F.col("l_returnflag") == "A", "all").when(F.col("l_returnflag") == "N", "1ST").otherwise("EXTRA")
    names = F.element_at(F.create_map(*[F.lit(x) for item in NAMES.items() for x in item]), n)
    return lines.select(
        F.col("l_orderkey").alias("event_id"),
        normalize_period(period).alias("period"),
        period.alias("period_raw"),
        F.lit("Match overview").alias("group_name"),
        names.alias("stat_name"),
        home.alias("home_value_raw"),
        away.alias("away_value_raw"),
        F.when(n == 4, q.cast("double")).alias("home_numeric_value"),
        F.lit(None).cast("double").alias("away_numeric_value"),
        F.when(n == 4, F.when(q % 9 == 0, 0).otherwise(q + 10).cast("double")).alias("home_total"),
        F.lit(None).cast("double").alias("away_total"),
        F.struct(*ORDINAL).alias("ordinal"),
    )


def wide_stats(spark, sf):
    # The statistics contract is known, so no extra job has to discover the columns.
    return statistics_wide(long_stats(spark, sf), features=FEATURES)


def _rounded(df, columns, keys=("event_id", "side")):
    return df.select(*keys, *[r(c).alias(c) for c in columns])


@query(
    "stats_long_to_wide",
    f"with {WIDE} select event_id, side, {', '.join(f'round(\"{f}\", 6) as \"{f}\"' for f in FEATURES)} from wide",
)
def stats_long_to_wide(spark, sf):
    return _rounded(wide_stats(spark, sf), FEATURES)


@query(
    "statistics_flatten",
    f"""with {LONG} select event_id, period, stat_name, home_raw as home_value_raw, away_raw as away_value_raw,
      home_num as home_numeric_value, home_tot as home_total from long
      where stat_name <> 'Total shots'""",
)
def statistics_flatten(spark, sf):
    rows = long_stats(spark, sf)
    item = F.struct(
        F.col("stat_name").alias("name"), F.col("home_value_raw").alias("home"), F.col("away_value_raw").alias("away"),
        F.col("home_numeric_value").alias("homeValue"), F.col("home_total").alias("homeTotal"),
    )
    # One payload per line item keeps every payload small.
    payload = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("period_raw").alias("period"),
                    F.array(F.struct(F.col("group_name").alias("groupName"), F.array(item).alias("statisticsItems"))).alias("groups"),
                )
            ).alias("statistics")
        )
    )
    flat = flatten_statistics(rows.select("event_id", payload.alias("payload")))
    return without_overview_repeat(flat).select(
        "event_id", "period", "stat_name", "home_value_raw", "away_value_raw", "home_numeric_value", "home_total"
    )


@query(
    "fraction_split",
    f"""with {LONG}, m as (select event_id, n, period, home_raw, case when n = 1
          then cast(rtrim(home_raw, '%') as double) / 100 else try_cast(replace(home_raw, ',', '') as double) end as safe,
        regexp_extract(home_raw, '{FRACTION_PATTERN}', ['w', 't', 'p']) as m from long)
    select event_id, n, period, home_raw, try_cast(m.w as double) as won, try_cast(m.t as double) as total,
      round(try_cast(m.p as double) / 100, 6) as pct, safe from m""",
)
def fraction_split(spark, sf):
    rows = long_stats(spark, sf)
    code = {v: k for k, v in NAMES.items()}
    names = F.create_map(*[F.lit(x) for item in code.items() for x in item])
    return rows.select(
        "event_id", F.element_at(names, F.col("stat_name")).alias("n"), "period",
        F.col("home_value_raw").alias("home_raw"),
        fraction_part("home_value_raw", 1).alias("won"), fraction_part("home_value_raw", 2).alias("total"),
        F.round(fraction_part("home_value_raw", 3) / 100, 6).alias("pct"), safe_numeric("home_value_raw").alias("safe"),
    )


def _cleaned(period: str, n: int) -> str:
    """SQL of the cleaned columns of one statistic: a fraction in three parts, a number, or its text."""
    name = f"{period}_{NAMES[n]}"
    here = f"max(case when stat = '{name}' then"
    if n in (2, 7):
        return f"""{here} try_cast(w as double) end) as "{name}_won", {here} try_cast(t as double) end) as "{name}_total",
          round({here} try_cast(p as double) end) / 100, 6) as "{name}_pct" """
    if n in (1, 5):
        number = "cast(rtrim(raw, '%') as double)" + (" / 100" if n == 1 else "")
        return f"""round({here} {number} end), 6) as "{name}" """
    return f"""{here} raw end) as "{name}" """


@query(
    "melt_and_clean",
    f"""with {LONG}, cells as (
      select event_id, side, period || '_' || stat_name as stat, raw from (
        select *, row_number() over (partition by event_id, period, stat_name, side order by raw is null, {', '.join(ORDINAL)}) as place
        from (select *, 'home' as side, home_raw as raw from long union all select *, 'away', away_raw from long)) where place = 1),
      t as (select event_id, side, stat, raw, m.w as w, m.t as t, m.p as p from (
        select *, regexp_extract(coalesce(raw, ''), '^(\\d+)/(\\d+)\\s*\\((\\d+)%\\)$', ['w', 't', 'p']) as m from cells))
    select event_id, side, {', '.join(_cleaned(p, n) for p in ('1ST', 'ALL', 'ET') for n in NAMES)} from t group by 1, 2""",
)
def melt_and_clean(spark, sf):
    """All periods and statistics, melted, pivoted and cleaned."""
    names = [f"{p}_{name}" for p in ("1ST", "ALL", "ET") for name in NAMES.values()]
    clean = melt_clean(
        long_stats(spark, sf).select(
            "event_id", F.concat_ws("_", "period", "stat_name").alias("stat_col"), "ordinal",
            F.col("home_value_raw").alias("home"), F.col("away_value_raw").alias("away"),
        ),
        names=names,
    )
    return clean.select(*[r(c).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in clean.dtypes])


@query(
    "possession_pairs",
    f"""with {WIDE}, p as (select event_id, max(case when side = 'home' then "ALL_Ball possession" end) as home,
        max(case when side = 'away' then "ALL_Ball possession" end) as away from wide group by 1)
    select event_id, round(home, 6) as home, round(away, 6) as away,
      coalesce(abs(home + away - 1.0) > 0.03001, false) as unbalanced from p""",
)
def possession_pairs(spark, sf):
    pairs = pair_by_side(wide_stats(spark, sf), "ALL_Ball possession")
    return pairs.select(
        "event_id", r("home").alias("home"), r("away").alias("away"), F.coalesce(off_balance(F.col("home") + F.col("away")), F.lit(False)).alias("unbalanced")
    )


def _any(prefix_test):
    names = [f for f in FEATURES if prefix_test(f)]
    return "(" + " or ".join(f'"{f}" is not null' for f in names) + ")"


@query(
    "coverage_flags",
    f"""with {WIDE} select event_id, side, true as has_statistics,
      {_any(lambda f: 'expected goals' in f.lower())} as has_xg, {_any(lambda f: f.startswith('1ST_'))} as has_first_half_stats,
      {_any(lambda f: f.startswith('ET_'))} as has_extra_time_stats, {_any(lambda f: 'distance' in f.lower())} as has_distance_data
    from wide""",
)
def coverage_flags_query(spark, sf):
    return coverage_flags(wide_stats(spark, sf)).select(
        "event_id", "side", "has_statistics", "has_xg", "has_first_half_stats", "has_extra_time_stats",
        "has_distance_data",
    )


PCT = [f for f in FEATURES if f.endswith("_pct")]
POSS = [f for f in FEATURES if f.endswith("Ball possession")]
SUMS = ", sums as (select event_id, " + ", ".join(
    f"""max(case when side = 'home' then "{c}" end) + max(case when side = 'away' then "{c}" end) as "{c}" """ for c in POSS
) + " from wide group by 1)"


@query(
    "quarantine_clean",
    f"""with {WIDE} {SUMS} select w.event_id, w.side, {', '.join(
        f'round(case when w."{c}" between 0 and 1 then w."{c}" end, 6) as "{c}"' for c in PCT)}, {', '.join(
        f'round(case when coalesce(abs(s."{c}" - 1.0) > 0.03001, false) then null else w."{c}" end, 6) as "{c}"' for c in POSS)}
    from wide w join sums s on s.event_id = w.event_id""",
)
def quarantine_clean(spark, sf):
    clean, _ = quarantine(wide_stats(spark, sf))
    return _rounded(clean, [*PCT, *POSS])


@query(
    "quarantine_issues",
    f"""with {WIDE} {SUMS} {' union all '.join(
        f'''select event_id, side, '{c}' as field, round("{c}", 6) as raw_normalized_value,
          'percentage outside [0, 1]' as issue from wide where not ("{c}" between 0 and 1)''' for c in PCT)}
    union all {' union all '.join(
        f'''select event_id, 'both', '{c}', round("{c}", 6), 'home and away possession do not sum to 1'
          from sums where abs("{c}" - 1.0) > 0.03001''' for c in POSS)}""",
)
def quarantine_issues(spark, sf):
    _, issues = quarantine(wide_stats(spark, sf))
    return issues.withColumn("raw_normalized_value", r("raw_normalized_value"))


@query(
    "empty_stats",
    f"""with {WIDE} select o_orderkey as event_id, s.side, "ALL_Total shots" as shots, w.event_id is not null as has_row
    from orders cross join (values ('home'), ('away')) s(side)
      left join wide w on w.event_id = o_orderkey and w.side = s.side""",
)
def empty_stats(spark, sf):
    wide = wide_stats(spark, sf).select("event_id", "side", F.col("`ALL_Total shots`").alias("shots"), F.lit(True).alias("row"))
    events = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"))
    return with_empty_stats(events, wide).select(
        "event_id", "side", "shots", F.coalesce("row", F.lit(False)).alias("has_row")
    )


@query(
    "safe_ratio",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      round(l_tax / nullif(l_discount, 0), 6) as ratio from lineitem""",
)
def safe_ratio(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.round(ratio("l_tax", "l_discount"), 6).alias("ratio"),
    )
