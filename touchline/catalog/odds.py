"""Odds, score-matrix and rating-probability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import FX, fixtures, query, r, table
from touchline.functions.odds import rating_outcome
from touchline.functions.scoreline import TOTAL_LINES, live_probabilities, poisson_over, poisson_pmf, score_matrix, with_markets
from touchline.operators.aggregates import share_in_group
from touchline.operators.quality import monotone, sums_to_one, violations
from touchline.plans.odds import edges, normalize_odds
from touchline.plans.serving import pair_parameters, with_prediction_markets

QUOTES = """quotes as (
  select l_orderkey as event_id, 'book' || cast(l_suppkey % 3 as varchar) as bookmaker, 'winner' as market,
    cast(l_linenumber as varchar) as selection, l_shipdate as snapshot_utc, o_orderdate as kickoff_utc,
    case l_returnflag when 'A' then 'Decimal' when 'N' then 'american' else 'fractional' end as odds_format,
    case l_returnflag when 'A' then cast(cast(l_quantity as bigint) + 1 as varchar)
      when 'N' then case when l_partkey % 2 = 0 then cast(cast(l_quantity as bigint) * 10 + 100 as varchar)
        else '-' || cast(cast(l_quantity as bigint) * 10 + 100 as varchar) end
      else cast(cast(l_quantity as bigint) as varchar) || '/' || cast(l_partkey % 7 + 1 as varchar) end as odds,
    l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_linestatus
  from lineitem join orders on o_orderkey = l_orderkey),
priced as (select *, case odds_format when 'Decimal' then cast(odds as double)
    when 'american' then 1 + case when cast(odds as double) > 0 then cast(odds as double) / 100 else 100 / abs(cast(odds as double)) end
    else 1 + cast(split_part(odds, '/', 1) as double) / cast(split_part(odds, '/', 2) as double) end as decimal_odds
  from quotes),
shared as (select *, snapshot_utc < kickoff_utc as is_prematch,
    (1 / decimal_odds) / sum(1 / decimal_odds) over (partition by event_id, bookmaker, market, snapshot_utc) as no_vig_probability
  from priced),
normal as (select * exclude (place) from (select *, row_number() over (
    partition by event_id, bookmaker, market, snapshot_utc, selection
    order by l_partkey desc, l_suppkey desc, l_extendedprice desc, l_discount desc, l_tax desc, l_linestatus desc) as place
  from shared) where place = 1)"""


def quotes(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    q = F.col("l_quantity").cast("bigint")
    flag = F.col("l_returnflag")
    american = (q * 10 + 100).cast("string")
    odds = (
        F.when(flag == "A", (q + 1).cast("string"))
        .when(flag == "N", F.when(F.col("l_partkey") % 2 == 0, american).otherwise(F.concat(F.lit("-"), american)))
        .otherwise(F.concat(q.cast("string"), F.lit("/"), (F.col("l_partkey") % 7 + 1).cast("string")))
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("event_id"),
        F.concat(F.lit("book"), (F.col("l_suppkey") % 3).cast("string")).alias("bookmaker"),
        F.lit("winner").alias("market"), F.col("l_linenumber").cast("string").alias("selection"),
        odds.alias("odds"),
        F.when(flag == "A", "Decimal").when(flag == "N", "american").otherwise("fractional").alias("odds_format"),
        F.col("l_shipdate").alias("snapshot_utc"), F.col("o_orderdate").alias("kickoff_utc"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus").alias("seq"),
    )


@query(
    "odds_decimal",
    f"""with {QUOTES} select event_id, selection, odds, odds_format, round(decimal_odds, 6) as decimal_odds, snapshot_utc
    from priced""",
)
def odds_decimal(spark, sf):
    from touchline.functions.odds import decimal_odds

    return quotes(spark, sf).select(
        "event_id", "selection", "odds", "odds_format", F.round(decimal_odds("odds", "odds_format"), 6).alias("decimal_odds"),
        "snapshot_utc",
    )


@query(
    "no_vig",
    f"""with {QUOTES} select event_id, bookmaker, market, selection, snapshot_utc, is_prematch,
      round(no_vig_probability, 6) as no_vig_probability from normal""",
)
def no_vig(spark, sf):
    out = normalize_odds(quotes(spark, sf), ["seq"])
    return out.select(
        "event_id", "bookmaker", "market", "selection", "snapshot_utc", "is_prematch",
        r("no_vig_probability").alias("no_vig_probability"),
    )


@query(
    "group_share",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      round(l_quantity / sum(l_quantity) over (partition by l_orderkey), 6) as share from lineitem""",
)
def group_share(spark, sf):
    out = share_in_group(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_quantity"), "share")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", r("share").alias("share"))


@query(
    "edges_ev",
    f"""with {QUOTES}, pred as (select o_orderkey as event_id, cast(s as varchar) as selection,
        (o_custkey % 50 + s) / 100.0 as p from orders, range(1, 8) t(s))
    select n.event_id, bookmaker, n.selection, snapshot_utc, round(1 / p, 6) as fair_odds,
      round(p - no_vig_probability, 6) as edge, round(p * decimal_odds - 1, 6) as expected_value
    from normal n join pred on pred.event_id = n.event_id and pred.selection = n.selection where is_prematch and p > 0""",
)
def edges_ev(spark, sf):
    predictions = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("s")
    ).select(
        "event_id", F.lit("winner").alias("market"), F.col("s").cast("string").alias("selection"),
        ((F.col("o_custkey") % 50 + F.col("s")) / 100).alias("model_probability"),
    )
    out = edges(normalize_odds(quotes(spark, sf), ["seq"]), predictions)
    return out.select(
        "event_id", "bookmaker", "selection", "snapshot_utc", r("fair_odds").alias("fair_odds"), r("edge").alias("edge"),
        r("expected_value").alias("expected_value"),
    )


RATES = """rates as (select p_partkey, 0.2 + p_size / 12.0 as home_xg, 0.1 + (cast(floor(p_retailprice) as bigint) % 37) / 10.0 as away_xg
  from part)"""
CELLS = RATES + """, cells as (
  select p_partkey, home_xg, away_xg, i, j, exp(-home_xg) * pow(home_xg, i) / factorial(cast(i as int))
    * exp(-away_xg) * pow(away_xg, j) / factorial(cast(j as int))
    * greatest(0, case when i = 0 and j = 0 then 1 + home_xg * away_xg * 0.08 when i = 0 and j = 1 then 1 - home_xg * 0.08
      when i = 1 and j = 0 then 1 - away_xg * 0.08 when i = 1 and j = 1 then 1.08 else 1 end) as w
  from rates, range(0, 11) a(i), range(0, 11) b(j)),
norm as (select *, w / sum(w) over (partition by p_partkey) as p from cells)"""


def rates(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", (F.lit(0.2) + F.col("p_size") / 12).alias("home_xg"),
        (F.lit(0.1) + (F.floor("p_retailprice") % 37) / 10).alias("away_xg"),
    )


@query(
    "score_matrix",
    f"""with {CELLS} select p_partkey, cast(i as int) as home_goals, cast(j as int) as away_goals,
      round(p, 8) as probability from norm""",
)
def score_matrix_query(spark, sf):
    out = score_matrix(rates(spark, sf))
    return out.select("p_partkey", "home_goals", "away_goals", r("probability", 8).alias("probability"))


LINE_SQL = ", ".join(
    f"round(sum(p) filter (i + j > {n}), 6) as over_{str(n).replace('.', '_')}, "
    f"round(sum(p) filter (i + j < {n}), 6) as under_{str(n).replace('.', '_')}"
    for n in TOTAL_LINES
)


@query(
    "markets",
    f"""with {CELLS} select p_partkey, round(sum(p) filter (i > j), 6) as home_win, round(sum(p) filter (i = j), 6) as draw,
      round(sum(p) filter (i < j), 6) as away_win, round(sum(p) filter (i > 0 and j > 0), 6) as btts_yes, {LINE_SQL}
    from norm group by 1""",
)
def markets(spark, sf):
    out = with_markets(rates(spark, sf))
    names = [c for c in out.columns if c not in {"p_partkey", "home_xg", "away_xg"}]
    return out.select("p_partkey", *[r(c).alias(c) for c in names])


@query(
    "team_totals",
    f"""with {CELLS} select p_partkey, {', '.join(
        f"round(sum(p) filter ({v} > {n}), 6) as {side}_over_{str(n).replace('.', '_')}"
        for side, v in (('home', 'i'), ('away', 'j')) for n in (0.5, 1.5, 2.5))}, round(sum(p), 6) as score_probability_sum
    from norm group by 1""",
)
def team_totals(spark, sf):
    out = with_prediction_markets(rates(spark, sf), "home_xg", "away_xg", team_lines=(0.5, 1.5, 2.5), top_score=True)
    names = [f"{s}_over_{n}" for s in ("home", "away") for n in ("0_5", "1_5", "2_5")]
    return out.select("p_partkey", *[r(c).alias(c) for c in [*names, "score_probability_sum"]])


@query(
    "top_score",
    f"""with {CELLS}, b as (select *, row_number() over (partition by p_partkey order by round(p, 12) desc, i, j) as place from norm)
    select p_partkey, cast(i as varchar) || '-' || cast(j as varchar) as most_likely_correct_score,
      round(p, 6) as most_likely_correct_score_probability from b where place = 1""",
)
def top_score(spark, sf):
    out = with_markets(rates(spark, sf), top_score=True)
    return out.select(
        "p_partkey", "most_likely_correct_score",
        r("most_likely_correct_score_probability").alias("most_likely_correct_score_probability"),
    )


OVER = (5.5, 7.5, 9.5, 11.5, 13.5)


@query(
    "over_lines",
    "with m as (select p_partkey, 0.5 + p_size / 4.0 as mu from part) select p_partkey, " + ", ".join(
        f"round(1 - ({' + '.join(f'exp(-mu) * pow(mu, {k}) / factorial({k})' for k in range(int(n) + 1))}), 6) "
        f"as prob_over_{str(n).replace('.', '_')}" for n in OVER
    ) + ", round(exp(-mu) * pow(mu, 3) / 6, 6) as prob_exactly_3 from m",
)
def over_lines(spark, sf):
    m = table(spark, sf, "part").select("p_partkey", (F.lit(0.5) + F.col("p_size") / 4).alias("mu"))
    return m.select(
        "p_partkey", *[F.round(poisson_over(n, "mu"), 6).alias(f"prob_over_{str(n).replace('.', '_')}") for n in OVER],
        F.round(poisson_pmf(3, "mu"), 6).alias("prob_exactly_3"),
    )


@query(
    "market_invariants",
    f"""with {CELLS}, m as (select p_partkey, sum(p) filter (i + j > 1.5) as a, sum(p) filter (i + j > 2.5) as b,
        sum(p) filter (i + j > 3.5) as c, sum(p) as total from norm group by 1)
    select 'over lines are not monotone' as rule, count(*) filter (b > a or c > b) as violations from m
    union all select 'probabilities do not sum to 1', count(*) filter (abs(total - 1) > 1e-9) from m""",
)
def market_invariants(spark, sf):
    rules = [monotone(["over_1_5", "over_2_5", "over_3_5"]), sums_to_one(["home_win", "draw", "away_win"])]
    return violations(with_markets(rates(spark, sf)), rules)


@query(
    "elo_probabilities",
    """with e as (select o_orderkey as event_id, least(greatest(coalesce(case when o_orderkey % 9 <> 0 then
        (o_custkey % 100) / 99.0 end, 0.5), 0.02), 0.98) as e from orders),
      d as (select *, 0.28 * exp(-abs(e - 0.5) * 2) as d from e)
    select event_id, round((1 - e) * (1 - d), 6) as loss, round(d, 6) as draw, round(e * (1 - d), 6) as win from d""",
)
def elo_probabilities(spark, sf):
    expected = F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_custkey") % 100) / 99)
    out = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), expected.alias("e"))
    return out.select("event_id", *[F.round(c, 6).alias(n) for n, c in rating_outcome("e").items()])


@query(
    "pair_parameters",
    f"""with {FX}, rt as (select event_id, 1300.0 + home_team_id * 12.5 as h, 1300.0 + away_team_id * 12.5 as a from fx),
      sp as (select *, least(greatest((h - a) / 400, -1.5), 1.5) as d from rt)
    select event_id, round(least(greatest(1.3 * exp(0.45 * d), 0.25), 4.5), 6) as home_rate,
      round(least(greatest(1.1 * exp(-0.45 * d), 0.25), 4.5), 6) as away_rate,
      round(1 / (1 + pow(10.0, (a - h) / 800)), 6) as penalty_home from sp""",
)
def pair_parameters_query(spark, sf):
    rated = fixtures(spark, sf).select(
        "event_id", (F.lit(1300.0) + F.col("home_team_id") * 12.5).alias("h"),
        (F.lit(1300.0) + F.col("away_team_id") * 12.5).alias("a"),
    )
    out = pair_parameters(rated, "h", "a")
    return out.select("event_id", *[r(c).alias(c) for c in ("home_rate", "away_rate", "penalty_home")])


LIVE_SQL = """v as (select *, greatest(0, 90 - minute) as rest, hs - aws as gap from lv),
  p as (select *, 1 / (1 + exp(-(gap * 1.35 + rest / 180))) as h, exp(-abs(gap) * 1.4) * (rest / 90) * 0.32 as d from v),
  q as (select *, greatest(0, 1 - h - d) as a from p)"""


@query(
    "live_probabilities",
    f"""with lv as (select event_id, coalesce(case when event_id % 6 <> 0 then event_id % 4 end, 0) as hs,
        event_id % 3 as aws, cast(floor(value) as bigint) % 100 as minute from events), {LIVE_SQL}
    select event_id, round(h / (h + d + a), 6) as home_win, round(d / (h + d + a), 6) as draw,
      round(a / (h + d + a), 6) as away_win from q""",
)
def live_probabilities_query(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(e % 6 != 0, e % 4).alias("hs"), (e % 3).alias("aws"), (F.floor("value") % 100).alias("minute")
    )
    return rows.select("event_id", *[F.round(c, 6).alias(n) for n, c in live_probabilities("hs", "aws", "minute").items()])
