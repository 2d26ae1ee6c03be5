"""Model queries. Fits without a closed form have no SQL; those that end in the means of groups have."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import TM, fixtures, query, r, team_rows
from touchline.operators.history import rolling_features
from touchline.operators.perspective import playable, with_competition
from touchline.operators.split import chronological_split
from touchline.plans import boosting
from touchline.plans import models as m
from touchline.plans.serving import different_teams, fixture_features
from touchline.operators.joins import with_opponent
from touchline.session import cut_lineage

SOURCES = ["goals_for", "goals_against", "goal_difference"]
NUMERIC = [f"rolling_{c}_5" for c in SOURCES] + [f"opponent_rolling_{c}_5" for c in SOURCES] + ["rest_days", "neutral_site"]
FEATURES = [*NUMERIC, "competition_type"]


def master(spark, sf):
    rows = rolling_features(playable(team_rows(spark, sf)), SOURCES, means=(5,), spread=None, trend=None)
    return with_opponent(rows, [f"rolling_{c}_5" for c in SOURCES], paired=True)


MODEL_COLUMNS = ["event_id", "team_id", "opponent_id", "kickoff_utc", "side", "result", "goals_for", "goals_against", "training_eligible"]


def model_rows(spark, sf):
    """The master's columns that models read."""
    return master(spark, sf).select(*MODEL_COLUMNS, *FEATURES)


def home_rows(spark, sf):
    return model_rows(spark, sf).where((F.col("side") == "home") & F.col("training_eligible"))


@query("logistic_metrics")
def logistic_metrics(spark, sf):
    return m.train_outcome(home_rows(spark, sf), FEATURES)[1]


@query("yearly_backtests")
def yearly_backtests(spark, sf):
    return m.yearly_backtests(cut_lineage(home_rows(spark, sf)), FEATURES, [1998, 2000])


@query("blend_grid")
def blend_grid(spark, sf):
    split = cut_lineage(chronological_split(home_rows(spark, sf)))
    train, validation = split.where("split = 'train'"), split.where("split = 'validation'")
    scored = m.score_outcome(m.fit_outcome(train, FEATURES), validation, FEATURES)
    both = m.score_softmax(m.fit_softmax_outcome(train, FEATURES), scored, FEATURES)
    return m.blend_losses(both, "boosted_", "probability_")


@query("poisson_glm")
def poisson_glm(spark, sf):
    return m.train_scorelines(home_rows(spark, sf), NUMERIC)[1]


@query("count_market")
def count_market(spark, sf):
    rows = model_rows(spark, sf).where("training_eligible")
    return m.train_count_market(rows, NUMERIC, "goals_for")[1]


@query("feature_importances")
def feature_importances(spark, sf):
    train = cut_lineage(home_rows(spark, sf))
    return m.feature_importances(m.fit_tree_outcome(train, FEATURES), train, FEATURES)


@query("score_fixtures")
def score_fixtures(spark, sf):
    history = cut_lineage(home_rows(spark, sf))
    outcome = m.fit_outcome(history, NUMERIC)
    rates = {
        "home": m.fit_rate(history, NUMERIC, "goals_for"), "away": m.fit_rate(history, NUMERIC, "goals_against"),
    }
    upcoming = with_competition(fixtures(spark, sf)).where("status_type = 'notstarted'").select(
        "event_id", "kickoff_utc", "home_team_id", "away_team_id", "neutral_site"
    )
    rows = fixture_features(different_teams(upcoming), master(spark, sf), NUMERIC).where("has_history")
    return m.score_fixtures(rows, outcome, rates, NUMERIC, "v1")


WEIGHTS = {"rolling_goals_for_5": 0.6, "opponent_rolling_goals_for_5": -0.5, "neutral_site": -0.2, "rest_days": 0.0}
LINEAR = " + ".join(f"{w} * coalesce({c}, 0)" for c, w in WEIGHTS.items())
LOG_LOSS = "-ln(case when result = 'win' then p else 1 - p end)"


@query(
    "permutation_importances",
    f"""with {TM}, f as (select event_id, team_id, opponent_id, kickoff_utc, side, result, training_eligible, neutral_site,
        avg(goals_for) over (w rows between 5 preceding and 1 preceding) as rolling_goals_for_5,
        (epoch_us(kickoff_utc) - epoch_us(lag(kickoff_utc) over w)) / 86400000000.0 as rest_days from pl
        window w as (partition by team_id order by kickoff_utc, event_id)),
      g as (select a.*, b.rolling_goals_for_5 as opponent_rolling_goals_for_5 from f a
        left join f b on a.event_id = b.event_id and a.opponent_id = b.team_id
        where a.side = 'home' and a.training_eligible),
      n as (select *, row_number() over (order by kickoff_utc, event_id) as n, count(*) over () as c from g),
      h as (select *, row_number() over (order by md5('7:' || event_id)) as at, count(*) over () as rows from n where n > floor(c * 0.85::double)),
      s as (select feature, 1 + cast('0x' || substr(md5('7:' || feature), 1, 8) as bigint) % (select any_value(rows) - 1 from h) as shift
        from (values {", ".join(f"('{c}')" for c in WEIGHTS)}) t(feature)),
      x as (select s.feature, h.result, {", ".join(f"case when s.feature = '{c}' then d.{c} else h.{c} end as {c}" for c in WEIGHTS)}
        from h cross join s join h d on d.at = (h.at - 1 + s.shift) % h.rows + 1
        union all select null, result, {", ".join(WEIGHTS)} from h),
      p as (select *, 1 / (1 + exp(-({LINEAR}))) as p from x),
      l as (select feature, avg({LOG_LOSS}) as loss from p group by 1)
    select l.feature, round(b.loss, 6) as loss, round(l.loss, 6) as permuted_loss, round(l.loss - b.loss, 6) as importance
    from l join l b on b.feature is null where l.feature is not null""",
)
def permutation_importances(spark, sf):
    """A given logistic model of a home win on the last held-out part; it does not use the rest days."""
    test = chronological_split(home_rows(spark, sf)).where("split = 'test'")

    def score(rows):
        return rows.withColumn("p", F.expr(f"1 / (1 + exp(-({LINEAR})))"))

    out = m.permutation_importances(test, score, list(WEIGHTS), F.expr(LOG_LOSS), seed=7)
    return out.select("feature", *[r(c).alias(c) for c in ("loss", "permuted_loss", "importance")])


HOST = "scores.example.com"


@query(
    "link_predictions",
    f"""with {TM}, f as (select event_id, team_id, kickoff_utc, training_eligible, side,
        avg(goals_for) over w as gf, avg(goals_against) over w as ga from pl
        window w as (partition by team_id order by kickoff_utc, event_id rows between 5 preceding and 1 preceding)),
      up as (select event_id, kickoff_utc, home_team_id, away_team_id, case when event_id % 10 = 3 then 'https://elsewhere.example.com/x#id:' || event_id
          when event_id % 10 = 4 then 'https://{HOST}/x/y' else 'https://{HOST}/x/y#id:' || event_id end as url,
          event_id % 10 = 3 as elsewhere, event_id % 10 = 4 as bare, event_id % 9 = 2 and event_id % 18 <> 2 as unknown,
          event_id % 25 = 0 as single, home_team_id % 16 = 5 as no_home, away_team_id % 16 = 5 as no_away
        from fx where status_type = 'notstarted'),
      past as (select up.event_id, s.side, f.event_id as other, f.gf, f.ga, f.kickoff_utc, row_number() over (partition by up.event_id, s.side
          order by f.kickoff_utc desc, f.event_id desc) as place
        from up, (values ('home'), ('away')) s(side), f
        where f.team_id = case s.side when 'home' then up.home_team_id else up.away_team_id end and f.kickoff_utc < up.kickoff_utc),
      r as (select up.*, h.gf as hf, a.gf as af, h.kickoff_utc as hk,
          case when elsewhere then 'not a supported match link' when bare then 'link has no event id'
            when unknown then 'no payload for the event' when single then 'event does not contain two teams'
            when no_home or no_away then 'no team history for: ' || concat_ws(', ', case when no_home then 'Team ' || home_team_id end,
              case when no_away then 'Team ' || away_team_id end)
            when h.other is null or a.other is null then 'no earlier match of both teams' end as reason
        from up left join past h on h.event_id = up.event_id and h.side = 'home' and h.place = 1
          left join past a on a.event_id = up.event_id and a.side = 'away' and a.place = 1)
    select url, case when not elsewhere and not bare then event_id end as event_id, reason as reject_reason,
      case when reason is null then round(hf, 6) end as rolling_goals_for_5,
      case when reason is null then round(af, 6) end as opponent_rolling_goals_for_5,
      case when reason is null then round((epoch_us(kickoff_utc) - epoch_us(hk)) / 86400000000.0, 6) end as rest_days,
      case when reason is null then 1.0::double end as total, case when reason is null then 'v1' end as model_version from r""",
)
def link_predictions(spark, sf):
    """Links of coming matches to predictions; chances add up to one, and each link without any keeps its reason."""
    history = cut_lineage(home_rows(spark, sf))
    outcome = m.fit_outcome(history, NUMERIC)
    rates = {side: m.fit_rate(history, NUMERIC, f"goals_{of}") for side, of in (("home", "for"), ("away", "against"))}
    e = F.col("event_id")
    coming = fixtures(spark, sf).where("status_type = 'notstarted'")
    link = F.when(e % 10 == 3, F.concat(F.lit("https://elsewhere.example.com/x#id:"), e)).when(e % 10 == 4, F.lit(f"https://{HOST}/x/y"))
    links = coming.select(F.coalesce(link, F.concat(F.lit(f"https://{HOST}/x/y#id:"), e)).alias("url"))

    def team(side):
        number = F.col(f"{side}_team_id")
        return F.struct(number.alias("id"), F.concat(F.lit("Team "), number).alias("name"))

    away = F.when(e % 25 != 0, team("away"))
    payload = F.to_json(F.struct(F.struct(
        F.unix_seconds(F.col("kickoff_utc").cast("timestamp")).alias("startTimestamp"), team("home").alias("homeTeam"), away.alias("awayTeam")
    ).alias("event")))
    payloads = coming.select("event_id", payload.alias("payload"), F.lit(1).alias("fetched_at"))
    teams = team_rows(spark, sf).where("team_id % 16 <> 5").select(
        F.col("team_id").alias("source_team_id"), "team_id", F.lit(None).cast("string").alias("country_name")
    ).distinct()
    scored, rejected = m.predict_links(
        links, payloads.where(e % 9 != 2), payloads.where(e % 18 == 2), teams, [HOST], master(spark, sf), outcome, rates, NUMERIC, "v1",
        newest="fetched_at",
    )
    total = sum((F.col(f"probability_{n}") for n in m.LABELS), F.lit(0.0))
    numbers = ["rolling_goals_for_5", "opponent_rolling_goals_for_5", "rest_days"]
    out = scored.select("url", "event_id", *[r(c).alias(c) for c in numbers], r(total).alias("total"), "model_version")
    return out.unionByName(rejected, allowMissingColumns=True)


KINDS = ["continental_championship", "friendly", "nations_league", "world_cup", "world_cup_qualifier"]
FREE = {"rate": 1.0, "rows": 1.0, "inputs": 1.0, "penalty": 0.0, "least_weight": 0.0, "least_gain": 1e-18}


@query(
    "boosted_leaves",
    "with " + TM + """
    select competition_type, count(*) as rows, round(avg(goals_for), 5) as mean_goals,
      round(avg(case when result = 'loss' then 1.0 else 0.0 end), 5) as share_loss,
      round(avg(case when result = 'draw' then 1.0 else 0.0 end), 5) as share_draw,
      round(avg(case when result = 'win' then 1.0 else 0.0 end), 5) as share_win
    from tm where training_eligible group by 1""",
)
def boosted_leaves(spark, sf):
    """Without penalty and samples, trees over one category end in its mean count and its shares of outcomes."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("competition_type")).cast("double")
    rows = cut_lineage(m.with_label(team_rows(spark, sf).where("training_eligible")).select(
        "competition_type", "goals_for", "label", "event_id", "team_id", F.array(place).alias("features")
    ))
    key = ["event_id", "team_id"]
    counts = boosting.fit(rows, boosting.Settings("poisson", rounds=10, **FREE), label="goals_for", key=key)
    outcomes = boosting.fit(rows, boosting.Settings("softmax", 3, rounds=40, **FREE), key=key)
    sizes = rows.groupBy("competition_type", "features").agg(F.count(F.lit(1)).alias("rows"))
    scored = boosting.predict(sizes.withColumn("again", F.col("features")), counts, ["mean_goals"]).withColumnRenamed("again", "features")
    shares = ["share_loss", "share_draw", "share_win"]
    return boosting.predict(scored, outcomes, shares).select("competition_type", "rows", *[r(c, 5).alias(c) for c in ["mean_goals", *shares]])
