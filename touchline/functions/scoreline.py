"""Score-matrix probabilities without a shuffle.

The matrix of independent Poisson goals has a product form, so its total and
every market are sums over the two 11-entry marginals plus the four corrected
low-score cells. All of it is computed inside the row; cells are exploded only
when the caller asks for the matrix itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import _col

# Fixed values of the score model.
MAX_GOALS = 10
LOW_SCORE_RHO = -0.08
TOTAL_LINES = (1.5, 2.5, 3.5)
TEAM_LINES = (0.5, 1.5, 2.5)
# Fixed values of the live model.
LIVE_GOAL_WEIGHT, LIVE_TIME_SCALE, LIVE_DRAW_DECAY, LIVE_DRAW_SHARE = 1.35, 180, 1.4, 0.32


def poisson_pmf(goals: int, mean) -> Column:
    """probability of exactly ``goals``."""
    mu = _col(mean)
    return F.exp(-mu) * F.pow(mu, F.lit(float(goals))) / float(math.factorial(goals))


def poisson_over(line: float, mean) -> Column:
    """probability of more than ``floor(line)`` events."""
    return F.lit(1.0) - _total([poisson_pmf(k, mean) for k in range(int(line) + 1)])


def _total(columns) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out + column
    return out


def _marginals(df: DataFrame, home: str, away: str, max_goals: int, rho: float) -> DataFrame:
    """Add both marginals ``_h*``/``_a*`` and the extra mass of the corrected cells."""
    with_pmf = df.select(
        "*",
        *[poisson_pmf(k, home).alias(f"_h{k}") for k in range(max_goals + 1)],
        *[poisson_pmf(k, away).alias(f"_a{k}") for k in range(max_goals + 1)],
    )
    h, a = F.col(home), F.col(away)
    factors = {(0, 0): 1 - h * a * rho, (0, 1): 1 + h * rho, (1, 0): 1 + a * rho, (1, 1): F.lit(1 - rho)}
    with_extra = with_pmf.select(
        "*",
        *[
            (F.col(f"_h{i}") * F.col(f"_a{j}") * (F.greatest(f, F.lit(0.0)) - 1)).alias(f"_x{i}{j}")
            for (i, j), f in factors.items()
        ],
    )
    return with_extra.withColumn(
        "_mass",
        _total([F.col(f"_h{k}") for k in range(max_goals + 1)])
        * _total([F.col(f"_a{k}") for k in range(max_goals + 1)])
        + _total([F.col(x) for x in ("_x00", "_x01", "_x10", "_x11")]),
    )


def score_matrix(
    df: DataFrame,
    home: str = "home_xg",
    away: str = "away_xg",
    max_goals: int = MAX_GOALS,
    rho: float = LOW_SCORE_RHO,
) -> DataFrame:
    """one row per cell ``(home_goals, away_goals, probability)`` of each fixture."""
    n = max_goals + 1
    base = _packed(_marginals(df, home, away, max_goals, rho), df.columns, max_goals)
    cells = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("_at"))
    return cells.select(
        *df.columns,
        F.floor(F.col("_at") / n).cast("int").alias("home_goals"),
        (F.col("_at") % n).alias("away_goals"),
        _packed_cell(F.col("_at"), n).alias("probability"),
    )


def _packed(base: DataFrame, keep, max_goals: int) -> DataFrame:
    """Marginals as two arrays, for code that goes over the cells by number."""
    n = max_goals + 1
    return base.select(
        *keep,
        F.array(*[F.col(f"_h{k}") for k in range(n)]).alias("_h"),
        F.array(*[F.col(f"_a{k}") for k in range(n)]).alias("_a"),
        "_x00", "_x01", "_x10", "_x11", "_mass",
    )


def _packed_cell(at: Column, n: int) -> Column:
    """Probability of cell number ``at`` over packed marginals."""
    extra = (
        F.when(at == 0, F.col("_x00"))
        .when(at == 1, F.col("_x01"))
        .when(at == n, F.col("_x10"))
        .when(at == n + 1, F.col("_x11"))
        .otherwise(0.0)
    )
    i = F.floor(at / n).cast("int")
    return (F.get("_h", i) * F.get("_a", at % n) + extra) / F.col("_mass")


def _most_likely(base: DataFrame, n: int) -> tuple[DataFrame, Column, Column]:
    """Most likely cell and its probability; ties go to the lowest cell, unknown rates to the first one.

    Plain columns: the best of each row of cells, the first row that has the best of all, the first such cell in it.
    """
    corner = {(i, j): F.col(f"_x{i}{j}") for i in range(2) for j in range(2)}

    def cell(i: int, j: int) -> Column:
        return (F.col(f"_h{i}") * F.col(f"_a{j}") + corner.get((i, j), F.lit(0.0))) / F.col("_mass")

    def first(found) -> Column:
        return F.coalesce(*[F.when(c, k) for k, c in enumerate(found)], F.lit(0))

    rows = base.select("*", *[F.greatest(*[cell(i, j) for j in range(n)]).alias(f"_r{i}") for i in range(n)])
    best = rows.withColumn("_best", F.greatest(*[F.col(f"_r{i}") for i in range(n)]))
    home = best.withColumn("_home", first(F.col(f"_r{i}") == F.col("_best") for i in range(n)))
    own = home.withColumn("_own", F.coalesce(*[F.when(F.col("_home") == i, F.col(f"_h{i}")) for i in range(n)]))

    def beside(j: int) -> Column:
        if j > 1:
            return F.lit(0.0)
        return F.when(F.col("_home") == 0, corner[0, j]).when(F.col("_home") == 1, corner[1, j]).otherwise(0.0)

    away = own.withColumn("_away", first(
        (F.col("_own") * F.col(f"_a{j}") + beside(j)) / F.col("_mass") == F.col("_best") for j in range(n)
    ))
    return away, F.concat_ws("-", F.col("_home").cast("string"), F.col("_away").cast("string")), F.col("_best")


def market_columns(lines=TOTAL_LINES, team_lines=(), max_goals: int = MAX_GOALS) -> dict[str, Column]:
    """market probabilities over the marginals added by ``_marginals``."""
    n = max_goals + 1
    h = [F.col(f"_h{k}") for k in range(n)]
    a = [F.col(f"_a{k}") for k in range(n)]
    mass = F.col("_mass")
    x00, x01, x10, x11 = (F.col(c) for c in ("_x00", "_x01", "_x10", "_x11"))
    out = {
        "home_win": (_total([h[i] * _total(a[:i]) for i in range(1, n)]) + x10) / mass,
        "draw": (_total([h[i] * a[i] for i in range(n)]) + x00 + x11) / mass,
        "away_win": (_total([a[j] * _total(h[:j]) for j in range(1, n)]) + x01) / mass,
        "btts_yes": (_total(h[1:]) * _total(a[1:]) + x11) / mass,
    }
    for line in lines:
        top = int(line)
        under = _total([h[i] * _total(a[: top - i + 1]) for i in range(top + 1)]) + x00
        if top >= 1:
            under = under + x01 + x10
        if top >= 2:
            under = under + x11
        suffix = str(line).replace(".", "_")
        out[f"over_{suffix}"] = 1 - under / mass
        out[f"under_{suffix}"] = under / mass
    for line in team_lines:
        top = int(line)
        suffix = str(line).replace(".", "_")
        home_under = _total(h[: top + 1]) * _total(a) + x00 + x01
        away_under = _total(a[: top + 1]) * _total(h) + x00 + x10
        if top >= 1:
            home_under = home_under + x10 + x11
            away_under = away_under + x01 + x11
        out[f"home_over_{suffix}"] = 1 - home_under / mass
        out[f"away_over_{suffix}"] = 1 - away_under / mass
    return out


def with_markets(
    df: DataFrame,
    home: str = "home_xg",
    away: str = "away_xg",
    *,
    team_lines=(),
    top_score: bool = False,
    max_goals: int = MAX_GOALS,
    rho: float = LOW_SCORE_RHO,
) -> DataFrame:
    """Add market probabilities, and the most likely score if asked."""
    base = _marginals(df, home, away, max_goals, rho)
    columns = dict(market_columns(team_lines=team_lines, max_goals=max_goals))
    if top_score:
        base, columns["most_likely_correct_score"], columns["most_likely_correct_score_probability"] = _most_likely(base, max_goals + 1)
        columns["score_probability_sum"] = (
            _total([F.col(f"_h{k}") for k in range(max_goals + 1)])
            * _total([F.col(f"_a{k}") for k in range(max_goals + 1)])
            + _total([F.col(x) for x in ("_x00", "_x01", "_x10", "_x11")])
        ) / F.col("_mass")
    return base.select(*df.columns, *[c.alias(n) for n, c in columns.items()])


def live_probabilities(home_score, away_score, minute) -> dict[str, Column]:
    """win / draw / loss from the current score and minute (unknown counts as 0)."""
    zero = F.lit(0)
    hs, as_, m = (F.coalesce(_col(c), zero) for c in (home_score, away_score, minute))
    left = F.greatest(zero, 90 - m)
    gap = hs - as_
    home = F.lit(1.0) / (F.exp(-(gap * LIVE_GOAL_WEIGHT + left / LIVE_TIME_SCALE)) + 1)
    draw = F.exp(F.abs(gap) * -LIVE_DRAW_DECAY) * (left / 90) * LIVE_DRAW_SHARE
    away = F.greatest(F.lit(0.0), 1 - home - draw)
    total = home + draw + away
    return {"home_win": home / total, "draw": draw / total, "away_win": away / total}
