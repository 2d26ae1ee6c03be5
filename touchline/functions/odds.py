"""Odds and rating arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.scalars import _col, clip

# Fixed values of the rating model.
RATING_SCALE = 400.0
PENALTY_SCALE = 800.0
HOME_BASE_RATE, AWAY_BASE_RATE = 1.30, 1.10
RATE_SLOPE, RATE_SPREAD = 0.45, 1.5
RATE_FLOOR, RATE_CEILING = 0.25, 4.5
DRAW_BASE, DRAW_DECAY = 0.28, 2.0
EXPECTED_FLOOR, EXPECTED_CEILING = 0.02, 0.98


def decimal_odds(value, odds_format) -> Column:
    """decimal price of decimal, American or fractional odds; other formats fail."""
    text, kind = _col(value).cast("string"), F.lower(_col(odds_format))
    number = text.try_cast("double")
    american = F.when(number > 0, number / 100).otherwise(F.lit(100.0) / F.abs(number))
    top = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    bottom = F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return (
        F.when(kind == "decimal", number)
        .when(kind == "american", american + 1)
        .when(kind == "fractional", F.try_divide(top, bottom) + 1)
        .otherwise(
            F.raise_error(F.concat(F.lit("Unsupported odds format: "), kind)).cast("double")
        )
    )


def expected_value(probability, price) -> Column:
    """expected profit of a unit stake."""
    return _col(probability) * _col(price) - 1


def expected_score(rating, opponent, adjustment=0.0) -> Column:
    """expected score of a rating difference."""
    adjustment = adjustment if isinstance(adjustment, Column) else F.lit(float(adjustment))
    gap = _col(opponent) - _col(rating) - adjustment
    return F.lit(1.0) / (F.pow(F.lit(10.0), gap / RATING_SCALE) + 1)


def rating_outcome(expected) -> dict[str, Column]:
    """loss / draw / win probabilities of an expected score."""
    e = clip(F.coalesce(_col(expected), F.lit(0.5)), EXPECTED_FLOOR, EXPECTED_CEILING)
    draw = F.exp(F.abs(e - 0.5) * -DRAW_DECAY) * DRAW_BASE
    return {"loss": (1 - e) * (1 - draw), "draw": draw, "win": e * (1 - draw)}


def goal_rates(home_rating, away_rating) -> dict[str, Column]:
    """goal rates of both sides and the home side's shoot-out probability."""
    home, away = _col(home_rating), _col(away_rating)
    spread = clip((home - away) / RATING_SCALE, -RATE_SPREAD, RATE_SPREAD)
    shootout = F.lit(1.0) / (F.pow(F.lit(10.0), (away - home) / PENALTY_SCALE) + 1)
    return {
        "home_rate": clip(F.exp(spread * RATE_SLOPE) * HOME_BASE_RATE, RATE_FLOOR, RATE_CEILING),
        "away_rate": clip(F.exp(spread * -RATE_SLOPE) * AWAY_BASE_RATE, RATE_FLOOR, RATE_CEILING),
        "penalty_home": shootout,
    }
