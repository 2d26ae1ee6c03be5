"""Scalar column functions: text, time, numbers, nullable flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tokens, classes, aliases and weights below have to equal the
# ones used by existing data sets for results to match.
CONTINENTAL_TOKENS = ["euro", "copa am", "africa cup", "asian cup", "gold cup"]
RATING_IMPORTANCE = {
    "friendly": 10,
    "nations_league": 20,
    "continental_qualifier": 25,
    "world_cup_qualifier": 30,
    "continental_championship": 40,
    "world_cup": 50,
    "other": 20,
}
COMPETITION_IMPORTANCE = {
    "friendly": 1,
    "nations_league": 2,
    "continental_qualifier": 3,
    "world_cup_qualifier": 4,
    "continental_championship": 5,
    "world_cup": 6,
}
COUNTRY_ALIASES = {
    "usa": "united states",
    "united states of america": "united states",
    "korea republic": "south korea",
    "republic of korea": "south korea",
    "czech republic": "czechia",
    "ivory coast": "côte d'ivoire",
    "turkiye": "türkiye",
}
COUNTRY_ALIASES_LEGACY = {
    "bosnia & herzegovina": "bosnia and herzegovina",
    "cote d'ivoire": "ivory coast",
    "côte d'ivoire": "ivory coast",
    "c�te d'ivoire": "ivory coast",
    "england": "england",
    "korea republic": "south korea",
    "republic of ireland": "ireland",
    "turkiye": "turkey",
    "türkiye": "turkey",
    "t�rkiye": "turkey",
    "united states": "united states",
    "usa": "united states",
    "west germany": "germany",
}
PERIOD_ALIASES = {
    "ALL": "ALL",
    "1ST": "1ST",
    "2ND": "2ND",
    "EXTRA": "ET",
    "ET": "ET",
    "ET1": "ET1",
    "ET2": "ET2",
}
FRACTION_PATTERN = r"^\s*(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)\s*\((-?\d+(?:\.\d+)?)%\)\s*$"
PERCENT_PATTERN = r"^\s*(-?\d+(?:\.\d+)?)%\s*$"
KNOCKOUT_PATTERN = "final|knockout|round of|quarter|semi"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(value, table: dict, default: Column | None = None) -> Column:
    """Map through a small literal table; unknown keys give ``default`` or null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), _col(value))
    return found if default is None else F.coalesce(found, default)


def _any_contains(text: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in tokens])


def classify_competition(name) -> Column:
    """one of seven competition classes, first matching rule wins."""
    text = F.lower(F.coalesce(_col(name), F.lit("")))
    qualifying = text.contains("qual")
    global_cup = _any_contains(text, ["world cup", "world championship"])
    return (
        F.when(text.contains("friendly"), "friendly")
        .when(text.contains("nations league"), "nations_league")
        .when(global_cup & qualifying, "world_cup_qualifier")
        .when(qualifying, "continental_qualifier")
        .when(global_cup, "world_cup")
        .when(_any_contains(text, CONTINENTAL_TOKENS), "continental_championship")
        .otherwise("other")
    )


def classify_competition_legacy(*names) -> Column:
    """narrower rules over the joined tournament, unique tournament and season text."""
    text = F.lower(F.concat_ws(" ", *[_col(n) for n in names]))
    return (
        F.when(text.contains("friendly"), "friendly")
        .when(text.contains("nations league"), "nations_league")
        .when(
            _any_contains(text, ["world cup qual", "world championship qual"]),
            "world_cup_qualifier",
        )
        .when(_any_contains(text, ["qualification", "qualifier"]), "continental_qualifier")
        .when(_any_contains(text, ["world cup", "world championship"]), "world_cup")
        .when(text.contains("euro"), "continental_championship")
        .otherwise("other")
    )


def infer_stage(round_name, tournament) -> Column:
    """the round name, else a stage read from the tournament text."""
    text = F.lower(F.coalesce(_col(tournament), F.lit("")))
    derived = (
        F.when(text.contains("qualification playoff"), "Qualification playoff")
        .when(_any_contains(text, ["qualification", "qual."]), "Qualification group")
        .when(text.contains("knockout"), "Knockout")
        .when(text.contains("finals"), "Finals")
        .when(_any_contains(text, ["group", "gr."]), "Group stage")
    )
    return F.coalesce(_col(round_name), derived)


def normalize_country(name, aliases: dict[str, str] = COUNTRY_ALIASES) -> Column:
    """trimmed, lower-cased country name with known aliases replaced."""
    cleaned = F.lower(F.trim(_col(name)))
    return lookup(cleaned, aliases, cleaned)


def epoch_to_timestamp(value) -> Column:
    """unix time in seconds, or in milliseconds when too large for seconds."""
    number = _col(value).cast("double")
    return F.timestamp_seconds(F.when(F.abs(number) > 1e10, number / 1000).otherwise(number))


def parse_day(text, pattern: str = "dd-MM-yyyy") -> Column:
    """day text to date, null when malformed."""
    return F.try_to_timestamp(_col(text), F.lit(pattern)).cast("date")


def safe_numeric(text) -> Column:
    """tolerant number parse; thousands commas and ``p%`` understood, else null."""
    cleaned = F.regexp_replace(F.trim(_col(text)), ",", "")
    percent = F.regexp_extract(cleaned, PERCENT_PATTERN, 1)
    return F.when(percent != "", percent.try_cast("double") / 100).otherwise(
        cleaned.try_cast("double")
    )


def fraction_part(text, part: int) -> Column:
    """won (1), total (2) or percentage (3) of ``a/b (p%)``, else null."""
    found = F.regexp_extract(F.coalesce(_col(text), F.lit("")), FRACTION_PATTERN, part)
    return F.nullif(found, F.lit("")).try_cast("double")


def ratio(numerator, denominator) -> Column:
    """division that gives null on a zero denominator."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def normalize_period(period) -> Column:
    """upper-cased period code with aliases replaced."""
    code = F.upper(F.coalesce(_col(period), F.lit("")))
    return lookup(code, PERIOD_ALIASES, code)


def to_number(value) -> Column:
    """Number, or null when the value does not parse."""
    return _col(value).try_cast("double")


def nullable_equal(left, right) -> Column:
    """1/0, null when either side is unknown."""
    return (_col(left) == _col(right)).cast("int")


def nullable_flag(condition: Column, available: Column) -> Column:
    """1/0 where ``available``, null elsewhere."""
    return F.when(available, F.coalesce(condition, F.lit(False)).cast("int"))


def clip(value, low=None, high=None) -> Column:
    """F32: limit to [low, high]; null stays null."""
    out = _col(value)
    known = out.isNotNull()
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(known, out)


def is_stale(observed, now, seconds: int = 60) -> Column:
    """true when the observation is older than ``seconds`` at ``now``."""
    return F.unix_micros(_col(now).cast("timestamp")) - F.unix_micros(
        _col(observed).cast("timestamp")
    ) > F.lit(seconds * 1_000_000)


def unix_micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp or (UTC) naive timestamp."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def host_flag(country, hosts_known: Column, is_host: Column) -> Column:
    """1/0 host flag, null when the country or the host list is unknown."""
    return F.when(_col(country).isNotNull() & hosts_known, is_host.cast("int"))


def attach_host_flags(
    df: DataFrame, hosts: DataFrame, *, competition: str, year: Column, countries: dict[str, str]
) -> DataFrame:
    """join the host list ``(competition_type, year, country)`` and add one
    tri-state flag per entry of ``countries`` (new column -> country column)."""
    lists = hosts.groupBy(
        F.col("competition_type").alias("_host_type"), F.col("year").alias("_host_year")
    ).agg(F.collect_set("country").alias("_hosts"))
    joined = df.join(
        lists, (F.col(competition) == F.col("_host_type")) & (year == F.col("_host_year")), "left"
    )
    known = F.col("_hosts").isNotNull()
    flags = [
        host_flag(country, known, F.array_contains("_hosts", F.col(country))).alias(name)
        for name, country in countries.items()
    ]
    return joined.select(*df.columns, *flags)
