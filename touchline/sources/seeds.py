"""Fixed lookup tables as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Confederation of each national team, by source spelling. A team
# listed under two confederations keeps the later one.
CONFEDERATIONS = {
    "UEFA": [
        "Albania", "Andorra", "Austria", "Azerbaijan", "Belarus", "Belgium", "Bosnia & Herzegovina", "Bulgaria",
        "Croatia", "Czechia", "Czechoslovakia", "Denmark", "England", "Estonia", "Finland", "France", "Germany",
        "Greece", "Hungary", "Iceland", "Ireland", "Israel", "Italy", "Kazakhstan", "Kosovo", "Latvia",
        "Liechtenstein", "Lithuania", "Luxembourg", "Malta", "Moldova", "Montenegro", "Netherlands",
        "North Macedonia", "Northern Ireland", "Norway", "Poland", "Portugal", "Romania", "Russia", "San Marino",
        "Scotland", "Serbia", "Slovakia", "Slovenia", "Spain", "Sweden", "Switzerland", "Türkiye", "Ukraine",
        "USSR", "Wales", "West Germany", "Yugoslavia",
    ],
    "CONMEBOL": ["Argentina", "Brazil", "Chile", "Colombia", "Ecuador", "Paraguay", "Peru", "Uruguay"],
    "CONCACAF": ["Costa Rica", "Honduras", "Mexico", "Panama", "Trinidad and Tobago", "USA"],
    "CAF": [
        "Algeria", "Cameroon", "Côte d'Ivoire", "DR Congo", "Egypt", "Ghana", "Morocco", "Nigeria", "Senegal",
        "Tunisia",
    ],
    "AFC": ["Australia", "Iran", "Japan", "Kuwait"],
    "OFC": ["New Zealand"],
}
# Host countries per competition class and year.
HOSTS = {
    "world_cup": {
        1966: ["england"],
        1970: ["mexico"],
        1974: ["germany"],
        1978: ["argentina"],
        1982: ["spain"],
        1986: ["mexico"],
        1990: ["italy"],
        1994: ["united states"],
        1998: ["france"],
        2002: ["japan", "south korea"],
        2006: ["germany"],
        2010: ["south africa"],
        2014: ["brazil"],
        2018: ["russia"],
        2022: ["qatar"],
        2026: ["canada", "mexico", "united states"],
    },
    "continental_championship": {
        1968: ["italy"],
        1980: ["italy"],
        1988: ["germany"],
        1992: ["sweden"],
        1996: ["england"],
        2000: ["belgium", "netherlands"],
        2004: ["portugal"],
        2008: ["austria", "switzerland"],
        2012: ["poland", "ukraine"],
        2016: ["france"],
        2021: [
            "azerbaijan", "denmark", "england", "germany", "hungary", "italy", "netherlands", "romania", "russia",
            "scotland", "spain",
        ],
        2024: ["germany"],
    },
    "nations_league": {2019: ["portugal"], 2021: ["italy"]},
}


def confederation_table(spark: SparkSession) -> DataFrame:
    """F8: ``(team, confederation)``."""
    rows = [(team, name) for name, teams in CONFEDERATIONS.items() for team in teams]
    return spark.createDataFrame(rows, "team string, confederation string")


def host_table(spark: SparkSession) -> DataFrame:
    """``(competition_type, year, country)``."""
    rows = [(kind, year, c) for kind, years in HOSTS.items() for year, cs in years.items() for c in cs]
    return spark.createDataFrame(rows, "competition_type string, year int, country string")
