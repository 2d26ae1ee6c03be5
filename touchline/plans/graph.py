"""Models with declared inputs: views for staging, catalog tables for marts.

A run builds every model after its inputs. Views are temporary. A table is written under a name of its own run, tested,
and only when all models of the run have passed do the published views ``schema.name`` turn to the new tables. A run that
fails takes back what it wrote and leaves the published marts as they were; readers never meet half a mart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.quality import violations
from touchline.plans.marts import (
    EVENT_DETAILS,
    RANKINGS,
    dim_competitions,
    dim_venues,
    grain_rules,
    match_context,
    stats_for_against,
)
from touchline.sources.io import register_views
from touchline.sources.tables import publish, version_name


@dataclass(frozen=True)
class Model:
    """``build`` takes one DataFrame for each input; ``saved`` models become tables and may carry rules."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    saved: bool = False
    rules: Sequence = field(default=())


class ModelError(ValueError):
    """A graph that can't be run, or a model that breaks its rules."""


def ordered(models: Sequence[Model], sources: Sequence[str]) -> list[Model]:
    """Models after their inputs; repeated names, missing inputs and cycles are errors."""
    named = {m.name: m for m in models}
    if len(named) < len(models) or set(named) & set(sources):
        raise ModelError("every model and source needs a name of its own")
    missing = sorted({f"{m.name} needs {i}" for m in models for i in m.inputs if i not in named and i not in sources})
    if missing:
        raise ModelError("missing inputs: " + ", ".join(missing))
    sorter = TopologicalSorter({m.name: [i for i in m.inputs if i in named] for m in models})
    try:
        return [named[n] for n in sorter.static_order()]
    except CycleError as error:
        raise ModelError("models need each other: " + " -> ".join(error.args[1])) from error


def upstream(models: Sequence[Model], names: Sequence[str]) -> list[Model]:
    """The named models and all that they need."""
    named = {m.name: m for m in models}
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name in named and name not in wanted:
            wanted.add(name)
            todo += named[name].inputs
    return [m for m in models if m.name in wanted]


def run_models(spark: SparkSession, models: Sequence[Model], sources: dict[str, DataFrame], schema: str) -> dict[str, DataFrame]:
    """Build all models; the saved ones are published in ``schema``, an existing schema of the catalog."""
    run = uuid.uuid4().hex
    built = dict(sources)
    written: dict[str, str] = {}
    views = {}
    try:
        for model in ordered(models, list(sources)):
            df = model.build(*[built[i] for i in model.inputs])
            if not model.saved:
                built[model.name] = views[model.name] = df
                continue
            name = version_name(schema, model.name, run)
            written[model.name] = name
            df.write.format("parquet").saveAsTable(name)
            built[model.name] = spark.table(name)
            if model.rules:
                broken = violations(built[model.name], model.rules).where("violations > 0").orderBy("rule").collect()
                if broken:
                    raise ModelError(f"{model.name}: " + "; ".join(f"{r['rule']} ({r['violations']})" for r in broken))
    except Exception:
        for name in written.values():
            spark.sql(f"drop table if exists {name}")
        raise
    register_views(views)
    publish(spark, schema, written)
    return {m.name: spark.table(f"{schema}.{m.name}") if m.saved else built[m.name] for m in models}


def _named(columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*[F.col(f"`{c}`") for c in columns])


def _same(df: DataFrame) -> DataFrame:
    return df


#: Canonical inputs of the warehouse models.
SOURCES = ["raw.fct_matches", "raw.fct_team_matches", "raw.fct_team_match_stats", "raw.dim_teams"]


def warehouse_models() -> list[Model]:
    """The staging views, the marts and the context features."""
    return [
        Model("stg_events", ("raw.fct_matches",), _same),
        Model("stg_teams", ("raw.dim_teams",), _same),
        Model("stg_team_match_stats", ("raw.fct_team_match_stats",), _same),
        Model("stg_event_details", ("stg_events",), _named(EVENT_DETAILS)),
        Model("stg_rankings", ("stg_events",), _named(RANKINGS)),
        Model("int_team_match_perspective", ("raw.fct_team_matches",), _same),
        Model("int_stats_for_against", ("stg_team_match_stats",), stats_for_against),
        Model("fct_matches", ("stg_events",), _same, True, grain_rules("fct_matches")),
        Model("fct_team_matches", ("int_team_match_perspective",), _same, True, grain_rules("fct_team_matches")),
        Model("fct_team_match_stats", ("int_stats_for_against",), _same, True, grain_rules("fct_team_match_stats")),
        Model("dim_teams", ("stg_teams",), _same, True, grain_rules("dim_teams")),
        Model("dim_competitions", ("stg_events",), dim_competitions, True),
        Model("dim_venues", ("stg_event_details",), dim_venues, True),
        Model("feat_match_context", ("fct_matches",), match_context, True),
    ]
