"""Every operator bound to the given tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from touchline.catalog.base import ORACLES, QUERIES

MODULES = ["canonical", "history", "joins", "stats", "aggregates", "odds", "payloads", "quality", "streams", "models", "lake", "warehouse"]


def _load():
    for name in MODULES:
        import_module(f"touchline.catalog.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
