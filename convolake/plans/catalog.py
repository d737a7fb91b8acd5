"""Registry of named queries: ``name -> (spark builder, oracle SQL)``.

A spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the driver tables; the oracle is DuckDB SQL over the same tables
(views from ``plans/oracle.py`` are added automatically) or ``None`` where
SQL cannot express the operator (rows-only check + unit fixture).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convolake.plans.oracle import with_views
from convolake.plans.views import Tables

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}

_MODULES = [
    "convolake.plans.q_interactions",
    "convolake.plans.q_curation",
    "convolake.plans.q_items",
    "convolake.plans.q_changes",
    "convolake.plans.q_adapters",
    "convolake.plans.q_labels",
    "convolake.plans.q_takeoff",
    "convolake.plans.q_documents",
    "convolake.plans.q_analytics",
    "convolake.plans.q_streaming",
]


def query(name: str, oracle: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = with_views(oracle)
        return fn
    return deco


def _load():
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Builder]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
