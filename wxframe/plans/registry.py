"""Query registry: name -> (Spark builder, DuckDB twin or None)."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..sources import fixtures
from .views_sql import with_views

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

_MODULES = ["q_frames", "q_clean", "q_levels", "q_serving", "q_stats", "q_timegrid",
            "q_anomaly", "q_spatial"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


_VIEW_CACHE: dict = {}


def _session_views(spark: SparkSession) -> dict:
    """The plans of the live session; those of an ended one are let go."""
    app = spark.sparkContext.applicationId
    if _VIEW_CACHE.get("app") != app or _VIEW_CACHE.get("session") is not spark:
        _VIEW_CACHE.clear()
        _VIEW_CACHE.update(app=app, session=spark, plans={})
    return _VIEW_CACHE["plans"]


class Views:
    """Fixture views for one (session, data folder).

    A view's DataFrame (a lazy plan, no data) is built once per session and
    folder and shared by the queries that use it, which saves re-analysing
    the same fixture plan for every query.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        fn = fixtures.VIEWS.get(f"v_{name}")
        if fn is None:
            raise AttributeError(name)
        plans, key = _session_views(self.spark), (self.spark.conf.get("spark.sql.session.timeZone"), self.sf_dir, name)
        if key not in plans:
            plans[key] = fn(self.spark, self.sf_dir)
        return plans[key]


def _load():
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query relies on, applied to whatever session runs it:
    naive timestamps are UTC wall clock, and workers can import the package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def _prepared(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: _prepared(v[0]) for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: with_views(v[1]) for k, v in REGISTRY.items() if v[1]}
