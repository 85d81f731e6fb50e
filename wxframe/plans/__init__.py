"""Registered queries: each operator applied to the fixture views, with its SQL twin."""

from .registry import REGISTRY, oracle_sql, queries  # noqa: F401
