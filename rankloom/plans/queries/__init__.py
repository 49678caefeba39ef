"""Registered queries: one entry per operator, each with its expected result in SQL."""

from rankloom.plans.queries import features, files, ranking, retrieval, schema, texts  # noqa: F401
from rankloom.plans.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
