"""Queries that bind the operators to the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries by name."""
    from plinth.plans import tables

    return tables.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL of the registered queries by name."""
    from plinth.plans import tables

    return tables.ORACLE
