"""Collects the query modules."""

from plinth.plans import clones, dependencies, flow, graphs, metrics, report, similarity  # noqa: F401
from plinth.plans.registry import ORACLE, QUERIES  # noqa: F401
