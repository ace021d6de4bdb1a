"""Registered queries over the lead tables."""

from . import queries_sources, queries_tables, queries_text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_sources", "queries_tables", "queries_text"]
