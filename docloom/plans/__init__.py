"""Queries of the library's operators, by name."""

from . import audits, columns, containers, documents, headers, packing, places, queries, revisions, streams, tables, tabular, templates, terms, turns, woven  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
