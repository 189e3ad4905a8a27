"""Importing this package registers every query."""

from panelmark.queries import extraction, history, ledger, rules, scalars, streams  # noqa: F401
from panelmark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
