"""Registered queries: the operators applied to the test tables, with equivalent SQL."""

from . import browse, catalog, localize, pages, publish, queue, resolve, search, stores  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
