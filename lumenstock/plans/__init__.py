"""All registered queries."""

from . import audits, catalogue, compare, discovery, ingest, leads, matching, offers, review  # noqa: F401
from .registry import QUERIES
from .registry import oracle as ORACLE_SQL

__all__ = ["QUERIES", "ORACLE_SQL"]
