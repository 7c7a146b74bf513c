"""Registered queries over the given tables, and their SQL."""

from . import claims, guard, intake, queues, reports, serving, stores, text, upkeep, vectors
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "claims", "guard", "intake", "queues", "reports", "serving", "stores", "text", "upkeep", "vectors"]
