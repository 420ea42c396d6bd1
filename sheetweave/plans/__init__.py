"""Queries over the driver tables; importing this package registers all of them."""

from . import answer_queries, more_queries, plant_queries, run_queries, split_queries  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
