"""All registered queries of the archive."""

from castleflow import payload_queries, queries  # noqa: F401  they register themselves
from castleflow.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
