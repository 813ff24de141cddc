"""Queries of this repository, one per operator, each with SQL that states the same result."""

from tidemark_queries import (  # noqa: F401
    cataloging,
    cleaning,
    comparing,
    hashing,
    runs,
    sources,
    validation,
    versions,
)
from tidemark_queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
