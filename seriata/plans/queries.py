"""All registered queries of the library outside ``llm``."""

from __future__ import annotations

from . import series_queries, structure_queries, validation_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
