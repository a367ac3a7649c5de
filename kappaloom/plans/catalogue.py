"""All registered queries of the library, with the SQL that each must equal."""

from __future__ import annotations

from . import agreement, grouping, io, ordering, statistics, temporal, texts, validation
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "agreement", "grouping", "io", "ordering", "statistics", "temporal", "texts", "validation"]
