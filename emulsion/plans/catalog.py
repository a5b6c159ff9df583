"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from . import detect_queries, effect_queries, file_queries, frame_queries, layout_queries, order_queries, pixel_queries, region_queries, roll_queries, source_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
