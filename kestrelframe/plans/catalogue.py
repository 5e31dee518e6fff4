"""Operators bound to the driver's tables: one named query each, with DuckDB SQL where SQL can express it."""

from . import missions, points, roundtrips, surfaces, telemetry
from .binding import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "missions", "points", "roundtrips", "surfaces", "telemetry"]
