"""Registered queries over the driver tables, with their DuckDB oracles."""

from lintel.catalog import capability, companies, files, leads, permits, reviews, seals, streams  # noqa: F401
from lintel.catalog.registry import ORACLES, QUERIES  # noqa: F401
