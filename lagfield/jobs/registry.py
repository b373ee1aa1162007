"""The registered queries on the driver tables and their DuckDB counterparts."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
