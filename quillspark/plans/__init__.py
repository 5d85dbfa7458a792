"""Registered queries; importing this package fills ``catalog``."""

from . import corpus, listings, logs, pages, responses, search  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
