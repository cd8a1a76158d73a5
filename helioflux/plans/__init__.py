"""Every query of the library by name, with its SQL twin where there is one."""

from . import detect_queries, event_queries, record_queries, scalar_queries, series_queries, verify_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
