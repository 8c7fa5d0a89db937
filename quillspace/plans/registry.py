"""All queries and their SQL."""

from __future__ import annotations

from . import library_queries  # noqa: F401  adds its own
from .catalogue import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
