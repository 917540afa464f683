"""Readers and writers."""
from .tables import spread, table

__all__ = ["spread", "table"]
