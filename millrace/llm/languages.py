"""The language a path claims."""

from __future__ import annotations

from pyspark.sql import Column

from millrace.operators.discovery import language


def language_of(path: Column) -> Column:
    """The language of the path's suffix; null for others."""
    return language(path)
