"""Canonical JSON and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """JSON text with keys sorted at every level."""
    return F.to_json(F.parse_json(text))


def content_hash(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(text), 256)


def digest(*values: Column, length: int = 64) -> Column:
    """SHA-256 of values joined by a unit separator; null is marked apart from empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(v.cast("string"), F.lit("\x00")) for v in values))
    return F.substring(F.sha2(joined, 256), 1, length)
