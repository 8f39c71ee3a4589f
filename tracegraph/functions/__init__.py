"""Scalar functions: identifiers, JSON text, payload states."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from ..schema import CONTENT_STATES, DERIVED_LENGTH, DERIVED_PREFIX


canonical_json = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode
"""The one JSON encoding: sorted keys, no spaces, characters as they are."""


def derived_id(adapter: Column, trace_id: Column, source_key: Column) -> Column:
    """The id of a span whose dialect gave it none of its own."""
    material = F.concat_ws("\0", adapter, F.coalesce(trace_id, F.lit("")), source_key)
    return F.concat(F.lit(DERIVED_PREFIX), F.left(F.sha2(material, 256), F.lit(DERIVED_LENGTH)))


def json_text(c: Column) -> Column:
    """A string column as JSON text; null stays null."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def has_content(payload: Column) -> Column:
    return payload["state"].isin(*CONTENT_STATES)


def start_key(started_at: Column) -> Column:
    """Nodes without a start sort last; NaN after them."""
    return F.coalesce(started_at, F.lit(float("inf")))
