"""Every registered query and the SQL that checks it."""

from __future__ import annotations

from . import geo_queries, list_queries, quality_queries, registry_queries, source_queries, stream_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "point_query"
