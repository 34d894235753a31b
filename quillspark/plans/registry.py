"""Registered queries by operator id, and their SQL."""

from __future__ import annotations

from . import answer_queries, catalogue_queries, evaluation_queries, filter_queries, landing_queries, search_queries, stream_queries
from .tables import Query

_PARTS = (search_queries, filter_queries, catalogue_queries, evaluation_queries, answer_queries, landing_queries, stream_queries)
QUERIES: dict[str, Query] = {name: q for part in _PARTS for name, q in part.R.queries.items()}
ORACLES: dict[str, str] = {name: s for part in _PARTS for name, s in part.R.oracles.items()}
FLAGSHIP = "qry3_lexical_search"
