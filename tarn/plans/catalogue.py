"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from tarn.plans import code_queries, conversation_queries, event_queries, file_queries, further_queries, index_queries, more_queries, repository_queries, search_queries, streaming_queries  # noqa: F401
from tarn.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
