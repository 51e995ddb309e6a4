"""Search engines over conversations: by meaning (vectors of their parts) and by text."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.embedding import EmbeddingProvider, HashedTokens, embed, query_vector, valid
from tarn.operators import conversations, search
from tarn.operators.neighbours import nearest_neighbours

#: Parts of conversations that one search takes, for each conversation asked for; characters of a title that stand for a snippet.
PARTS, TITLE = 10, 100


class ConversationSearchEngine(Protocol):
    def index(self, conversations: DataFrame) -> DataFrame:
        """The parts of conversations as they are searched."""

    def search(self, parts: DataFrame, summaries: DataFrame, query: str, limit: int = 10, where: Column | None = None) -> DataFrame:
        """(conv_id, title, score, snippet, last_active, snippets), best first."""


class SemanticEngine:
    """Parts are embedded by a provider; the nearest ones, joined with summaries, are grouped by conversation."""

    def __init__(self, make: Callable[[], EmbeddingProvider] = HashedTokens, metric: str = "cosine"):
        self.make, self.metric = make, metric

    def index(self, conversations_: DataFrame) -> DataFrame:
        """(id, conv_id, kind, position, content, embedding) of ``conversations.content_rows``; blank parts are left out."""
        parts = conversations.content_rows(conversations_).where(valid(F.col("content")))
        return parts.withColumn("id", F.concat_ws("/", "conv_id", "kind", "position")).withColumn("embedding", embed(self.make)("content"))

    def search(self, parts: DataFrame, summaries: DataFrame, query: str, limit: int = 10, where: Column | None = None) -> DataFrame:
        if where is not None:
            summaries = summaries.where(where)
            parts = parts.join(summaries.select("conv_id"), "conv_id", "left_semi")
        hits = search.dense_topk(parts, query_vector(query, self.make), limit * PARTS, self.metric)
        # as many rows as the top has
        payload = parts.select("id", "conv_id", "content").join(F.broadcast(hits), "id")
        return results(payload, summaries, limit)


class TextEngine:
    """Parts that hold the query count 1, others the share of its words that they hold."""

    def index(self, conversations_: DataFrame) -> DataFrame:
        return conversations.content_rows(conversations_).withColumn("id", F.concat_ws("/", "conv_id", "kind", "position"))

    def search(self, parts: DataFrame, summaries: DataFrame, query: str, limit: int = 10, where: Column | None = None) -> DataFrame:
        summaries = summaries.where(where) if where is not None else summaries
        scored = parts.withColumn("score", F.round(conversations.text_similarity(F.col("content"), query), 6)).where("score > 0")
        top = scored.join(summaries.select("conv_id"), "conv_id", "left_semi").orderBy(F.desc("score"), "id").limit(limit * PARTS)
        return results(top.select("id", "conv_id", "content", "score"), summaries, limit)


def results(hits: DataFrame, summaries: DataFrame, limit: int) -> DataFrame:
    """Hits (id, conv_id, content, score) by conversation, joined with ``summaries`` (conv_id, title, last_active)."""
    best_first = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "content"))), lambda x: x["content"])
    grouped = hits.groupBy("conv_id").agg(F.max("score").alias("score"), best_first.alias("snippets"))
    joined = summaries.select("conv_id", "title", "last_active").join(F.broadcast(grouped), "conv_id")
    snippet = F.coalesce(F.get("snippets", 0), F.substring("title", 1, TITLE))
    return joined.select("conv_id", "title", "score", snippet.alias("snippet"), "last_active", "snippets").orderBy(F.desc("score"), "conv_id").limit(limit)


def similar_conversations(parts: DataFrame, conv_id, k: int = 5) -> DataFrame:
    """(conv_id, score, rank): other conversations whose title is nearest to this one's."""
    titles = parts.where("kind = 'title'").select("conv_id", "embedding")
    own = titles.where(F.col("conv_id") == F.lit(conv_id)).select("embedding").first()
    if own is None:
        return parts.sparkSession.createDataFrame([], "conv_id long, score double, rank int")
    near = search.dense_topk(titles.where(F.col("conv_id") != F.lit(conv_id)), own["embedding"], k, id_col="conv_id")
    return near.select(F.col("id").alias("conv_id"), "score", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))


def all_similar_conversations(parts: DataFrame, k: int = 5) -> DataFrame:
    """(conv_id, other, score, rank): for every conversation the k others whose titles are nearest."""
    titles = parts.where("kind = 'title'").select("conv_id", "embedding")
    found, _ = nearest_neighbours(titles, k, "conv_id")
    return found.select(F.col("id").alias("conv_id"), "other", "score", "rank")
