"""A collection of points with a dense and a sparse side, searched by both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import search
from tarn.sources.inverted import InvertedIndex
from tarn.sources.store import VectorStore


class Collection:
    """Points (id, repo, branch, .., text, dense) whose vectors are in a ``VectorStore`` and whose terms in an ``InvertedIndex``.

    A change is made to the sparse side first and to the points last. Points are what counts: postings of ids that are no
    points (what a writer has left that died between the two) are not found, and the next upsert of such an id replaces them.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, buckets: int = 64):
        self.spark = spark
        self.store = VectorStore(spark, f"{path}/points", dim)
        self.index = InvertedIndex(spark, f"{path}/terms", buckets)

    def upsert(self, points: DataFrame, text: str = "text", name: Column | None = None) -> None:
        """Adds points, or replaces those of the same id; ``name`` is the file name whose terms count twice."""
        self.index.upsert_texts(points, "id", F.coalesce(text, F.lit("")), name)
        self.store.upsert(points)

    def delete(self, where: Column) -> None:
        """Deletes points by a condition on their columns."""
        gone = self.store.points().where(where).select("id")
        self.index.delete(gone)
        self.store.delete(where)

    def count(self) -> int:
        return self.store.count()

    def search(self, query: str, vector: Sequence[float], limit: int = 10, config: search.SearchConfig = search.DEFAULT, where: Column | None = None, dedup: Sequence[str] = ()) -> DataFrame:
        """(id, score): both sides fused; the sparse one reads the buckets of the query's terms."""
        # with a condition, postings of what is no point are left out as well
        return search.hybrid_search(self.store.points(), self.index.postings, query, vector, limit, config, vector_col="dense", where=F.lit(True) if where is None else where, dedup=dedup)

    def compact(self) -> None:
        """One segment of terms, and nothing that no reader is led to."""
        self.index.compact()
        self.index.vacuum()
        self.store.vacuum()
