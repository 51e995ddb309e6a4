"""Dense, sparse and hybrid search.

Every leg is a top-k by score and id (``TakeOrderedAndProject``); ranks exist only among the k rows of a leg, so no
window sorts the corpus. Filters go below both legs, payload columns are joined last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import vectors
from tarn.operators import tokens


@dataclass(frozen=True)
class SearchConfig:
    """How legs are cut and fused."""

    fusion: str = "rrf"
    dense_multiplier: int = 4
    sparse_multiplier: int = 6
    use_tf: bool = True
    filename_boost: float = 2.0
    threshold: float | None = None
    rrf_k: int = 60


# Presets.
DEFAULT = SearchConfig()
CODE = SearchConfig(filename_boost=3.0, threshold=0.1)
RRF = SearchConfig(dense_multiplier=5, sparse_multiplier=7)
DOCUMENT = SearchConfig(fusion="dbsf", dense_multiplier=3, sparse_multiplier=4, filename_boost=1.5)


def branch_of(asked: Column, active: Column, default: Column) -> Column:
    """The branch that a search is about: the one asked for, else the active one, else the repository's default."""
    given = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(given(asked), given(active), given(default), F.lit("main"))


def dense_topk(points: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest; scores rounded to 6 digits, ties by id."""
    score, descending = vectors.METRICS[metric]
    scored = points.select(F.col(id_col).alias("id"), F.round(score(F.col(vector_col), vectors.literal(query)), 6).alias("score"))
    return scored.orderBy(F.desc("score") if descending else F.asc("score"), "id").limit(k)


def dense_threshold(points: DataFrame, query: Sequence[float], least: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    return points.select(F.col(id_col).alias("id"), F.round(vectors.cosine(F.col(vector_col), vectors.literal(query)), 6).alias("score")).where(F.col("score") >= least)


def sparse_scores(post: DataFrame, query: DataFrame, id_col: str, idf: bool = True, total: int | None = None) -> DataFrame:
    """(id, score): sum of query weight x term weight [x idf]. A query has few terms: its side is broadcast.

    The document frequency is counted over the same hits as the score: both read one shuffle.
    """
    hits = post.join(F.broadcast(query.withColumnRenamed("weight", "_q")), "term")
    part = F.col("weight") * F.col("_q")
    if idf:
        # counted with what the score needs too, so that the plan below is the same and runs once
        df = hits.groupBy("term").agg(F.count_if((F.col("weight") > 0) & F.col("_q").isNotNull() & F.col(id_col).isNotNull()).alias("df"))
        hits = hits.join(F.broadcast(df), "term")  # as many rows as the query has terms
        part = part * tokens.idf(F.lit(float(total)), F.col("df"))
    return hits.groupBy(F.col(id_col).alias("id")).agg(F.round(F.sum(part), 6).alias("score"))


def topk(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)


def ranked(leg: DataFrame) -> DataFrame:
    """A leg with ranks from 1. A leg has at most its limit of rows."""
    return leg.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def fuse_rrf(legs: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum over legs of 1 / (k + rank)."""
    parts = [ranked(leg).select("id", (F.lit(1.0) / (k + F.col("rank"))).alias("part")) for leg in legs]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"))


def fuse_dbsf(legs: Sequence[DataFrame]) -> DataFrame:
    """Distribution-based fusion: each leg's scores from mean - 3 sd to mean + 3 sd onto 0 to 1 (0.5 without spread), summed."""
    parts = []
    for leg in legs:
        w = W.partitionBy(F.lit(1))
        mean, sd = F.avg("score").over(w), F.coalesce(F.stddev_samp("score").over(w), F.lit(0.0))
        part = F.when(sd > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") - (mean - 3 * sd)) / (6 * sd)))).otherwise(0.5)
        parts.append(leg.select("id", part.alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"))


def dedup_keep_max(hits: DataFrame, keys: Sequence[str], score: str = "score", id_col: str = "id") -> DataFrame:
    """The best hit of each key; ties by id."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), id_col)
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def hybrid_search(points: DataFrame, post: DataFrame | Callable[[list[str]], DataFrame] | None, query: str, vector: Sequence[float], limit: int = 10, config: SearchConfig = DEFAULT, id_col: str = "id", vector_col: str = "embedding", total: int | None = None, where: Column | None = None, dedup: Sequence[str] = ()) -> DataFrame:
    """(id, score) of the best ``limit`` of a dense and a sparse leg; without postings, or terms in the query, the dense one alone.

    ``post`` is a table of postings, or a function that makes those of a few terms. ``where`` filters points and, through
    their ids, postings. ``dedup`` names columns of ``points`` of which one row each remains.
    """
    if where is not None:
        points = points.where(where)
    expanded = limit * 8
    legs = [dense_topk(points, vector, expanded * config.dense_multiplier, id_col=id_col, vector_col=vector_col)]
    query_weights = tokens.query_terms(points.sparkSession, query, config.use_tf, config.filename_boost)
    terms = [r["term"] for r in query_weights.select("term").collect()] if post is not None else []  # a query's
    if terms:
        found = post(terms) if callable(post) else post.where(F.col("term").isin(*terms))
        if where is not None:
            found = found.join(points.select(id_col), id_col, "left_semi")
        n = total if total is not None else points.count()
        legs.append(topk(sparse_scores(found, query_weights, id_col, total=n), expanded * config.sparse_multiplier))
    fused = fuse_dbsf(legs) if config.fusion == "dbsf" else fuse_rrf(legs, config.rrf_k)
    if config.threshold is not None:
        fused = fused.where(F.col("score") >= config.threshold)
    fused = topk(fused, expanded)
    if dedup:
        # the fused side has at most ``expanded`` rows
        payload = points.select(F.col(id_col).alias("id"), *dedup).join(F.broadcast(fused), "id")
        fused = dedup_keep_max(payload, dedup).select("id", "score")
    return topk(fused, limit)


def similar_items(points: DataFrame, k: int, queries: Column, id_col: str = "id", vector_col: str = "embedding", block: int = 4096, tile: int = 16_384) -> DataFrame:
    """(id, other, score, rank): the k nearest of the rows that ``queries`` selects, against all rows.

    One join of blocks of queries with tiles of rows: each pair of them is a task's matrix product, and only the k best of
    a tile leave it for each query. Both numbers follow from counts; nothing but these comes to the driver.
    """
    import numpy as np
    import pandas as pd

    rows = points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), queries.alias("asked"))
    n, m = rows.agg(F.count("*"), F.count_if("asked")).first()
    blocks, tiles = max(1, -(-m // block)), max(1, -(-n // tile))
    dealt = lambda side, of, other, own: rows.where(of).select(F.lit(side).alias("side"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
    asked = dealt(0, F.col("asked"), tiles, blocks).select("side", "id", "v", F.col("own").alias("b"), F.col("other").alias("t"))
    every = dealt(1, F.lit(True), blocks, tiles).select("side", "id", "v", F.col("other").alias("b"), F.col("own").alias("t"))

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("id")
        out = []
        if len(q) and len(x):
            ids, other, right = q.id.to_numpy(), x.id.to_numpy(), unit(x.v).T
            for at in range(0, len(q), 256):
                scores = np.round(unit(q.v.iloc[at : at + 256]) @ right, 6)
                scores[ids[at : at + 256, None] == other[None, :]] = -np.inf
                top = min(k, len(x))
                cut = np.partition(scores, len(x) - top, axis=1)[:, len(x) - top]
                for i, (row, least) in enumerate(zip(scores, cut)):
                    # ties with the last one are settled by id, which is the order of columns
                    near = np.flatnonzero(row >= least)
                    near = near[np.argsort(-row[near], kind="stable")][:top]
                    near = near[row[near] > -np.inf]
                    out.append(pd.DataFrame({"id": ids[at + i], "other": other[near], "score": row[near]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "score": []})

    kind = points.schema[id_col].dataType.simpleString()
    found = asked.unionByName(every).groupBy("b", "t").applyInPandas(best, f"id {kind}, other {kind}, score double")
    order = W.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def group_hits(hits: DataFrame, key: str, snippet: str, keep: int = 3) -> DataFrame:
    """Hits by a key: best score and the snippets of the best hits."""
    # the best of a key are ranked before they meet, so a key of many hits is no long row
    order = W.partitionBy(key).orderBy(F.desc("score"), "id")
    first = hits.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= keep)
    best = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", F.col(snippet).alias("x")))), lambda x: x["x"]).alias("snippets"))
    every = hits.groupBy(F.col(key).alias("_of")).agg(F.max("score").alias("score"), F.count("*").alias("n_hits"))
    return every.join(best, F.col("_of").eqNullSafe(F.col(key))).select(key, "score", "n_hits", "snippets")
