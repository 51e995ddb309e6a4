"""Lists of vectors around centroids, and exact nearest neighbours of all rows by bounds on distances of lists.

Vectors are scaled to length one, so the cosine of two is 1 - d^2 / 2 of their distance d, and the triangle inequality bounds
it for whole lists: what is between ``near`` and ``far`` from a centroid is at least max(0, d(q, c) - far, near - d(q, c))
from q. Vectors that cannot be scaled (null, empty, zero, or with null or non-finite numbers) are in list -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.session import checkpointed

#: Rows of the sample for each list; steps of its clustering; what a bound gives way (scores have 6 digits).
SAMPLE, STEPS, GIVE = 64, 8, 2e-6
#: Rows that one task compares with others; shelves that small tables are dealt to at least; numbers of a product, or rows that
#: leave a task, at once.
TILE, SHELVES, CELLS, SENT = 16_384, 16, 1 << 19, 4096


@dataclass(frozen=True)
class Lists:
    """Centroids of length one and, for each, the least and greatest distance and the number of its members."""

    centroids: np.ndarray
    near: np.ndarray
    far: np.ndarray
    size: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ self.centroids.T)))

    def best(self, x: np.ndarray) -> np.ndarray:
        """For rows and lists, the greatest cosine that a member can have; -inf for empty lists."""
        d = self.distances(x)
        gap = np.maximum(0.0, np.maximum(d - self.far, self.near - d) - 1e-7)
        return np.where(self.size > 0, 1 - gap * gap / 2, -np.inf)


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def scaled(column: pa.Array) -> np.ndarray:
    """Vectors of one length, each scaled to length one."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def parts(rows: int, others: int) -> Iterator[slice]:
    """Slices of rows, each as long as its product with ``others`` has ``CELLS`` numbers at most (a row at least)."""
    step = max(1, CELLS // max(1, others))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid and its cosine."""
    own, cosine = np.empty(len(x), np.int64), np.empty(len(x))
    for part in parts(len(x), len(centroids)):
        product = x[part] @ centroids.T
        own[part], cosine[part] = np.argmax(product, axis=1), product.max(axis=1)
    return own, cosine


def fitted(points: DataFrame, lists: int, id_col: str = "id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids fitted on a sample of at most ``SAMPLE`` rows a list (those of least hash): spherical k-means.

    All vectors must have the length of the sample's first; a longer or shorter one raises.
    """
    sample = points.where(usable(F.col(vector_col))).orderBy(F.xxhash64(id_col), id_col).limit(lists * SAMPLE).select(F.col(vector_col).cast("array<double>").alias("v")).toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    x = scaled(sample.column("v").combine_chunks())
    centroids = x[: min(lists, len(x))].copy()
    for _ in range(STEPS):
        own, _ = nearest_centroids(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centroids)
    return centroids


def assigned(points: DataFrame, centroids: np.ndarray, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id, v, list (of the nearest centroid; -1: none) and distance from its centroid."""
    kind = points.schema[id_col].dataType.simpleString()
    rows = points.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), usable(F.col(vector_col)).alias("fit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, distance = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            fit = np.flatnonzero(np.asarray(batch.column("fit")))
            if len(fit) and len(centroids):
                own[fit], cosine = nearest_centroids(scaled(batch.column("v").take(pa.array(fit))), centroids)
                distance[fit] = np.sqrt(np.maximum(0.0, 2 - 2 * cosine))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(distance)], ["id", "v", "list", "distance"])

    return rows.mapInArrow(run, f"id {kind}, v array<double>, list int, distance double")


def measured(rows: DataFrame, centroids: np.ndarray) -> Lists:
    """The lists of ``rows(list, distance)``: as many numbers as there are lists."""
    n = len(centroids)
    near, far, size = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for r in rows.where("list >= 0").groupBy("list").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.count("*").alias("n")).collect():
        near[r["list"]], far[r["list"]], size[r["list"]] = r["near"], r["far"], r["n"]
    return Lists(centroids, near, far, size)


def shelved(held: Lists, most: int) -> np.ndarray:
    """For each list its shelf: lists one after another, from each to the nearest that is left, as long as ``most`` rows hold them."""
    shelf, left, now, filled = np.full(len(held.size), -1), held.size > 0, 0, 0
    at = int(np.argmax(held.size)) if len(left) else 0
    while left.any():
        if filled and filled + held.size[at] > most:
            now, filled = now + 1, 0
        shelf[at], left[at] = now, False
        filled += int(held.size[at])
        at = int(np.argmax(np.where(left, held.centroids @ held.centroids[at], -np.inf)))
    return shelf


def _tops(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray) -> tuple[list, list, list]:
    """(id, other, score) of the k best of ``x`` for each query, none below its ``least``. ``ids`` ascend: ties go by id."""
    out: tuple[list, list, list] = ([], [], [])
    right = np.ascontiguousarray(x.T)
    top = min(k + 1, len(ids))
    for part in parts(len(q), len(ids)):
        scores, bar = q[part] @ right, least[part, None]
        scores[query_ids[part, None] == ids[None]] = -np.inf
        near = scores >= bar - GIVE
        if not np.isfinite(bar).all() or near.sum() > 32 * len(scores):
            scores = np.round(scores, 6)
            cut = np.maximum(np.partition(scores, len(ids) - top, axis=1)[:, len(ids) - top :][:, :1], bar)
            tied = scores == cut
            near = (scores > cut) | (tied & (np.cumsum(tied, axis=1) <= k))
        row, column = np.nonzero(near)
        value = np.round(scores[row, column], 6)
        order = np.lexsort((column, -value, row))
        row, column, value = row[order], column[order], value[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        good = (rank < k) & (value > -np.inf) & (value >= least[part][row])
        out[0].append(query_ids[part][row[good]])
        out[1].append(ids[column[good]])
        out[2].append(value[good])
    return out


def nearest_neighbours(points: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", lists: int | None = None) -> tuple[DataFrame, float]:
    """(id, other, score, rank): the k nearest rows (cosine, 6 digits, ties by id) of every row, exactly; the share of pairs compared.

    Near lists share a shelf, of ``TILE`` rows at most unless one list has more. Each row's k-th best score within a tile of
    its own shelf is a threshold. A row then goes to those shelves only that have a list whose bound reaches its threshold, so
    what is clustered compares little and what is not compares all pairs in tiles, as a plain product would: a row is copied
    once a tile then, not once a list. Members and visitors of a shelf are dealt in tiles; a task holds two of them.

    Rows that cannot be scaled have no neighbours and are none's; rows of one id are not neighbours. ids must be numbers.
    """
    n = points.count()
    wanted = lists or max(1, min(4096, round(n**0.5)))
    centroids = fitted(points, wanted, id_col, vector_col)
    width = points.schema[vector_col].dataType.simpleString()  # as narrow as they came; products are of doubles
    rows = checkpointed(assigned(points, centroids, id_col, vector_col).where("list >= 0 and id is not null").withColumn("v", F.col("v").cast(width)))
    held = measured(rows, centroids)
    shelf = shelved(held, max(1, min(TILE, -(-n // SHELVES))))
    firsts = np.flatnonzero(np.diff(np.sort(shelf), prepend=-2) * (np.sort(shelf) >= 0))  # where shelves begin among lists ordered by shelf
    by_shelf, total = np.argsort(shelf, kind="stable"), np.bincount(shelf[shelf >= 0], held.size[shelf >= 0]).astype(int)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, other {kind}, score double"
    spark = rows.sparkSession
    places = spark.createDataFrame([(i, int(c), int(-(-total[c] // TILE))) for i, c in enumerate(shelf) if c >= 0], "list int, shelf int, tiles int")  # a row for each list
    members = rows.join(F.broadcast(places), "list").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))

    def within(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, x = np.asarray(t.column("id")), scaled(t.column("v").combine_chunks())
        out = [np.concatenate(c) for c in _tops(ids, x, ids, x, k, np.full(len(ids), -np.inf))]
        return pa.table(out, ["id", "other", "score"])

    own = members.select("id", "v", "shelf", "tile").groupBy("shelf", "tile").applyInArrow(within, schema)
    bar = own.groupBy("id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("bar"))
    barred = checkpointed(members.select("id", "v").join(bar, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0))))

    def routed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Parts of a batch with places of rows in them and the shelves that these go to."""
        for some in parts(batch.num_rows, len(held.size)):
            part = batch.slice(some.start, some.stop - some.start)
            best = np.maximum.reduceat(held.best(scaled(part.column("v")))[:, by_shelf], firsts, axis=1)
            yield part, *np.nonzero(best >= np.asarray(part.column("bar"))[:, None] - GIVE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visits = np.zeros(len(total), np.int64)
        for batch in batches:
            for _, _, to in routed(batch):
                visits += np.bincount(to, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(visits)], ["shelf", "n"])

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, to in routed(batch):
                for first in range(0, len(row), SENT):
                    at = pa.array(row[first : first + SENT])
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("v").take(at), part.column("bar").take(at), pa.array(to[first : first + SENT], pa.int32())], ["id", "v", "bar", "shelf"])

    # routes are found twice, which costs less than to keep all the copies
    count = {r["shelf"]: r["n"] for r in barred.select("v", "bar").mapInArrow(counted, "shelf int, n long").groupBy("shelf").agg(F.sum("n").alias("n")).collect()}
    compared = sum(c * int(total[i]) for i, c in count.items())
    blocks = spark.createDataFrame([(i, int(-(-s // TILE)), int(max(1, -(-count.get(i, 0) // TILE)))) for i, s in enumerate(total)], "shelf int, tiles int, blocks int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visits = barred.select("id", "v", "bar").mapInArrow(routes, f"id {kind}, v {width}, bar double, shelf int")
    asked = visits.join(F.broadcast(blocks), "shelf").select("shelf", each("tiles").alias("tile"), F.pmod(F.xxhash64(F.lit(5), "id"), "blocks").cast("int").alias("block"), F.lit(0).alias("side"), "id", "v", "bar")
    there = members.drop("tiles").join(F.broadcast(blocks), "shelf").select("shelf", "tile", each("blocks").alias("block"), F.lit(1).alias("side"), "id", "v", F.lit(-2.0).alias("bar"))

    def across(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("id", "ascending")]).combine_chunks()
        split = int(np.searchsorted(np.asarray(t.column("side")), 1))
        ids, x = np.asarray(t.column("id")), scaled(t.column("v").combine_chunks())
        if not 0 < split < len(ids):
            return pa.table([ids[:0], ids[:0], np.empty(0)], ["id", "other", "score"])
        out = [np.concatenate(c) for c in _tops(ids[:split], x[:split], ids[split:], x[split:], k, np.asarray(t.column("bar"))[:split])]
        return pa.table(out, ["id", "other", "score"])

    found = asked.unionByName(there).groupBy("shelf", "tile", "block").applyInArrow(across, schema)
    order = W.partitionBy("id").orderBy(F.desc("score"), "other")
    best = found.dropDuplicates(["id", "other"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best, compared / max(1, n * n)
