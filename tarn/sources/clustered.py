"""A stored index of vectors: every vector in the list of its nearest centroid, one folder a list."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators import neighbours, search
from tarn.sources.commits import CommitLog


class ClusteredVectors:
    """Vectors (id, embedding) in lists around centroids, searched by cosine.

    ``search`` reads the lists of the ``probes`` nearest centroids and ranks them exactly: approximate, of a recall to be
    measured. ``search_exactly`` reads what it must: its first lists give the k-th best score, then every list goes whose
    bound (triangle inequality on the list's least and greatest distance) does not reach it; the result is that of a search
    of all rows. Vectors that are null or zero score 0 and are in list -1, which every search reads; those with null or
    non-finite numbers compare with nothing and are left out.

    ``add`` puts more vectors around the same centroids and commits by one rename.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, CommitLog(spark, path)

    def build(self, points: DataFrame, lists: int, id_col: str = "id", vector_col: str = "embedding") -> None:
        """Makes the index anew: centroids from a bounded sample, all vectors in lists."""
        version, _ = self.log.current()
        folder = f"lists-{uuid.uuid4().hex}"
        centroids = neighbours.fitted(points, lists, id_col, vector_col)
        name = f"centroids-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/{name}")
        self._write(points, centroids, folder, id_col, vector_col)
        self.log.commit(version, {"centroids": name, "folders": [folder]})

    def add(self, points: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> None:
        """Adds vectors; ids are taken to be new."""
        version, state = self.log.current()
        if state is None:
            raise ValueError(f"there is no index at {self.path}")
        folder = f"lists-{uuid.uuid4().hex}"
        self._write(points, self._centroids(state), folder, id_col, vector_col)
        self.log.commit(version, {**state, "folders": [*state["folders"], folder]})

    def _write(self, points: DataFrame, centroids: np.ndarray, folder: str, id_col: str, vector_col: str) -> None:
        finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
        rows = neighbours.assigned(points.where(F.coalesce(finite, F.lit(True))), centroids, id_col, vector_col)
        # a list of many rows is several files
        dealt = rows.select("id", F.col("v").alias("embedding"), "distance", "list").repartition("list", F.pmod(F.xxhash64("id"), F.lit(4)))
        dealt.sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{self.path}/{folder}")
        written = self.spark.read.parquet(f"{self.path}/{folder}")
        written.groupBy("list").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.path}/{folder}-sizes")

    def _centroids(self, state: dict) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/{state['centroids']}").orderBy("list").collect()  # bounded by the number of lists
        return np.array([r["centroid"] for r in found])

    def lists(self) -> neighbours.Lists:
        """What bounds the lists: as many numbers as there are lists."""
        state = self._state()
        centroids = self._centroids(state)
        near, far, size = np.full(len(centroids), np.inf), np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
        for folder in state["folders"]:
            for r in self.spark.read.parquet(f"{self.path}/{folder}-sizes").where("list >= 0").collect():
                i = r["list"]
                near[i], far[i], size[i] = min(near[i], r["near"]), max(far[i], r["far"]), size[i] + r["n"]
        return neighbours.Lists(centroids, np.where(size > 0, near, 0.0), far, size)

    def _state(self) -> dict:
        _, state = self.log.current()
        if state is None:
            raise ValueError(f"there is no index at {self.path}")
        return state

    def rows(self, lists: Sequence[int] | None = None) -> DataFrame:
        """(id, embedding, distance, list) of some lists, and of -1: a filter on folders."""
        out = None
        for folder in self._state()["folders"]:
            one = self.spark.read.parquet(f"{self.path}/{folder}")
            one = one.where(F.col("list").isin(-1, *map(int, lists))) if lists is not None else one
            out = one if out is None else out.unionByName(one)
        return out

    def _unit(self, vector: Sequence[float]) -> np.ndarray | None:
        v = np.asarray(vector, np.float64)
        n = np.linalg.norm(v)
        return v[None] / n if n > 0 else None

    def calibrate(self, k: int = 10, recall: float = 0.95, queries: int = 64) -> int:
        """How many lists a search must read for a recall at k, measured on a bounded sample of rows; kept with the index."""
        state, held, rows = self._state(), self.lists(), self.rows()
        asked = rows.where("list >= 0").orderBy(F.xxhash64(F.lit(1), "id")).limit(queries).select("embedding").toArrow()
        if not asked.num_rows:
            return 1
        q = neighbours.scaled(asked.column("embedding").combine_chunks())

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = q @ neighbours.scaled(batch.column("embedding")).T
                top = np.argsort(-scores, axis=1)[:, :k]
                query = np.repeat(np.arange(len(q)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(scores[query, top.ravel()]), batch.column("list").take(pa.array(top.ravel()))], ["query", "score", "list"])

        found = rows.where("list >= 0").select("embedding", "list").mapInArrow(best, "query long, score double, list int")
        kept = found.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") <= k).collect()  # k rows a query
        rank = np.argsort(np.argsort(np.where(held.size > 0, held.distances(q), np.inf), axis=1), axis=1)
        needed = np.sort([rank[r["query"], r["list"]] for r in kept])
        probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
        self.log.commit(self.log.current()[0], {**state, "probes": probes})
        return probes

    def search(self, vector: Sequence[float], k: int = 10, probes: int | None = None) -> DataFrame:
        """(id, score) of the best k in the lists nearest to a vector (as many as ``calibrate`` has found, else 8)."""
        unit, held = self._unit(vector), self.lists()
        probes = probes or self._state().get("probes", 8)
        near = np.argsort(np.where(held.size > 0, held.distances(unit)[0], np.inf))[:probes] if unit is not None else range(probes)
        return search.dense_topk(self.rows(list(near)), vector, k)

    def search_exactly(self, vector: Sequence[float], k: int = 10, probes: int = 4) -> DataFrame:
        """(id, score) of the best k of all."""
        return search.dense_topk(self.rows(self.reached(vector, k, probes)), vector, k)

    def reached(self, vector: Sequence[float], k: int, probes: int = 4) -> list[int] | None:
        """The lists that may hold one of the best k (None: all)."""
        unit = self._unit(vector)
        if unit is None:
            return None
        first = self.search(vector, k, probes).collect()
        if len(first) < k:
            return None
        held = self.lists()
        return np.flatnonzero(held.best(unit)[0] >= first[-1]["score"] - neighbours.GIVE).tolist()

    def vacuum(self) -> list[str]:
        """Deletes what no reader is led to any more."""
        state = self._state()
        used = {f for folder in state["folders"] for f in (folder, f"{folder}-sizes")}
        return self.log.vacuum(used, "lists-") + self.log.vacuum({state["centroids"]}, "centroids-")
