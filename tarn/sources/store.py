"""Sinks: chunks, vectors and vocabularies as Parquet tables partitioned by repository and branch."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.operators import search
from tarn.session import checkpointed
from tarn.sources.commits import CommitLog


class Store(Protocol):
    """What an engine needs of a collection of points; ``VectorStore`` is one on Parquet."""

    def exists(self) -> bool: ...
    def ensure(self, schema: str | None = None) -> bool: ...
    def create(self, schema: str) -> None: ...
    def drop(self) -> None: ...
    def points(self) -> DataFrame: ...
    def upsert(self, points: DataFrame) -> None: ...
    def delete(self, where: Column) -> None: ...
    def count(self) -> int: ...
    def info(self) -> DataFrame: ...
    def languages(self, repo: str, branch: str) -> list[str]: ...
    def scroll(self, after=None, limit: int = 1000, where: Column | None = None) -> DataFrame: ...
    def search(self, vector: Sequence[float], limit: int = 10, where: Column | None = None, metric: str = "cosine", threshold: float | None = None) -> DataFrame: ...


class VectorStore:
    """A collection of points (id, repo, branch, .., dense) in a folder.

    A change writes the branches that it touches into a folder of its own (``commit-..``) and then becomes visible by one
    rename (``CommitLog``): a reader sees all of it or nothing, also where a point moves between branches, and a writer that
    dies leaves what was. Rows are sorted by the ``indexed`` columns within a branch and those columns carry Bloom filters,
    so a filter on a path reads the row groups that may have it.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, vector: str = "dense", key: str = "id", indexed: Sequence[str] = ("file_path", "language"), row_group: int | None = None):
        self.spark, self.path, self.dim, self.vector, self.key = spark, path, dim, vector, key
        self.indexed, self.row_group, self.log = tuple(indexed), row_group, CommitLog(spark, path)

    def exists(self) -> bool:
        return self.log.current()[1] is not None

    def points(self) -> DataFrame:
        _, state = self.log.current()
        if state is None:
            raise ValueError(f"there is no collection at {self.path}")
        return self._read(state, None)

    def _read(self, state: dict, some: list[tuple[str, str]] | None) -> DataFrame:
        """The points of a state, or those of some of its branches: filters on partitions of the folders that have them."""
        schema = StructType.fromJson(state["schema"])
        out = None
        for folder, branches in state["folders"].items():
            wanted = [b for b in map(tuple, branches) if some is None or b in some]
            if wanted:
                one = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").where(self._among(wanted)).select(*schema.names)
                out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], schema) if out is None else out

    @staticmethod
    def _among(branches: list[tuple[str, str]]) -> Column:
        by_repo: dict[str, list[str]] = {}
        for repo, branch in branches:
            by_repo.setdefault(repo, []).append(branch)
        return reduce(lambda a, b: a | b, ((F.col("repo") == r) & F.col("branch").isin(*b) for r, b in by_repo.items()))

    def ensure(self, schema: str | None = None) -> bool:
        """Whether the collection is there with its dimension; one of another dimension is dropped. With a schema it is made."""
        _, state = self.log.current()
        fits = state is not None and state["dim"] == self.dim
        if state is not None and not fits:
            self.drop()
        if not fits and schema is not None:
            self.create(schema)
        return fits

    def create(self, schema: str) -> None:
        """An empty collection."""
        self.drop()
        self.log.commit(0, {"dim": self.dim, "schema": self.spark.createDataFrame([], schema).schema.jsonValue(), "folders": {}})

    def drop(self) -> None:
        self.log.remove("")

    def _commit(self, version: int, state: dict | None, points: DataFrame, touched: list[tuple[str, str]]) -> None:
        """Writes ``points``, all that the touched branches hold from now on, and makes them what is read."""
        folder = f"commit-{uuid.uuid4().hex}"
        order = [c for c in ("repo", "branch", *self.indexed) if c in points.columns]
        writer = points.repartition("repo", "branch", F.pmod(F.xxhash64(self.key), F.lit(64))).sortWithinPartitions(*order).write.partitionBy("repo", "branch")
        for c in self.indexed:
            if c in points.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if self.row_group:
            writer = writer.option("parquet.block.size", str(self.row_group))
        writer.parquet(f"{self.path}/{folder}")
        left = self._names(points.select("repo", "branch").distinct())
        folders = {f: kept for f, held in (state["folders"] if state else {}).items() if (kept := [b for b in held if tuple(b) not in touched])}
        if left:
            folders[folder] = [list(b) for b in left]
        self.log.commit(version, {"dim": self.dim, "schema": points.schema.jsonValue(), "folders": folders})

    def upsert(self, points: DataFrame) -> None:
        """Adds points; those of the same id are replaced. Of rows of one id, one (of the greatest hash) comes in."""
        if points.isEmpty():
            return
        bad = points.where(~F.coalesce(F.size(self.vector) == self.dim, F.lit(False)) | F.col(self.key).isNull())
        if not bad.isEmpty():
            raise ValueError(f"points must have an id and vectors of {self.dim} dimensions")
        last = W.partitionBy(self.key).orderBy(F.desc(F.xxhash64(*points.columns)))
        points = checkpointed(points.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n"))
        version, state = self.log.current()
        branches = points.select("repo", "branch")
        if state is None:
            self._commit(version, None, points, [])
            return
        # the branches that points come to, and those that hold an older point of the same id
        held = self._read(state, None).join(points.select(self.key), self.key, "left_semi").select("repo", "branch")
        touched = self._names(branches.union(held).distinct())
        old = self._read(state, touched).join(points.select(self.key), self.key, "left_anti")
        self._commit(version, state, checkpointed(old.unionByName(points, allowMissingColumns=True)), touched)

    def delete(self, where: Column) -> None:
        """Deletes points. Only branches that hold some are read in full and written."""
        version, state = self.log.current()
        if state is None:
            return
        touched = self._names(self._read(state, None).where(where).select("repo", "branch").distinct())
        if touched:
            self._commit(version, state, checkpointed(self._read(state, touched).where(~F.coalesce(where, F.lit(False)))), touched)

    def vacuum(self) -> list[str]:
        """Deletes what no reader is led to any more."""
        _, state = self.log.current()
        return self.log.vacuum(set(state["folders"]) if state else set(), "commit-")

    def _names(self, branches: DataFrame) -> list[tuple[str, str]]:
        return sorted({(r["repo"], r["branch"]) for r in branches.collect()})  # a row per branch

    def _of(self, branches: list[tuple[str, str]]) -> DataFrame:
        """The points of some branches."""
        return self._read(self.log.current()[1], branches)

    def delete_files(self, repo: str, branch: str, paths: Sequence[str]) -> None:
        self.delete((F.col("repo") == repo) & (F.col("branch") == branch) & F.col("file_path").isin(*paths))

    def delete_branch(self, repo: str, branch: str) -> None:
        self.delete((F.col("repo") == repo) & (F.col("branch") == branch))

    def count(self) -> int:
        return self.points().count() if self.exists() else 0

    def info(self) -> DataFrame:
        return self.points().groupBy("repo", "branch").agg(F.count("*").alias("points"))

    def languages(self, repo: str, branch: str) -> list[str]:
        """Distinct languages of a branch, in order."""
        return [r[0] for r in self._of([(repo, branch)]).where("language is not null").select("language").distinct().orderBy("language").collect()]  # a few

    def scroll(self, after=None, limit: int = 1000, where: Column | None = None) -> DataFrame:
        """The next points in the order of ids."""
        df = self.points()
        df = df.where(where) if where is not None else df
        return (df.where(F.col(self.key) > after) if after is not None else df).orderBy(self.key).limit(limit)

    def search(self, vector: Sequence[float], limit: int = 10, where: Column | None = None, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
        df = self.points()
        found = search.dense_topk(df.where(where) if where is not None else df, vector, limit, metric, self.key, self.vector)
        return found.where(F.col("score") >= threshold) if threshold is not None else found


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vocabulary_json(vocab: DataFrame, most: int = 1_000_000) -> str:
    """A small vocabulary as JSON, in the order of ids."""
    rows = vocab.orderBy("term_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} terms; save it as a table")
    return json.dumps({r["term"]: r["term_id"] for r in rows}, ensure_ascii=False)


def collections(spark: SparkSession, root: str) -> list[str]:
    """Names of the collections in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []
