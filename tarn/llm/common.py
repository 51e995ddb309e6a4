"""What several operators need: Arrow mapping, lineage cuts and the parallel order of rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one call of a Python kernel, in code points.
SLICE_CHARS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the ``shared_folder``.

    Spark removes the files when the frame is garbage (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a batch-to-batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield kernel(part)

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most about ``limit`` bytes of its column ``text`` (one row at least)."""
    if "text" not in batch.schema.names or batch.nbytes <= limit:
        if batch.num_rows:
            yield batch
        return
    sizes = pc.binary_length(batch.column("text")).to_pylist()
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + (n or 0) > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n or 0
    yield batch.slice(first)


def bucket(column: Column, n: int) -> Column:
    """A bucket from 0 to n-1 by hash."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, else what ``setCheckpointDir`` was given.

    Only a session on one machine that has neither (tests) gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    given, held = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if given or held.isDefined():
        return given or held.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "tarn-checkpoints")


def text_hashes(*parts: Column) -> list[Column]:
    """128 bits of hash of the text (or of ``parts``, none null) as two columns.

    With the id they tell a row from others. Rows equal in id and text are one document that came twice: whatever is
    decided about one holds for both.
    """
    parts = parts or (F.coalesce("text", F.lit("")),)
    return [F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)]


def with_hashes(docs: DataFrame, *parts: Column, names: tuple[str, str] = ("h1", "h2")) -> DataFrame:
    return docs.withColumns(dict(zip(names, text_hashes(*parts))))


def beside(docs: DataFrame, decided: DataFrame, how: str, *parts: Column) -> DataFrame:
    """_doc (a row of ``docs`` as a struct) joined with ``decided(doc_id, h1, h2, ...)``, whose other columns get a ``_``.

    Rows meet by id, null like others, and by ``text_hashes(*parts)``, so rows that share an id get their own decisions.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"), *(h.alias(n) for h, n in zip(text_hashes(*parts), ("_h1", "_h2"))))
    right = decided.toDF(*(f"_by_{c}" if c in ("doc_id", "h1", "h2") else f"_{c}" for c in decided.columns))
    return whole.join(right, F.expr("_id <=> _by_doc_id and _h1 = _by_h1 and _h2 = _by_h2"), how)


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that the optimiser does not copy into the expressions (and loops) that use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and where; what a failed write leaves goes."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tarn-{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        return spark.read.parquet(path), path
    except BaseException:
        removed(spark, path)
        raise


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, one whose path ``written`` gave."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` (a few narrow columns, read twice) marked for a broadcast if it has no more than ``most`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder while the block runs."""
    table, path = written(df, name)
    try:
        yield table
    finally:
        removed(df.sparkSession, path)
