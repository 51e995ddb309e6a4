"""Session and path helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tarn", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings every query here assumes (UTC, AQE on)."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus or os.environ.get('BENCH_CPUS', '*')}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the ``shared_folder``."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A path in the shared folder, deleted at the end of the block: what is read from it must be settled by then."""
    path = f"{shared_folder(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
