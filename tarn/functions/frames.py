"""Helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that the optimiser does not copy into the expressions (and loops over arrays) that use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores at least: a small table may be one split, and its texts work for all.

    Only tables of fewer bytes than a file split for each core are dealt anew.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * split and df.rdd.getNumPartitions() < cores else df
