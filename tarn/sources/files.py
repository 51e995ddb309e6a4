"""Sources: folders, trees and tables as ``files`` rows; readers of other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import fixed
from tarn.functions.text import extension, glob_match, hidden, ignored_by_map, in_target, lookup

#: Fixed value: larger files are not chunked.
MOST_BYTES = 5 * 1024 * 1024


def folder(spark: SparkSession, path: str, extensions: list[str] | None = None, repo: str = "", branch: str = "main") -> DataFrame:
    """``files`` (repo, branch, file_path, language, size, modified, text) below a folder: no dot entries, no ``target``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    inner = F.substring(name, len(path.rstrip("/")) + 2, 1 << 30)
    files = raw.select(F.lit(repo).alias("repo"), F.lit(branch).alias("branch"), inner.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return visible(files, extensions).withColumn("text", F.decode("content", "UTF-8")).drop("content").withColumn("language", language_of("file_path"))


def language_of(path: str):
    return lookup(F.lower(extension(F.col(path))), fixed.PARSER_LANGUAGES, "fallback")


def visible(files: DataFrame, extensions: list[str] | None = None, path: str = "file_path") -> DataFrame:
    files = files.where(~hidden(F.col(path)) & ~in_target(F.col(path)))
    return files.where(F.lower(extension(F.col(path))).isin([e.lower() for e in extensions])) if extensions is not None else files


def tree(files: DataFrame, commit: str | None = None, path: str = "file_path") -> DataFrame:
    """Files of a commit's tree that are indexed."""
    if commit is not None:
        files = files.where(F.col("commit_hash") == commit)
    return files.where(F.lower(extension(F.col(path))).isin(*fixed.TREE_EXTENSIONS))


def for_map(files: DataFrame, paths: list[str] | None = None, file_extension: str | None = None, content: str | None = None, path: str = "file_path") -> DataFrame:
    """Files of a repository map; ``content`` is looked for literally."""
    files = files.where(~ignored_by_map(F.col(path)) & extension(F.col(path)).isin(*fixed.MAP_EXTENSIONS))
    if paths:
        files = files.where(F.greatest(*(F.col(path).startswith(p) for p in [*paths, paths[0]])))
    if file_extension:
        files = files.where(F.col(path).endswith(file_extension))
    return files.where(F.col("text").contains(content)) if content else files


def matching(files: DataFrame, glob: str, case_sensitive: bool = True, path: str = "file_path") -> DataFrame:
    return files.where(glob_match(F.col(path), glob, case_sensitive))


def chunkable(files: DataFrame, text: str = "text") -> DataFrame:
    return files.where(F.octet_length(text) <= MOST_BYTES)


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table of any format that Spark reads."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def stream(spark: SparkSession, path: str, schema, form: str = "parquet", per_batch: int = 1) -> DataFrame:
    """A folder as a stream of its files."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_batch).load(path)
