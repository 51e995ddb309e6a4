"""Snapshots of file sets: differences, roots, sync decisions, incremental re-indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import fixed
from tarn.functions.text import extension


def content_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256)


def file_hash(content: Column, modified: Column) -> Column:
    """SHA-256 of size (8 bytes, little endian), content and modification time (8 bytes, little endian)."""

    def little(n: Column) -> Column:
        return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(n.cast("long")), 16, "0"), 15 - 2 * i, 2) for i in range(8))))

    body = content.cast("binary")
    return F.sha2(F.concat(little(F.octet_length(body)), body, little(modified)), 256)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Paths that a manifest leaves out: ``*.ext``, a substring, an exact name, and all below .git."""
    out = path.rlike(r"(^|/)\.git(/|$)")
    for p in patterns:
        out = out | (path.endswith(p[1:]) if p.startswith("*.") else path.contains(p))
    return out


def diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(path, status) with added, modified, deleted or unchanged."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), new.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    joined = a.join(b, key, "full_outer")
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return joined.select(key, status.alias("status"))


def changed(differences: DataFrame) -> DataFrame:
    return differences.where("status <> 'unchanged'")


def with_renames(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(path, status, old_path): an added path whose content was deleted elsewhere is renamed; the least old path counts."""
    d = diff(old, new, key, value)
    gone = d.where("status = 'deleted'").join(old.select(key, value), key).groupBy(value).agg(F.min(key).alias("old_path"))
    come = d.where("status = 'added'").join(new.select(key, value), key).join(gone, value, "left")
    first = come.groupBy("old_path").agg(F.min(key).alias("_first"))
    renamed = come.join(first, "old_path", "left").select(key, F.when(F.col("old_path").isNotNull() & (F.col(key) == F.col("_first")), F.col("old_path")).alias("old_path"))
    out = d.join(renamed, key, "left")
    sources = renamed.where("old_path is not null").select(F.col("old_path").alias(key), F.lit(True).alias("_moved"))
    out = out.join(sources, key, "left").where("_moved is null")
    return out.select(key, F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("status")).alias("status"), "old_path")


def merkle_root(manifest: DataFrame, by: list[str] | None = None, key: str = "path", value: str = "hash") -> DataFrame:
    """SHA-256 of path and hash of all files in the order of paths, for each group ``by``.

    A root is one hash over all of a group's pairs: as many bytes as its manifest has meet in one place.
    """
    pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: F.concat(x[key], x[value])), "")
    grouped = manifest.groupBy(*by) if by else manifest.groupBy()
    return grouped.agg(F.count("*").alias("files"), F.sha2(pairs, 256).alias("root"))


def supported(path: Column) -> Column:
    return F.coalesce(F.lower(extension(path)).isin(*fixed.TREE_EXTENSIONS), F.lit(False))


def sync_decision(repos: DataFrame) -> DataFrame:
    """``repos`` (commit, last_commit, forced) with sync_type: full, incremental or none."""
    kind = F.when(F.col("forced") | F.col("last_commit").isNull(), "full").when(F.col("commit") == F.col("last_commit"), "none").otherwise("incremental")
    return repos.withColumn("sync_type", kind)


def touched(differences: DataFrame, key: str = "path") -> DataFrame:
    """Paths whose chunks go before new ones come: changed, deleted and where renamed files were."""
    paths = changed(differences).select(key)
    if "old_path" in differences.columns:
        paths = paths.union(differences.where("old_path is not null").select("old_path"))
    return paths.distinct()


def incremental(chunks: DataFrame, new_chunks: DataFrame, differences: DataFrame, key: str = "path") -> DataFrame:
    """Chunks after a sync: those of untouched files, and new ones of files that were added, modified or renamed."""
    keep = chunks.join(touched(differences, key), key, "left_anti")
    come = new_chunks.join(differences.where("status in ('added', 'modified', 'renamed')").select(key).distinct(), key, "left_semi")
    return keep.unionByName(come)


def index_lists(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths to index, paths to delete) of tree deltas (kind, old_path, new_path)."""
    index = deltas.where(F.col("kind").isin("added", "modified", "renamed", "copied", "typechange")).select(F.col("new_path").alias("path"))
    delete = deltas.where(F.col("kind").isin("deleted", "renamed")).select(F.col("old_path").alias("path"))
    return index.distinct(), delete.distinct()


def collection_name(prefix: str, repo: Column, branch: Column) -> Column:
    return F.concat(F.lit(prefix), repo, F.lit("_br_"), F.substring(F.sha2(branch, 256), 1, 8))


def switch_lists(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths to add, paths to delete) when a branch is switched: a rename deletes the old path, a change of type is passed over."""
    add = deltas.where(F.col("kind").isin("added", "modified", "renamed", "copied")).select(F.col("new_path").alias("path"))
    delete = deltas.where(F.col("kind").isin("deleted", "renamed")).select(F.col("old_path").alias("path"))
    return add.distinct(), delete.distinct()
