"""Merkle trees of file manifests: hashes by directory, and differences that descend only where hashes differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import checkpointed


def merkle_tree(manifest: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(node, parent, depth, leaf, hash, files) of all files and directories of a manifest; the root is '' at depth 0.

    Made level by level from the deepest: the entries of a directory are hashed in 256 buckets by their names' hashes
    (sorted lines ``name:hash``, a directory's name with a slash), and the directory is the hash of its buckets (sorted
    lines ``bucket:hash``), so a directory of a million files is 256 groups. As many rounds as paths have parts. An empty
    manifest has no root. Null hashes count as empty ones.
    """
    path = F.col(key)
    leaves = manifest.where(path.isNotNull()).select(path.alias("node"), F.regexp_replace(path, "/?[^/]*$", "").alias("parent"), (F.length(path) - F.length(F.replace(path, F.lit("/"))) + 1).alias("depth"), F.lit(True).alias("leaf"), F.coalesce(value, F.lit("")).alias("hash"), F.lit(1).cast("long").alias("files"))
    leaves = checkpointed(leaves)
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    levels, dirs = [], None
    for depth in range(deepest, 0, -1):
        level = leaves.where(F.col("depth") == depth)
        level = checkpointed(level.unionByName(dirs)) if dirs is not None else level
        levels.append(level)
        name = F.regexp_extract("node", "[^/]*$", 0)
        lines = lambda first: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(first, "hash"))), lambda x: F.concat(x["name"], F.lit(":"), x["hash"])), "\n")
        inner = level.withColumn("name", F.when(F.col("leaf"), name).otherwise(F.concat(name, F.lit("/")))).groupBy("parent", F.substring(F.sha2("name", 256), 1, 2).alias("bucket")).agg(F.sha2(lines("name"), 256).alias("hash"), F.sum("files").alias("files"))
        outer = inner.withColumnRenamed("bucket", "name").groupBy("parent").agg(F.sha2(lines("name"), 256).alias("hash"), F.sum("files").alias("files"))
        above = F.regexp_replace("parent", "/?[^/]*$", "")
        dirs = outer.select(F.col("parent").alias("node"), above.alias("parent"), F.lit(depth - 1).alias("depth"), F.lit(False).alias("leaf"), "hash", "files")
    out = checkpointed(dirs) if dirs is not None else leaves
    for level in levels:
        out = out.unionByName(level)
    return out


def tree_difference(old: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """(path, status): files added, modified or deleted between two trees, and how many nodes were compared.

    A directory whose hashes are equal is not entered. ``old`` and ``new`` are read once a level; they should be tables.
    """
    side = lambda tree, depth, mark: tree.where(F.col("depth") == depth).select("node", "parent", "leaf", F.col("hash").alias(mark))
    frontier, found, compared, depth = None, None, 0, 0
    while True:
        a, b = side(old, depth, "a"), side(new, depth, "b")
        if frontier is not None:
            inside = frontier.select(F.col("node").alias("parent"))
            a, b = a.join(inside, "parent", "left_semi"), b.join(inside, "parent", "left_semi")
        met = checkpointed(a.drop("parent").join(b.drop("parent"), ["node", "leaf"], "full"))
        compared += met.count()
        changed = met.where(~F.col("a").eqNullSafe(F.col("b")))
        status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("modified")
        files = changed.where("leaf").select(F.col("node").alias("path"), status.alias("status"))
        found = files if found is None else found.union(files)
        frontier = changed.where("not leaf")
        if frontier.isEmpty():
            return found, compared
        depth += 1
