"""Connected components of link tables, and components of everything that shares buckets and passes a test.

Both work on narrow rows of ids with aggregations and equi-joins; neither brings links or components to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed, few, scratch

#: What one task compares with one another: so many texts, or (with few long ones) so many code points.
TILE, TILE_CHARS = 1024, 16_000_000


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for all ids of ``links(a, b)``; a component is named by its smallest id.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014): O(log^2 n) rounds; the rows of a hub only
    take part in a minimum (combined before the shuffle) and in joins that can be split.
    """
    edges, state = _settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"))
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v")))
        before = state
        edges, state = _settled(small)
        if before == state:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges, cut from what made them, and their number and the sum of their hashes (from the same pass)."""
    seen = Observation()
    marks = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    out = checkpointed(edges.distinct().observe(seen, *marks))
    return out, (seen.get.get("n", 0), seen.get.get("s"))


def shared_buckets(members: DataFrame) -> DataFrame:
    """The rows of ``members(key, id)`` whose key more than one id has. ``members`` is read twice and may repeat rows."""
    shared = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return members.join(shared, "key").distinct()


def probed_buckets(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, id): what is entered under a key that something else probes, and what probes it. Rows may repeat."""
    owners = index.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    met = probes.join(owners, "key").where("lo <> id or hi <> id").select("key", F.explode(F.array("id", "lo", "hi")).alias("id"))
    return met.distinct()


def linked_groups(bucket: DataFrame, payload: Callable[[DataFrame], DataFrame], compare: Callable[[list, int], np.ndarray]) -> DataFrame:
    """(id, component) of the graph that links two texts if they share a ``key`` of ``bucket(key, id)`` and are alike.

    ``id`` in ``bucket`` is a hash of 64 bits. ``payload(ids)`` gives (id, node, text) of a table of such ids, one row for
    each node: what has one hash by chance are two nodes, compared like all others. ids of the result are nodes.

    Buckets are merged by their leader (the member of least hash; alike buckets have the same one): a group is all that
    shares a bucket with its leader, so ids of one bucket always meet, mostly once. Groups are dealt out in tiles of at
    most about ``TILE`` texts or ``TILE_CHARS``; within a task all pairs of a tile, and the leader, are compared, and a
    spanning forest leaves it. In groups of several tiles, what did not end in the group's largest component then meets
    all the group, tile by tile. ``compare(texts, n)`` gives the pairs (i < n, j) of a list of texts that are alike, as
    two rows of indices.
    """
    bucket = checkpointed(bucket)
    leaders = bucket.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("g"))
    met = checkpointed(bucket.join(leaders, "key").select("g", "id").distinct())
    wanted = lambda n, chars: F.ceil(F.greatest(n / TILE, chars / TILE_CHARS)).cast("int")
    # ids that are few spare the texts a shuffle
    with scratch(payload(few(met.select("id").distinct())).select("id", "node", F.length("text").alias("size"), "text"), "candidates") as texts:
        grouped = met.join(texts.select("id", "node", "size"), "id")
        tiles = grouped.groupBy("g").agg(wanted(F.count("*"), F.sum("size")).alias("tiles")).withColumn("tiles", F.greatest("tiles", F.lit(1)))
        tiled = checkpointed(grouped.join(tiles, "g").withColumn("tile", F.expr("cast(pmod(xxhash64(node, g), tiles) as int)")))
        seats = tiled.select("g", F.explode(F.expr("if(id = g, sequence(0, tiles - 1), array(tile))")).alias("tile"), F.lit(0).alias("other"), F.lit(False).alias("late"), "node")
        edges = checkpointed(_forests(seats, texts, compare))
        found = connected_components(edges)
        named = found.select(F.col("id").alias("node"), "component")
        large = checkpointed(tiled.where("tiles > 1").join(named, "node", "left").select("g", "node", "size", "tiles", "tile", F.coalesce("component", "node").alias("component")))
        if large.isEmpty():
            return found
        parts = large.groupBy("g", "component").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
        most = parts.groupBy("g").agg(F.max_by("component", F.struct("n", "component")).alias("most"), wanted(F.sum("n") - F.max("n"), F.sum("chars") - F.max_by("chars", F.struct("n", "component"))).alias("rests"))
        split = large.join(most, "g").where("rests > 0").withColumn("rest", F.expr("if(component = most, -1, cast(pmod(xxhash64(g, node), rests) as int))"))
        meet = split.select("g", "tile", F.explode(F.expr("sequence(0, rests - 1)")).alias("other"), F.lit(True).alias("late"), "node")
        comes = split.where("rest >= 0").select("g", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.col("rest").alias("other"), F.lit(False).alias("late"), "node")
        more = checkpointed(_forests(comes.union(meet), texts, compare))
    if more.isEmpty():
        return found
    return connected_components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more))


def _forests(seats: DataFrame, texts: DataFrame, compare: Callable[[list, int], np.ndarray]) -> DataFrame:
    """(a, b): forests of the links in each (g, tile, other). Rows that are ``late`` are not compared with one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, texts, n, first = None, [], [], 0, set()
        kind = pa.binary()
        a: list = []
        b: list = []

        def close() -> None:
            if len(ids) > 1:
                for i, j in forest(len(ids), compare(texts, n or len(ids))):
                    a.append(ids[i])
                    b.append(ids[j])

        for batch in batches:
            for g, tile, other, late, x, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, tile, other) != place:
                    close()
                    place, ids, texts, n, first = (g, tile, other), [], [], 0, set()
                if late and not n:
                    n = len(ids)
                if x not in ids[-1:] and not (late and x in first):  # a leader may sit twice
                    ids.append(x)
                    texts.append(text)
                    if not late:
                        first.add(x)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])
                a, b = [], []
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    full = seats.join(texts, "node").select("g", "tile", "other", "late", "node", "text")
    return full.repartition("g", "tile", "other").sortWithinPartitions("g", "tile", "other", "late", "node").mapInArrow(run, "a binary, b binary")


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Stars that span the components of pairs of 0 to n-1: (least member, other member)."""
    root = list(range(n))
    for i, j in pairs.T.tolist():
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        root[max(i, j)] = min(i, j)
    out = []
    for i in range(n):
        root[i] = root[root[i]]  # the parent is less than its child, so it knows the root already
        if root[i] != i:
            out.append((root[i], i))
    return out
