"""Similarity of conversations and greedy clusters of at most a few members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.vectors import cosine
from tarn.session import checkpointed

# Least similarity, members of a cluster at most, hours that count, least rows.
LEAST, LARGEST, HOURS, FEWEST = 0.7, 20, 168, 5
#: Rounds in which clusters are decided before one task for each group does the rest.
ROUNDS = 40
#: Pairs of a group that one task decides at once.
ALONE = 500_000
#: Rows of a group that tell how many pairs it has; open clusters that a walk may be expected to hold; rows of its step.
SAMPLE, OPEN, STEP = 512, 20_000, 512


def temporal_weight(score: Column, hours: Column) -> Column:
    """0.7 s + 0.3 (1 - d / 168) within 168 hours, else 0.5 s."""
    return F.when(hours <= HOURS, 0.7 * score + 0.3 * (1 - hours / HOURS)).otherwise(0.5 * score)


def tag_weight(score: Column, common: Column, total: Column) -> Column:
    """0.8 s + 0.2 common / total where tags are common."""
    return F.when(common > 0, 0.8 * score + 0.2 * common / total).otherwise(score)


def similar_pairs(points: DataFrame, within: str, least: float, id_col: str = "id", vector_col: str = "embedding", tile: int = 4096) -> DataFrame:
    """(a, b, score): pairs a < b of rows with the same ``within`` whose cosine is ``least`` or more.

    Rows of a group are dealt to tiles of about ``tile``; each pair of tiles is a task's matrix product, and only pairs
    that count leave it.
    """
    kind = points.schema[id_col].dataType.simpleString()
    rows = points.select(F.col(within).alias("g"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    tiles = rows.groupBy("g").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    placed = rows.join(tiles, "g").withColumn("t", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    # a row sits with each tile: on the left side of those from its own on, on the right side of those up to its own
    seats = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j")))
    seated = placed.select("g", "id", "v", "t", F.inline(seats))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.v.tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, left = pdf.id.to_numpy(), (pdf.t == pdf.i).to_numpy()
        right = ~left if pdf.i[0] != pdf.j[0] else left
        out = []
        for at in range(0, int(left.sum()), 512):
            some = np.flatnonzero(left)[at : at + 512]
            scores = np.round(x[some] @ x[right].T, 6)
            p, q = np.nonzero(scores >= least)
            a, b = ids[some[p]], ids[right][q]
            once = a < b if pdf.i[0] == pdf.j[0] else slice(None)
            out.append((np.minimum(a, b)[once], np.maximum(a, b)[once], scores[p, q][once]))
        whole = [np.concatenate(x) for x in zip(*out)] if out else [ids[:0], ids[:0], np.empty(0)]
        return pd.DataFrame(dict(zip(("a", "b", "score"), whole)))

    return seated.groupBy("g", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}, score double")


def greedy_clusters(points: DataFrame, group: str, least: float = LEAST, id_col: str = "id", vector_col: str = "embedding", alone: int = ALONE) -> DataFrame:
    """(group, cluster, id): rows of a group in the order of ids; each that is free gathers the first free ones similar to it.

    Groups with few similar pairs are decided in rounds on the graph of these pairs, so they may be of any size; see ``gathered``.
    Where more than ``alone`` pairs are to be expected, nearly all of them never matter: see ``walked``. Both give the same.
    """
    rows = points.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    sizes = points.groupBy(group).count().where(F.col("count") >= FEWEST).select(F.col(group).alias("g"), "count")
    dense = crowded(rows, sizes, least, alone)
    rest = points
    if dense:
        rest = points.where(~F.col(group).isin(dense))
    pairs = similar_pairs(rest, group, least, id_col, vector_col).join(rest.select(F.col(id_col).alias("a"), F.col(group).alias("g")), "a")
    found = gathered(pairs.join(sizes, "g", "left_semi").select("g", "a", "b"))
    if dense:
        found = found.union(walked(rows.where(F.col("g").isin(dense)), least, parts=2 * len(dense)))
    return found.select(F.col("g").alias(group), "cluster", F.col("id").alias(id_col))


def _units(v: pa.Array) -> np.ndarray:
    x = np.asarray(v.flatten(), np.float64).reshape(len(v), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def crowded(rows: DataFrame, sizes: DataFrame, least: float, alone: int) -> list:
    """Groups of ``rows(g, id, v)`` for which more than ``alone`` similar pairs and few open clusters are to be expected.

    Told from the pairs among ``SAMPLE`` rows of each large group. It is a choice of the way only, never of the result.
    """
    large = [r["g"] for r in sizes.where(f"g is not null and count * (count - 1D) / 2 > {alone}").select("g").collect()]  # a row for as many rows as have ``alone`` pairs
    if not large:
        return []
    some = rows.where(F.col("g").isin(large)).withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(F.xxhash64("id"), "id"))).where(F.col("r") <= SAMPLE)

    def share(t: pa.Table) -> pa.Table:
        x = _units(t.column("v").combine_chunks())
        near = np.triu(np.round(x @ x.T, 6) >= least, 1).sum() / max(1, len(x) * (len(x) - 1) / 2)
        return pa.table({"g": t.column("g").slice(0, 1), "share": [float(near)]})

    kind = rows.schema["g"].dataType.simpleString()
    shares = some.select("g", "v").groupBy("g").applyInArrow(share, f"g {kind}, share double").join(sizes, "g")
    return [r["g"] for r in shares.where(f"share * count * (count - 1D) / 2 > {alone} and share * {OPEN} >= {LARGEST}").collect()]


def walked(rows: DataFrame, least: float, most: int = LARGEST, parts: int = 8, step: int = STEP) -> DataFrame:
    """(g, cluster, id) as of ``gathered``, from ``rows(g, id, v)`` themselves, in one pass in the order of ids.

    A task reads its groups a batch at a time and holds only clusters that still are open, that is a row for each that has not
    found its members yet. A batch's rows are offered to these in their order, then lead clusters themselves; what is full
    leaves. A dense group needs few comparisons, as a cluster ends at ``most`` members: no pairs are made.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def take(near: np.ndarray, free: np.ndarray, wants: int) -> np.ndarray:
        hits = np.flatnonzero(near & free)[:wants]
        free[hits] = False
        return hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the group; its open clusters are ``leaders``, the vectors ``x`` of these and how many rows they ``need``
        for batch in batches:
            g, every = batch.column("g"), batch.column("id").to_numpy()
            starts = (np.flatnonzero(np.asarray(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)))) + 1).tolist()
            cuts = [0, *starts, len(g)]
            for lo, hi in zip(cuts, cuts[1:]):
                if last is None or lo or g[lo].as_py() != last:
                    last, leaders, x, need = g[lo].as_py(), every[:0], np.empty((0, 0)), np.empty(0, np.int64)
                clusters, members = [every[:0]], [every[:0]]
                for at in range(lo, hi, step):
                    ids, v = every[at : min(hi, at + step)], _units(batch.column("v").slice(at, min(hi, at + step) - at))
                    free = np.ones(len(ids), bool)
                    near = np.round(x @ v.T, 6) >= least if len(leaders) else np.empty((0, len(ids)), bool)
                    own = np.triu(np.round(v @ v.T, 6) >= least, 1)
                    begun: list[int] = []
                    wanted: list[int] = []
                    # open clusters first, then rows that are still free, all in the order of ids
                    for leader, row, wants, i in [*zip(leaders, near, need, [-1] * len(leaders)), *zip(ids, own, [most - 1] * len(ids), range(len(ids)))]:
                        if i >= 0 and not free[i]:
                            continue
                        hits = take(row, free, wants)
                        if len(hits):
                            some = ids[hits] if wants < most - 1 else np.concatenate([[leader], ids[hits]])
                            clusters.append(np.full(len(some), leader))
                            members.append(some)
                        if i >= 0:
                            free[i] = False
                            begun.append(i)
                        wanted.append(wants - len(hits))
                    left = np.array(wanted, np.int64)
                    leaders, x = np.concatenate([leaders, ids[begun]]), np.vstack([x.reshape(-1, v.shape[1]), v[begun]])
                    leaders, x, need = leaders[left > 0], x[left > 0], left[left > 0]
                whole = np.concatenate(clusters)
                yield pa.RecordBatch.from_arrays([pa.array([last] * len(whole), g.type), pa.array(whole, batch.column("id").type), pa.array(np.concatenate(members), batch.column("id").type)], ["g", "cluster", "id"])

    return rows.repartition(parts, "g").sortWithinPartitions("g", "id").mapInArrow(run, f"g {kinds['g']}, cluster {kinds['id']}, id {kinds['id']}")


def gathered(pairs: DataFrame, most: int = LARGEST, rounds: int = ROUNDS, alone: int = ALONE) -> DataFrame:
    """(g, cluster, id): what taking rows in the order of ids gives, where a free row takes up to ``most`` - 1 free later ones.

    ``pairs(g, a, b)``: similar rows, a < b, ids unique over groups. In a round every row acts that is the least undecided one
    of all that are up to two pairs away: nothing that is still open can take from it, nor it from what acts beside it.
    Who acts and who is taken is decided; who has no pair left stays alone. Each round shuffles pairs of undecided rows only,
    and decides the first of each connected part at least; ids in random order need a number of rounds that grows with the
    logarithm of the rows. Chains whose ids ascend need more: what ``rounds`` leave open is decided by one task for each group,
    and so is from the beginning a group of no more than ``alone`` pairs.
    """
    every = checkpointed(pairs.where("a < b").select("g", "a", "b").distinct())
    large = [r["g"] for r in every.groupBy("g").count().where(F.col("count") > alone).select("g").collect()]  # a row for ``alone`` pairs
    left, small = (every.where(F.col("g").isin(large)), every.where(~F.col("g").isin(large))) if large else (every.where("false"), every)
    done = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        both = left.select("g", F.col("a").alias("x"), F.col("b").alias("y")).union(left.select("g", "b", "a"))
        first = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        near = both.join(first.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("m").alias("n"))
        acting = first.join(near, "x").where("m = x and n >= x").select(F.col("x").alias("a"))
        order = W.partitionBy("a").orderBy("b")
        taken = checkpointed(left.join(acting, "a").withColumn("k", F.row_number().over(order)).where(F.col("k") < most).select("g", F.col("a").alias("cluster"), F.col("b").alias("id")))
        done = taken if done is None else done.union(taken)
        gone = taken.select("id").union(taken.select("cluster")).distinct()
        left = checkpointed(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("g", "a", "b"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = f"g {kinds['g']}, cluster {kinds['a']}, id {kinds['a']}"

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        free, rows = set(pdf.a) | set(pdf.b), []
        for i, near in pdf.sort_values(["a", "b"]).groupby("a", sort=True).b:
            some = [j for j in near if j in free][: most - 1] if i in free else []
            if some:
                free.difference_update([i, *some])
                rows += [(pdf.g.iloc[0], i, j) for j in some]
        return pd.DataFrame(rows, columns=["g", "cluster", "id"])

    last = small.union(left).groupBy("g").applyInPandas(rest, schema)
    done = last if done is None else done.union(last)
    return done.union(done.select("g", "cluster", F.col("cluster").alias("id")).distinct())


def cohesion(members: DataFrame, points: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(cluster, n, cohesion): mean similarity of a cluster's pairs; clusters have at most 20 members."""
    full = members.select("cluster", id_col).join(points.select(id_col, vector_col), id_col)
    a, b = full.select("cluster", F.col(id_col).alias("a"), F.col(vector_col).alias("va")), full.select("cluster", F.col(id_col).alias("b"), F.col(vector_col).alias("vb"))
    pairs = a.join(b, "cluster").where("a < b").groupBy("cluster").agg(F.round(F.avg(cosine(F.col("va"), F.col("vb"))), 6).alias("cohesion"))
    return members.groupBy("cluster").agg(F.count("*").alias("n")).join(pairs, "cluster", "left")


def outliers(points: DataFrame, members: DataFrame, id_col: str = "id") -> DataFrame:
    return points.select(id_col).join(members.select(id_col), id_col, "left_anti")


def common_words(titles: DataFrame, key: str, word: str = "tag") -> DataFrame:
    """(key, word, n): words that at least half (rounded down, 1 at least) of a group's rows have. ``titles``: key, id, word."""
    size = titles.groupBy(key).agg(F.countDistinct("id").alias("_n"))
    counts = titles.select(key, "id", word).distinct().groupBy(key, word).agg(F.count("*").alias("n"))
    return counts.join(size, key).where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))).select(key, word, "n")


def metrics(cohesions: DataFrame) -> DataFrame:
    """One row: clusters, mean cohesion, and 0.8 of it as a silhouette where there is more than one cluster."""
    mean = F.avg("cohesion")
    return cohesions.agg(F.count("*").alias("clusters"), F.round(mean, 6).alias("avg_cohesion"), F.round(F.when(F.count("*") > 1, 0.8 * mean).otherwise(0.0), 6).alias("silhouette"))
