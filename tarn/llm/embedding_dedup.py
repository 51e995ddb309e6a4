"""Operator 9: near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length one, rotated at random and cut into blocks. A cosine of t is a squared distance of
2 (1 - t); if two vectors are that near, some block holds no more of it than its share of the dimensions. Each block is
therefore range-joined on its own under that budget: vectors fall into slabs, one budget's radius wide, of the block's
first coordinate, and meet those of their slab and the next. Within a task a matrix product gives the blocks' distances;
the union of what passes is verified on whole vectors in double precision. A pair is reported by the block that takes
the least share of its budget, which has it by the pigeonhole principle, so no pair counts twice.

Equal vectors are collapsed first. Slabs are dealt out in tiles of at most ``TILE`` vectors (``TILE_NUMBERS`` numbers), by
pairs of tiles, so that a crowded slab is many tasks. A task reports counts of links and a spanning forest, never all its
pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths are not compared. Rows of the same vector are links of each other. Null ids: such a row takes no part and is its
own component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed
from tarn.llm.components import connected_components

BLOCKS = 4
#: Vectors of a tile, fewer of long ones: so many numbers at most.
TILE, TILE_NUMBERS = 8192, 1 << 22
#: Rows of a tile compared at a time.
STRIP = 256
#: What single precision may add to a squared distance of unit vectors.
SLACK = 1e-5


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20240229).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int) -> list[tuple[int, int]]:
    edges = [round(i * dim / min(BLOCKS, dim)) for i in range(min(BLOCKS, dim) + 1)]
    return list(zip(edges, edges[1:]))



def slabs(unit: np.ndarray, budget: float) -> np.ndarray:
    """Slab of each vector in each block."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim)
    width = [math.sqrt(budget * (b - a) / dim) + SLACK for a, b in cuts(dim)]
    return np.stack([np.floor(turned[:, a] / w) for (a, _), w in zip(cuts(dim), width)], axis=1).astype(np.int64)


def linked(left: np.ndarray, right: np.ndarray, block: int, cosine: float, same: bool):
    """Verified pairs (i, j) of two tiles that belong to a block, strip by strip."""
    dim = left.shape[1]
    budget = 2 * (1 - cosine)
    parts = cuts(dim)
    a, b = parts[block]
    share = np.array([(e - s) / dim for s, e in parts])
    turned_left, turned_right = left @ rotation(dim), right @ rotation(dim)
    # with two more columns, half the negative squared distance is one product
    half = lambda v: -(v**2).sum(axis=1, keepdims=True) / 2
    x, y = turned_left[:, a:b], turned_right[:, a:b]
    x = np.hstack([x, half(x), np.ones((len(x), 1))]).astype(np.float32)
    y = np.ascontiguousarray(np.hstack([y, np.ones((len(y), 1)), half(y)]).astype(np.float32).T)
    least = np.float32(-(budget * share[block] + SLACK) / 2)
    for at in range(0, len(left), STRIP):
        near = np.flatnonzero(x[at : at + STRIP] @ y >= least)
        i, j = near // len(right) + at, near % len(right)
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 65_536):
            p, q = i[k : k + 65_536], j[k : k + 65_536]
            good = np.einsum("nd,nd->n", left[p], right[q]) >= cosine
            p, q = p[good], q[good]
            if len(p):
                gap = (turned_left[p] - turned_right[q]) ** 2
                owner = np.argmin(np.stack([gap[:, s:e].sum(axis=1) for s, e in parts], axis=1) / share, axis=1)
                yield p[owner == block], q[owner == block]


def tile_links(dim: int, block: int, cosine: float, left_ids: np.ndarray, left: np.ndarray, left_n: np.ndarray, right_ids: np.ndarray, right: np.ndarray, right_n: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root): what a pair of tiles adds to the links of its vectors, and an edge of a forest for each."""
    ids = left_ids if same else np.concatenate([left_ids, right_ids])
    offset = 0 if same else len(left_ids)
    count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for p, q in linked(left, right, block, cosine, same):
        np.add.at(count, p, right_n[q])
        np.add.at(count, q + offset, left_n[p])
        q = q + offset
        # labels of equal components are equal after each strip: merge by rows, whose partners are few sets
        for i in np.unique(p):
            group = np.unique(label[np.append(q[p == i], i)])
            if len(group) > 1:
                label[np.isin(label, group)] = group[0]
    some = np.flatnonzero(count)
    return ids[some], count[some], ids[label[some]]


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id (least vec_id reachable, itself included), kept."""
    kind = "float" if "float" in vectors.schema["embedding"].dataType.simpleString() else "double"
    vectors = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("v"))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("v", lambda x: x != 0)
    # 0.0 and -0.0 are one value to a grouping, and to a cosine
    sets = checkpointed(vectors.where(usable).groupBy("v").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("n")))
    packed = sets.select("id", "n", F.size("v").alias("dim"), "v")
    budget = 2 * (1 - cosine)

    def locate(batches):
        for batch in batches:
            rows = [np.empty(0, np.int64)] * 5
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                values = np.asarray(part.column("v").flatten(), np.float64).reshape(-1, dim)
                values = values / np.abs(values).max(axis=1, keepdims=True)
                slab = slabs(values / np.linalg.norm(values, axis=1, keepdims=True), budget)
                n, blocks = slab.shape
                new = [np.repeat(np.asarray(part.column("id")), blocks), np.repeat(np.asarray(part.column("n")), blocks), np.full(n * blocks, dim), np.tile(np.arange(blocks), n), slab.ravel()]
                rows = [np.concatenate(x) for x in zip(rows, new)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]).cast(pa.int32()), pa.array(rows[3]).cast(pa.int32()), pa.array(rows[4])], ["id", "n", "dim", "block", "slab"])

    located = packed.mapInArrow(locate, "id long, n long, dim int, block int, slab long")
    # a slab is a radius wide and unit vectors reach from -1 to 1: few rows for each length of vector
    tile = lambda dim: max(1, min(TILE, TILE_NUMBERS // dim))
    crowd = {(r["dim"], r["block"], r["slab"]): -(-r["count"] // tile(r["dim"])) for r in located.groupBy("dim", "block", "slab").count().collect()}
    tiles = vectors.sparkSession.createDataFrame([(*k, m, crowd.get((k[0], k[1], k[2] + 1), 0), crowd.get((k[0], k[1], k[2] - 1), 0)) for k, m in crowd.items()], "dim int, block int, slab long, own int, after int, before int")
    placed = located.join(F.broadcast(tiles), ["dim", "block", "slab"]).withColumn("tile", F.expr("cast(pmod(xxhash64(id), own) as int)"))
    # as the left side: of its slab with tiles of its slab not before its own, and with tiles of the next slab
    seats = """
        concat(
          transform(sequence(tile, own - 1), j -> named_struct('slab', slab, 'i', tile, 'j', j, 'kind', 0, 'side', 0)),
          transform(sequence(0, tile), i -> named_struct('slab', slab, 'i', i, 'j', tile, 'kind', 0, 'side', 1)),
          if(after > 0, transform(sequence(0, after - 1), j -> named_struct('slab', slab, 'i', tile, 'j', j, 'kind', 1, 'side', 0)), array()),
          if(before > 0, transform(sequence(0, before - 1), i -> named_struct('slab', slab - 1, 'i', i, 'j', tile, 'kind', 1, 'side', 1)), array()))"""
    seated = placed.withColumn("seat", F.explode(F.expr(seats))).where("not (seat.kind = 0 and seat.side = 1 and seat.i = seat.j)")
    data = sets.select("id", F.col("v"))
    dealt = seated.select("id", "n", "dim", "block", "seat.*").join(data, "id")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim, block, kind, i, j = (key[k].as_py() for k in (0, 1, 3, 4, 5))
        t = t.sort_by([("side", "ascending"), ("id", "ascending")]).combine_chunks()
        side, ids, n = (np.asarray(t.column(c)) for c in ("side", "id", "n"))
        x = np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        same, left = kind == 0 and i == j, side == 0
        right = left if same else ~left
        out = tile_links(dim, block, cosine, ids[left], x[left], n[left], ids[right], x[right], n[right], same)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["id", "links", "root"])

    found = checkpointed(dealt.groupBy("dim", "block", "slab", "kind", "i", "j").applyInArrow(compare, "id long, links long, root long"))
    edges = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = sets.join(links, "id", "left").join(connected_components(edges), "id", "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = vectors.withColumn("key", F.when(usable, F.col("v"))).join(named.withColumnRenamed("v", "key"), "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
