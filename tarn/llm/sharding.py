"""Operator 4: shards on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard has ``virtual_nodes`` points on a ring of 64-bit hashes; a row's key goes to the next point clockwise. A
shard holds no more than its bound; keys that find it full continue clockwise to the next shard with room, so loads are
balanced whatever the hashes, and only the overflow moves. With ``slack`` 0 the bounds add up to the number of rows, so
counts differ by one at most (law ``rows``).

The ring itself is a table of fixed size (shards * virtual_nodes arcs, each split into ``cells``): counts by cell come
to the driver, which solves the overflow on counts; rows then find their interval by cell and rank in the cell.

Cases: a null text counts one byte and has the checksum of no bytes; equal rows get places of their own, in any order;
null ids are keys like others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm.common import documents

#: The ring is [0, RING): the upper bits of a 64-bit hash.
RING = 1 << 20


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) in clockwise order."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big") % RING
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold; with no slack they add up to ``total``."""
    if slack > 0:
        return [math.ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def solve(counts: dict[int, int], n_cells: int, points: list[tuple[int, int]], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, first slot) so that no shard has more than its limit.

    Cells lie clockwise. In each round every shard admits, in clockwise order, what has reached it while it has room; the
    rest goes on to the next point of another shard that has room.
    """
    width = RING // n_cells
    positions = [p for p, _ in points]
    waiting = [(cell, 0, n - 1, bisect.bisect_left(positions, cell * width) % len(points)) for cell, n in sorted(counts.items()) if n]
    room, filled = list(limits), [0] * len(limits)
    out = []
    while waiting:
        late = []
        for cell, low, high, point in waiting:
            shard = points[point][1]
            take = min(high - low + 1, room[shard])
            if take:
                out.append((cell, low, low + take - 1, shard, filled[shard]))
                filled[shard] += take
                room[shard] -= take
            if low + take <= high:
                late.append((cell, low + take, high, point))
        waiting = []
        for cell, low, high, point in late:
            while not room[points[point][1]]:
                point = (point + 1) % len(points)
            waiting.append((cell, low, high, point))
    return out


def assign(rows: DataFrame, key: list[str], shards: int, virtual_nodes: int = 128, slack: float = 0.0, cells: int = 1 << 14) -> DataFrame:
    """``rows`` with shard and slot (gapless from 0 in each shard). ``rows`` is read twice.

    Nothing of ``rows`` but ``key`` decides, so it should be narrow: text is better joined afterwards.
    """
    spark = rows.sparkSession
    celled = rows.withColumn("_hash", F.xxhash64(*key)).withColumn("_cell", F.expr(f"cast(shiftrightunsigned(_hash, 44) div {RING // cells} as int)"))
    counts = {r["_cell"]: r["count"] for r in celled.groupBy("_cell").count().collect()}  # ``cells`` rows at most
    plan = solve(counts, cells, ring_points(shards, virtual_nodes), bounds(sum(counts.values()), shards, slack))
    places = spark.createDataFrame(plan, "_at int, _low long, _high long, shard int, _first long")
    ranked = celled.withColumn("_rank", F.row_number().over(W.partitionBy("_cell").orderBy("_hash", *rows.columns)).cast("long") - 1)
    # the plan has no more rows than cells plus shards per round: broadcast by its construction
    found = ranked.join(F.broadcast(places), (ranked["_cell"] == places["_at"]) & ranked["_rank"].between(places["_low"], places["_high"]))
    return found.select(*rows.columns, "shard", F.expr("_first + _rank - _low").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # of an id that many rows have, each text is a key of its own
    placed = assign(rows, ["doc_id", "text_crc32", "size"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
