"""Operator 10: near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``CHUNKS`` x ``WIDTH`` symbols of 16 bits. Two signatures that differ in fewer than 2 * ``CHUNKS``
symbols agree, by the pigeonhole principle, in all but one symbol of some chunk; every chunk is therefore indexed under
each of its ``WIDTH`` variants with one symbol left out (the allowed chunk error), and documents that share an entry are
candidates. That finds all pairs of distance up to 15 of 32, and at similarity s misses a pair with a probability of
(1 - s^4 - 4 s^3 (1 - s))^8: 1.1e-6 at 0.8, less above. Candidates are confirmed on their full shingle sets.

Documents of one set (128 bits of hash) are collapsed to the first row before the join: the least id, rows without one
last, then the texts' hashes. Candidates are compared in tiles (see ``components.linked_groups``), so large groups of
near copies make no table of pairs.

Cases: words are split at ASCII white space and A-Z lower-cased; a document with fewer words than a shingle takes is one
shingle; null, empty and blank texts have no set and link with nothing. Decisions are made for rows, known by id and
text: rows that share an id, or have none, are documents of their own. Of a class of rows without ids the component is
null and the first row is kept. Ids may be of any type that has an order. Extra columns are kept by ``apply_decisions``.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import beside, checkpointed, documents, few, map_batches, with_hashes
from tarn.llm.components import linked_groups, shared_buckets

CHUNKS, WIDTH = 8, 4
SYMBOLS = CHUNKS * WIDTH
#: Shingles hashed at a time.
BLOCK = 16_384


@lru_cache(maxsize=1)
def multipliers() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"minhash {k}".encode()) | 1 for k in range(SYMBOLS)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed((total + hashes[k : len(words) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """The symbols of a non-empty set."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), BLOCK):
        np.minimum(least, mixed(found[i : i + BLOCK, None] * multipliers()).min(axis=0), out=least)
    return (mixed(least * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.uint16)


def index_keys(symbols: np.ndarray) -> list[int]:
    """One key for each chunk and symbol left out: chunk, place, and the symbols that remain."""
    keys = []
    for c, chunk in enumerate(symbols.reshape(CHUNKS, WIDTH).tolist()):
        for left_out in range(WIDTH):
            key = c * WIDTH + left_out
            for i, s in enumerate(chunk):
                if i != left_out:
                    key = key << 16 | s
            keys.append(key if key < 1 << 63 else key - (1 << 64))
    return keys


SIGNED = "h1 long, h2 long, n_shingles long, set_id binary, keys array<long>"


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hashes of the text, size of the set, its identity (null without one) and index keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            found = shingles(text, width)
            if len(found):
                symbols = signature(found)
                rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), index_keys(symbols)))
            else:
                rows.append((0, None, None))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.list_(pa.int64())))]
        same = ["doc_id", "h1", "h2"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), *columns], [*same, "n_shingles", "set_id", "keys"])

    return map_batches(with_hashes(docs.select("doc_id", "text")), kernel, f"doc_id {kind}, {SIGNED}")


def similar_pairs(width: int, percent: int):
    """Of texts, the pairs (i < n, j) with 100 * intersection >= percent * union of their sets, counted in full."""

    def compare(texts: list[str], n: int) -> np.ndarray:
        sets = [shingles(t, width) for t in texts]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        whole, lone = np.concatenate(sets), len(sets) == n
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(whole, kind="stable")
        whole, owner = whole[order], owner[order]
        fresh = np.append(True, whole[1:] != whole[:-1])
        column = np.cumsum(fresh) - 1
        common = np.bincount(column)[column] > 1  # shingles of one text alone are in no intersection
        owner, column = owner[common], column[common]
        column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
        both = np.zeros((n, len(sets)), np.float32)  # counts are exact below 2**24
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK // 4):
            here = slice(*np.searchsorted(column, [low, low + BLOCK // 4]))
            matrix = np.zeros((len(sets), BLOCK // 4), np.float32)
            matrix[owner[here], column[here] - low] = 1
            both += matrix[:n] @ matrix.T
        union = sizes[:n, None] + sizes - both
        i, j = np.nonzero((both > 0) & (100 * both.astype(np.float64) >= percent * union))
        keep = i < j if lone else slice(None)
        return np.stack([i[keep], j[keep]])

    return compare


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), n_shingles, component_id, kept, first.

    component_id is the least id reachable by links; kept says whether that is the row's own id, first whether the row is
    the first of its class (of rows that share an id and are alike, all are kept and one is first).
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = checkpointed(signed(docs, width).withColumn("row", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2", "row")
    sets = base.where("set_id is not null").groupBy("set_id").agg(F.min(place).alias("rep"))
    short = F.conv(F.hex(F.substring("set_id", 1, 8)), 16, -10).cast("long")
    firsts = base.join(sets, "set_id").where(F.col("row") == F.col("rep.row")).select("keys", short.alias("id"))

    def texts(ids: DataFrame) -> DataFrame:
        wanted = sets.select(short.alias("id"), F.col("set_id").alias("node"), F.xxhash64(F.col("rep.no_id"), F.col("rep.doc_id")).alias("h0"), "rep.h1", "rep.h2").join(ids, "id", "left_semi")
        wanted = few(checkpointed(wanted), 300_000)
        there = with_hashes(docs).withColumn("h0", F.xxhash64(F.col("doc_id").isNull(), "doc_id"))
        # rows equal in id and text are met as one
        whole = there.join(wanted, ["h0", "h1", "h2"], "left_semi").groupBy("h0", "h1", "h2").agg(F.min("text").alias("text"))
        return whole.join(wanted, ["h0", "h1", "h2"]).select("id", "node", "text")

    members = firsts.select(F.explode("keys").alias("key"), "id")
    found = linked_groups(shared_buckets(members), texts, similar_pairs(width, percent))
    classed = sets.join(found.select(F.col("id").alias("set_id"), F.col("component").alias("class")), "set_id", "left")
    heads = classed.where("class is not null").groupBy("class").agg(F.min("rep").alias("head"))
    named = classed.join(heads, "class", "left").select("set_id", F.coalesce("head", "rep").alias("head"))
    out = base.join(named, "set_id", "left")
    alone, own = F.col("head").isNull(), F.struct("doc_id", "h1", "h2")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    first = alone | own.eqNullSafe(F.struct("head.doc_id", "head.h1", "head.h2"))
    return out.select("doc_id", "h1", "h2", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, first).alias("kept"), first.alias("first"))


def apply_decisions(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The first row of each class; of rows equal in id and text, one (whichever their extra columns)."""
    key = ["doc_id", "h1", "h2"]
    out = beside(docs, decisions.where("not first").select(*key).distinct(), "left_anti").select("_doc.*")
    twice = decisions.where("first").groupBy(*key).count().where("count > 1").select(*key)
    if not twice.isEmpty():
        one = beside(out, twice, "left_semi").dropDuplicates(["_id", "_h1", "_h2"])
        out = beside(out, twice, "left_anti").union(one).select("_doc.*")
    return out


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4).drop("h1", "h2", "first")
