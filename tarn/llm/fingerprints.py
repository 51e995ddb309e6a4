"""Operator 8: document fingerprints by consistent weighted sampling.

A text is the multiset of its lower-cased words. For each of ``SAMPLES`` hashes, a word w of weight x draws r, c from
Gamma(2, 1) and b from U(0, 1), all functions of (w, hash) alone; t = floor(ln x / r + b) and
ln a = ln c - r (t + 1 - b). The sample is the word (and t) of least a (Ioffe, ICDM 2010), so two texts agree in a sample
with a probability of their generalised Jaccard similarity, sum of min over sum of max of the weights. ln a depends on
(w, t) alone: its bits stand for the sample, shortened to 16 bits, which adds 1/65536 to the likeness.

Documents also meet their successor in the order of ids. Rows are dealt by ranges of ids, more with more rows, sorted and
streamed; each range gets a copy of the first row of the next, so no window covers the whole table and a text is
shuffled once. An id (or null) that many rows have is several ranges, cut by the hash of the text.

Cases: null texts are empty; an empty text (or one of white space) has a fingerprint of its own and likeness 1 to
another such text, 0 to all others; equal ids are ordered by the text's hash, then the text; a table of one row is its
own successor; ids are whole numbers, null ones come first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import documents

SAMPLES = 64
#: (word, weight) vectors that a worker keeps, 256 bytes each; emptied when full, which changes no result.
MEMO = 120_000
#: Rows that a range should hold.
RANGE_ROWS = 50_000
#: Draws are quantiles of Gamma(2, 1) at so many points.
R_BITS, C_BITS = 18, 20
#: Words drawn at a time, distinct words of a text that is not remembered, and code points of text compared at a time.
DRAWN, BLOCK, SLICE = 4096, 16_384, 300_000


def gamma2_quantiles(bits: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**bits equal parts: roots of 1 - (1 + x) exp(-x) = p."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    grid = np.concatenate([np.geomspace(1e-6, 1, 20_000), np.linspace(1, 60, 40_000)[1:]])
    x = np.interp(p, -np.expm1(-grid) - grid * np.exp(-grid), grid)
    for _ in range(4):
        x = np.maximum(x - (-np.expm1(-x) - x * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


class Sampler:
    def __init__(self) -> None:
        self.r = gamma2_quantiles(R_BITS).astype(np.float32)
        self.ln_c = np.log(gamma2_quantiles(C_BITS)).astype(np.float32)
        self.seeds = np.array([xxhash.xxh64_intdigest(f"sample {k}".encode()) for k in range(SAMPLES)], np.uint64)
        self.rows: dict[tuple[str, int], int] = {}
        self.matrix = np.empty((1024, SAMPLES), np.float32)

    def draw(self, keys: list[tuple[str, int]]) -> np.ndarray:
        """ln a of (word, weight) pairs for all samples."""
        words = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w, _ in keys), np.uint64, len(keys))
        ln_x = np.log(np.fromiter((n for _, n in keys), np.float32, len(keys)))
        z = words[:, None] ^ self.seeds
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
        r = self.r[z >> np.uint64(64 - R_BITS)]
        ln_c = self.ln_c[(z >> np.uint64(64 - R_BITS - C_BITS)) & np.uint64((1 << C_BITS) - 1)]
        b = (z & np.uint64((1 << 24) - 1)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(ln_x[:, None] / r + b)
        return ln_c - r * (t + 1 - b)

    def signatures(self, texts: list[str]) -> np.ndarray:
        """len(texts) x SAMPLES 16-bit symbols; 0 throughout for texts without words."""
        out = np.zeros((len(texts), SAMPLES), np.uint16)
        bags = [list(Counter(t.lower().split()).items()) for t in texts]
        if len(self.rows) > MEMO:
            self.rows.clear()
        # what a very long text holds is drawn as it goes and not remembered
        fresh = list(set().union(*(bag for bag in bags if len(bag) <= BLOCK)).difference(self.rows))
        for i in range(0, len(fresh), DRAWN):
            part, n = fresh[i : i + DRAWN], len(self.rows)
            while n + len(part) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
            self.matrix[n : n + len(part)] = self.draw(part)
            self.rows.update(zip(part, range(n, n + len(part))))
        for i, bag in enumerate(bags):
            if not bag:
                continue
            if len(bag) <= BLOCK:
                least = self.matrix[np.fromiter(map(self.rows.__getitem__, bag), np.int64, len(bag))].min(axis=0)
            else:
                least = np.min([self.draw(bag[j : j + DRAWN]).min(axis=0) for j in range(0, len(bag), DRAWN)], axis=0)
            bits = (least + np.float32(0)).view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out[i] = np.maximum(bits >> np.uint64(48), 1)
        if len(self.matrix) > 3 * MEMO:
            self.rows.clear()
            self.matrix = np.empty((1024, SAMPLES), np.float32)
        return out


@lru_cache(maxsize=1)
def sampler() -> Sampler:
    return Sampler()


def fingerprints(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Hexadecimal fingerprints and the symbols they spell."""
    symbols = sampler().signatures(texts)
    return [row.astype(">u2").tobytes().hex() for row in symbols], symbols


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_batch(ids: list, texts: list[str], nexts: list[str], kind: pa.DataType | None) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, nexts)]
    own, own_symbols = fingerprints(texts)
    other, other_symbols = fingerprints(changed)
    # each text but the last one's successor is in the list already
    after = np.concatenate([own_symbols[1:], own_symbols[:1]])
    odd = [i for i in range(len(texts)) if i + 1 == len(texts) or nexts[i] is not texts[i + 1]]
    after[odd] = fingerprints([nexts[i] for i in odd])[1]
    columns = [pa.array(ids, kind), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array(own), pa.array(other), pa.array(likeness(own_symbols, other_symbols)), pa.array(likeness(own_symbols, after))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])


def range_numbers(ids: np.ndarray, hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The range of each row: by the edges of ids; what repeats among them is an id of several ranges, dealt by hash."""
    low, high = np.searchsorted(edges, ids, side="left"), np.searchsorted(edges, ids, side="right")
    share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    return np.where(high - low > 1, low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low), high)


def with_successors(docs: DataFrame) -> DataFrame:
    """(range, tail, doc_id, text), partitioned by range and sorted: the tail of a range is the row that follows it."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lowest = int(np.iinfo(np.int64).min)
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx(number, [(i + 1) / n for i in range(n - 1)] or [0.5], 20 * n).alias("x")).first()["x"] or []
    edges = np.array(sorted(cuts), np.int64)

    # one partition for each range: numbers whose hashes fall into partitions 0 to n-1 stand for the ranges
    hashed = spark.range(40 * n + 400).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
    names = np.array([r["id"] for r in sorted(hashed.collect(), key=lambda r: r["at"])], np.int32)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(names[range_numbers(ids.to_numpy(np.int64), hashes.to_numpy(np.int64), edges) % len(names)])

    ranged = docs.select("*", F.xxhash64("text").alias("hash"), number.alias("number")).withColumn("range", range_of("number", "hash"))
    least = {r["range"]: r["number"] for r in ranged.groupBy("range").agg(F.min("number").alias("number")).collect()}  # a row per range
    columns = ["range", F.lit(False).alias("tail"), "doc_id", "hash", "text"]
    if not least:
        return ranged.select(*columns)
    there = [int(r) for r in names if int(r) in least]  # in the order of ranges
    heads = spark.createDataFrame([(here, after, least[after]) for here, after in zip(there, there[1:] + there[:1])], "before int, range int, number long")
    # as many heads as ranges; of the rows of a head's id, the first by hash and text
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "hash", "text")).alias("first")
    tails = ranged.join(F.broadcast(heads), ["range", "number"]).groupBy("before").agg(first).select(F.col("before").alias("range"), "first.text")
    both = ranged.select(*columns).unionByName(tails.select("range", F.lit(True).alias("tail"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("hash"), "text"))
    return both.repartition(n, "range").sortWithinPartitions("range", "tail", "doc_id", "hash", "text").drop("hash")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and ``COLUMNS`` of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, last, ids, texts, nexts, size = (pa.int64() if kind == "bigint" else None), None, [], [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and not last[1]:
                    ids.append(last[2])
                    texts.append(last[3])
                    nexts.append(row[3])
                    size += len(last[3])
                    if size > SLICE:
                        yield compare_batch(ids, texts, nexts, arrow)
                        ids, texts, nexts, size = [], [], [], 0
                last = row
        if ids:
            yield compare_batch(ids, texts, nexts, arrow)

    return with_successors(docs).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
