"""Text to vectors: providers, their batches, and the Pandas UDF that runs one on executors.

A provider is any object with ``dim`` and ``embed_batch``; a function that makes one goes to the executors, where each
Python worker calls it once. ``HashedTokens`` needs no model file and is the default.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.session import checkpointed

SPACE = r"[\t-\r\x{85}\p{Z}]"


class EmbeddingProvider(Protocol):
    dim: int

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """One row of ``dim`` numbers for each text; texts are trimmed and not empty."""


class HashedTokens:
    """Signed hashed words, averaged over the first ``most`` words and scaled to length one.

    Texts of a batch are tokenised together, cut to ``most`` tokens and padded to the longest; the mask keeps padding out
    of the mean. A token's vector is a sign at one coordinate, both from the MD5 of the word.
    """

    def __init__(self, dim: int = 384, most: int = 512):
        self.dim, self.most = dim, most

    @staticmethod
    @lru_cache(maxsize=1 << 16)
    def token(word: str) -> int:
        """31 bits of the word's hash, never 0 (padding)."""
        return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % (2**31 - 1) + 1

    def tokenise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids (0 where padded) and mask, as long as the longest text."""
        found = [[self.token(w) for w in re.findall(r"[a-z0-9]+", t.lower())[: self.most]] for t in texts]
        ids = np.zeros((len(texts), max(map(len, found), default=0)), np.int64)
        for row, x in zip(ids, found):
            row[: len(x)] = x
        return ids, (ids > 0).astype(np.int64)

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        ids, mask = self.tokenise(texts)
        out = np.zeros((len(texts), self.dim))
        rows, columns = np.nonzero(mask)
        tokens = ids[rows, columns]
        np.add.at(out, (rows, tokens % self.dim), np.where(tokens // self.dim % 2 == 0, 1.0, -1.0))
        out /= np.maximum(mask.sum(axis=1, keepdims=True), 1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def normalised(text: Column) -> Column:
    """A text without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")


def valid(text: Column) -> Column:
    """Whether a text can be embedded: it is not blank."""
    return normalised(text) != ""


def validated(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts``; reading a blank one is an error."""
    message = F.concat(F.lit("a text is empty or white space only: column "), F.lit(text))
    return texts.withColumn(text, F.when(valid(F.col(text)), F.col(text)).otherwise(F.raise_error(message)))


def with_dimension(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """``vectors``; reading one of another dimension (or null) is an error."""
    good = F.coalesce(F.size(vector) == dim, F.lit(False))
    return vectors.withColumn(vector, F.when(good, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector has not {dim} dimensions"))))


def batch_size(texts: Column, cores: int, most: int, memory_mb: int | None = None) -> Column:
    """Texts embedded at a time: four for each core, one for each MB, ``most``, and no more than there are."""
    bounds = [texts.cast("long"), F.lit(4 * cores).cast("long"), F.lit(most).cast("long")]
    return F.least(*bounds, *([F.lit(memory_mb).cast("long")] if memory_mb is not None else []))


def embed(make: Callable[[], EmbeddingProvider] = HashedTokens, at_a_time: int = 256):
    """A Pandas UDF from texts to vectors (array<double>); null for blank texts.

    ``make`` is called once for each run of a task in a Python worker; texts are embedded, and vectors leave, ``at_a_time``.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for batch in batches:
            for at in range(0, len(batch), at_a_time):
                texts = [(t or "").strip() for t in batch.iloc[at : at + at_a_time]]
                some = [i for i, t in enumerate(texts) if t]
                out: list = [None] * len(texts)
                if some:
                    for i, v in zip(some, provider.embed_batch([texts[i] for i in some])):
                        out[i] = v.tolist()
                yield pd.Series(out, dtype=object)

    return run


def query_vector(text: str, make: Callable[[], EmbeddingProvider] = HashedTokens) -> list[float]:
    """The vector of one query text, made on the driver."""
    text = text.strip()
    if not text:
        raise ValueError("a query must not be blank")
    return make().embed_batch([text])[0].tolist()


def padding(texts: DataFrame, batch: Column, most: int, text: str = "text") -> DataFrame:
    """(batch, n, longest, truncated, padded): what tokenising texts in batches cuts and adds."""
    words = F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    sized = texts.select(batch.alias("batch"), words.alias("w")).withColumn("kept", F.least("w", F.lit(most)))
    return sized.groupBy("batch").agg(F.count("*").alias("n"), F.max("kept").alias("longest"), F.sum(F.col("w") - F.col("kept")).alias("truncated"), (F.count("*") * F.max("kept") - F.sum("kept")).alias("padded"))


#: Lengths of a class differ by this factor at most, so that padding stays below its excess over 1; texts ranked together.
CLASS, LANE = 1.08, 50_000
#: Texts that are Python's at once.
PART = 256


def padded_batches(texts: DataFrame, key: str, text: str = "text", budget: int = 16_384, most: int = 512, make: Callable[[], HashedTokens] = HashedTokens) -> DataFrame:
    """(size, lane, batch, n, longest, keys, ids, masks): texts in batches of like length, as a model takes them.

    Texts are tokenised and cut to ``most``; those of one class of lengths (no two differ by more than a twelfth, or by one
    token) go into batches whose padded tokens do not exceed ``budget``. ids and masks are padded to the batch's longest.
    A class is ranked in lanes of about ``LANE`` texts, so a common length is many tasks; a batch holds ``budget`` tokens.
    Blank texts, and those without a token, are in no batch. Rows that share a key are rows of their own.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                found = [provider.tokenise([t.as_py() or ""])[0][0][:most] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], [key, "ids"])

    made = texts.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<bigint>").where("size(ids) > 0")
    length = F.size("ids")
    # classes: lengths up to 12 by themselves, then by the factor
    size = F.when(length <= 12, length).otherwise(12 + F.floor(F.log(length / 12.0) / math.log(CLASS)).cast("int") + 1)
    rows = checkpointed(made.withColumns({"length": length, "size": size}))
    wide = rows.groupBy("size").agg(F.max("length").alias("longest"), F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))  # a row for each class
    laned = rows.join(F.broadcast(wide), "size").withColumn("lane", F.pmod(F.xxhash64("ids", key), "lanes").cast("int"))
    order = W.partitionBy("size", "lane").orderBy("length", key, F.xxhash64("ids"))
    fits = F.greatest(F.lit(1), F.floor(budget / F.col("longest")))
    placed = laned.withColumn("batch", F.floor((F.row_number().over(order) - 1) / fits).cast("long"))
    met = placed.groupBy("size", "lane", "batch").agg(F.sort_array(F.collect_list(F.struct("length", key, "ids"))).alias("rows"), F.count("*").alias("n"), F.max("length").alias("longest"))
    padded = lambda value: F.transform("rows", lambda r: F.concat(value(r), F.array_repeat(F.lit(0).cast("long"), F.col("longest") - r["length"])))
    ids, masks = padded(lambda r: r["ids"]), padded(lambda r: F.array_repeat(F.lit(1).cast("long"), r["length"]))
    return met.select("size", "lane", "batch", "n", "longest", F.transform("rows", lambda r: r[key]).alias("keys"), ids.alias("ids"), masks.alias("masks"))
