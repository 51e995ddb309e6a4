"""Operator 12: compression of vectors to one byte a part, with vantage-point trees over the entries of each part position.

Components become integers, floor(256 x). A vector is cut into 16 equal parts; each part position has a codebook of 64
entries, first those parts of the 64 vectors of least id. A round assigns each part to its nearest entry and replaces each
entry by the floor of its parts' mean; unused entries stay. Codes are the assignments after the last round.

Nearest entries are found by branch and bound on a tree for each position: a node has a vantage entry and two children,
each with the least and greatest distance of its entries from the vantage entry, rounded outwards. A greedy descent gives
each part of a batch a first candidate; then a child is entered by the parts for which it may hold an entry that is as near
(not only nearer: of equals the lower index wins). Distances are compared as whole numbers, square roots only bound them.

Tasks hold one Arrow batch and the codebooks (64 entries whatever the corpus). They send sums and counts for each entry and
component, which Spark adds up; the driver gets 64 numbers for each component. Labels' errors are summed with a combine
before the shuffle and joined back, by a broadcast or a join whose hot labels Spark splits.

Cases: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those whose length 16
does not divide or is not that of the kept vector of least id. Null ids come last; rows of one id are vectors of their own, by
their components. Fewer than 64 vectors give as many entries. Integers beyond 2^40 either way count as 2^40; errors beyond a
long count as its greatest value. Null labels are one label. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that a leaf compares one by one.
LEAF = 8
GREATEST = 1 << 40
LONG = (1 << 63) - 1
#: What a bound gives way, relative to itself: far more than square roots in double precision are wrong by.
GIVE = 2.0**-40


@dataclass
class Node:
    """A leaf has ``entries`` only; else distances of a child's entries from ``vantage`` are within ``low`` and ``high``."""

    entries: np.ndarray
    vantage: int = -1
    children: tuple = ()
    low: tuple = ()
    high: tuple = ()


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def plant(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The vantage-point tree of the entries of one position."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= LEAF:
        return Node(entries)
    far = np.stack([root(squared(book[entries], book[e])) for e in entries])
    at = int(np.argmax(far.var(axis=1)))  # distances from it tell entries apart best
    others, d = np.delete(entries, at), np.delete(far[at], at)
    order = np.argsort(d, kind="stable")
    halves = order[: len(order) // 2], order[len(order) // 2 :]
    return Node(entries, int(entries[at]), tuple(plant(book, np.sort(others[h])) for h in halves), tuple(d[h].min() * (1 - GIVE) for h in halves), tuple(d[h].max() * (1 + GIVE) for h in halves))


class Search:
    """Nearest entries of the parts ``x`` of one position: squared distances and indices."""

    def __init__(self, book: np.ndarray, tree: Node, x: np.ndarray):
        self.book, self.x = book, x
        self.entry = np.full(len(x), tree.entries[0], np.int64)
        self.best = squared(x, book[tree.entries[0]])
        self.compared = 0
        every = np.arange(len(x))
        self.descend(tree, every)
        self.visit(tree, every)

    def offer(self, who: np.ndarray, d: np.ndarray, entry: np.ndarray | int) -> None:
        better = (d < self.best[who]) | ((d == self.best[who]) & (entry < self.entry[who]))
        self.best[who[better]] = d[better]
        self.entry[who[better]] = entry[better] if isinstance(entry, np.ndarray) else entry

    def leaf(self, node: Node, who: np.ndarray) -> None:
        d = squared(self.x[who][:, None], self.book[node.entries][None])
        self.compared += d.size
        nearest = np.argmin(d, axis=1)  # the first of equals, and a leaf's entries ascend
        self.offer(who, d[np.arange(len(who)), nearest], node.entries[nearest])

    def gaps(self, node: Node, who: np.ndarray) -> list[np.ndarray]:
        """Compares with the vantage entry; for each child how far off its entries are at least."""
        d = squared(self.x[who], self.book[node.vantage])
        self.compared += d.size
        self.offer(who, d, node.vantage)
        r = root(d)
        return [np.maximum(np.maximum(r * (1 - GIVE) - high, low - r * (1 + GIVE)), 0.0) for low, high in zip(node.low, node.high)]

    def descend(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if not node.children:
            return self.leaf(node, who)
        gaps = self.gaps(node, who)
        first = gaps[0] <= gaps[1]
        self.descend(node.children[0], who[first])
        self.descend(node.children[1], who[~first])

    def visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if not node.children:
            return self.leaf(node, who)
        for child, gap in zip(node.children, self.gaps(node, who)):
            self.visit(child, who[gap * gap * (1 - GIVE) <= self.best[who].astype(np.float64) * (1 + GIVE)])


class Codebooks:
    """Entries by part, entry and position within the part, and their trees."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.reach = int(np.abs(books).max()) if books.size else 0
        self.trees = [plant(b) for b in self.exact(books, 2 * self.reach)]

    @staticmethod
    def exact(x: np.ndarray, gap: int) -> np.ndarray:
        """``x``, as whole numbers of any size where squared distances of gaps up to ``gap`` may not fit a long."""
        return x.astype(object) if gap * gap * x.shape[2] > LONG // 2 else x

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances (vectors by parts) of integer vectors."""
        x = x.reshape(len(x), PARTS, -1)
        gap = self.reach + int(np.abs(x).max(initial=0))
        books, x = self.exact(self.books, gap), self.exact(x, gap)
        found = [Search(b, t, x[:, i]) for i, (b, t) in enumerate(zip(books, self.trees))]
        return np.stack([s.entry for s in found], axis=1), np.stack([s.best for s in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def whole(column: pa.ListArray, dim: int) -> np.ndarray:
    """floor(256 x) of a batch's vectors."""
    scaled = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    return np.clip(scaled, -GREATEST, GREATEST).astype(np.int64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the vectors that can be cut and hold finite numbers only."""
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.select("vec_id", "label", F.col("embedding").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0)).where(fine)


def first_vectors(good: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The vectors as long as that of least id, and the first of them as integers."""
    order = F.col("vec_id").asc_nulls_last(), F.col("v")
    first = [r["v"] for r in good.orderBy(*order).limit(ENTRIES).select("v").collect()]
    dim = len(first[0]) if first else PARTS
    good = good.where(F.size("v") == dim)
    if any(len(v) != dim for v in first):
        first = [r["v"] for r in good.orderBy(*order).limit(ENTRIES).select("v").collect()]
    return good, whole(pa.array(first, pa.list_(pa.float64())), dim)


def refined(good: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one more round."""
    parts, entries, width = books.books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = whole(batch.column("v"), parts * width)
            entry, _ = books.assign(x)
            own = np.zeros((parts, entries, width), np.int64)  # a batch's sums stay far below a long
            for i in range(parts):
                np.add.at(own[i], entry[:, i], x[:, i * width : (i + 1) * width])
                count[i] += np.bincount(entry[:, i], minlength=entries)
            total += own
        part, e = np.nonzero(count)
        spot = np.tile(np.arange(width), len(part))
        part, e = np.repeat(part, width), np.repeat(e, width)
        sent = pa.array([Decimal(int(t)) for t in total[part, e, spot]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(e, pa.int32()), pa.array(spot, pa.int32()), pa.array(count[part, e], pa.int64()), sent], ["part", "entry", "spot", "n", "total"])

    found = good.select("v").mapInArrow(sums, "part int, entry int, spot int, n long, total decimal(38,0)")
    new = books.books.copy()
    for r in found.groupBy("part", "entry", "spot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # as many rows as the codebooks have numbers
        new[r["part"], r["entry"], r["spot"]] = int(r["total"]) // r["n"]
    return Codebooks(new)


def coder(books: Codebooks, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dim = books.books.shape[0] * books.books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = books.assign(whole(batch.column("v"), dim))
            error = [min(sum(map(int, row)), LONG) for row in far] if far.dtype == object else far.sum(axis=1)
            codes = [bytes(row).hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(codes, pa.string()), pa.array(error, pa.int64())], [*kept, "code", "error"])

    return run


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error of the usable rows of ``vectors(vec_id, label, embedding)``, and the codebooks."""
    good, first = first_vectors(usable(vectors))
    books = Codebooks(first.reshape(len(first), PARTS, first.shape[1] // PARTS).swapaxes(0, 1))
    if len(first):
        for _ in range(rounds):
            books = refined(good, books)
    else:
        good = good.where("false")
    kinds = {f.name: f.dataType.simpleString() for f in good.schema}
    return good.mapInArrow(coder(books, ["vec_id", "label"]), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = checkpointed(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
