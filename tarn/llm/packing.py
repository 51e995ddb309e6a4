"""Operator 5: best-two-fit packing of tokenised documents into sequences of fixed capacity.

Sizes are whole numbers up to the capacity, so the packing problem is fully stated by how many pieces there are of
each size: at most ``capacity`` counts, whatever the corpus. The plan is made on those counts. A bin is filled greedily
(always the largest size that still fits), then, while it has a gap, its smallest document is taken out if two unpacked
documents fit the expanded gap more tightly. A filled bin is a pattern of sizes, repeated while the counts allow it.
Rows then find their place by their rank among the pieces of their size, so no row needs to meet another one.

ids are those of the tokenizers library at its default setting: what a text holds of the file's added tokens gets their
own ids. Texts of ordinary characters are merged by tiktoken from the file's own ranks, for a fifth of the time; texts
with added tokens, very long words or runs of blanks, or characters whose class may differ by version of Unicode go to the
library, and so does one text of each slice, whose ids must be the same by both.

Cases: a null text is an empty one and gives one piece of the end id alone. Repeated rows are pieces of their own; ties
within a size go by doc_id, piece, start and checksum. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed, documents, map_batches, text_hashes

#: Pieces of one size that are ranked together: a common size is dealt to as many lanes as it needs.
LANE = 100_000


#: Fixed value: how byte-level files part words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are letters, digits, blanks or none of these in all versions of Unicode alike.
STABLE = r"[\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*+"
#: Words and runs of blanks of so many characters are left to the library.
LONG = 1000


class FileEncoder:
    """ids of texts as the tokenizers library gives them for a byte-level file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.stable = re.compile(STABLE)
        self.special = re.compile("|".join([*map(re.escape, added), rf"\s{{{LONG}}}", rf"\S{{{LONG}}}"]))
        if self.plain:
            visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            hidden = [b for b in range(256) if b not in set(visible)]
            byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
            self.merger = tiktoken.Encoding("from_file", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})

    def ordinary(self, text: str) -> bool:
        return self.plain and self.stable.fullmatch(text) is not None and self.special.search(text) is None

    def ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [self.merger.encode_ordinary(t) if self.ordinary(t) else None for t in texts]
        checked = next((i for i, ids in enumerate(out) if ids), None)
        if checked is not None and self.ask([texts[checked]])[0] != out[checked]:
            raise ValueError("the merger's ids are not the library's")
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.ask([texts[i] for i in rest])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> FileEncoder:
    return FileEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids, row]: each document's ids cut to ``capacity``, the first piece shorter.

    ``row`` tells documents that share an id apart: 128 bits of hash of the text, as hexadecimal digits.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids", "row"] * with_ids

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        encoded = encoder(tokenizer_path).encode([t or "" for t in batch.column("text").to_pylist()])
        row = batch.column("row").to_pylist() if with_ids else [None] * len(encoded)
        for doc_id, found, own in zip(batch.column("doc_id").to_pylist(), encoded, row):
            packed = np.array([*found, end_id], "<u4")
            first = (len(packed) - 1) % capacity + 1
            for k, stop in enumerate(range(first, len(packed) + 1, capacity)):
                start = max(0, stop - capacity) if k else 0
                part = packed[start:stop]
                rows.append((doc_id, k, start, stop - start, zlib.crc32(part.tobytes()), *((part, own) if with_ids else ())))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64() if kind == "bigint" else None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string()]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>, row string" * with_ids
    row = [F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in text_hashes())).alias("row")] if with_ids else []
    return map_batches(docs.select("doc_id", "text", *row), kernel, schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of sizes and how often each is used, by best-two-fit on the counts of sizes."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] += n
    plan = []
    while left.any():
        taken: list[int] = []
        gap = capacity
        while gap > 0 and (fits := np.flatnonzero(left[: gap + 1])).size:
            size = int(fits[-1])
            taken.append(size)
            left[size] -= 1
            gap -= size
        while gap > 0 and len(taken) > 1:
            smallest = min(taken)
            room, pair = gap + smallest, None
            there = np.flatnonzero(left[: room + 1])
            if there.size:
                # the largest partner of each size that still fits beside it
                at = np.searchsorted(there, room - there, side="right") - 1
                partner = np.where(at >= 0, there[np.maximum(at, 0)], 0)
                alone = (partner == there) & (left[there] < 2)  # a size cannot be paired with itself if there is one
                partner = np.where(alone, np.where(at >= 1, there[np.maximum(at - 1, 0)], 0), partner)
                total = np.where(partner > 0, there + partner, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    pair = int(there[best]), int(partner[best])
            if pair is None:
                break
            taken.remove(smallest)
            left[smallest] += 1
            for size in pair:
                left[size] -= 1
                taken.append(size)
            gap = room - sum(pair)
        need = np.bincount(taken, minlength=capacity + 1)
        sizes = np.flatnonzero(need)
        times = 1 + int((left[sizes] // need[sizes]).min())
        left[sizes] -= (times - 1) * need[sizes]
        plan.append((sorted(taken, reverse=True), times))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces of this size in each bin, offset of the first)."""
    ranks: dict[int, int] = {}
    sequence = 0
    for taken, times in plan:
        offset = 0
        for size in dict.fromkeys(taken):
            each = taken.count(size)
            first = ranks.get(size, 0)
            yield size, first, first + each * times - 1, sequence, each, offset
            ranks[size] = first + each * times
            offset += each * size
        sequence += times


def place(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """``parts`` with sequence_id and offset. Reads ``parts`` three times; it should be a checkpoint or a table."""
    spark = parts.sparkSession
    total = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # ``capacity`` counts at most
    lanes = {n: -(-count // LANE) for n, count in total.items()}
    bins = spark.createDataFrame(list(slots(plan_bins(total, capacity))), "length long, low long, high long, sequence long, each long, shift long")
    wide = spark.createDataFrame(list(lanes.items()), "length long, lanes long")
    # as many rows as sizes
    laned = parts.join(F.broadcast(wide), "length").withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "lanes"))
    found = laned.groupBy("length", "lane").count().collect()  # a row for ``LANE`` pieces, and one for each size
    bases, before = [], dict.fromkeys(total, 0)
    for r in sorted(found, key=lambda r: (r["length"], r["lane"])):
        bases.append((r["length"], r["lane"], before[r["length"]]))
        before[r["length"]] += r["count"]
    bases = spark.createDataFrame(bases, "length long, lane long, base long")
    order = W.partitionBy("length", "lane").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = laned.withColumn("n", F.row_number().over(order).cast("long")).join(F.broadcast(bases), ["length", "lane"]).withColumn("rank", F.expr("base + n - 1"))
    # the plan's rows are bounded by the capacity, not by the corpus
    placed = ranked.join(F.broadcast(bins), (ranked["length"] == bins["length"]) & ranked["rank"].between(bins["low"], bins["high"])).drop(bins["length"])
    return placed.select(*parts.columns, F.expr("sequence + (rank - low) div each").alias("sequence_id"), F.expr("shift + ((rank - low) % each) * length").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32 [, ids, row], sequence_id, offset."""
    return place(checkpointed(pieces(docs, tokenizer_path, end_id, capacity, with_ids)), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
