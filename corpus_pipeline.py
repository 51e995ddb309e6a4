"""Corpus preparation: ``documents`` through the stages below, each over all that its predecessor kept.

1. quality: documents below the quality or above the toxicity threshold go.
2. lines: of lines that repeat, exactly or nearly, the first stays; documents stay, if need be with an empty text.
3. near_duplicates: of each group of near duplicates (shingles of five words, similarity 0.8) the first stays, that of
   least id (none last). Documents without words are duplicates of none; of rows equal in id and text one stays.
4. personal_data: what is found is replaced by its kind in angle brackets.
5. packing: the rest in sequences of 1024 tokens, one row per piece: its ids, its place (sequence_id, offset), and the
   document it is of (doc_id; row: 128 bits of hash of the text it was cut from). A sequence is its pieces' ids by offset.

All stages decide by row, known by id and text: rows that share an id, or have none, are documents of their own. Null texts
are judged by the first stage like empty ones, then pass (the last packs them as empty); extra columns pass all but the
last; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import line_dedup, minhash, packing, pii, quality
from tarn.llm.common import removed, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.apply_decisions(docs, quality.classify(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.apply_decisions(docs, line_dedup.all_line_decisions(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.apply_decisions(docs, minhash.near_duplicates(docs, width=5))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: Tokenisation, shingle sets and the classifier cannot be said in SQL; ``tests/llm`` compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written to the shared folder and read again.

    A stage's table goes when the next one is written, and the last, or that before a failure, when this function ends:
    only tables that it has made itself.
    """
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for name, stage in STAGES[:-1]:
            docs, path = written(stage(spark, docs, sf_dir), name)
            if kept:
                removed(spark, kept)
            kept = path
        return STAGES[-1][1](spark, docs, sf_dir)  # packing reads its own checkpoint from here on
    finally:
        if kept:
            removed(spark, kept)
