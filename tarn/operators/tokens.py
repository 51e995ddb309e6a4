"""Code tokens, vocabularies and term weights."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import fixed
from tarn.functions.text import filename_term
from tarn.session import checkpointed

# Alternatives begin with different characters but for those that the table's order keeps apart, so the frequent ones may
# be tried first.
_FIRST = sorted(range(len(fixed.TOKEN_PATTERNS)), key=lambda i: (i not in (4, 7, 5), i))
ANY_TOKEN = "(?s)" + "|".join(f"(?:{fixed.TOKEN_PATTERNS[i][0]})" for i in _FIRST)
INDEXED = ("Identifier", "Literal")
# The indexed tokens alone, each behind all that is not indexed: characters that begin no such token, comments, slashes. A
# quote without its second half, and the end of the text, are found too and are no tokens.
_REST = rf"""(?:[^a-zA-Z_"'/\p{{Nd}}]++|{fixed.TOKEN_PATTERNS[0][0]}|/)*+"""
INDEXED_TOKEN = f"(?s){_REST}(" + "|".join(fixed.TOKEN_PATTERNS[i][0] for i in (4, 5, 1, 2, 3)) + r"""|["']|\z)"""
SYMBOL_CODES = [ord(c) for c in "(){}[]<>=+-*/%&|^!~,;:."]


def kind_of(token: Column) -> Column:
    """Kind of a token, from its first character and length: they tell which pattern has matched."""
    c, many = F.ascii(token), F.length(token) > 1
    return (
        F.when(c.between(97, 122) | c.between(65, 90) | (c == 95), "Identifier")
        .when(c.between(9, 13) | (c == 32) | ((c > 127) & token.rlike(r"^[\x{85}\p{Z}]")), "Whitespace")
        .when(c.between(48, 57) | ((c > 127) & token.rlike(r"^\p{Nd}")), "Literal")
        .when((c == 34) & many, "Literal")
        .when((c == 39) & many, F.when(token.endswith("'"), "Literal").otherwise("Identifier"))
        .when((c == 47) & many, "Comment")
        .when(c.isin(SYMBOL_CODES), "Symbol")
        .otherwise("Unknown")
    )


def tokens(text: Column, keep_whitespace: bool = False, lower_identifiers: bool = True) -> Column:
    """Array of (text, kind); identifiers are lower-cased, white space is left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY_TOKEN), F.lit(0)), lambda t: F.struct(t.alias("text"), kind_of(t).alias("kind")))
    if not keep_whitespace:
        found = F.filter(found, lambda t: t["kind"] != "Whitespace")
    if lower_identifiers:
        found = F.transform(found, lambda t: F.struct(F.when(t["kind"] == "Identifier", F.lower(t["text"])).otherwise(t["text"]).alias("text"), t["kind"].alias("kind")))
    return found


def token_rows(docs: DataFrame, keep: list, text: Column) -> DataFrame:
    """(.., term, kind), one row for each token but white space.

    Rows are made first, so kinds are compiled code.
    """
    rows = docs.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(ANY_TOKEN), F.lit(0))).alias("_t"))
    kinds = rows.withColumn("kind", kind_of(F.col("_t"))).where("kind <> 'Whitespace'")
    return kinds.withColumn("term", F.when(F.col("kind") == "Identifier", F.lower("_t")).otherwise(F.col("_t"))).drop("_t")


def indexed_rows(docs: DataFrame, keep: list, text: Column) -> DataFrame:
    """(.., term), one row for each indexed token: ``token_rows`` without the other kinds, which are not even made rows."""
    rows = docs.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(INDEXED_TOKEN), F.lit(1))).alias("_t")).where(~F.col("_t").isin("", '"', "'"))
    # of the indexed ones, literals in quotes alone are not lower-cased, and numbers have no case
    quoted = F.col("_t").startswith('"') | F.col("_t").endswith("'")
    return rows.withColumn("term", F.when(quoted, F.col("_t")).otherwise(F.lower("_t"))).drop("_t")


def term_rows(docs: DataFrame, id_col: str, text: Column, kinds: tuple[str, ...] = INDEXED) -> DataFrame:
    """(id, term), one row for each indexed token."""
    if kinds == INDEXED:
        return indexed_rows(docs, [id_col], text)
    return token_rows(docs, [id_col], text).where(F.col("kind").isin(*kinds)).select(id_col, "term")


def postings(docs: DataFrame, id_col: str, text: Column, name: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """(id, term, tf, weight): tf counts 2 for a term that is also in the document's file name; weight = 1 + ln tf.

    With ``only``, those of a few terms: documents that do not contain one are not tokenised, and no other token is
    counted or shuffled.
    """
    if only is not None:
        asked = [F.lower(text).contains(t.lower()) for t in only] or [F.lit(False)]
        docs = docs.where(reduce(lambda a, b: a | b, asked))
    names = [F.transform(tokens(name), lambda t: t["text"]).alias("_name")] if name is not None else []
    if name is not None:
        docs = docs.select("*", *names)
        names = ["_name"]
    terms = indexed_rows(docs, [id_col, *names], text)
    if only is not None:
        terms = terms.where(F.col("term").isin(*only))
    count = F.sum(F.when(F.array_contains("_name", F.col("term")), 2).otherwise(1)) if name is not None else F.count("*")
    return terms.groupBy(id_col, "term").agg(count.cast("long").alias("tf")).withColumn("weight", 1 + F.log(F.col("tf")))


#: Texts whose tokens are counted together.
PART = 1024


def counted(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, terms, length): for each row its indexed terms with their tf, and the sum of these; nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                found = part.column(1).flatten().dictionary_encode()
                seen = found.dictionary
                quoted = pc.or_(pc.starts_with(seen, '"'), pc.ends_with(seen, "'"))
                terms = pc.if_else(quoted, seen, pc.ascii_lower(seen)).dictionary_encode()  # as in ``indexed_rows``
                code = np.asarray(terms.indices)[np.asarray(found.indices)]
                row = np.repeat(np.arange(part.num_rows), np.asarray(pc.fill_null(pc.list_value_length(part.column(1)), 0)))
                good = ~np.asarray(pc.is_in(terms.dictionary, pa.array(["", '"', "'"])).to_numpy(zero_copy_only=False))
                keep, width = good[code] if len(code) else np.zeros(0, bool), max(1, len(good))
                key, tf = np.unique(row[keep].astype(np.int64) * width + code[keep], return_counts=True)
                held = pa.StructArray.from_arrays([terms.dictionary.take(pa.array(key % width)), pa.array(tf, pa.int32())], ["term", "tf"])
                ends = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * width), pa.int32())
                length = np.bincount(key // width, tf, part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, held), pa.array(length)], ["id", "terms", "length"])

    rows = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(text, F.lit(INDEXED_TOKEN), F.lit(1)).alias("_t"))
    return rows.mapInArrow(run, f"id {kind}, terms array<struct<term:string,tf:int>>, length long")


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(terms: DataFrame, range_terms: int = 100_000) -> DataFrame:
    """(term, term_id): ids from 0 in the order of terms."""
    return numbered(checkpointed(terms.select("term").distinct()), 0, range_terms)


def grown_vocabulary(vocab: DataFrame, terms: DataFrame, range_terms: int = 100_000) -> DataFrame:
    """``vocab`` with the terms that it lacks, behind its greatest id in their order. Ids that are given stay; run again, it adds nothing."""
    new = checkpointed(terms.select("term").distinct().join(vocab.select("term"), "term", "left_anti"))
    last = vocab.agg(F.max("term_id")).first()[0]
    return vocab.select("term", "term_id").unionByName(numbered(new, 0 if last is None else last + 1, range_terms))


def numbered(unique: DataFrame, start: int, range_terms: int = 100_000) -> DataFrame:
    """(term, term_id): ids from ``start`` in the order of the terms of ``unique``, which is read three times.

    Ids are dealt by ranges of terms, whose bounds come from a sample of what there is: counts of ranges are summed, so no
    task numbers the whole vocabulary, and a common beginning is as many ranges as its terms need.
    """
    many = unique.agg(F.approx_count_distinct("term").alias("n")).first()["n"]
    bounds = []
    if many > range_terms:
        picked = sorted(r["term"] for r in unique.where(F.pmod(F.xxhash64("term"), F.lit(max(1, many // 10_000))) == 0).collect())  # about 10000
        bounds = picked[:: max(1, len(picked) * range_terms // many)]
    ordered = unique.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<string>"), lambda b: b <= F.col("term"))))
    sizes = ordered.groupBy("_range").count().withColumn("_base", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = ordered.withColumn("_n", F.row_number().over(W.partitionBy("_range").orderBy("term")))
    return ranked.join(sizes.select("_range", "_base"), "_range").select("term", (F.col("_base") + F.col("_n") + (start - 1)).cast("int").alias("term_id"))


def term_ids(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """``terms`` with the term_id of each term, null for unknown ones."""
    return terms.join(vocab, "term", "left")


def terms_of(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """``ids`` with the term of each term_id, null for unknown ones."""
    return ids.join(vocab, "term_id", "left")


def idf(total: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def query_terms(spark, query: str, use_tf: bool = True, boost: float = 2.0) -> DataFrame:
    """(term, weight) of a query: 1 + ln f, or f over the query's length; terms like file names times ``boost``."""
    one = spark.createDataFrame([(query,)], "q string").select(tokens(F.col("q")).alias("t"))
    terms = one.select(F.size("t").alias("length"), F.inline("t")).groupBy("text", "length").agg(F.count("*").alias("f"))
    base = 1 + F.log("f") if use_tf else F.col("f") / F.greatest(F.col("length"), F.lit(1))
    return terms.select(F.col("text").alias("term"), (base * F.when(filename_term(F.col("text"), query), boost).otherwise(1.0)).alias("weight"))
