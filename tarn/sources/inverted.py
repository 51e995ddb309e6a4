"""A stored inverted index: postings in blocks with their greatest impact, in files by bucket of terms.

The index is a list of segments, each written once. A segment holds

- ``blocks``: for each term, postings (ids and frequencies) in blocks of documents of like length, with the block's greatest
  frequency; partitioned by a bucket of the term's hash;
- ``terms``: by bucket, how much a segment changes each term's document frequency;
- ``forward``: the terms and frequencies of each document, so that a deletion knows what it changes; what else a segment
  holds is made of it;
- ``gone``: the ids that a segment deletes or replaces in all segments before it.

A search reads the buckets of its terms and no others. Document frequencies are sums of what the segments say, so they are
exact after any number of upserts and deletions. The best k are found in two passes: headers of blocks (no postings) bound
what a group of documents can score; the groups of the highest bounds are scored, and the k-th best of them is a threshold
that leaves out every group that cannot reach it. Results are those of an exhaustive search.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import search, tokens
from tarn.session import checkpointed
from tarn.sources.commits import CommitLog

#: Documents of a group, whose postings of a term are one block.
GROUP = 4096
#: Shares that a bucket is written in at most, and groups for each.
SHARES, SHARE_GROUPS = 8, 16
#: Groups scored for a threshold, and how much a score may gain by rounding.
FIRST_GROUPS, ROUNDING = 8, 1e-5


class InvertedIndex:
    """Postings of documents (an id and terms) in a folder.

    Writers add segments and commit by one rename; readers see whole commits. ``compact`` merges all segments into one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets, self.log = spark, path, buckets, CommitLog(spark, path)

    def _load(self, name: str, part: str, kind: str) -> DataFrame:
        """A part of a segment, which may have no rows; ``kind``: the type of ids."""
        schema = {
            "terms": "term string, df long, bucket int",
            "forward": f"id {kind}, terms array<struct<term:string,tf:int>>, length long",
            "blocks": f"term string, size int, part int, most int, n long, postings array<struct<id:{kind},tf:int>>, bucket int",
            "gone": f"id {kind}",
        }
        return self.spark.read.schema(schema[part]).parquet(f"{self.path}/{name}/{part}")

    # writing

    def _bucket(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int").alias("bucket")

    def upsert(self, postings: DataFrame, ids: DataFrame | None = None) -> None:
        """Adds the documents of ``postings(id, term, tf)``, one row for each term of each; those held under an id are replaced.

        ``ids(id)`` names documents that count though they may have no term.
        """
        self._append(self._grouped(postings, ids), None)

    def upsert_texts(self, docs: DataFrame, id_col: str, text: Column, name: Column | None = None) -> None:
        """Adds documents by their texts, or replaces them; rows of one id are one document. ``name``: see ``tokens.postings``."""
        docs = docs.where(F.col(id_col).isNotNull())
        post = lambda some: tokens.postings(some, id_col, text, name).select(F.col(id_col).alias("id"), "term", "tf")
        if name is not None:
            self.upsert(post(docs), docs.select(F.col(id_col).alias("id")))
            return
        # terms are counted by rows, but for ids that have several
        shared = checkpointed(docs.groupBy(id_col).count().where("count > 1").select(id_col))
        if shared.isEmpty():
            self._append(tokens.counted(docs, id_col, text), None)
            return
        met = docs.join(shared, id_col, "left_semi")
        single = tokens.counted(docs.join(shared, id_col, "left_anti"), id_col, text)
        self._append(single.unionByName(self._grouped(post(met), met.select(F.col(id_col).alias("id")))), None)

    @staticmethod
    def _grouped(postings: DataFrame, ids: DataFrame | None) -> DataFrame:
        """(id, terms, length) of postings."""
        docs = postings.where("id is not null").groupBy("id").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("terms"), F.sum("tf").cast("long").alias("length"))
        if ids is not None:
            docs = docs.join(ids.select("id").where("id is not null").distinct(), "id", "full")
        return docs.select("id", F.coalesce("terms", F.array().cast("array<struct<term:string,tf:int>>")).alias("terms"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))

    def delete(self, ids: DataFrame) -> None:
        """Deletes documents by ``ids(id)``."""
        self._append(None, ids)

    def _append(self, docs: DataFrame | None, ids: DataFrame | None) -> None:
        """A segment with ``docs(id, terms, length)`` and without what is held under their ids, or under ``ids``."""
        version, state = self.log.current()
        segments = list(state["segments"]) if state else []
        live = self._live("forward")
        if docs is None and live is None:
            return
        seq, name, count, deltas = version + 1, f"segment-{uuid.uuid4().hex}", 0, []
        at, kind = f"{self.path}/{name}", (docs if docs is not None else ids).schema["id"].dataType.simpleString()
        has = {"terms": True, "blocks": docs is not None, "gone": False}
        if docs is not None:
            docs.write.parquet(f"{at}/forward")
            docs = self._load(name, "forward", kind)
            count, ids = docs.count(), docs
            deltas.append(self._changes(docs, 1))
        if live is not None:
            live.select("id").join(ids.select("id"), "id", "left_semi").distinct().write.parquet(f"{at}/gone")
            gone = self._load(name, "gone", kind)
            n = gone.count()
            has["gone"] = n > 0
            count -= n
            deltas.append(self._changes(live.join(gone, "id", "left_semi"), -1))
        self._terms(deltas[0] if len(deltas) == 1 else deltas[0].unionByName(deltas[1]), name)
        if docs is not None:
            self._blocks(docs, name)
        segments.append({"name": name, "seq": seq, "id": kind, **has})
        self.log.commit(version, {"segments": segments, "documents": (state["documents"] if state else 0) + count})

    @staticmethod
    def _changes(docs: DataFrame, sign: int) -> DataFrame:
        """(term, df): how much documents that come (1) or go (-1) change document frequencies."""
        return docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df"))

    def _terms(self, changes: DataFrame, name: str) -> None:
        df = changes.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        df.select("term", "df", self._bucket(F.col("term"))).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{name}/terms")

    def _blocks(self, docs: DataFrame, name: str) -> None:
        """Writes postings in blocks. Long documents stand apart from short ones: their frequencies are high.

        Postings are shuffled once, by bucket and share of its groups: a block is within a share.
        """
        sized = docs.where("length > 0").select("id", F.floor(2 * F.log2("length")).cast("int").alias("size"), "terms")
        sizes = {r["size"]: -(-r["count"] // GROUP) for r in sized.groupBy("size").count().collect()}  # a row for each power of two
        parts = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(v)))) if sizes else F.create_map()
        shares = max(1, min(SHARES, sum(sizes.values()) // SHARE_GROUPS))
        placed = sized.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), parts[F.col("size")]).cast("int"))
        placed = placed.select("id", "size", "part", F.pmod(F.hash("size", "part"), F.lit(shares)).alias("share"), F.inline("terms"))
        held = placed.withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket", "share")
        block = F.array_sort(F.collect_list(F.struct("id", "tf")))
        made = held.groupBy("bucket", "share", "term", "size", "part").agg(F.max("tf").alias("most"), F.count("*").alias("n"), block.alias("postings"))
        made.select("term", "size", "part", "most", "n", "postings", "bucket").sortWithinPartitions("bucket", "term", F.desc("size"), "part").write.partitionBy("bucket").parquet(f"{self.path}/{name}/blocks")

    def compact(self) -> None:
        """All segments as one, without what was deleted."""
        version, state = self.log.current()
        live = self._live("forward")
        if live is None:
            return
        name, kind = f"segment-{uuid.uuid4().hex}", live.schema["id"].dataType.simpleString()
        live.select("id", "terms", "length").write.parquet(f"{self.path}/{name}/forward")
        docs = self._load(name, "forward", kind)
        self._terms(self._changes(docs, 1), name)
        self._blocks(docs, name)
        self.log.commit(version, {"segments": [{"name": name, "seq": version + 1, "id": kind, "terms": True, "blocks": True, "gone": False}], "documents": state["documents"]})

    def vacuum(self) -> list[str]:
        """Deletes segments that no reader is led to any more."""
        _, state = self.log.current()
        return self.log.vacuum({s["name"] for s in state["segments"]} if state else set(), "segment-")

    # reading

    def _segments(self, part: str) -> list[dict]:
        _, state = self.log.current()
        return [s for s in state["segments"] if s["blocks" if part == "forward" else part]] if state else []

    def _read(self, part: str, where: Column | None = None) -> DataFrame | None:
        """A part of all segments, with the number of the segment (seq); filters reach the scans."""
        out = None
        for s in self._segments(part):
            one = self._load(s["name"], part, s["id"])
            one = (one.where(where) if where is not None else one).withColumn("seq", F.lit(s["seq"]))
            out = one if out is None else out.unionByName(one)
        return out

    def _alive(self, rows: DataFrame) -> DataFrame:
        """``rows(id, seq, ..)`` that no later segment has deleted."""
        gone = self._read("gone")
        if gone is None:
            return rows
        last = gone.groupBy("id").agg(F.max("seq").alias("_gone"))
        return rows.join(last, "id", "left").where("_gone is null or _gone <= seq").drop("_gone")

    def _live(self, part: str) -> DataFrame | None:
        rows = self._read(part)
        return None if rows is None else self._alive(rows)

    def total(self) -> int:
        """Documents held."""
        _, state = self.log.current()
        return state["documents"] if state else 0

    def _of_terms(self, terms: list[str]) -> Column:
        """A filter on the partitions and terms of a few terms."""
        values = [r["b"] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t")).alias("b")).distinct().collect()] if terms else []
        return F.col("bucket").isin(*values) & F.col("term").isin(*terms) if terms else F.lit(False)

    def blocks(self, terms: list[str]) -> DataFrame | None:
        return self._read("blocks", self._of_terms(terms))

    def live_postings(self, terms: list[str] | None = None) -> DataFrame | None:
        """(id, term, tf) of all live documents, or those of a few terms."""
        rows = self._read("blocks", self._of_terms(terms) if terms is not None else None)
        return None if rows is None else self._alive(rows.select("term", "seq", F.inline("postings"))).select("id", "term", "tf")

    def postings(self, terms: list[str]) -> DataFrame:
        """(id, term, tf, weight) of a few terms, as ``search.sparse_scores`` and ``search.hybrid_search`` take them."""
        rows = self.live_postings(terms)
        if rows is None:
            rows = self.spark.createDataFrame([], "id long, term string, tf int")
        return rows.withColumn("weight", 1 + F.log("tf"))

    def frequencies(self, terms: list[str]) -> DataFrame:
        """(term, df) of a few terms."""
        rows = self._read("terms", self._of_terms(terms))
        if rows is None:
            return self.spark.createDataFrame([], "term string, df long")
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def topk(self, query: DataFrame, k: int, idf: bool = True) -> DataFrame:
        """(id, score) of the best k for ``query(term, weight)``; scores rounded to 6 digits, ties by id."""
        return self._topk(query, k, idf)[0]

    def _topk(self, query: DataFrame, k: int, idf: bool = True) -> tuple[DataFrame, dict[str, int]]:
        """``topk`` and how many groups of documents there are, and are scored."""
        asked = {r["term"]: r["weight"] for r in query.collect()}  # a query's terms
        blocks = self.blocks(list(asked))
        empty = self.spark.createDataFrame([], "id long, score double")
        if blocks is None or not asked:
            return empty, {"groups": 0, "scored": 0}
        df = {r["term"]: r["df"] for r in self.frequencies(list(asked)).collect()}
        n = float(self.total())
        factor = {t: w * (math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) if idf else 1.0) for t, w in asked.items() if t in df}
        if not factor:
            return empty, {"groups": 0, "scored": 0}
        of_term = F.create_map(*(x for t, w in factor.items() for x in (F.lit(t), F.lit(w))))
        group = ["seq", "size", "part"]
        known = blocks.where(F.col("term").isin(*factor))
        # headers alone: the scan leaves postings out
        bounds = checkpointed(known.groupBy(*group).agg(F.sum(F.greatest(F.lit(0.0), of_term[F.col("term")]) * (1 + F.log("most"))).alias("bound")))

        def scored(some: DataFrame | None) -> DataFrame:
            held = known.join(some, group, "left_semi") if some is not None else known
            rows = self._alive(held.select("term", "seq", F.inline("postings")))
            part = (1 + F.log("tf")) * of_term[F.col("term")]
            return search.topk(rows.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")), k)

        first = bounds.orderBy(F.desc("bound"), *group).limit(FIRST_GROUPS)
        best = scored(F.broadcast(first.select(*group))).collect()  # k rows
        groups = bounds.count()
        if len(best) < k:
            return scored(None), {"groups": groups, "scored": groups}
        reach = bounds.where(F.col("bound") >= best[-1]["score"] - ROUNDING)
        return scored(reach.select(*group)), {"groups": groups, "scored": reach.count()}


def build(spark: SparkSession, path: str, docs: DataFrame, id_col: str, text: Column, name: Column | None = None, buckets: int = 64) -> InvertedIndex:
    """An index of documents at a path, or its next segment where there is one."""
    index = InvertedIndex(spark, path, buckets)
    index.upsert_texts(docs, id_col, text, name)
    return index
