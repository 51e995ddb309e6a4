"""Stored indices and stores over the driver's tables: built in the shared folder, asked, and deleted again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import embedding
from tarn.operators import conversation_search, neighbours, search, tokens
from tarn.plans.further_queries import _PARTS, _embedded_sql, _provider, _summaries
from tarn.plans.register import query
from tarn.plans.search_queries import _COS, _Q, _SPARSE, _VEC, QUERY, TOKENS_SQL, _documents, _hybrid_sql, _points, _vector, tokens_sql
from tarn.session import checkpointed, folder, table
from tarn.sources import clustered, collection, inverted, store


@query(f"with {TOKENS_SQL}, {_Q}, {_SPARSE} select id, score from s order by score desc, id limit 20")
def sparse_topk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    with folder(spark, "index") as path:
        index = inverted.build(spark, path, _documents(spark, sf_dir), "doc_id", F.col("text"))
        return checkpointed(index.topk(tokens.query_terms(spark, QUERY), 20))


@query(_hybrid_sql("true", 320, 480, "rrf") + " select id, score from fused order by score desc, id limit 10")
def hybrid_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search whose sparse leg reads the stored index."""
    points = _points(spark, sf_dir)
    with folder(spark, "index") as path:
        index = inverted.build(spark, path, _documents(spark, sf_dir), "doc_id", F.col("text"))
        return checkpointed(search.hybrid_search(points, index.postings, QUERY, _vector(spark, sf_dir), total=points.count(), where=F.lit(True)))


_CHANGED = "changed as (select doc_id, case when doc_id % 4 = 0 then text || ' extra handler' else text end text from documents where (doc_id % 3 <> 0 or doc_id % 4 = 0) and doc_id % 10 <> 3)"


def _changed_index(spark: SparkSession, sf_dir: str, path: str) -> inverted.InvertedIndex:
    """Some documents, then some of them with another text and some more, then without some."""
    docs = _documents(spark, sf_dir)
    index = inverted.build(spark, path, docs.where("doc_id % 3 <> 0"), "doc_id", F.col("text"))
    inverted.build(spark, path, docs.where("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit(" extra handler"))), "doc_id", F.col("text"))
    index.delete(docs.where("doc_id % 10 = 3").select(F.col("doc_id").alias("id")))
    return index


@query(f"with {_CHANGED}, {tokens_sql('changed', 'doc_id')}, {_Q} select term, count(*) df from post semi join q using (term) group by term")
def index_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies after upserts and deletions."""
    terms = [r["term"] for r in tokens.query_terms(spark, QUERY).collect()]  # a query's
    with folder(spark, "index") as path:
        return checkpointed(_changed_index(spark, sf_dir, path).frequencies(terms))


@query(f"with {_CHANGED}, {tokens_sql('changed', 'doc_id')}, {_Q}, {_SPARSE.replace('from documents', 'from changed')} select id, score from s order by score desc, id limit 20")
def sparse_topk_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents after upserts, deletions and a compaction."""
    with folder(spark, "index") as path:
        index = _changed_index(spark, sf_dir, path)
        index.compact()
        return checkpointed(index.topk(tokens.query_terms(spark, QUERY), 20))


@query(f"with {_VEC} select vec_id id, round({_COS}, 6) score from embeddings e, v order by score desc, id limit 10")
def dense_topk_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact mode of the index by lists."""
    with folder(spark, "lists") as path:
        index = clustered.ClusteredVectors(spark, path)
        e = table(spark, sf_dir, "embeddings")
        index.build(e.where("vec_id % 5 <> 0"), 32, "vec_id")
        index.add(e.where("vec_id % 5 = 0"), "vec_id")
        return checkpointed(index.search_exactly(_vector(spark, sf_dir), 10))


@query("""with p as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings),
    s as (select a.vec_id id, b.vec_id other, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) score from p a join p b on a.vec_id <> b.vec_id)
    select id, other, score, row_number() over (partition by id order by score desc, other)::int rank from s qualify rank <= 5""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), 5, "vec_id")[0]


@query(f"""with {_PARTS}, {_embedded_sql('e', 'titled', 'conv_id', 'title')},
    pairs as (select a.conv_id, b.conv_id other, sum(a.v * b.v) x from e a join e b using (c) group by all),
    s as (select a.conv_id, b.conv_id other, round(coalesce(x, 0), 6) score from titled a join titled b on a.conv_id <> b.conv_id left join pairs on pairs.conv_id = a.conv_id and pairs.other = b.conv_id)
    select conv_id, other, score, row_number() over (partition by conv_id order by score desc, other)::int rank from s qualify rank <= 5""")
def similar_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every conversation the others whose titles are nearest."""
    full, _ = _summaries(spark, sf_dir)
    return conversation_search.all_similar_conversations(conversation_search.SemanticEngine(_provider).index(full), 5)


@query("""with n as (select count(*) n from embeddings), m as (select count(*) n from embeddings where vec_id % 2 = 0)
    select * from (select 'before' step, false fits, 0::bigint points union all select 'created', true, 0 union all select 'filled', true, n from n
    union all select 'without odd ids', true, n from m union all select 'another dimension', false, 0 union all select 'dropped', false, 0)""")
def store_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``ensure`` says and the store holds while it is made, filled, emptied, asked in another dimension, and dropped."""
    v = F.col("vec_id")
    points = table(spark, sf_dir, "embeddings").select(v.alias("id"), F.lit("r").alias("repo"), F.concat(F.lit("b"), v % 3).alias("branch"), F.concat(F.lit("f"), v % 10).alias("file_path"), F.col("embedding").alias("dense"))
    schema, seen = "id long, repo string, branch string, file_path string, dense array<float>", []
    with folder(spark, "store") as path:
        kept = store.VectorStore(spark, path, 64)
        note = lambda step, s: seen.append((step, s.ensure(), s.count()))
        note("before", kept)
        kept.create(schema)
        note("created", kept)
        kept.upsert(points)
        note("filled", kept)
        kept.delete(F.col("id") % 2 == 1)
        note("without odd ids", kept)
        note("another dimension", store.VectorStore(spark, path, 32))
        kept.create(schema)
        kept.drop()
        note("dropped", kept)
    return spark.createDataFrame(seen, "step string, fits boolean, points long")


@query("""select vec_id id, 'b' || vec_id % 3 branch from embeddings where vec_id % 50 = 7 and case when vec_id % 4 = 0 then 'rust' else 'go' end = 'go'""")
def store_payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a path and a language, found by the files' order and Bloom filters."""
    v = F.col("vec_id")
    points = table(spark, sf_dir, "embeddings").select(v.alias("id"), F.lit("r").alias("repo"), F.concat(F.lit("b"), v % 3).alias("branch"), F.concat(F.lit("f"), v % 50).alias("file_path"), F.when(v % 4 == 0, "rust").otherwise("go").alias("language"), F.col("embedding").alias("dense"))
    with folder(spark, "store") as path:
        kept = store.VectorStore(spark, path, 64)
        kept.upsert(points)
        return checkpointed(kept.points().where("file_path = 'f7' and language = 'go'").select("id", "branch"))


@query(f"""with {TOKENS_SQL}, one as (select distinct term from post where doc_id % 2 = 0), two as (select distinct term from post where term not in (select term from one))
    select term, (row_number() over (order by term) - 1)::int term_id from one union all select term, ((select count(*) from one) + row_number() over (order by term) - 1)::int from two""")
def vocabulary_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of some documents, grown by all of them: ids stay."""
    terms = tokens.term_rows(_documents(spark, sf_dir), "doc_id", F.col("text"))
    first = tokens.vocabulary(terms.where("doc_id % 2 = 0"))
    return tokens.grown_vocabulary(checkpointed(first), terms)


@query("""with w as (select doc_id, least(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), 512) w from documents), t as (select w, case when w <= 12 then w else 12 + floor(ln(w / 12.0) / ln(1.08))::int + 1 end size from w where w > 0)
    select size::int size, count(*) texts, sum(w)::bigint tokens, max(w)::int longest from t group by size""")
def padded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ids and masks for a model, summed up by class of lengths."""
    made = embedding.padded_batches(table(spark, sf_dir, "documents"), "doc_id", budget=16_384, most=512, make=_provider)
    own = F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.aggregate(m, F.lit(0).cast("long"), lambda x, y: x + y))
    return made.groupBy("size").agg(F.sum("n").alias("texts"), F.sum(own).alias("tokens"), F.max("longest").alias("longest"))


@query(
    _hybrid_sql("documents.lang = 'en' and vec_id % 9 <> 4", 320, 480, "rrf").replace(TOKENS_SQL, "changed as (select doc_id, case when doc_id % 3 = 0 then text || ' extra handler' else text end text from documents), " + tokens_sql("changed", "doc_id"))
    + " select id, score from fused order by score desc, id limit 10"
)
def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of both sides: filled, partly replaced, partly emptied, compacted, asked with a filter."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo"), F.lit("main").alias("branch"), F.col("lang").alias("language"), "text")
    points = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense")), "id")
    with folder(spark, "collection") as path:
        kept = collection.Collection(spark, path, 64)
        kept.upsert(points)
        kept.upsert(points.where("id % 3 = 0").withColumn("text", F.concat("text", F.lit(" extra handler"))))
        kept.delete(F.col("id") % 9 == 4)
        kept.compact()
        return checkpointed(kept.search(QUERY, _vector(spark, sf_dir), where=F.col("language") == "en"))
