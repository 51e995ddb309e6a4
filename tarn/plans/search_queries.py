"""Dense, sparse and hybrid search over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import fixed
from tarn.functions.frames import spread
from tarn.functions.text import filename_term
from tarn.operators import search, tokens
from tarn.plans.register import query
from tarn.session import table

QUERY = "the tion der que handler upload_file.rs the"

# SQL of tokens: the same patterns without possessive loops, which change nothing here
_PATTERNS = [(p.replace("*+", "*"), k) for p, k in fixed.TOKEN_PATTERNS]
_ANY = ("(?s)" + "|".join(f"(?:{p})" for p, _ in _PATTERNS)).replace("'", "''")
_KIND = "case " + " ".join("when regexp_full_match(t, '(?s)" + p.replace("'", "''") + f"') then '{k}'" for p, k in _PATTERNS) + " else 'Unknown' end"
def tokens_sql(source: str, key: str) -> str:
    """raw, kinds, toks and post of a table's texts."""
    return f"""raw as (select {key}, unnest(regexp_extract_all(text, '{_ANY}')) t from {source}),
    kinds as (select {key}, t, {_KIND} kind from raw),
    toks as (select {key}, case when kind = 'Identifier' then lower(t) else t end term, kind from kinds where kind <> 'Whitespace'),
    post as (select {key}, term, count(*) tf, 1 + ln(count(*)) weight from toks where kind in ('Identifier', 'Literal') group by all)"""


TOKENS_SQL = tokens_sql("documents", "doc_id")
_QRAW = f"""qraw as (select unnest(regexp_extract_all('{QUERY}', '{_ANY}')) t),
    qk as (select t, {_KIND} kind from qraw),
    qt as (select case when kind = 'Identifier' then lower(t) else t end term from qk where kind <> 'Whitespace')"""
_BOOST = "(strpos(lower('{q}'), lower(term)) > 0 and (regexp_matches(term, '{e}$') or regexp_matches(term, '[_.-]') or (strlen(term) > 3 and regexp_matches(term, '[A-Z]')))) or (regexp_matches(lower('{q}'), '{c}') and (regexp_matches(term, '[_.-]') or (strlen(term) > 3 and regexp_matches(term, '[A-Z]')) or term in ({n})))".format(
    q=QUERY, e="(" + "|".join(x.replace(".", "\\.") for x in fixed.FILENAME_EXTENSIONS) + ")", c="|".join(fixed.FILENAME_CONTEXT), n=", ".join(f"'{x}'" for x in fixed.FILENAME_NOUNS)
)
_Q = f"{_QRAW}, q as (select term, (1 + ln(count(*))) * case when {_BOOST} then 2.0 else 1.0 end weight from qt group by term)"
_VEC = "v as (select embedding::double[] q from embeddings where vec_id = 0)"
_COS = "list_dot_product(e.embedding::double[], v.q) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(v.q, v.q)))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def _dense(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    return search.dense_topk(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, metric, "vec_id")


@query(f"with {_VEC} select vec_id id, round({_COS}, 6) score from embeddings e, v order by score desc, id limit 10")
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "cosine")


@query(f"with {_VEC} select vec_id id, round(list_dot_product(e.embedding::double[], v.q), 6) score from embeddings e, v order by score desc, id limit 10")
def dense_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "dot")


@query(f"with {_VEC} select vec_id id, round(list_distance(e.embedding::double[], v.q), 6) score from embeddings e, v order by score, id limit 10")
def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "euclidean")


@query(f"with {_VEC} select vec_id id, round(list_sum(list_transform(list_zip(e.embedding::double[], v.q), lambda x: abs(x[1] - x[2]))), 6) score from embeddings e, v order by score, id limit 10")
def dense_topk_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "manhattan")


@query(f"with {_VEC} select * from (select vec_id id, round({_COS}, 6) score from embeddings e, v) where score >= 0.2")
def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_threshold(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 0.2, "vec_id")


@query("""with p as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings),
    s as (select a.vec_id id, b.vec_id other, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) score from p a join p b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
    select id, other, score, row_number() over (partition by id order by score desc, other)::int rank from s qualify rank <= 5""")
def similar_items_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similar_items(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 20 == 0, "vec_id")


@query(f"with {TOKENS_SQL} select kind, count(*) n, count(distinct term) n_distinct from toks group by kind")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_rows(_documents(spark, sf_dir), [], F.col("text"))
    # terms are counted before they are shuffled
    by_term = found.groupBy("kind", "term").agg(F.count("*").alias("c"))
    return by_term.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))


@query(f"with {TOKENS_SQL} select term, (row_number() over (order by term) - 1)::int term_id from (select distinct term from post)")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(tokens.term_rows(_documents(spark, sf_dir), "doc_id", F.col("text")))


@query(f"with {TOKENS_SQL} select term, count(*) df from post group by term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_frequency(tokens.postings(_documents(spark, sf_dir), "doc_id", F.col("text")))


@query(f"with {TOKENS_SQL} select doc_id, term, tf, round(weight, 6) weight from post")
def doc_term_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.postings(_documents(spark, sf_dir), "doc_id", F.col("text")).withColumn("weight", F.round("weight", 6))


@query(f"""with {TOKENS_SQL}, f as (select doc_id, lower(lang) lang from documents)
    select doc_id, term, sum(case when term in (lang, 'doc', 'txt') then 2 else 1 end)::bigint tf from toks join f using (doc_id) where kind in ('Identifier', 'Literal') group by all""")
def doc_term_filename_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc/"), F.col("lang"), F.lit(".txt"))
    return tokens.postings(_documents(spark, sf_dir), "doc_id", F.col("text"), name).select("doc_id", "term", "tf")


@query(f"with {TOKENS_SQL}, {_Q}, dfs as (select term, count(*) df from post group by term) select q.term, round(weight, 6) weight, coalesce(df, 0) df from q left join dfs using (term)")
def query_term_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a query's terms, and how many documents have them."""
    asked = tokens.query_terms(spark, QUERY)
    terms = [r["term"] for r in asked.collect()]  # a query's
    df = tokens.document_frequency(tokens.postings(_documents(spark, sf_dir), "doc_id", F.col("text"), only=terms))
    return asked.join(df, "term", "left").select("term", F.round("weight", 6).alias("weight"), F.coalesce("df", F.lit(0)).alias("df"))


@query(f"with {TOKENS_SQL} select distinct term, ({_BOOST}) boosted from post")
def filename_term_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms of the corpus a query that names files would boost."""
    terms = tokens.term_rows(_documents(spark, sf_dir), "doc_id", F.col("text")).select("term").distinct()
    return terms.select("term", filename_term(F.col("term"), QUERY).alias("boosted"))


_SPARSE_TF = "s as (select doc_id id, round(sum(p.weight * q.weight), 6) score from post p join q using (term) group by doc_id)"
_SPARSE = """dfs as (select term, count(*) df from post group by term), total as (select count(*)::double n from documents),
    s as (select doc_id id, round(sum(p.weight * q.weight * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) score from post p join q using (term) join dfs using (term), total group by doc_id)"""


def _postings(spark: SparkSession, sf_dir: str, terms: list[str] | None = None) -> DataFrame:
    return tokens.postings(_documents(spark, sf_dir), "doc_id", F.col("text"), only=terms)


def _sparse(spark: SparkSession, sf_dir: str, idf: bool) -> DataFrame:
    asked = tokens.query_terms(spark, QUERY)
    terms = [r["term"] for r in asked.select("term").collect()]  # of one query
    total = table(spark, sf_dir, "documents").count() if idf else None
    return search.topk(search.sparse_scores(_postings(spark, sf_dir, terms), asked, "doc_id", idf=idf, total=total), 20)


@query(f"with {TOKENS_SQL}, {_Q}, {_SPARSE_TF} select id, score from s order by score desc, id limit 20")
def sparse_topk_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir, False)


@query(f"with {TOKENS_SQL}, {_Q}, {_SPARSE} select id, score from s order by score desc, id limit 20")
def sparse_topk_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir, True)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(docs, "id")


def _hybrid_sql(where: str, dense: int, sparse: int, fuse: str, limit: int = 10) -> str:
    points = f"pts as (select vec_id id, embedding, lang, source from embeddings join documents on vec_id = doc_id where {where})"
    legs = f"""total2 as (select count(*)::double n from pts), hit as (select p.* from post p join q using (term) join pts on pts.id = p.doc_id),
        dfs as (select term, count(*) df from hit group by term),
        sp as (select p.doc_id id, round(sum(p.weight * q.weight * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) score from hit p join q using (term) join dfs using (term), total2 group by p.doc_id),
        d as (select e.id, round({_COS}, 6) score from pts e, v order by score desc, id limit {dense}), sx as (select * from sp order by score desc, id limit {sparse})"""
    if fuse == "rrf":
        parts = "parts as (select id, 1.0::double / (60 + row_number() over (order by score desc, id)) part from d union all select id, 1.0::double / (60 + row_number() over (order by score desc, id)) from sx)"
    else:
        norm = "case when coalesce(stddev_samp(score) over (), 0) > 0 then least(1.0, greatest(0.0, (score - (avg(score) over () - 3 * stddev_samp(score) over ())) / (6 * stddev_samp(score) over ()))) else 0.5 end"
        parts = f"parts as (select id, {norm} part from d union all select id, {norm} from sx)"
    return f"with {TOKENS_SQL}, {_Q}, {_VEC}, {points}, {legs}, {parts}, fused as (select id, round(sum(part), 6) score from parts group by id)"


def _hybrid(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    points = _points(spark, sf_dir)
    post = lambda terms: _postings(spark, sf_dir, terms).withColumnRenamed("doc_id", "id")
    more.setdefault("where", F.lit(True))
    total = points.where(more["where"]).count()
    return search.hybrid_search(points, post, QUERY, _vector(spark, sf_dir), total=total, **more)


@query(_hybrid_sql("true", 320, 480, "rrf") + " select id, score from fused order by score desc, id limit 10")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir)


@query(_hybrid_sql("true", 240, 320, "dbsf") + " select id, round(score, 4) score from fused order by fused.score desc, id limit 10")
def hybrid_dbsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, config=search.SearchConfig(fusion="dbsf", dense_multiplier=3, sparse_multiplier=4)).withColumn("score", F.round("score", 4))


@query(_hybrid_sql("lang = 'en'", 320, 480, "rrf") + " select id, score from fused order by score desc, id limit 10")
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, where=F.col("lang") == "en")


@query(_hybrid_sql("true", 320, 480, "rrf") + """, top as (select * from fused order by score desc, id limit 80),
    kept as (select id, score from top join pts using (id) qualify row_number() over (partition by source, lang order by score desc, id) = 1)
    select id, score from kept order by score desc, id limit 10""")
def hybrid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, dedup=("source", "lang"))


@query("select doc_id, source, lang, n_chars from documents qualify row_number() over (partition by source, lang order by n_chars desc, doc_id) = 1")
def dedup_keep_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return search.dedup_keep_max(docs, ("source", "lang"), "n_chars", "doc_id")


@query(f"""with {_VEC}, h as (select vec_id id, label, round({_COS}, 6) score from embeddings e, v)
    select label, max(score) score, count(*) n_hits, array_to_string((list(id::varchar order by score desc, id))[1:3], ',') snippets from h where score >= 0.0 group by label""")
def group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    hits = search.dense_threshold(points, _vector(spark, sf_dir), 0.0, "vec_id").join(points.select(F.col("vec_id").alias("id"), "label"), "id").withColumn("s", F.col("id").cast("string"))
    return search.group_hits(hits, "label", "s").withColumn("snippets", F.array_join("snippets", ","))
