"""Filters, feeds and metrics over conversations built from ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import conversations, events, tagging
from tarn.plans.register import query
from tarn.session import table

# a conversation is a user of ``events``: its messages are views, its branches purchases, its checkpoints signups
_C = """c as (select user_id conv_id, 'w' || user_id % 5 workspace_id, case user_id % 3 when 0 then 'Completed' when 1 then 'Active' else 'Paused' end status,
    ['t' || user_id % 2, 't' || user_id % 7, 'all'] tags, min(ts) created_at, max(ts) last_active, count(*) n_messages,
    list(value order by event_id) filter (event_type = 'purchase') scores, count(*) filter (event_type = 'signup') n_checkpoints, count(*) * 1.5::double as minutes from events group by user_id)"""


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u = F.col("user_id")
    status = F.when(u % 3 == 0, "Completed").when(u % 3 == 1, "Active").otherwise("Paused")
    return e.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_active"), F.count("*").alias("n_messages"), F.collect_list(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("branch_scores"), F.count_if(F.col("event_type") == "signup").alias("n_checkpoints")).select(
        u.alias("conv_id"), F.concat(F.lit("w"), (u % 5).cast("string")).alias("workspace_id"), status.alias("status"), F.array(F.concat(F.lit("t"), (u % 2).cast("string")), F.concat(F.lit("t"), (u % 7).cast("string")), F.lit("all")).alias("tags"),
        "created_at", "last_active", "n_messages", "branch_scores", "n_checkpoints", (F.col("n_messages") * 1.5).alias("minutes"),
    )


@query(f"with {_C} select conv_id from c where workspace_id = 'w1' and list_contains(tags, 't1') and list_contains(tags, 'all') and created_at between timestamp '2024-01-01' and timestamp '2024-01-10'")
def conversations_by_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = (F.expr("timestamp '2024-01-01'"), F.expr("timestamp '2024-01-10'"))
    return conversations.select_conversations(_conversations(spark, sf_dir), workspace="w1", all_tags=["t1", "all"], created=times).select("conv_id")


@query(f"with {_C} select conv_id from c where status = 'Active' and list_has_any(tags, ['t3', 't5']) and last_active between timestamp '2024-01-20' and timestamp '2024-02-10'")
def conversations_by_any_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = (F.expr("timestamp '2024-01-20'"), F.expr("timestamp '2024-02-10'"))
    return conversations.select_conversations(_conversations(spark, sf_dir), status="Active", any_tags=["t3", "t5"], active=times).select("conv_id")


@query(f"""with {_C} select round(avg(case when status = 'Completed' then minutes end), 6) resolution_minutes, round(sum(len(list_filter(scores, lambda x: x >= 0.7))) / sum(len(scores))::double, 6) branch_efficiency,
    round(avg((n_checkpoints > 0)::int::double), 6) checkpoint_use, round(sum(len(scores)) / count(*)::double, 6) switches from c""")
def conv_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.efficiency(_conversations(spark, sf_dir))


@query(f"with {_C} select workspace_id, count(*) n, round(avg((status = 'Completed')::int::double), 6) rate from c group by workspace_id")
def project_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.insights(_conversations(spark, sf_dir).withColumn("success", F.col("status") == "Completed"), "workspace_id")


@query(f"with {_C} select conv_id from c where last_active < timestamp '2024-01-29' or n_messages < 60 or status = 'Paused'")
def conversation_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.archive(_conversations(spark, sf_dir), F.expr("timestamp '2024-02-05'"), 7, 60, "Paused")[0].select("conv_id")


@query(f"with {_C}, a as (select *, n_messages + n_checkpoints activity from c where created_at between timestamp '2024-01-01' and timestamp '2024-01-03') select conv_id, activity from a order by activity desc, last_active desc, conv_id limit 20")
def conversation_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conversations(spark, sf_dir).withColumn("activity", F.col("n_messages") + F.col("n_checkpoints"))
    return conversations.timeline(c, F.expr("timestamp '2024-01-01'"), F.expr("timestamp '2024-01-03'"), 20).select("conv_id", "activity")


@query("""with m as (select conv_id, string_agg(text, chr(0) order by turn) x, min(text order by turn) from conversations group by conv_id), t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 k from conversations)
    select conv_id, 'title' kind, 0::int as position, md5('conversation ' || conv_id) as content from m union all select conv_id, 'message', k::int, md5(text) from t
    union all select conv_id, 'branch', 0, md5('b') from m where conv_id % 2 = 0 union all select conv_id, 'tags', 0, md5('x, y') from m where conv_id % 3 = 0 union all select conv_id, 'project', 0, md5('p') from m""")
def content_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("messages"))
    none = F.array().cast("array<string>")
    full = m.withColumns({"title": F.concat(F.lit("conversation "), c.cast("string")), "branches": F.when(c % 2 == 0, F.array(F.lit("b"))).otherwise(none), "checkpoints": none, "tags": F.when(c % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(none), "project": F.lit("p")})
    return conversations.content_rows(full).withColumn("content", F.md5("content"))


@query("""with e as (select user_id conv_id, ts, event_type, event_id label from events), m as (select * from e where event_type = 'view' qualify row_number() over (partition by conv_id order by ts desc, label) <= 5),
    b as (select conv_id, ts, 'message' kind, label from m union all select conv_id, ts, event_type, label from e where event_type in ('purchase', 'signup'))
    select conv_id, kind, label, row_number() over (partition by conv_id order by ts desc, kind, label)::int as position from b qualify position <= 10""")
def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), "ts", F.col("event_type").alias("kind"), F.col("event_id").alias("label"))
    return conversations.activity_feed(e.where("kind = 'view'"), e.where("kind in ('purchase', 'signup')")).drop("ts")


@query("select doc_id id, round((n_chars % 64) / 64.0::double * case when lang = 'en' then 1.2::double else 1.0 end, 6) score from documents")
def navigation_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 64) / 64.0).alias("score"), "lang")
    return conversations.rerank(hits, F.col("lang") == "en").select("id", "score")


@query("""with s as (select event_id, ts, (epoch_us(timestamp '2024-01-15') - epoch_us(ts)) // 1000000 s from events where ts <= timestamp '2024-01-15')
    select event_id, case when s < 60 then 'just now' when s < 3600 then (s // 60) || 'm ago' when s < 86400 then (s // 3600) || 'h ago' when s < 604800 then (s // 86400) || 'd ago' else strftime(ts, '%Y-%m-%d') end label, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') stamp from s""")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.expr("timestamp '2024-01-15'")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") <= now)
    return e.select("event_id", conversations.relative_time(F.col("ts"), now).alias("label"), events.rfc3339(F.col("ts")).alias("stamp"))


@query("select page_id, not (starts_with(url, 'http://a/') or contains(url, '/docs/') or starts_with(url, 'docs/') or ends_with(url, '.html') or starts_with(regexp_extract(url, '[^/]*$'), 'tmp') or url = 'index' or ends_with(url, '/index')) watched from pages")
def watch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", events.watched(F.col("url"), ("http://a/", "docs/", "*.html", "tmp*", "index")).alias("watched"))


@query("select o_orderkey path, o_orderkey % 4 <> 0 and o_orderkey % 3 = 0 and o_orderkey % 10 < 7 hit from orders")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(k.alias("path"), k.alias("modified"), (k * 2).alias("size"))
    now = F.expr("timestamp '2024-01-15'")
    cache = table(spark, sf_dir, "orders").where(k % 4 != 0).select(k.alias("path"), F.when(k % 3 == 0, "m").otherwise("n").alias("model"), (k * 33).alias("hash"), (now - F.make_dt_interval((k % 10).cast("int"))).alias("at"))
    return events.cached(files, cache, now, "m")


@query("""with v as (select vec_id, embedding::double[] e from embeddings), q as (select 'tag' || vec_id tag, e from v where vec_id in (1, 2, 3)), s as (select v.vec_id, tag, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) confidence from v, q)
    select * from s where confidence >= 0.2""")
def tag_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    corpus = {f"tag{r['vec_id']}": r["embedding"] for r in v.where("vec_id in (1, 2, 3)").collect()}  # a corpus of three
    return v.select("vec_id", F.inline(tagging.corpus_tags(F.col("embedding"), corpus, 0.2))).drop("source")
