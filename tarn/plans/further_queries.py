"""Embedding, conversation search, rules, groupings, reports, stores and helpers over the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import embedding, fixed, text, vectors
from tarn.operators import chunks, clusters, code_chunks, conversation_search, conversations, events, search, snapshots, symbols, tagging, tokens
from tarn.plans.file_queries import _PATHS, _files
from tarn.plans.more_queries import _C, _conversations
from tarn.plans.register import query
from tarn.plans.search_queries import _Q, _VEC, QUERY, TOKENS_SQL, _documents, _hybrid, _hybrid_sql, _vector
from tarn.session import checkpointed, folder, table
from tarn.sources import files, store

# embedding -----------------------------------------------------------------------------------------------------------

DIM = 32
ASKED = "the tion der que and of"


def _provider() -> embedding.HashedTokens:
    return embedding.HashedTokens(DIM, 1 << 20)


def _embedded_sql(name: str, source: str, key: str, content: str) -> str:
    """(key, c, v): coordinates of the vectors of texts that are not blank, and their norms."""
    return f"""{name}_w as (select {key}, unnest(regexp_extract_all(lower({content}), '[a-z0-9]+')) x from {source}), {name}_t as (select {key}, ('0x' || substr(md5(x), 1, 8))::bigint % 2147483647 + 1 t from {name}_w),
    {name}_s as (select {key}, t % {DIM} c, sum(case when t // {DIM} % 2 = 0 then 1 else -1 end)::double s from {name}_t group by all),
    {name} as (select {key}, c, s / nullif(sqrt(sum(s * s) over (partition by {key})), 0) v from {name}_s where s <> 0)"""


@query(f"with {_embedded_sql('e', 'documents', 'doc_id', 'text')} select doc_id, c::int coordinate, round(v, 6) as value from e")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _documents(spark, sf_dir).select("doc_id", F.posexplode(embedding.embed(_provider)("text")).alias("coordinate", "value"))
    return made.where("value <> 0").withColumn("value", F.round("value", 6))


@query(f"""with {_embedded_sql('e', 'documents', 'doc_id', 'text')}, one as (select 0 k, '{ASKED}' t), {_embedded_sql('q', 'one', 'k', 't')}
    select doc_id id, round(sum(e.v * q.v), 6) score from e join q using (c) group by doc_id order by score desc, id limit 10""")
def text_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), embedding.embed(_provider)("text").alias("embedding")).where("embedding is not null")
    return search.dense_topk(points, embedding.query_vector(ASKED, _provider), 10)


@query("""with w as (select doc_id // 32 batch, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) w from documents)
    select batch, count(*) n, max(least(w, 100))::int longest, sum(w - least(w, 100))::bigint truncated, (count(*) * max(least(w, 100)) - sum(least(w, 100)))::bigint padded from w group by batch""")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.padding(table(spark, sf_dir, "documents"), F.floor(F.col("doc_id") / 32), 100)


_SPACE = "[\\t-\\r\\x{85}\\p{Z}]"


@query(f"with t as (select doc_id, regexp_replace(chr(160) || coalesce(text, '') || chr(10), '^{_SPACE}+|{_SPACE}+$', '', 'g') x from documents) select doc_id, sha256(x) as content, x <> '' valid from t")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(embedding.normalised(padded), 256).alias("content"), embedding.valid(F.col("text")).alias("valid"))


@query("select source, least(count(*), 32, 20) small, least(count(*), 32, 64, 12) least from documents group by source")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf_dir, "documents").groupBy("source").agg(embedding.batch_size(n, 8, 20).alias("small"), embedding.batch_size(n, 8, 64, 12).alias("least"))


@query("with r as (select unnest(generate_series(0, 383)) i), v as (select i, (case when i % 2 = 0 then 1.0 else -1.0 end) * (i + 1) / 384.0::double x from r) select doc_id, 384 dim, 1.0::double norm, round(-384 / 384.0::double / (select sqrt(sum(x * x)) from v), 6) as last from documents")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", vectors.hash_embedding(F.substring("text", 1, 64)).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.round(vectors.norm(F.col("v")), 6).alias("norm"), F.round(F.element_at("v", -1), 6).alias("last"))


@query("""with u as (select vec_id // 4 g, unnest(generate_series(1, 64)) c, embedding::double[] e from embeddings where vec_id % 4 < 3), m as (select g, c, avg(e[c]) x from u group by all)
    select g, (c - 1)::int coordinate, round(x / sqrt(sum(x * x) over (partition by g)), 6) as value from m""")
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("g")).agg(F.collect_list(F.struct("embedding", (F.col("vec_id") % 4 < 3).cast("int").alias("m"))).alias("x"))
    pooled = vectors.mean_pool(F.transform("x", lambda x: x["embedding"]), F.transform("x", lambda x: x["m"]))
    return e.where(F.exists("x", lambda x: x["m"] == 1)).select("g", F.posexplode(pooled).alias("coordinate", "value")).withColumn("value", F.round("value", 6))


# search --------------------------------------------------------------------------------------------------------------


@query(_hybrid_sql("true", 320, 480, "rrf").replace("then 2.0 else", "then 3.0 else") + " select id, score from fused where score >= 0.016 order by score desc, id limit 10")
def hybrid_code_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, config=replace(search.CODE, threshold=0.016))


@query(_hybrid_sql("true", 240, 320, "dbsf").replace("then 2.0 else", "then 1.5 else") + " select id, round(score, 4) score from fused order by fused.score desc, id limit 10")
def hybrid_document_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, config=search.DOCUMENT).withColumn("score", F.round("score", 4))


@query(_hybrid_sql("true", 400, 560, "rrf") + " select id, score from fused order by score desc, id limit 10")
def hybrid_rrf_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, config=search.RRF)


@query(f"""with {_VEC}, d as (select vec_id id, round(list_dot_product(e.embedding::double[], v.q) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(v.q, v.q))), 6) score from embeddings e, v order by score desc, id limit 320)
    select id, round(1.0::double / (60 + row_number() over (order by score desc, id)), 6) score from d order by 2 desc, id limit 10""")
def hybrid_without_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return search.hybrid_search(points, None, QUERY, _vector(spark, sf_dir))


@query(f"with {TOKENS_SQL}, {_Q}, v as (select term, (row_number() over (order by term) - 1)::int term_id from (select distinct term from post)) select q.term, coalesce(v.term_id, -1) term_id, w.term back from q left join v using (term) left join v w on w.term_id = v.term_id")
def vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with folder(spark, "vocabulary") as place:
        store.save_vocabulary(tokens.vocabulary(tokens.term_rows(_documents(spark, sf_dir), "doc_id", F.col("text"))), place)
        vocab = store.load_vocabulary(spark, place)
        found = tokens.term_ids(tokens.query_terms(spark, QUERY).select("term"), vocab)
        return checkpointed(tokens.terms_of(found, vocab.withColumnRenamed("term", "back")).withColumn("term_id", F.coalesce("term_id", F.lit(-1))))


# conversations -------------------------------------------------------------------------------------------------------

_PARTS = """titled as (select conv_id, 'about ' || first(text order by turn)[1:40] title, max(turn) last from conversations group by conv_id),
    nth as (select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 k from conversations where text is not null),
    parts as (select conv_id, conv_id || '/title/0' id, title as content from titled union all select conv_id, conv_id || '/message/' || k, text from nth)"""


def _summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations with their messages, and their summaries."""
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"), F.max("turn").alias("last_active"))
    none = F.array().cast("array<string>")
    full = grouped.select("conv_id", F.concat(F.lit("about "), F.substring(F.get("m", 0)["text"], 1, 40)).alias("title"), F.array_compact(F.transform("m", lambda x: x["text"])).alias("messages"), none.alias("branches"), none.alias("checkpoints"), none.alias("tags"), F.lit(None).cast("string").alias("project"), "last_active")
    return full, full.select("conv_id", "title", "last_active")


@query(f"""with {_PARTS}, {_embedded_sql('e', 'parts', 'id', 'content')}, one as (select 0 k, '{ASKED}' t), {_embedded_sql('q', 'one', 'k', 't')},
    x as (select id, sum(e.v * q.v) x from e join q using (c) group by id),
    s as (select id, round(coalesce(x, 0), 6) score from parts left join x using (id) where regexp_replace(content, '[\\t-\\r\\x{{85}}\\p{{Z}}]+', '', 'g') <> '' order by score desc, id limit 100),
    g as (select conv_id, max(score) score, arg_min(content, (-score, id)) snippet, count(*) n_snippets from s join parts using (id) group by conv_id)
    select conv_id, title, score, sha256(snippet) snippet, last::bigint last_active, n_snippets::int n_snippets from g join titled using (conv_id) order by score desc, conv_id limit 10""")
def conversation_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, summaries = _summaries(spark, sf_dir)
    engine = conversation_search.SemanticEngine(_provider)
    found = engine.search(engine.index(full), summaries, ASKED)
    return found.select("conv_id", "title", "score", F.sha2("snippet", 256).alias("snippet"), "last_active", F.size("snippets").alias("n_snippets"))


_WANTED = "the tion"


@query(f"""with {_PARTS}, s as (select id, conv_id, content, round(case when contains(lower(content), '{_WANTED}') then 1.0::double else (contains(lower(content), 'the')::int + contains(lower(content), 'tion')::int) / 2.0::double end, 6) score from parts),
    t as (select * from s where score > 0 order by score desc, id limit 100), g as (select conv_id, max(score) score, arg_min(content, (-score, id)) snippet from t group by conv_id)
    select conv_id, title, score, sha256(snippet) snippet from g join titled using (conv_id) order by score desc, conv_id limit 10""")
def conversation_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, summaries = _summaries(spark, sf_dir)
    engine = conversation_search.TextEngine()
    return engine.search(engine.index(full), summaries, _WANTED).select("conv_id", "title", "score", F.sha2("snippet", 256).alias("snippet"))


_EXTRA_RULES = (
    tagging.Rule("number", "numbers", 0.6, 90, "regex", (r"\b[a-z]+\d+\b", r"^The\b")),
    tagging.Rule("broken", "never", 0.6, 89, "regex", ("(",)),
    tagging.Rule("long_talk", "long", 0.5, 80, "duration", (), 24.0, 500.0),
    tagging.Rule("short", "short", 0.5, 70, "messages", (), None, 3),
    tagging.Rule("own", "owned", 0.9, 60, "custom", test=lambda c: c.title.endswith("e")),
    tagging.Rule("off", "off", 0.9, 50, "title", ("a",), enabled=False),
    tagging.Rule("exact", "exact", 0.4, 40, "keyword", ("The",), case_sensitive=True),
    tagging.Rule("strange", "strange", 0.4, 30, "no such kind"),
    tagging.Rule("forked", "forked", 0.6, 20, "branches", (), 2, 9),
)


def _ruled(spark: SparkSession, sf_dir: str, summary: bool) -> DataFrame:
    c = tagging.Conversation(F.col("text"), F.col("lang"), (F.col("doc_id") % 6), (F.col("doc_id") % 4), hours=F.col("n_chars").cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(tagging.rule_tags(c, _EXTRA_RULES, summary)))


_OF = lambda tag, confidence, source, test: f"select doc_id, '{tag}' tag, {confidence}::double confidence, '{source}' source from documents where {test}"


@query(" union all ".join((
    _OF("numbers", 0.6, "number", "regexp_matches(text, '\\b[a-z]+\\d+\\b') or regexp_matches(text, '^The\\b')"), _OF("long", 0.5, "long_talk", "n_chars between 24 and 500"), _OF("short", 0.5, "short", "doc_id % 6 <= 3"),
    _OF("owned", 0.9, "own", "ends_with(lang, 'e')"), _OF("exact", 0.4, "exact", "contains(text, 'The')"), _OF("forked", 0.6, "forked", "doc_id % 4 between 2 and 9"))))
def tag_rules_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, False)


@query(_OF("short", 0.5, "short", "doc_id % 6 <= 3"))
def tag_rules_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, True)


@query("select doc_id, case when c >= 0.8 then 0.9 when c >= 0.6 then 0.7 when c >= 0.4 then 0.5 else 0.3 end::double score from (select doc_id, (doc_id % 11) / 10.0::double c from documents)")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tagging.level_score(tagging.level((F.col("doc_id") % 11) / 10.0)).alias("score"))


@query("select * from (select doc_id, unnest(list_filter([{'tag': case when lang in ('de', 'en') then lang end, 'confidence': 0.7::double, 'source': 'project_type'}, {'tag': case when n_chars % 50 > 20 then 'long-conversation' end, 'confidence': 0.5, 'source': 'message_count'}, {'tag': case when doc_id % 3 > 0 then 'branched' end, 'confidence': 0.6, 'source': 'has_branches'}], lambda x: x.tag is not null), recursive := true) from documents)")
def pattern_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = F.when(F.col("lang").isin("de", "en"), F.upper("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(tagging.pattern_tags(project, F.col("n_chars") % 50, F.col("doc_id") % 3)))


_NOW = "timestamp '2024-01-31'"
_G = f"""{_C}, g as (select *, case when conv_id % 4 > 0 then 'P' || conv_id % 4 end project, case when conv_id % 5 > 1 then conv_id % 5 end cluster, (conv_id % 5) / 8.0::double cohesion, case when conv_id % 6 = 0 then []::varchar[] else ['T ' || conv_id % 3, 'all'] end tg,
    date_diff('day', last_active::date, {_NOW}::date) age from c), r as (select *, case when age <= 0 then 'Today' when age = 1 then 'Yesterday' when age < 7 then 'This Week' when age < 30 then 'This Month' else 'Older' end recency from g)"""


@query(f"""with {_G}, k as (
    select 'recency' as mode, replace(lower(recency), ' ', '_') group_id, recency as name, case recency when 'Today' then 100 when 'Yesterday' then 90 when 'This Week' then 80 when 'This Month' then 70 else 60 end priority, last_active from r
    union all select 'project', coalesce(project, 'no-project'), coalesce(project, 'No Project'), (project is null)::int, last_active from r
    union all select 'status', 'status_' || lower(status), status, case status when 'Active' then 100 when 'Paused' then 90 else 80 end, last_active from r
    union all select 'tag', 'tag_' || replace(lower(t), ' ', '_'), t, 50, last_active from (select unnest(tg) t, last_active from r) union all select 'tag', 'untagged', 'Untagged', 10, last_active from r where len(tg) = 0
    union all select 'cluster', case when cluster is null then 'unclustered' else 'cluster_' || cluster end, coalesce(cluster::varchar, 'Unclustered'), case when cluster is null then 10 else floor(100 - cohesion * 100) end, last_active from r
    union all select 'success', case status when 'Completed' then 'successful' when 'Active' then 'in_progress' else 'other' end, case status when 'Completed' then 'Successful' when 'Active' then 'In Progress' else 'Other' end, case status when 'Completed' then 100 when 'Active' then 80 else 60 end, last_active from r)
    select mode, group_id, name, priority::int priority, count(*) n from k group by all""")
def conversation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    grouped = _conversations(spark, sf_dir).withColumns({
        "project": F.when(c % 4 > 0, F.concat(F.lit("P"), c % 4)), "cluster": F.when(c % 5 > 1, c % 5), "cohesion": (c % 5) / 8.0,
        "tags": F.when(c % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("T "), c % 3), F.lit("all"))),
    })
    out = None
    for mode in ("recency", "project", "status", "tag", "cluster", "success"):
        part = conversations.groups_by(grouped, mode, F.expr(_NOW)).drop("last_active").withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with {_C}, s as (select *, len(coalesce(scores, []::double[])) b from c) select workspace_id, count(*) n, count(*) filter (status = 'Active') n_active, sum(n_messages)::bigint messages, sum(b)::bigint branches, sum(n_checkpoints)::bigint checkpoints,
    round(avg(n_messages), 6) avg_messages, grouping(workspace_id) = 1 everything from s group by rollup (workspace_id)""")
def manager_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.statistics(_conversations(spark, sf_dir))


_PERIOD = ("timestamp '2024-01-01'", "timestamp '2024-01-02 12:00:00'")
_CHOSEN = f"""{_C}, x as (select *, coalesce(scores, []::double[]) sc, n_messages * 1000 tokens, case when conv_id % 3 > 0 then 'k' || conv_id % 3 end project_type from c where created_at between {_PERIOD[0]} and {_PERIOD[1]} and n_messages >= 3),
    y as (select *, status = 'Completed' or (n_messages >= 3 and len(list_filter(sc, lambda v: v >= 0.7)) > 0) success from x)"""


@query(f"with {_CHOSEN} select 'theme' kind, 'Programming Help' as name, (count(*) // 3)::bigint frequency, null::double rate from y union all select 'behaviour', 'Iterative Problem Solving', count(*) filter (n_messages > 5), 0.8 from y union all select 'topic', 'Async Programming', count(*) // 4, 0.75 from y union all select 'topic', 'Error Handling', count(*) // 3, 0.82 from y")
def conversation_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.patterns(conversations.in_period(_reported(spark, sf_dir), *map(F.expr, _PERIOD)))


@query("""with w as (select distinct conv_id // 20 period, conv_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) word from conversations where role = 'user'),
    n as (select period, word, count(*) n from w group by all), b as (select a.*, coalesce(p.n, 0) before from n a left join n p on p.word = a.word and p.period = a.period - 1),
    t as (select conv_id // 20 period, count(distinct conv_id) c from conversations where role = 'user' group by 1)
    select b.period, word, n, before, round((n - before) / c::double, 6) rise from b join t using (period) qualify row_number() over (partition by b.period order by n - before desc, n desc, word) <= 5""")
def trending_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of users that rise most from one period to the next."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.floor(F.col("conv_id") / 20).alias("period"), "conv_id", "text")
    return conversations.rising_words(said, "period", 5)


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return _conversations(spark, sf_dir).withColumns({"tokens": F.col("n_messages") * 1000, "project_type": F.when(c % 3 > 0, F.concat(F.lit("k"), c % 3))})


@query(f"""with {_CHOSEN}, m as (select count(*) n, sum(n_messages) msgs, round(avg(n_messages), 6) am, sum(tokens) tok, count(*) filter (tokens > 60000) large, max(tokens) peak, round(avg(success::int::double), 6) rate, count(*) filter (success) good,
      round(avg(case when status = 'Completed' then minutes end), 6) res, round(sum(len(list_filter(sc, lambda v: v >= 0.7))) / nullif(sum(len(sc)), 0)::double, 6) be, round(avg((n_checkpoints > 0)::int::double), 6) cu, round(sum(len(sc)) / count(*)::double, 6) sw, count(*) filter (n_messages > 5) long from y)
    select section, name, value::double as value from (
    select 'overall' section, unnest(['n_conversations', 'n_messages', 'avg_messages', 'tokens', 'n_large', 'peak_tokens']) as name, unnest([n::double, msgs::double, am, tok::double, large::double, peak::double]) as value from m
    union all select 'success', unnest(['success_rate', 'n_successful']), unnest([rate, good::double]) from m
    union all select 'efficiency', unnest(['resolution_minutes', 'branch_efficiency', 'checkpoint_use', 'switches']), unnest([res, be, cu, sw]) from m
    union all select 'usage', unnest(['tokens', 'cost']), unnest([tok::double, round(tok / 1000 * 0.03::double, 6)]) from m
    union all select 'project', coalesce(project_type, 'unknown'), round(avg(success::int::double), 6) from y group by project_type
    union all select unnest(['pattern_theme', 'pattern_behaviour', 'pattern_topic', 'pattern_topic']), unnest(['Programming Help', 'Iterative Problem Solving', 'Async Programming', 'Error Handling']), unnest([(n // 3)::double, long::double, (n // 4)::double, (n // 3)::double]) from m
    union all select 'advice', 'low_success_rate', rate from m where rate < 0.7 union all select 'advice', 'few_messages', am from m where am < 3 union all select 'advice', 'low_branch_efficiency', be from m where be < 0.6 union all select 'advice', 'low_checkpoint_use', cu from m where cu < 0.3)""")
def conversation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(_reported(spark, sf_dir), *map(F.expr, _PERIOD))


@query("select conv_id, turn, 4 + strlen(coalesce(role, '')) // 4 + strlen(coalesce(text, '')) // 4 tokens, 4 + strlen(coalesce(role, '')) // 4 + strlen(coalesce(text, '')) // 4 > 80 near from conversations")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = conversations.message_tokens(F.col("role"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("tokens"), conversations.near_limit(n, 100).alias("near"))


@query("""with recursive s as (select conv_id, turn, ((conv_id * 7 + turn * 3) % 11) / 10.0::double x, row_number() over (partition by conv_id order by turn) k from conversations),
    r as (select conv_id, k, (0.5 + x) / 2 a from s where k = 1 union all select s.conv_id, s.k, (r.a + s.x) / 2 from r join s on s.conv_id = r.conv_id and s.k = r.k + 1) select conv_id, round(arg_max(a, k), 6) average from r group by conv_id""")
def running_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ((F.col("conv_id") * 7 + F.col("turn") * 3) % 11) / 10.0
    scores = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))).alias("s"))
    return scores.select("conv_id", F.round(conversations.running_success(F.transform("s", lambda v: v["x"])), 6).alias("average"))


@query("select conv_id, turn, round(least(1.0::double, 0.5 + case turn % 4 when 0 then 0.4 when 1 then 0.3 when 2 then 0.1 else 0 end + case when role = 'assistant' then 0.2 else 0 end + least(turn / 10.0::double, 1.0) * 0.1), 6) as value from conversations")
def restoration_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.element_at(F.array(*map(F.lit, ("SuccessfulSolution", "TaskCompletion", "PeriodicAutomatic", "Other"))), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(conversations.restoration_value(reason, F.col("role") == "assistant", F.col("turn")), 6).alias("value"))


@query("""with w as (select distinct lang, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) word from documents), s as (select lang, count(distinct doc_id) n from w group by lang), c as (select lang, word, count(*) n from w group by all)
    select c.lang, word, c.n from c join s using (lang) where c.n >= greatest(1, s.n // 2)""")
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _documents(spark, sf_dir).select("lang", F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("word"))
    return clusters.common_words(words, "lang", "word")


@query(f"select conv_id, turn, round(case when contains(lower(text), '{_WANTED}') then 1.0::double else (contains(lower(text), 'the')::int + contains(lower(text), 'tion')::int) / 2.0::double end, 6) score from conversations where text is not null")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.round(conversations.text_similarity(F.col("text"), _WANTED), 6).alias("score"))


# files, snapshots, syncs -----------------------------------------------------------------------------------------------

_EMBED_EXTENSIONS = ("rs", "h", "C++", "tsx", "kts", "R", "mk", "zz", "jsx", "cljc", "markdown", "sass")


@query("with e as (select doc_id, ['" + "', '".join(_EMBED_EXTENSIONS) + "'][1 + doc_id % 12] e from documents) select doc_id, coalesce(case lower(e) " + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.EMBED_LANGUAGES.items()) + " end, 'unknown') as \"language\" from e")
def embed_language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EMBED_EXTENSIONS)), (1 + F.col("doc_id") % 12).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.embed_language(F.concat(F.lit("src/a."), ext)).alias("language"))


_KINDS = ("function", "method", "struct", "enum", "trait", "module", "type", "interface", "namespace", "h3_section", "singleton_method")
_OWN = " ".join(f"when '{k}' then e in ({', '.join(map(repr, v))})" for k, v in fixed.CORE_BY_LANGUAGE.items())


_GRID = [(lang, kind) for lang in (*fixed.CORE_BY_LANGUAGE, "java") for kind in _KINDS]


@query(f"with t as (select doc_id, [{', '.join(repr(x) for x, _ in _GRID)}][1 + doc_id % {len(_GRID)}] l, [{', '.join(repr(x) for _, x in _GRID)}][1 + doc_id % {len(_GRID)}] e from documents) select doc_id, l as \"language\", e element_type, coalesce(case l {_OWN} end, false) core from t")
def core_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as elements of all kinds and languages in turn."""
    of = lambda k: F.get(F.array(*(F.lit(x[k]) for x in _GRID)), (F.col("doc_id") % len(_GRID)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", of(0).alias("language"), of(1).alias("element_type"))
    return rows.withColumn("core", text.core_of_language(F.col("element_type"), F.col("language")))


_EXT = "regexp_extract(file_path, '[^/]\\.([^./]+)$', 1)"


@query(f"with {_PATHS} select file_path from paths where not ({' or '.join(f'contains(file_path, {x!r})' for x in fixed.MAP_IGNORED)}) and {_EXT} in ({', '.join(map(repr, fixed.MAP_EXTENSIONS))}) and (starts_with(file_path, 'src1') or starts_with(file_path, 'src3')) and ends_with(file_path, 's') and contains(text, 'the')")
def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.for_map(_files(spark, sf_dir), ["src1", "src3"], "s", "the").select("file_path")


@query(f"with {_PATHS} select file_path from paths where doc_id % 3 = 1 and lower({_EXT}) in ({', '.join(map(repr, fixed.TREE_EXTENSIONS))})")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = _files(spark, sf_dir).withColumn("commit_hash", (F.col("doc_id") % 3).cast("string"))
    return files.tree(committed, "1").select("file_path")


@query(f"with {_PATHS}, f as (select * from paths where strlen(text) <= {files.MOST_BYTES}) select sha256(concat_ws(chr(1), 'r', 'main', file_path, '1', '9', 'block')) chunk_id, {_EXT} file_extension from f")
def chunk_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = files.chunkable(_files(spark, sf_dir)).select(F.lit("r").alias("repo"), F.lit("main").alias("branch"), "file_path", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("block").alias("element_type"))
    return chunks.with_file_fields(whole).select("chunk_id", "file_extension")


_LITTLE = "unhex(array_to_string(list_reverse(regexp_extract_all(lpad(hex({}), 16, '0'), '..')), ''))"


@query(f"with {_PATHS} select file_path, sha256({_LITTLE.format('strlen(text)')} || encode(text) || {_LITTLE.format('1700000000 + strlen(text)')}) as hash from paths where text is not null")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of size, content and time of modification."""
    modified = F.lit(1_700_000_000).cast("long") + F.octet_length("text")
    return _files(spark, sf_dir).where("text is not null").select("file_path", snapshots.file_hash(F.col("text"), modified).alias("hash"))


_KINDS_OF = "['added', 'modified', 'renamed', 'copied', 'typechange', 'deleted']"


@query(f"""with d as (select {_KINDS_OF}[1 + doc_id % 6] kind, 'o' || doc_id old_path, 'n' || doc_id new_path from documents) select 'add' what, new_path as path from d where kind in ('added', 'modified', 'renamed', 'copied') union all select 'delete', old_path from d where kind in ('deleted', 'renamed')""")
def switch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("added", "modified", "renamed", "copied", "typechange", "deleted")))
    deltas = table(spark, sf_dir, "documents").select(F.element_at(kinds, (1 + F.col("doc_id") % 6).cast("int")).alias("kind"), F.concat(F.lit("o"), "doc_id").alias("old_path"), F.concat(F.lit("n"), "doc_id").alias("new_path"))
    add, delete = snapshots.switch_lists(deltas)
    return add.select(F.lit("add").alias("what"), "path").union(delete.select(F.lit("delete"), "path"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.concat(F.lit("r"), F.col("user_id") % 3).alias("repo"), F.concat(F.lit("p"), "user_id").alias("path"), "ts")


@query("""with l as (select 'r' || user_id % 3 repo, 'p' || user_id as path, max(ts) ts from events group by user_id), n as (select *, count(*) over (partition by repo) n, row_number() over (partition by repo order by ts, path) k from l)
    select repo, path from n where n < 20 or k <= 10""")
def watch_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.bounded_buffer(_changes(spark, sf_dir), "repo", "ts", 20).select("repo", "path")


_STEPS = "select 'r' || conv_id % 40 repo, conv_id attempt, conv_id % 4 > 0 local_ok, conv_id % 3 > 0 has_remote, conv_id % 5 > 1 remote_ok, case conv_id % 7 when 0 then 'authentication' when 1 then 'network' when 2 then 'disk' end error from (select distinct conv_id from conversations)"


@query(f"""with s as ({_STEPS} qualify row_number() over (partition by conv_id % 40 order by conv_id desc) = 1), t as (select *, case when not local_ok then 'Failed' when not has_remote then 'LocalOnly' when remote_ok then 'FullySynced' else 'LocalIndexedRemoteFailed' end state from s)
    select repo, state, case state when 'FullySynced' then 'Success' when 'LocalOnly' then 'Info' when 'Failed' then 'Error' else 'Warning' end as level,
    case state when 'Failed' then coalesce(error, 'Sync failed') when 'LocalIndexedRemoteFailed' then case error when 'authentication' then 'Authentication failed' when 'network' then 'Network error' else 'Remote sync failed' end else state end message from t""")
def sync_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    steps = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.concat(F.lit("r"), c % 40).alias("repo"), c.alias("attempt"), (c % 4 > 0).alias("local_ok"), (c % 3 > 0).alias("has_remote"), (c % 5 > 1).alias("remote_ok"), F.when(c % 7 == 0, "authentication").when(c % 7 == 1, "network").when(c % 7 == 2, "disk").alias("error"))
    return events.sync_states(steps)


@query("with f as (select 'r' || user_id % 30 repo, min(ts) ts from events group by 1) select repo, row_number() over (order by ts, repo)::int as position from f")
def sync_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("user_id") % 30).alias("repo"), "ts")
    return events.sync_queue(e).drop("ts")


@query("select doc_id, to_json({'id': doc_id, 'lang': lang, 'size': n_chars, 'tags': [source, 'x']}) as json from documents")
def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("size"), F.array("source", F.lit("x")).alias("tags"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(row).alias("json"))


# a store -----------------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str, some: Column, path: str) -> DataFrame:
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").where(some)
    return e.select(v.alias("id"), F.concat(F.lit("r"), v % 2).alias("repo"), F.concat(F.lit("b"), v % 3).alias("branch"), F.concat(F.lit(path), v % 10).alias("file_path"), F.when(v % 4 == 0, "rust").otherwise("go").alias("language"), F.col("embedding").alias("dense"))


@contextmanager
def _store(spark: SparkSession, sf_dir: str) -> Iterator[store.VectorStore]:
    """Two upserts, a deletion of files in a branch and one of a branch; deleted at the end of the block."""
    v = F.col("vec_id")
    with folder(spark, "store") as path:
        kept = store.VectorStore(spark, path, 64)
        kept.upsert(_points(spark, sf_dir, v % 5 != 0, "old"))
        kept.upsert(_points(spark, sf_dir, v % 7 == 0, "new"))
        kept.delete_files("r0", "b0", ["old2", "new4"])
        kept.delete_branch("r1", "b2")
        yield kept


_STORED = """p as (select vec_id id, 'r' || vec_id % 2 repo, 'b' || vec_id % 3 branch, case when vec_id % 7 = 0 then 'new' else 'old' end || vec_id % 10 file_path, case when vec_id % 4 = 0 then 'rust' else 'go' end "language", embedding from embeddings where vec_id % 5 <> 0 or vec_id % 7 = 0),
    k as (select * from p where not (repo = 'r0' and branch = 'b0' and file_path in ('old2', 'new4')) and not (repo = 'r1' and branch = 'b2'))"""


@query(f"with {_STORED} select id, repo, branch, file_path from k")
def store_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _store(spark, sf_dir) as kept:
        return checkpointed(kept.points().select("id", "repo", "branch", "file_path"))


@query(f"with {_STORED} select repo, branch, count(*) points from k group by all")
def store_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _store(spark, sf_dir) as kept:
        return checkpointed(kept.info())


@query(f"with {_STORED} select id, file_path from k where id > 40 and \"language\" = 'go' order by id limit 25")
def store_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _store(spark, sf_dir) as kept:
        return checkpointed(kept.scroll(40, 25, F.col("language") == "go").select("id", "file_path"))


@query(f"with {_STORED}, {_VEC} select id, round(list_dot_product(k.embedding::double[], v.q) / (sqrt(list_dot_product(k.embedding::double[], k.embedding::double[])) * sqrt(list_dot_product(v.q, v.q))), 6) score from k, v where (branch = 'b0' or branch = 'b1') and repo = 'r0' order by score desc, id limit 10")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _store(spark, sf_dir) as kept:
        return checkpointed(kept.search(_vector(spark, sf_dir), 10, (F.col("repo") == "r0") & ((F.col("branch") == "b0") | (F.col("branch") == "b1"))))


@query("""with t as (select source, sum(len(string_split(text, chr(10))))::bigint m, count(*) f from documents where text is not null group by source) select source, m as "lines", f as files, greatest(5, 1000 // greatest(1, m // f)) per_page from t""")
def auto_page_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a page for each source, from its files' lines."""
    sizes = table(spark, sf_dir, "documents").where("text is not null").groupBy("source").agg(F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.count("*").alias("files"))
    return sizes.withColumn("per_page", symbols.page_size(F.col("lines"), F.col("files"), 1000))


@query("select doc_id, coalesce(case when doc_id % 3 = 0 then 'asked' || doc_id % 5 end, nullif(case when doc_id % 4 = 0 then 'active' else '' end, ''), case when doc_id % 7 > 0 then 'trunk' end, 'main') branch from documents")
def default_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    branch = search.branch_of(F.when(i % 3 == 0, F.concat(F.lit("asked"), i % 5)), F.when(i % 4 == 0, "active").otherwise(""), F.when(i % 7 > 0, "trunk"))
    return table(spark, sf_dir, "documents").select("doc_id", branch.alias("branch"))


@query(f"with {_PATHS} select file_path from paths where lower({_EXT}) in ('rs', 'py', 'go')")
def extension_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.visible(_files(spark, sf_dir), ["RS", "py", "go"]).select("file_path")


@query(f"with {_PATHS} select file_path, ends_with(file_path, '.md') or contains(file_path, 'main1') or file_path = 'src3/file3.py' ignored from paths")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_path", snapshots.ignored(F.col("file_path"), ["*.md", "main1", "src3/file3.py"]).alias("ignored"))


def _line_parser(content: str) -> list[tuple[int, int, str, str]]:
    return [(i, i, "line", line) for i, line in enumerate(content.split("\n"), 1) if line]


@query("""with l as (select doc_id, string_split(text, chr(10)) l from documents where lang = 'en' and text is not null), e as (select doc_id, unnest(l) x, unnest(generate_series(1, len(l))) i from l)
    select doc_id, i::int start_line, i::int end_line, 'line' element_type, sha256(x) as content from e where x <> ''""")
def own_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser handed in by the caller for a language of its own."""
    docs = _documents(spark, sf_dir).where("lang = 'en'").withColumnRenamed("lang", "language")
    return code_chunks.chunk_files(docs, parsers={"en": _line_parser}).drop("language").withColumn("content", F.sha2("content", 256))
