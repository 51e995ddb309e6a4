"""Conversation analytics over ``conversations``; ratings and tags over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import phrases
from tarn.operators import clusters, search, tagging, tokens
from tarn.operators import conversations as conv
from tarn.plans.register import query
from tarn.plans.search_queries import tokens_sql
from tarn.session import table

# the invented texts hold few of the phrases: each message gets one, by its number
WORDS = ("error", "maybe we could", "tests pass", "working", "done?", "experiment", "plain", "cargo trait impl", "import python", "help?")
_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_M = f"m as (select conv_id, turn, role, coalesce(text, '') || ' ' || {_LIST}[1 + (conv_id * 3 + turn) % {len(WORDS)}] text from conversations)"
_TOK = "strlen(coalesce(text, '')) // 4"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, WORDS)), (1 + (F.col("conv_id") * 3 + F.col("turn")) % len(WORDS)).cast("int"))
    return table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), word))


_SUM = f"s as (select conv_id, count(*) n_messages, sum({_TOK})::bigint tokens, sum(strlen(coalesce(text, '')))::bigint n_bytes from conversations group by conv_id)"


@query(f"with {_SUM} select * from s")
def conv_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.summaries(table(spark, sf_dir, "conversations"))


@query(f"with {_SUM} select count(*) n_conversations, sum(n_messages)::bigint n_messages, round(avg(n_messages), 6) avg_messages, sum(tokens)::bigint tokens, count(*) filter (tokens > 60000) n_large, max(tokens) peak_tokens from s")
def conv_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.overall(conv.summaries(table(spark, sf_dir, "conversations")))


@query(f"select role, count(*) n_messages, sum({_TOK})::bigint tokens from conversations group by role")
def conv_tokens_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.tokens_by(table(spark, sf_dir, "conversations"), "role")


@query(f"with {_SUM} select conv_id, case when tokens > 0 then round(tokens / 1000.0::double * 0.03::double, 6) end cost from s")
def conv_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.summaries(table(spark, sf_dir, "conversations")).select("conv_id", conv.cost(F.col("tokens")).alias("cost"))


@query(f"with {_SUM} select ((n_messages // 5) * 5)::bigint bucket, count(*) n, round(avg((conv_id % 3 = 0)::int::double), 6) rate from s group by 1")
def conv_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.success_by_length(conv.summaries(table(spark, sf_dir, "conversations")).withColumn("success", F.col("conv_id") % 3 == 0))


@query(f"with {_SUM} select case when tokens < 100 then 'small' when tokens < 1000 then 'medium' else 'large' end size, count(*) n from s group by 1")
def conv_token_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("tokens") < 100, "small").when(F.col("tokens") < 1000, "medium").otherwise("large")
    return conv.summaries(table(spark, sf_dir, "conversations")).groupBy(size.alias("size")).agg(F.count("*").alias("n"))


@query(f"""with {_SUM} select conv_id, (conv_id % 4 = 0) or (n_messages >= 3 and (conv_id % 10) / 10.0 >= 0.7) success from s""")
def conv_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("conv_id") % 4 == 0, "Completed").otherwise("Active")
    scores = F.array((F.col("conv_id") % 10) / 10.0, F.lit(None).cast("double"))
    return conv.summaries(table(spark, sf_dir, "conversations")).select("conv_id", conv.successful(status, F.col("n_messages"), scores).alias("success"))


@query("select floor(n_chars / 5000.0)::bigint * 5000 bucket, count(*) n, round(avg(quality::double), 6) rate from documents join labels using (doc_id) group by 1")
def success_rate_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return conv.success_by_length(rated, "n_chars", "quality", 5000)


@query("""with m as (select (select avg(quality) from labels) success_rate, (select count(*)::double / count(distinct conv_id) from conversations) avg_messages, (select avg((toxic = 0)::int) from labels) branch_efficiency, (select avg((role = 'assistant')::int) / 4 from conversations) checkpoint_use)
    select rule, round(v, 6) as value from (select unnest(['low_success_rate', 'few_messages', 'low_branch_efficiency', 'low_checkpoint_use']) rule, unnest([success_rate, avg_messages, branch_efficiency, checkpoint_use]) v, unnest([0.7, 3.0, 0.6, 0.3]) least from m) where v < least""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report would advise, from metrics of the tables."""
    rated = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("success_rate"), F.avg((F.col("toxic") == 0).cast("int")).alias("branch_efficiency"))
    said = table(spark, sf_dir, "conversations").agg((F.count("*") / F.count_distinct("conv_id")).alias("avg_messages"), (F.avg((F.col("role") == "assistant").cast("int")) / 4).alias("checkpoint_use"))
    # a row each
    return conv.recommendations(rated.join(F.broadcast(said))).withColumn("value", F.round("value", 6))


_T = f"t as (select conv_id, turn, role, {_TOK} + 4 tokens, role = 'system' s from conversations)"


@query(f"""with {_T}, w as (select *, sum(tokens) over (partition by conv_id, s order by turn desc rows between unbounded preceding and current row) + sum(case when s then tokens else 0 end) over (partition by conv_id) total,
    row_number() over (partition by conv_id, s order by turn desc) n from t) select conv_id, turn, role, tokens::bigint tokens from w where s or total <= 400 or n = 1""")
def history_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.truncate_history(table(spark, sf_dir, "conversations"), 400).select("conv_id", "turn", "role", "tokens")


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.last_messages(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


_RECENT = lambda n: "lower(text)" + "".join(f" || ' ' || coalesce(lower(lag(text, {k}) over (partition by conv_id order by turn)), '')" for k in range(1, n))
_ANY = lambda words, c="recent": "(" + " or ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
_HITS = lambda words, c="low": "(" + " + ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')::int" for w in words) + ")"
_PHASE = "case " + " ".join(f"when {_ANY(w)} then '{p}'" for p, w in phrases.PHASES) + " else 'ProblemDefinition' end"
_STATE = "case " + " ".join(f"when {_ANY(w)} then '{p}'" for p, w in phrases.STATES) + " else 'SolutionDevelopment' end"


@query(f"with {_M}, r as (select conv_id, turn, {_RECENT(5)} recent from m) select conv_id, turn, {_PHASE} phase from r")
def conversation_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.recent_text(_messages(spark, sf_dir), 5).select("conv_id", "turn", conv.conversation_phase(F.col("recent")).alias("phase"))


@query(f"""with {_M}, r as (select conv_id, turn, lower(text) low, {_RECENT(5)} recent, count(*) over (partition by conv_id) n from m), p as (select *, {_PHASE} phase from r),
    s as (select conv_id, turn, round({' + '.join(f'{_HITS(w)} * {v}' for w, v in phrases.CHECKPOINT_WEIGHTS)} + case phase {' '.join(f"when '{k}' then {v}" for k, v in phrases.PHASE_BONUS.items())} else 0.0 end + case when n > 20 and n % 20 = 0 then 0.1 else 0 end, 6)::double x from p)
    select conv_id, turn, case when x >= 0.3 then least(x, 1.0) end importance from s""")
def checkpoint_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    m = conv.recent_text(_messages(spark, sf_dir), 5).withColumn("n", F.count("*").over(W.partitionBy("conv_id")))
    return m.select("conv_id", "turn", conv.checkpoint_importance(F.col("text"), conv.conversation_phase(F.col("recent")), F.col("n")).alias("importance"))


_BRANCH = f"""r as (select conv_id, turn, role, lower(text) low, {_RECENT(3)} recent from m), p as (select *, {_STATE} state from r),
    s as (select *, round({' + '.join(f'{_HITS(w)} * {v}' for w, v in phrases.BRANCH_WEIGHTS)} + case state when 'ErrorState' then 0.3 when 'OptionEvaluation' then 0.2 else 0.0 end + case when role = 'user' and contains(low, '?') then 0.1 else 0 end + case when strlen(low) > 500 then 0.1 else 0 end, 6)::double x,
    case when {_ANY(phrases.UNCERTAINTIES, 'low')} then 'UserUncertainty' when {_ANY(phrases.ERRORS, 'low')} then 'ErrorRecovery' when {_ANY(phrases.BRANCHES, 'low')} then 'AlternativeApproach' when role = 'user' and contains(low, '?') then 'UserUncertainty' when strlen(low) > 500 then 'ComplexProblem' else 'AlternativeApproach' end reason from p)"""


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = conv.recent_text(_messages(spark, sf_dir), 3)
    confidence = conv.branch_confidence(F.col("text"), conv.conversation_state(F.col("recent")), F.col("role"))
    return m.select("conv_id", "turn", "role", confidence.alias("confidence"), conv.branch_reason(F.col("text"), F.col("role")).alias("reason"))


@query(f"with {_M}, {_BRANCH} select conv_id, turn, reason, case when x >= 0.3 then least(x, 1.0) end confidence from s")
def branch_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _branches(spark, sf_dir).select("conv_id", "turn", "reason", "confidence")


@query(f"""with {_M}, {_BRANCH} select conv_id, turn, round(least(1.0, greatest(0.0, 0.5 + case reason when 'ErrorRecovery' then 0.2 when 'AlternativeApproach' then 0.1 else 0.0 end + case when role = 'user' then 0.1 else 0.0 end + least(turn / 10.0, 1.0) * 0.1)), 6)::double p from s""")
def branch_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _branches(spark, sf_dir).select("conv_id", "turn", conv.branch_success(F.col("reason"), F.col("role"), F.col("turn")).alias("p"))


@query("""with f as (select conv_id, count(*) filter (role = 'user') a, count(*) filter (role = 'system') b, max(turn) * 2 m from conversations group by conv_id)
    select conv_id, round(least(1.0, a * 0.1 + b * 0.05 + case when m > 5 then m * 0.01 else 0 end + 0.1), 6)::double frustration from f""")
def frustration_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("a"), F.count_if(F.col("role") == "system").alias("b"), (F.max("turn") * 2).alias("m"))
    return f.select("conv_id", conv.frustration(F.col("a"), F.col("b"), F.col("m"), F.lit(1)).alias("frustration"))


@query("""with a as (select user_id, ts, event_id, event_type = 'purchase' ok from events), l as (select *, max(case when ok then ts end) over (partition by user_id) last from a),
    f as (select user_id, event_id, row_number() over (partition by user_id order by l.ts desc, event_id desc) n, e.event_type from l join events e using (user_id, event_id) where not ok and (last is null or l.ts > last)),
    t as (select user_id, event_type, count(*) n, count(*) filter (n <= 5) r from f group by all) select user_id, sum(n)::bigint failures, max(r) repeats from t group by user_id""")
def failures_since_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    # event times repeat: the id makes their order whole
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "purchase").alias("ok"), "event_type")
    last = e.withColumn("at", F.struct(F.col("at.ts").alias("ts"), F.col("at.event_id").alias("event_id")))
    return conv.failures_since_success(last, "user_id", "at", "ok", "event_type")


@query("select conv_id, case when lower(text) = 'in nicht' then 1.0 else 0.5 end::double score from conversations where turn = 0 and contains(lower(text), 'der')")
def conv_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("title"))
    return conv.title_search(titles, "der")


@query("""with l as (select conv_id, turn, text, strpos(lower(text), 'the') a, strpos(lower(text), 'der') b from conversations)
    select conv_id, turn, array_to_string(list_filter([case when a > 0 then substr(text, greatest(a - 50, 1), 103) end, case when b > 0 and not (a > 0 and substr(text, greatest(a - 50, 1), 103) = substr(text, greatest(b - 50, 1), 103)) then substr(text, greatest(b - 50, 1), 103) end], lambda x: x is not null), '|') snippets from l where a > 0 or b > 0""")
def conv_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").where(F.lower("text").contains("the") | F.lower("text").contains("der"))
    one = conv.snippets(F.col("text"), ["the", "der"])
    return m.select("conv_id", "turn", F.array_join(one, "|").alias("snippets"))


@query("with m as (select conv_id, lower(string_agg(text, ' ' order by turn)) t from conversations group by conv_id) select conv_id, round((contains(t, 'the')::int + contains(t, 'der')::int + contains(t, 'tion')::int) / 3.0::double, 6) score from m")
def outcome_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    return whole.select("conv_id", conv.outcome_score(F.col("t"), ("the", "der", "tion")).alias("score"))


def _rule_sql(rule: tuple) -> str:
    name, tag, confidence, _, kind, words, least = rule
    test = {"keyword": lambda: _ANY(words, "lower(text)"), "title": lambda: _ANY(words, "lower(text)"), "extension": lambda: _ANY(tuple(f".{w}" for w in words), "lower(text)"), "project": lambda: f"project in ({', '.join(repr(w) for w in words)})", "messages": lambda: f"turn >= {least}", "branches": lambda: f"conv_id % 2 >= {least}"}[kind]()
    return f"select conv_id, turn, '{tag}' tag, {confidence}::double confidence, '{name}' source from p where {test}"


@query(f"with {_M}, p as (select *, case conv_id % 3 when 0 then 'rust' when 1 then 'python' end project from m) " + " union all ".join(map(_rule_sql, phrases.TAG_RULES)))
def tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).withColumn("project", F.when(F.col("conv_id") % 3 == 0, "rust").when(F.col("conv_id") % 3 == 1, "python"))
    return m.select("conv_id", "turn", F.inline(tagging.rule_tags(tagging.Conversation(F.col("text"), F.col("text"), F.col("turn"), F.col("conv_id") % 2, F.col("project")))))


_CONTENT = " union all ".join(f"select conv_id, turn, {i} pos, '{tag}' tag, round({_HITS(words, 'lower(text)')} / {len(words)}.0::double * {w}::double, 6) confidence, '{source}' source from m where {_ANY(words, 'lower(text)')}" for i, (source, tag, words, w) in enumerate([("language", t, ws, phrases.LANGUAGE_WEIGHT) for t, ws in phrases.LANGUAGE_TAGS.items()] + [("topic", t, ws, phrases.TOPIC_WEIGHT) for t, ws in phrases.TOPIC_TAGS.items()]))


@query(f"with {_M} select conv_id, turn, tag, confidence, source from ({_CONTENT})")
def content_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", F.inline(tagging.content_tags(F.col("text"))))


_TITLE = " union all ".join(f"select conv_id, turn, '{tag}' tag, 0.5::double confidence, 'title' source from m where {_ANY(words, 'lower(text)')}" for tag, words in phrases.TITLE_TAGS.items())


@query(f"with {_M} {_TITLE}")
def title_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", F.inline(tagging.title_tags(F.col("text"))))


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _messages(spark, sf_dir).select("conv_id", "turn", F.posexplode(tagging.content_tags(F.col("text"))).alias("i", "s"))
    return found.select("conv_id", (F.col("turn") * 100 + F.col("i")).alias("pos"), "s.*")


@query(f"with {_M}, c as ({_CONTENT}) select conv_id, tag, confidence from c qualify row_number() over (partition by conv_id, tag order by confidence desc, turn) = 1")
def suggest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.best_per_tag(_suggestions(spark, sf_dir), "conv_id").select("conv_id", "tag", "confidence")


@query(f"with {_M}, c as ({_CONTENT}), b as (select conv_id, tag, max(confidence) confidence from c group by all), r as (select *, row_number() over (partition by conv_id order by confidence desc, tag)::int rank from b) select * from r where rank <= 5 and confidence >= 0.2")
def suggest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = tagging.best_per_tag(_suggestions(spark, sf_dir), "conv_id").select("conv_id", "tag", "confidence")
    return tagging.top_suggestions(best, "conv_id", least=0.2)


@query(f"""with {_M}, c as ({_CONTENT}), t as (select distinct conv_id id, tag from c), n as (select id, count(*) n from t group by id), p as (select a.id, b.id other, count(*) common from t a join t b on a.tag = b.tag and a.id < b.id group by all)
    select p.id, other, common, score from (select p.*, round(common / greatest(x.n, y.n)::double, 6) score from p join n x on x.id = p.id join n y on y.id = other) p where score > 0.5""")
def tag_overlap_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _suggestions(spark, sf_dir).select(F.col("conv_id").alias("id"), "tag").distinct()
    return tagging.tag_overlap(tags)


@query("select case when n_chars % 3 = 0 then 'rule' else 'content' end source, count(*) n, count(*) filter (doc_id % 2 = 0) accepted, count(*) filter (doc_id % 2 = 1) rejected, round(count(*) filter (doc_id % 2 = 0) / count(*)::double, 6) rate from documents group by 1")
def suggestion_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") % 3 == 0, "rule").otherwise("content").alias("source"), F.when(F.col("doc_id") % 2 == 0, "accepted").otherwise("rejected").alias("action"))
    return tagging.suggestion_statistics(actions)


@query("""with a as (select doc_id id, round((n_chars % 128) / 128.0::double, 6) score from documents where doc_id % 2 = 0), b as (select doc_id id, round((n_chars % 64) / 64.0::double, 6) score from documents where doc_id % 3 = 0)
    select coalesce(a.id, b.id) id, round(coalesce((a.score + b.score) / 2, a.score, b.score), 6) score from a full join b using (id)""")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = lambda k, m: docs.where(F.col("doc_id") % k == 0).select(F.col("doc_id").alias("id"), F.round((F.col("n_chars") % m) / float(m), 6).alias("score"))
    return conv.merge_results(part(2, 128), part(3, 64))


_COSAB = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"


@query(f"with e as (select vec_id, label, embedding::double[] v from embeddings), p as (select a.vec_id a, b.vec_id b, {_COSAB} score from e a join e b on a.label = b.label and a.vec_id < b.vec_id) select * from p where score >= 0.2")
def conv_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.similar_pairs(table(spark, sf_dir, "embeddings"), "label", 0.2, "vec_id")


# greedy clusters: a label's ids in order; each that is free gathers the first 19 free ones after it that are similar
_CLUSTERS = f"""e as (select vec_id, label, embedding::double[] v from embeddings), sims as (select a.vec_id a, b.vec_id b, {_COSAB} score, {_COSAB.replace("round(", "(").replace(", 6)", ")")} exact from e a join e b on a.label = b.label and a.vec_id < b.vec_id),
    groups as (select label, list(vec_id order by vec_id) ids from e group by label having count(*) >= 5),
    walk as (select label, 0 k, []::bigint[] used, []::bigint[] members from groups
      union all select label, k + 1, used || found, found from (
        select w.label, w.k, w.used, case when list_contains(w.used, g.ids[w.k + 1]) then []::bigint[] else coalesce((select case when count(*) > 0 then [g.ids[w.k + 1]] || list(b order by b)[1:19] else []::bigint[] end from sims where a = g.ids[w.k + 1] and score >= 0.2 and not list_contains(w.used, b)), []::bigint[]) end found
        from walk w join groups g using (label) where w.k < len(g.ids))),
    members as (select label, members[1] as cluster, unnest(members) vec_id from walk where len(members) > 0),
    cohesions as (select m.cluster, count(distinct m.vec_id) n, round(avg(s.exact), 6) cohesion from members m left join members o on o.cluster = m.cluster and o.vec_id > m.vec_id left join sims s on s.a = m.vec_id and s.b = o.vec_id group by m.cluster)"""


@query(f"with recursive {_CLUSTERS} select label, cluster, vec_id, n, cohesion from members join cohesions using (cluster)")
def conv_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    found = clusters.greedy_clusters(points, "label", 0.2, "vec_id")
    return found.join(clusters.cohesion(found, points, "vec_id"), "cluster")


@query(f"with recursive {_CLUSTERS} select vec_id from embeddings where vec_id not in (select vec_id from members)")
def conv_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    return clusters.outliers(points, clusters.greedy_clusters(points, "label", 0.2, "vec_id"), "vec_id")


@query(f"with recursive {_CLUSTERS} select count(*) clusters, round(avg(cohesion), 6) avg_cohesion, round(case when count(*) > 1 then 0.8 * avg(cohesion) else 0.0 end, 6)::double silhouette from cohesions")
def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    found = clusters.greedy_clusters(points, "label", 0.2, "vec_id")
    return clusters.metrics(clusters.cohesion(found, points, "vec_id"))


_THEMES = " union all ".join([f"select conv_id, '{n}' theme, {w} v from m where {_ANY(ws, 'lower(text)')}" for n, w, ws in phrases.THEMES] + ["select conv_id, 'How-To Questions', 2 from m where contains(lower(text), 'how') and contains(lower(text), '?')"])


@query(f"with {_M}, t as ({_THEMES}), s as (select conv_id, theme, sum(v)::bigint votes from t group by all) select conv_id, theme, votes from s qualify row_number() over (partition by conv_id order by votes desc, theme) = 1")
def cluster_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.theme(_messages(spark, sf_dir), "conv_id", "text")


@query("select page_id, case " + " ".join(f"when regexp_matches(lower(url), '{p}') then '{n}'" for n, p in phrases.PROJECT_TYPES) + " else 'unknown' end project_type from pages")
def project_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", conv.project_type(F.col("url")).alias("project_type"))


@query(f"""with {_SUM} select conv_id, round((greatest(ln(n_messages), 1.0) + (conv_id % 3) * 0.5 + (conv_id % 2) * 0.3) * greatest(0.1, 1.0 / (conv_id % 30 + 1)), 6)::double activity from s""")
def activity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = conv.summaries(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    return s.select("conv_id", conv.activity_score(F.col("n_messages"), c % 3, c % 2, c % 30).alias("activity"))


@query("with h as (select vec_id id, (label / 10.0)::double s from embeddings) select id, round(0.7 * s + 0.3 * (1 - (s * 100) / 168), 6)::double t, round(case when id % 3 > 0 then 0.8 * s + 0.2 * (id % 3) / 7 else s end, 6)::double g from h")
def similarity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10.0).alias("s"))
    return s.select("id", F.round(clusters.temporal_weight(F.col("s"), F.col("s") * 100), 6).alias("t"), F.round(clusters.tag_weight(F.col("s"), F.col("id") % 3, F.lit(7)), 6).alias("g"))


_MESSAGES = tokens_sql("(select conv_id || '-' || turn id, text from conversations)", "id")
_ASKED = ("the", "tion", "der", "que")


@query(f"""with {_MESSAGES}, total as (select count(*)::double n from conversations), hit as (select * from post where term in {_ASKED}), dfs as (select term, count(*) df from hit group by term),
    s as (select id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) score from hit join dfs using (term), total group by id), g as (select conv_id, s.id, score, text from s join conversations on s.id = conv_id || '-' || turn)
    select conv_id, max(score) score, count(*) n_hits, sha256(array_to_string((list(text order by score desc, id))[1:3], '|')) snippets from g group by conv_id""")
def message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best hits of the flagship search over messages in place of documents, grouped by conversation."""
    m = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    post = tokens.postings(m, "id", F.col("text"), only=list(_ASKED))
    hits = search.sparse_scores(post, tokens.query_terms(spark, " ".join(_ASKED)), "id", total=m.count()).join(m.select("id", "conv_id", "text"), "id")
    return search.group_hits(hits, "conv_id", "text").withColumn("snippets", F.sha2(F.array_join("snippets", "|"), 256))


@query()
def message_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of messages by a public BPE file."""
    import public_tokenizers

    count = conv.bpe_tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return said.select("conv_id", "turn", count("role", "text").alias("tokens"))
