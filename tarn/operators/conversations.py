"""Conversation analytics: metrics, scores, tags, ranking, history limits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import phrases

# Fixed values of reports: least messages, success score, tokens that count as many, price of 1000 tokens.
LEAST_MESSAGES, SUCCESS, MANY_TOKENS, PRICE = 3, 0.7, 60_000, 0.03


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the phrases a text contains."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def first_group(text: Column, groups, default: str) -> Column:
    """The first group one of whose phrases a text contains."""
    return reduce(lambda rest, g: F.when(any_of(text, g[1]), g[0]).otherwise(rest), reversed(groups), F.lit(default))


def summaries(messages: DataFrame, conv: str = "conv_id", text: str = "text") -> DataFrame:
    """One row per conversation: messages, tokens, bytes."""
    return messages.groupBy(conv).agg(F.count("*").alias("n_messages"), F.sum(token_estimate(F.col(text))).alias("tokens"), F.sum(F.octet_length(F.coalesce(text, F.lit("")))).alias("n_bytes"))


def overall(conversations: DataFrame) -> DataFrame:
    """Totals and averages over summaries: one row."""
    return conversations.agg(
        F.count("*").alias("n_conversations"),
        F.sum("n_messages").alias("n_messages"),
        F.round(F.avg("n_messages"), 6).alias("avg_messages"),
        F.sum("tokens").alias("tokens"),
        F.count_if(F.col("tokens") > MANY_TOKENS).alias("n_large"),
        F.max("tokens").alias("peak_tokens"),
    )


def tokens_by(messages: DataFrame, key: str, text: str = "text") -> DataFrame:
    return messages.groupBy(key).agg(F.count("*").alias("n_messages"), F.sum(token_estimate(F.col(text))).alias("tokens"))


def cost(tokens: Column) -> Column:
    """Price of tokens; null for none."""
    return F.when(tokens > 0, F.round(tokens / 1000 * PRICE, 6))


def successful(status: Column, n_messages: Column, branch_scores: Column, least: int = LEAST_MESSAGES, score: float = SUCCESS) -> Column:
    """Completed, or long enough with a branch that scores well."""
    return (status == "Completed") | ((n_messages >= least) & F.exists(branch_scores, lambda x: F.coalesce(x >= score, F.lit(False))))


def success_by_length(conversations: DataFrame, n: str = "n_messages", success: str = "success", width: int = 5) -> DataFrame:
    """(bucket, n, rate) with buckets of ``width`` messages."""
    return conversations.groupBy((F.floor(F.col(n) / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(success).cast("double")), 6).alias("rate"))


def peak_hours(rows: DataFrame, ts: str = "ts", share: float = 0.8) -> DataFrame:
    """Hours of the day with at least ``share`` of the busiest hour's rows (integer division of the bound)."""
    by_hour = rows.groupBy(F.hour(ts).cast("int").alias("hour")).agg(F.count("*").alias("n"))
    hours = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(F.broadcast(by_hour), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
    most = by_hour.agg(F.floor(F.max("n") * int(share * 10) / 10).alias("least"))
    # 24 rows against one
    return hours.join(F.broadcast(most), F.col("n") >= F.coalesce("least", F.lit(0))).select("hour", "n")


def recommendations(metrics: DataFrame) -> DataFrame:
    """(rule, value) for each threshold that a one-row table of metrics misses."""
    rules = F.array(
        *(
            F.when(F.col(c) < limit, F.struct(F.lit(name).alias("rule"), F.col(c).cast("double").alias("value")))
            for name, c, limit in (("low_success_rate", "success_rate", 0.7), ("few_messages", "avg_messages", float(LEAST_MESSAGES)), ("low_branch_efficiency", "branch_efficiency", 0.6), ("low_checkpoint_use", "checkpoint_use", 0.3))
        )
    )
    return metrics.select(F.inline(F.array_compact(rules)))


def last_messages(messages: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return messages.withColumn("_n", F.row_number().over(W.partitionBy(conv).orderBy(F.desc(turn)))).where(F.col("_n") <= n).drop("_n")


def truncate_history(messages: DataFrame, limit: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", overhead: int = 4) -> DataFrame:
    """System messages and the newest others that fit a token limit; one other stays at least."""
    marked = messages.withColumn("tokens", token_estimate(F.col(text)) + overhead).withColumn("_s", F.col(role) == "system")
    newest = W.partitionBy(conv, "_s").orderBy(F.desc(turn))
    suffix = F.sum("tokens").over(newest.rowsBetween(W.unboundedPreceding, 0))
    system = F.sum(F.when(F.col("_s"), F.col("tokens")).otherwise(0)).over(W.partitionBy(conv))
    kept = marked.withColumn("_sum", suffix + system).withColumn("_n", F.row_number().over(newest))
    return kept.where(F.col("_s") | (F.col("_sum") <= limit) | (F.col("_n") == 1)).drop("_s", "_sum", "_n")


def near_limit(tokens: Column, limit: int) -> Column:
    return tokens > 0.8 * limit


def recent_text(messages: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with ``recent``: the lower-cased last n texts of the conversation up to each, newest first."""
    w = W.partitionBy(conv).orderBy(turn)
    parts = [F.coalesce(F.lower(F.lag(text, k).over(w)) if k else F.lower(text), F.lit("")) for k in range(n)]
    return messages.withColumn("recent", F.concat_ws(" ", *parts))


def conversation_phase(recent: Column) -> Column:
    return first_group(recent, phrases.PHASES, "ProblemDefinition")


def conversation_state(recent: Column) -> Column:
    return first_group(recent, phrases.STATES, "SolutionDevelopment")


def bonus(label: Column, table: dict[str, float]) -> Column:
    return reduce(lambda rest, x: F.when(label == x[0], x[1]).otherwise(rest), table.items(), F.lit(0.0))


def checkpoint_importance(text: Column, phase: Column, n_messages: Column, tools: Column | None = None) -> Column:
    """Weight of a message as a checkpoint, at most 1; null below 0.3."""
    score = sum((hits(F.lower(text), words) * weight for words, weight in phrases.CHECKPOINT_WEIGHTS), F.lit(0.0)) + bonus(phase, phrases.PHASE_BONUS)
    if tools is not None:
        score = score + F.when(tools, 0.2).otherwise(0.0)
    score = score + F.when((n_messages > 20) & (n_messages % 20 == 0), 0.1).otherwise(0.0)
    score = F.round(score, 6)
    return F.when(score >= 0.3, F.least(score, F.lit(1.0)))


def branch_confidence(text: Column, state: Column, role: Column) -> Column:
    """Weight of a message as a point to branch, at most 1; null below 0.3."""
    low = F.lower(text)
    score = sum((hits(low, words) * weight for words, weight in phrases.BRANCH_WEIGHTS), F.lit(0.0)) + bonus(state, phrases.STATE_BONUS)
    score = score + F.when((role == "user") & low.contains("?"), 0.1).otherwise(0.0) + F.when(F.octet_length(low) > 500, 0.1).otherwise(0.0)
    score = F.round(score, 6)
    return F.when(score >= 0.3, F.least(score, F.lit(1.0)))


def branch_reason(text: Column, role: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_of(low, phrases.UNCERTAINTIES), "UserUncertainty")
        .when(any_of(low, phrases.ERRORS), "ErrorRecovery")
        .when(any_of(low, phrases.BRANCHES), "AlternativeApproach")
        .when((role == "user") & low.contains("?"), "UserUncertainty")
        .when(F.octet_length(low) > 500, "ComplexProblem")
        .otherwise("AlternativeApproach")
    )


def branch_success(reason: Column, role: Column, n_context: Column, history: Column | None = None, weight: float = 0.3) -> Column:
    """Predicted success of a branch, blended with a history where there is one."""
    base = 0.5 + bonus(reason, phrases.REASON_BONUS) + F.when(role == "user", 0.1).otherwise(0.0) + F.least(n_context / 10, F.lit(1.0)) * 0.1
    if history is not None:
        base = F.coalesce(base * (1 - weight) + history * weight, base)
    return F.round(F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0)), 6)


def running_success(scores: Column) -> Column:
    """(average + new) / 2 over an array of scores in order, from 0.5."""
    return F.aggregate(scores, F.lit(0.5), lambda a, x: (a + x) / 2)


def restoration_value(reason: Column, tools: Column, n_context: Column) -> Column:
    by_reason = bonus(reason, {"SuccessfulSolution": 0.4, "TaskCompletion": 0.3, "MajorMilestone": 0.3, "BeforeRiskyOperation": 0.2, "PeriodicAutomatic": 0.1})
    return F.least(F.lit(1.0), 0.5 + by_reason + F.when(tools, 0.2).otherwise(0.0) + F.least(n_context / 10, F.lit(1.0)) * 0.1)


def frustration(failures: Column, repeats: Column, minutes: Column, indicators: Column) -> Column:
    return F.round(F.least(F.lit(1.0), failures * 0.1 + repeats * 0.05 + F.when(minutes > 5, minutes * 0.01).otherwise(0.0) + indicators * 0.1), 6)


def failures_since_success(actions: DataFrame, conv: str = "conv_id", ts: str = "ts", success: str = "success", action: str = "action") -> DataFrame:
    """(conv, failures, repeats): failures after the last success, and the most of one action among the last five."""
    last = F.max(F.when(F.col(success), F.col(ts))).over(W.partitionBy(conv))
    after = actions.withColumn("_last", last).where(~F.col(success) & (F.col("_last").isNull() | (F.col(ts) > F.col("_last"))))
    recent = after.withColumn("_n", F.row_number().over(W.partitionBy(conv).orderBy(F.desc(ts)))).withColumn("_r", F.col("_n") <= 5)
    by_action = recent.groupBy(conv, action).agg(F.count("*").alias("n"), F.count_if("_r").alias("r"))
    return by_action.groupBy(conv).agg(F.sum("n").alias("failures"), F.max("r").alias("repeats"))


def activity_score(n_messages: Column, n_branches: Column, n_checkpoints: Column, days: Column) -> Column:
    return F.round((F.greatest(F.log(n_messages), F.lit(1.0)) + n_branches * 0.5 + n_checkpoints * 0.3) * F.greatest(F.lit(0.1), 1 / (days + 1)), 6)


def trending(rows: DataFrame, key: str, ts: str, now: Column, days: int = 7, least: int = 5) -> DataFrame:
    """Keys with more than ``least`` rows in the last days."""
    return rows.groupBy(key).agg(F.count_if(F.col(ts) >= now - F.make_dt_interval(F.lit(days))).alias("n_recent")).where(F.col("n_recent") > least)


def status_after(status: Column, last_active: Column, now: Column, manual: Column | None = None) -> Column:
    """Active becomes Paused after 30 idle minutes, Completed becomes Archived after 90 days; a manual status stays."""
    moved = F.when((status == "Active") & (now - last_active > F.expr("interval 30 minutes")), "Paused").when((status == "Completed") & (now - last_active > F.expr("interval 90 days")), "Archived").otherwise(status)
    return F.when(F.coalesce(manual, F.lit(False)), status).otherwise(moved) if manual is not None else moved


def title_search(conversations: DataFrame, query: str, title: str = "title", key: str = "conv_id") -> DataFrame:
    """(key, score): 1 for a title that is the query, 0.5 for one that contains it."""
    low = F.lower(F.col(title))
    return conversations.where(low.contains(query.lower())).select(key, F.when(low == query.lower(), 1.0).otherwise(0.5).alias("score"))


def snippets(text: Column, words: list[str], most: int = 3, around: int = 50) -> Column:
    """Distinct pieces of text around the first place of each word."""
    one = [F.when(F.locate(w.lower(), F.lower(text)) > 0, F.substring(text, F.greatest(F.locate(w.lower(), F.lower(text)) - around, F.lit(1)), F.lit(2 * around + len(w)))) for w in words]
    return F.slice(F.array_distinct(F.array_compact(F.array(*one))), 1, most)


def text_similarity(text: Column, query: str) -> Column:
    """1 where a text contains the query, else the share of the query's words that it contains."""
    words = query.lower().split()
    return F.when(F.lower(text).contains(query.lower()), 1.0).otherwise(hits(F.lower(text), tuple(words)) / max(1, len(words)))


def outcome_score(text: Column, criteria: tuple[str, ...]) -> Column:
    return F.round(hits(F.lower(text), criteria) / len(criteria), 6)


def merge_results(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Two result lists: scores averaged where both have a key."""
    y = b.select(key, F.col("score").alias("_other"))
    return a.join(y, key, "full_outer").select(key, F.round(F.coalesce((F.col("score") + F.col("_other")) / 2, "score", "_other"), 6).alias("score"))


def archive(conversations: DataFrame, now: Column, days: int, fewer_than: int, status: str) -> tuple[DataFrame, DataFrame]:
    """(archived, kept): archived are the old, the short and those of a status."""
    goes = F.coalesce((F.col("last_active") < now - F.make_dt_interval(F.lit(days))) | (F.col("n_messages") < fewer_than) | (F.col("status") == status), F.lit(False))
    return conversations.where(goes), conversations.where(~goes)


def grouped_by_recency(last_active: Column, now: Column) -> Column:
    age = F.datediff(now, last_active)
    return F.when(age <= 0, "Today").when(age == 1, "Yesterday").when(age < 7, "This Week").when(age < 30, "This Month").otherwise("Older")


# Groups of statuses with their ranks, and of outcomes.
STATUS_RANKS = (("Active", 100), ("Paused", 90), ("Completed", 80), ("Summarizing", 75), ("Archived", 70))
RECENCY_RANKS = (("Today", 100), ("Yesterday", 90), ("This Week", 80), ("This Month", 70), ("Older", 60))


def groups_by(conversations: DataFrame, mode: str, now: Column | None = None) -> DataFrame:
    """(group_id, name, priority, n, last_active): conversations (project, status, tags, last_active, cluster, cohesion) grouped.

    ``mode``: recency, project, status, tag, cluster or success. A conversation is in the group of each of its tags.
    """
    status = F.col("status")
    if mode == "recency":
        name = grouped_by_recency(F.col("last_active"), now if now is not None else F.current_timestamp())
        keyed = conversations.select(F.lower(F.replace(name, F.lit(" "), F.lit("_"))).alias("group_id"), name.alias("name"), bonus(name, dict(RECENCY_RANKS)).alias("priority"), "last_active")
    elif mode == "project":
        p = F.col("project")
        keyed = conversations.select(F.coalesce(p, F.lit("no-project")).alias("group_id"), F.coalesce(p, F.lit("No Project")).alias("name"), F.when(p.isNull(), 1).otherwise(0).alias("priority"), "last_active")
    elif mode == "status":
        keyed = conversations.where(status.isin(*(s for s, _ in STATUS_RANKS))).select(F.concat(F.lit("status_"), F.lower(status)).alias("group_id"), status.alias("name"), bonus(status, dict(STATUS_RANKS)).alias("priority"), "last_active")
    elif mode == "tag":
        tagged = conversations.select(F.explode_outer("tags").alias("t"), "last_active")
        name = F.coalesce("t", F.lit("Untagged"))
        keyed = tagged.select(F.when(F.col("t").isNull(), "untagged").otherwise(F.concat(F.lit("tag_"), F.replace(F.lower("t"), F.lit(" "), F.lit("_")))).alias("group_id"), name.alias("name"), F.when(F.col("t").isNull(), 10).otherwise(50).alias("priority"), "last_active")
    elif mode == "cluster":
        c = F.col("cluster")
        keyed = conversations.select(F.coalesce(F.concat(F.lit("cluster_"), c.cast("string")), F.lit("unclustered")).alias("group_id"), F.coalesce(c.cast("string"), F.lit("Unclustered")).alias("name"), F.when(c.isNull(), 10).otherwise(F.floor(100 - F.col("cohesion") * 100)).alias("priority"), "last_active")
    elif mode == "success":
        name = F.when(status == "Completed", "Successful").when(status == "Active", "In Progress").otherwise("Other")
        keyed = conversations.select(F.lower(F.replace(name, F.lit(" "), F.lit("_"))).alias("group_id"), name.alias("name"), F.when(status == "Completed", 100).when(status == "Active", 80).otherwise(60).alias("priority"), "last_active")
    else:
        raise ValueError(f"no such grouping: {mode}")
    return keyed.groupBy("group_id", "name", F.col("priority").cast("int").alias("priority")).agg(F.count("*").alias("n"), F.max("last_active").alias("last_active"))


def statistics(conversations: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """(workspace, n, n_active, messages, branches, checkpoints, avg_messages), the row of all with ``everything`` true.

    ``conversations``: workspace, status, n_messages, branch_scores, n_checkpoints.
    """
    totals = [F.count("*").alias("n"), F.count_if(F.col("status") == "Active").alias("n_active"), F.sum("n_messages").alias("messages"), F.sum(F.size("branch_scores")).alias("branches"), F.sum("n_checkpoints").alias("checkpoints"), F.round(F.avg("n_messages"), 6).alias("avg_messages"), (F.grouping(workspace) == 1).alias("everything")]
    return conversations.rollup(workspace).agg(*totals)


def patterns(conversations: DataFrame) -> DataFrame:
    """(kind, name, frequency, rate): themes, behaviour and topics of a report. Their shares and rates are fixed values."""
    n = F.count("*")
    one = lambda kind, name, frequency, rate: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(frequency).cast("long").alias("frequency"), F.lit(rate).cast("double").alias("rate"))
    counts = conversations.agg(F.floor(n / 3).alias("third"), F.floor(n / 4).alias("quarter"), F.count_if(F.col("n_messages") > 5).alias("long"))
    return counts.select(F.inline(F.array(one("theme", "Programming Help", "third", None), one("behaviour", "Iterative Problem Solving", "long", 0.8), one("topic", "Async Programming", "quarter", 0.75), one("topic", "Error Handling", "third", 0.82))))


def rising_words(messages: DataFrame, period: str, keep: int = 5, word: str = "[a-z]{4,}") -> DataFrame:
    """(period, word, n, before, rise): for each period (a whole number) the words that rise most.

    ``messages``: period, conv_id, text. n and before count conversations of this and the last period; rise is their
    difference over the period's conversations. Ties go by n, then by word. Words are counted before they meet.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(word), F.lit(0)))
    said = messages.select(period, "conv_id", F.explode(words).alias("word")).distinct()
    counts = said.groupBy(period, "word").agg(F.count("*").alias("n"))
    # one shuffle: each count is sent to its own period and the next
    met = counts.select("word", "n", F.inline(F.array(F.struct(F.col(period).alias("of"), F.lit(True).alias("own")), F.struct((F.col(period) + 1).alias("of"), F.lit(False).alias("own")))))
    both = met.groupBy("of", "word").agg(F.max(F.when(F.col("own"), F.col("n"))).alias("n"), F.coalesce(F.max(F.when(~F.col("own"), F.col("n"))), F.lit(0)).alias("before")).where("n is not null")
    total = messages.groupBy(F.col(period).alias("of")).agg(F.count_distinct("conv_id").alias("c"))
    order = W.partitionBy("of").orderBy(F.desc(F.col("n") - F.col("before")), F.desc("n"), "word")
    best = both.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= keep)
    return best.join(total, "of").select(F.col("of").alias(period), "word", "n", "before", F.round((F.col("n") - F.col("before")) / F.col("c"), 6).alias("rise"))


def in_period(conversations: DataFrame, start: Column, end: Column, least: int = LEAST_MESSAGES) -> DataFrame:
    """Conversations that a report is about: created within the period (inclusive) and of ``least`` messages at least."""
    return conversations.where(F.col("created_at").between(start, end) & (F.col("n_messages") >= least))


def report(conversations: DataFrame, start: Column, end: Column, least: int = LEAST_MESSAGES) -> DataFrame:
    """(section, name, value): all metrics of a period as rows.

    ``conversations``: created_at, status, n_messages, tokens, minutes, branch_scores, n_checkpoints, project_type.
    """
    chosen = in_period(conversations, start, end, least).withColumn("success", successful(F.col("status"), F.col("n_messages"), F.col("branch_scores")))
    rate = F.round(F.avg(F.col("success").cast("double")), 6)
    long_form = lambda section, df: df.select(F.lit(section).alias("section"), F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns))))
    totals = overall(chosen)
    success = chosen.agg(rate.alias("success_rate"), F.count_if("success").alias("n_successful"))
    work = efficiency(chosen)
    usage = chosen.agg(F.sum("tokens").alias("tokens"), cost(F.sum("tokens")).alias("cost"))
    by_project = insights(chosen).select(F.lit("project").alias("section"), F.coalesce("project_type", F.lit("unknown")).alias("name"), F.col("rate").alias("value"))
    found = patterns(chosen).select(F.concat(F.lit("pattern_"), "kind").alias("section"), "name", F.col("frequency").cast("double").alias("value"))
    advice = recommendations(chosen.agg(rate.alias("success_rate"), F.round(F.avg("n_messages"), 6).alias("avg_messages"), *efficiency_columns())).select(F.lit("advice").alias("section"), F.col("rule").alias("name"), "value")
    parts = [long_form("overall", totals), long_form("success", success), long_form("efficiency", work), long_form("usage", usage), by_project, found, advice]
    return reduce(lambda a, b: a.unionByName(b), parts)


def bpe_tokens(ranks_path: str, pattern: str, overhead: int = 4):
    """A Pandas UDF (role, content) -> tokens of a message by a BPE file of ranks: both texts' and ``overhead``.

    ``ranks_path`` must be readable on every executor; without a file, ``message_tokens`` estimates.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # long runs of blanks exhaust the pattern's stack: texts are encoded in parts, cut where a word begins
        count = lambda text: sum(len(encoder.encode_ordinary(p)) for p in blank_runs(text or ""))
        for roles, contents in batches:
            yield pd.Series([overhead + count(r) + count(c) for r, c in zip(roles, contents)], dtype="int64")

    return run


def blank_runs(text: str, most: int = 1000) -> list[str]:
    """A text in parts none of which holds more than ``most`` blanks in a row."""
    import re

    out, at = [], 0
    for m in re.finditer(rf"\s{{{most},}}", text):
        out.append(text[at : m.start()])
        out += [text[i : min(i + most, m.end())] for i in range(m.start(), m.end(), most)]
        at = m.end()
    return [p for p in (*out, text[at:]) if p]


def message_tokens(role: Column, content: Column, overhead: int = 4) -> Column:
    """Tokens of a message where there is no vocabulary: a quarter of the bytes of either text."""
    return (F.lit(overhead) + token_estimate(role) + token_estimate(content)).cast("long")


def project_type(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda rest, x: F.when(low.rlike(x[1]), x[0]).otherwise(rest), reversed(phrases.PROJECT_TYPES), F.lit("unknown"))


def theme(titles: DataFrame, key: str, title: str = "title") -> DataFrame:
    """(key, theme, votes): the theme with most votes of a group's titles, by name among equals."""
    low = F.lower(F.col(title))
    votes = [F.struct(F.lit(name).alias("theme"), F.when(any_of(low, words), weight).otherwise(0).alias("v")) for name, weight, words in phrases.THEMES]
    votes.append(F.struct(F.lit("How-To Questions").alias("theme"), F.when(low.contains("how") & low.contains("?"), 2).otherwise(0).alias("v")))
    summed = titles.select(key, F.inline(F.array(*votes))).groupBy(key, "theme").agg(F.sum("v").alias("votes")).where("votes > 0")
    best = F.min(F.struct((-F.col("votes")).alias("n"), F.col("theme").alias("theme")))
    return summed.groupBy(key).agg(best.alias("b")).select(key, "b.theme", (-F.col("b.n")).alias("votes"))


def timeline(conversations: DataFrame, start: Column, end: Column, limit: int) -> DataFrame:
    return conversations.where(F.col("created_at").between(start, end)).orderBy(F.desc("activity"), F.desc("last_active"), "conv_id").limit(limit)


def select_conversations(conversations: DataFrame, workspace: str | None = None, status: str | None = None, all_tags: list[str] | None = None, any_tags: list[str] | None = None, created: tuple[Column, Column] | None = None, active: tuple[Column, Column] | None = None) -> DataFrame:
    """Conversations that meet all conditions given: all or any of some tags, created or last active within times (inclusive)."""
    if workspace is not None:
        conversations = conversations.where(F.col("workspace_id") == workspace)
    if status is not None:
        conversations = conversations.where(F.col("status") == status)
    if all_tags:
        conversations = conversations.where(F.size(F.array_intersect("tags", F.array(*map(F.lit, all_tags)))) == len(set(all_tags)))
    if any_tags:
        conversations = conversations.where(F.arrays_overlap("tags", F.array(*map(F.lit, any_tags))))
    for column, bounds in (("created_at", created), ("last_active", active)):
        if bounds is not None:
            conversations = conversations.where(F.col(column).between(*bounds))
    return conversations


def efficiency_columns() -> list[Column]:
    n = F.sum(F.size("branch_scores"))
    good = F.sum(F.size(F.filter("branch_scores", lambda x: x >= SUCCESS)))
    return [
        F.round(F.avg(F.when(F.col("status") == "Completed", F.col("minutes"))), 6).alias("resolution_minutes"),
        F.round(F.when(n > 0, good / n), 6).alias("branch_efficiency"),
        F.round(F.avg((F.col("n_checkpoints") > 0).cast("double")), 6).alias("checkpoint_use"),
        F.round(n / F.count("*"), 6).alias("switches"),
    ]


def efficiency(conversations: DataFrame) -> DataFrame:
    """One row: minutes to resolution of completed conversations, share of branches that succeed, of conversations with
    checkpoints, branches per conversation. ``conversations``: status, minutes, branch_scores, n_checkpoints."""
    return conversations.agg(*efficiency_columns())


def insights(conversations: DataFrame, by: str = "project_type", success: str = "success") -> DataFrame:
    return conversations.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(success).cast("double")), 6).alias("rate"))


def content_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, kind, position, content): what of a conversation is indexed. ``conversations``: conv_id, title, messages,
    branches, checkpoints, tags, project."""
    rows = lambda kind, texts: F.transform(texts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), x.alias("content")))
    one = lambda kind, text: rows(kind, F.array_compact(F.array(text)))
    parts = [one("title", F.col("title")), rows("message", F.col("messages")), rows("branch", F.col("branches")), rows("checkpoint", F.col("checkpoints")), one("tags", F.when(F.size("tags") > 0, F.array_join("tags", ", "))), one("project", F.col("project"))]
    return conversations.select("conv_id", F.inline(F.filter(F.concat(*parts), lambda x: x["content"].isNotNull())))


def activity_feed(messages: DataFrame, others: DataFrame, conv: str = "conv_id", ts: str = "ts", last: int = 5, top: int = 10) -> DataFrame:
    """The ``top`` newest of a conversation's last messages and its other events (conv, ts, kind, label)."""
    recent = messages.withColumn("_n", F.row_number().over(W.partitionBy(conv).orderBy(F.desc(ts), "label"))).where(F.col("_n") <= last).drop("_n")
    both = recent.select(conv, ts, F.lit("message").alias("kind"), "label").unionByName(others.select(conv, ts, "kind", "label"))
    newest = W.partitionBy(conv).orderBy(F.desc(ts), "kind", "label")
    return both.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= top)


def rerank(hits: DataFrame, related: Column, boost: float = 1.2) -> DataFrame:
    """Hits with the scores of related ones raised, best first."""
    return hits.withColumn("score", F.round(F.col("score") * F.when(related, boost).otherwise(1.0), 6)).orderBy(F.desc("score"), "id")


def relative_time(ts: Column, now: Column) -> Column:
    """Just now, minutes, hours or days ago, or the date."""
    s = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(F.floor(s / 60), "m")).when(s < 86_400, ago(F.floor(s / 3600), "h")).when(s < 604_800, ago(F.floor(s / 86_400), "d")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
