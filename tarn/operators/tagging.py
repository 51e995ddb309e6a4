"""Tags of conversations: rules, content, titles, suggestions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import phrases
from tarn.operators.conversations import any_of, hits
from tarn.session import checkpointed

# Cut points of confidence, least confidence and most tags of suggestions.
LEVELS, LEAST, TOP, AUTO_APPLY, MOST_TAGS = ((0.8, "VeryHigh"), (0.6, "High"), (0.4, "Medium")), 0.4, 5, 0.7, 10

SUGGESTION = "struct<tag:string,confidence:double,source:string>"


def _suggest(tag: str, confidence: Column | float, source: str) -> Column:
    return F.struct(F.lit(tag).alias("tag"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), F.lit(source).alias("source"))


def content_tags(text: Column) -> Column:
    """Suggestions of a text: the share of a tag's keywords that it has, times the weight of languages or topics."""
    low = F.lower(text)
    out = []
    for source, table, weight in (("language", phrases.LANGUAGE_TAGS, phrases.LANGUAGE_WEIGHT), ("topic", phrases.TOPIC_TAGS, phrases.TOPIC_WEIGHT)):
        for tag, words in table.items():
            n = hits(low, words)
            out.append(F.when(n > 0, _suggest(tag, F.round(n / len(words) * weight, 6), source)))
    return F.array_compact(F.array(*out))


def title_tags(title: Column) -> Column:
    low = F.lower(title)
    return F.array_compact(F.array(*(F.when(any_of(low, words), _suggest(tag, phrases.TITLE_WEIGHT, "title")) for tag, words in phrases.TITLE_TAGS.items())))


def pattern_tags(project: Column, n_messages: Column, n_branches: Column) -> Column:
    by_project = F.when(project.isNotNull(), F.struct(F.lower(project).alias("tag"), F.lit(0.7).cast("double").alias("confidence"), F.lit("project_type").alias("source")))
    return F.array_compact(F.array(by_project, F.when(n_messages > 20, _suggest("long-conversation", 0.5, "message_count")), F.when(n_branches > 0, _suggest("branched", 0.6, "has_branches"))))


@dataclass(frozen=True)
class Conversation:
    """Columns that rules look at; null ones match nothing."""

    text: Column
    title: Column
    n_messages: Column
    n_branches: Column
    project: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    hours: Column = field(default_factory=lambda: F.lit(None).cast("double"))


@dataclass(frozen=True)
class Rule:
    """A tag, and what a conversation must be like for it. ``least`` and ``most`` bound numbers, both inclusive."""

    name: str
    tag: str
    confidence: float
    priority: int
    kind: str
    words: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    enabled: bool = True
    case_sensitive: bool = False
    test: Callable[[Conversation], Column] | None = None


RULES = tuple(Rule(*r) for r in phrases.TAG_RULES)


def _between(value: Column, rule: Rule) -> Column:
    low = value >= rule.least if rule.least is not None else F.lit(True)
    return low & (value <= rule.most if rule.most is not None else F.lit(True)) & value.isNotNull()


def _keyword(rule: Rule, c: Conversation) -> Column:
    return any_of(c.text, rule.words) if rule.case_sensitive else any_of(F.lower(c.text), tuple(w.lower() for w in rule.words))


# kind -> the condition on a conversation; a pattern that is no regular expression matches nothing, like an unknown kind
KINDS: dict[str, Callable[[Rule, Conversation], Column]] = {
    "keyword": _keyword,
    "regex": lambda r, c: reduce(lambda a, b: a | b, (c.text.rlike(w) for w in r.words if _pattern(w)), F.lit(False)),
    "title": lambda r, c: any_of(F.lower(c.title), tuple(w.lower() for w in r.words)),
    "extension": lambda r, c: any_of(F.lower(c.text), tuple(f".{w.lower()}" for w in r.words)),
    "project": lambda r, c: c.project.isin(*r.words),
    "messages": lambda r, c: _between(c.n_messages, r),
    "branches": lambda r, c: _between(c.n_branches, r),
    "duration": lambda r, c: _between(c.hours, r),
    "custom": lambda r, c: r.test(c) if r.test else F.lit(False),
}
# What a summary tells: numbers and the title; branches are there or not.
SUMMARY_KINDS = ("messages", "title", "branches")


def _pattern(text: str) -> bool:
    try:
        re.compile(text)
    except re.error:
        return False
    return True


def rule_matches(rule: Rule, c: Conversation, summary: bool = False) -> Column:
    known = SUMMARY_KINDS if summary else KINDS
    if not rule.enabled or rule.kind not in known:
        return F.lit(False)
    if summary and rule.kind == "branches":
        c = replace(c, n_branches=F.when(c.n_branches > 0, 1).otherwise(0))
    return F.coalesce(KINDS[rule.kind](rule, c), F.lit(False))


def rule_tags(c: Conversation, rules: Sequence[Rule] = RULES, summary: bool = False) -> Column:
    """Suggestions of all rules that match, by falling priority. Rules are columns: no join."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    return F.array_compact(F.array(*(F.when(rule_matches(r, c, summary), _suggest(r.tag, r.confidence, r.name)) for r in ordered)))


def conversation_hours(created: Column, last: Column) -> Column:
    """Whole minutes between two times, as hours."""
    return F.floor((F.unix_micros(last) - F.unix_micros(created)) / 60_000_000) / 60.0


def best_per_tag(suggestions: DataFrame, key: str) -> DataFrame:
    """Of equal tags of a key the most confident, the earlier one among equals. ``suggestions``: key, pos, tag, confidence, source."""
    order = W.partitionBy(key, "tag").orderBy(F.desc("confidence"), "pos")
    return suggestions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top_suggestions(suggestions: DataFrame, key: str, top: int = TOP, least: float = LEAST) -> DataFrame:
    """The ``top`` most confident of each key, and of those the ones of ``least`` or more."""
    order = W.partitionBy(key).orderBy(F.desc("confidence"), "tag")
    return suggestions.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= top) & (F.col("confidence") >= least))


def level(confidence: Column) -> Column:
    out = F.lit("Low")
    for cut, name in reversed(LEVELS):
        out = F.when(confidence >= cut, name).otherwise(out)
    return out


def level_score(name: Column) -> Column:
    """The score that stands for a level of confidence."""
    return reduce(lambda rest, x: F.when(name == x[0], x[1]).otherwise(rest), (("Low", 0.3), ("Medium", 0.5), ("High", 0.7), ("VeryHigh", 0.9)), F.lit(None).cast("double"))


#: Rows of one set of tags that meet as many others in a unit of work; pairs of a task.
LANE, PAIRS = 1000, 500_000


def tag_overlap(tags: DataFrame, key: str = "id", tag: str = "tag", least: float = 0.5) -> DataFrame:
    """(id, other, common, score): pairs with common tags, score = common / larger number of tags, score > least.

    Rows of one set of tags are one class. A class is entered under the prefix of its tags (rarest first) that any other
    class of such a score must share, so a tag that very many rows have makes no pairs by itself; classes that meet are
    compared, and only pairs that count are written out.
    """
    rare = tags.groupBy(tag).agg(F.count("*").alias("_df"))
    each = tags.select(F.col(key).alias("id"), F.col(tag).alias("tag")).distinct().join(rare.select(F.col(tag).alias("tag"), "_df"), "tag")
    rows = checkpointed(each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_df", "tag"))).alias("t")).select("id", F.transform("t", lambda x: x["tag"]).alias("tags")))
    classes = rows.groupBy("tags").agg(F.min("id").alias("c")).withColumn("n", F.size("tags"))
    # more than least * n of n tags are common: the first n - floor(least * n) hold one of them
    entered = classes.select("c", "tags", "n", F.explode(F.slice("tags", 1, (F.col("n") - F.floor(F.col("n") * least)).cast("int"))).alias("p"))
    a, b = entered.select("p", F.col("c").alias("ca"), F.col("tags").alias("ta")), entered.select("p", F.col("c").alias("cb"), F.col("tags").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    first = F.get(F.filter("ta", lambda x: F.array_contains("tb", x)), 0)  # a pair is the first common tag's
    met = a.join(b, "p").where((F.col("ca") <= F.col("cb")) & (F.col("p") == first)).select("ca", "cb", common.alias("common"), F.round(common / F.greatest(F.size("ta"), F.size("tb")), 6).alias("score")).where(F.col("score") > least)
    # a class is dealt to lanes: each pair of lanes is a row of its own, so a class that very many rows have is many tasks
    sized = rows.groupBy("tags").agg(F.min("id").alias("c"), F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    members = rows.join(sized, "tags").select("c", F.pmod(F.xxhash64("id"), "lanes").cast("int").alias("lane"), "id")
    held = checkpointed(members.groupBy("c", "lane").agg(F.collect_list("id").alias("ids")))
    a, b = held.select(F.col("c").alias("ca"), F.col("lane").alias("la"), F.col("ids").alias("xs"), F.size("ids").alias("na")), held.select(F.col("c").alias("cb"), F.col("lane").alias("lb"), F.col("ids").alias("ys"), F.size("ids").alias("nb"))
    tasks = checkpointed(met.join(a.drop("xs"), "ca").join(b.drop("ys"), "cb").where((F.col("ca") < F.col("cb")) | (F.col("la") <= F.col("lb"))))
    work = tasks.agg(F.sum(F.col("na").cast("long") * F.col("nb"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-work // PAIRS))
    dealt = tasks.drop("na", "nb").join(a.drop("na"), ["ca", "la"]).join(b.drop("nb"), ["cb", "lb"]).repartition(parts, "ca", "la", "cb", "lb")
    alone = (F.col("ca") == F.col("cb")) & (F.col("la") == F.col("lb"))
    pairs = dealt.withColumn("x", F.explode("xs")).withColumn("y", F.explode("ys")).where(~alone | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("other"), F.col("common").cast("long").alias("common"), "score")


def suggestion_statistics(actions: DataFrame) -> DataFrame:
    """(source, n, accepted, rejected, rate) of suggestions by source. ``actions``: source, action."""
    return actions.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "accepted").alias("accepted"), F.count_if(F.col("action") == "rejected").alias("rejected")).withColumn("rate", F.round(F.col("accepted") / F.col("n"), 6))


def corpus_tags(vector: Column, corpus: dict[str, list[float]], least: float = LEAST) -> Column:
    """Suggestions of a vector: tags of a small corpus whose vectors are similar to it."""
    from tarn.functions.vectors import cosine, literal

    scores = [(tag, F.round(cosine(vector, literal(v)), 6)) for tag, v in sorted(corpus.items())]
    return F.array_compact(F.array(*(F.when(s >= least, _suggest(tag, s, "embedding")) for tag, s in scores)))
