"""Operator 3: a quality classifier that combines a document's own evidence with that of its site.

Two logistic models (quality, toxicity) over words, word beginnings and graded shape features (capitals, odd endings,
repetition, tables, length) are fitted on a sample of labelled documents bounded by ``TRAINING``; their features are
those whose likelihood ratio statistic on the sample is high. A document's evidence is the model's log odds less those
of the sample's base rate.

Sites are hosts and paths below them (here: ``source`` and ``lang``). All documents, labelled or not (then with the
model's probability), are counted by grouped aggregation. Rates are shrunk by empirical Bayes: a path's towards its
host's, a host's towards the global one, with prior strengths from the method of moments, so a sparse site says little.
Each document is left out of its own site. Posterior log odds = evidence + log odds of the site.

Cases: null and empty texts have the one feature ``empty``; a null host or path is the same site as an empty one; conflicting
labels of a document are averaged, a null label counts for nothing; without labels of both values a model has no say and
its probability is the one that keeps. Decisions are made for rows, known by id, text, host and path: rows that share an
id, or have none, each get their own. Extra columns are kept by ``apply_decisions``.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import beside, checkpointed, documents, map_batches, text_hashes, with_hashes

#: Labelled documents (rows) that the models are fitted on: those of least hash.
TRAINING = 20_000
#: Sample documents that must have a feature, and the statistic (one degree of freedom) that it must reach.
LEAST_DOCS, LEAST_G = 3, 20.0
RIDGE = 1.0
#: Paths of sites up to this number are broadcast.
FEW_SITES = 100_000
#: A document goes below this probability of quality, or above this one of toxicity.
GOOD, TOXIC = 0.5, 0.3
MARKS = "".join(c for c in string.punctuation)
STEPS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
TARGETS = ("quality", "toxic")


def features(text: str | None) -> set[str]:
    """The features of a text."""
    words = text.split() if text else []
    if not words:
        return {"empty"}
    distinct = set(words)
    n = len(distinct)
    plain = {w.strip(MARKS).lower() for w in distinct}
    plain.discard("")
    out = {"w:" + w for w in plain}
    for start, count in Counter([w[:5] for w in plain if len(w) > 5]).items():
        out.update(f"p:{start}:{k}" for k in range(1, min(count, 4) + 1))
    lines = text.split("\n")
    size = int(math.log2(len(words)))
    shares = {
        "caps": sum(map(str.isupper, distinct)) / n,
        "odd": sum(not w[-1].isalnum() and w[-1] not in ".,;:?)\"'" for w in distinct) / n,
        "pipe": words.count("|") / len(words),
        "rep": 1 - n / len(words),
        f"rep{size}": 1 - n / len(words),
        "line": 1 - len(set(lines)) / len(lines),
    }
    out.update(f"{name}>{step}" for name, share in shares.items() for step in STEPS if share >= step)
    mean = sum(map(len, distinct)) / n
    out.update(f"avg>{step}" for step in (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16) if mean >= step)
    out.update(f"len>{step}" for step in range(1, size + 1))
    return out


def sample_of(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """text, quality, toxic (0/1, null where unknown) of at most ``bound`` labelled documents.

    Rows are bounded, not ids: of all rows that have one of ``bound`` labelled ids, those of least hash; equal rows are one.
    """
    own = ["doc_id", "h1", "h2"]
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # both sides of these joins that are broadcast are bounded by a parameter
    labelled = with_hashes(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")
    rows = labelled.select(*own).distinct().orderBy(F.xxhash64(*own), *own).limit(bound)
    of_row = [F.first(c).alias(c) for c in ("text", *TARGETS)]
    return checkpointed(labelled.join(F.broadcast(rows), own).groupBy(*own).agg(*of_row).drop(*own))


def clean_labels(labels: DataFrame) -> DataFrame:
    """One row per labelled id, values averaged."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.avg(t).alias(t) for t in TARGETS))


def counted(sample: DataFrame) -> DataFrame:
    """feature, and for each target how many documents of either value have it."""
    columns = [f"{t}_{v}" for t in TARGETS for v in "01"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, *values in zip(*(batch.column(c).to_pylist() for c in ("text", *TARGETS))):
                hit = [2 * k + (v >= 0.5) for k, v in enumerate(values) if v is not None]
                for f in features(text):
                    row = counts.setdefault(f, [0] * 4)
                    for h in hit:
                        row[h] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4))], ["feature", *columns])

    raw = sample.mapInArrow(run, "feature string, " + ", ".join(f"{c} long" for c in columns))
    return raw.groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))


def statistic(p: Column, a: Column, q: Column, b: Column) -> Column:
    """Likelihood ratio statistic of p of a against q of b."""

    def ll(k: Column, m: Column) -> Column:
        term = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
        return term(k) + term(m - k)

    return 2 * (ll(p, a) + ll(q, b) - ll(p + q, a + b))


def fit(at: np.ndarray, columns: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic model, by accelerated scaled gradients; row ``at[i]`` has feature ``columns[i]``."""
    scale = np.bincount(columns, minlength=n) * 4.0 + RIDGE
    weights = look = np.zeros(n)
    bias = look_bias = math.log(y.sum() / (len(y) - y.sum()))
    t = 1.0
    for step in range(400):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(at, look[columns], minlength=len(y)) + look_bias, -40, 40))) - y
        new = look - (np.bincount(columns, error[at], minlength=n) + RIDGE * look) / scale / 2
        new_bias = look_bias - error.sum() / (2 * len(y))
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / after * (new - weights), new_bias + (t - 1) / after * (new_bias - bias)
        weights, bias, t = new, new_bias, after if step % 50 != 49 else 1.0
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING) -> dict[str, tuple[dict[str, float], float, float]]:
    """For each target its weights, intercept and base log odds; no entry where the labels do not tell."""
    sample = sample_of(docs, labels, bound)
    totals = sample.agg(*(F.count_if((F.col(t) >= 0.5) == F.lit(bool(v))).alias(f"{t}_{v}") for t in TARGETS for v in (0, 1))).first()
    counts = checkpointed(counted(sample))
    models = {}
    for t in TARGETS:
        negatives, positives = totals[f"{t}_0"], totals[f"{t}_1"]
        if not negatives or not positives:
            continue
        p, q = F.col(f"{t}_1"), F.col(f"{t}_0")
        good = counts.where((p + q >= LEAST_DOCS) & (statistic(p, F.lit(float(positives)), q, F.lit(float(negatives))) >= LEAST_G))
        index = {r["feature"]: i for i, r in enumerate(good.select("feature").orderBy("feature").collect())}  # of the sample alone

        def numbered(batch: pa.RecordBatch, index: dict[str, int] = index) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("y"), pa.array([sorted(index[f] for f in features(x) if f in index) for x in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["y", "f"])

        rows = map_batches(sample.where(F.col(t).isNotNull()).select("text", (F.col(t) >= 0.5).cast("double").alias("y")), numbered, "y double, f array<int>").toArrow()  # as numbers, not as objects
        found = rows.column("f").combine_chunks()
        at = np.repeat(np.arange(rows.num_rows, dtype=np.int32), np.asarray(pc.list_value_length(found)))
        weights, bias = fit(at, np.asarray(found.flatten()), np.asarray(rows.column("y")), len(index))
        models[t] = ({f: float(weights[i]) for f, i in index.items()}, bias, math.log(positives / negatives))
    return models


def evidence(docs: DataFrame, models: dict, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and, for each target, a document's log odds relative to the base rate."""
    known = {f for w, _, _ in models.values() for f in w}

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(x) & known for x in batch.column("text").to_pylist()]
        out = []
        for t in TARGETS:
            weights, bias, base = models.get(t, ({}, 0.0, 0.0))
            out.append(pa.array([bias - base + sum(sorted(weights[f] for f in x if f in weights)) for x in found], pa.float64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out], [*columns, *(f"{t}_evidence" for t in TARGETS)])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), *(f"{t}_evidence double" for t in TARGETS)])
    return map_batches(docs.select(*columns, "text"), kernel, schema)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, value: str, weight: str, prior: Column) -> float:
    """Prior weight of groups' rates by the method of moments: mean (1 - mean) / variance between groups - 1."""
    n, rate = F.col(weight), F.col(value) / F.col(weight)
    r = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"), F.sum(n * (rate - prior) ** 2).alias("s"), (F.sum(n * prior * (1 - prior)) / F.sum(n)).alias("v")).first()
    if not r["n"] or r["k"] < 2 or not r["v"]:
        return 1e4
    between = (r["s"] - (r["k"] - 1) * r["v"]) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return min(max(r["v"] / between - 1, 1.0), 1e4) if between > 0 else 1e4


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", bound: int = TRAINING) -> DataFrame:
    """doc_id, h1, h2 (hashes of text, host and path), p_quality, p_toxic, kept."""
    labels = clean_labels(labels)
    h1, h2 = text_hashes(*row_parts(host, path))
    docs = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text", F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path"))
    models = train(docs, labels, bound)
    own = evidence(docs, models, ["doc_id", "h1", "h2", "host", "path"]).join(labels, "doc_id", "left")
    value = lambda t: F.coalesce(F.col(t).cast("double"), 1 / (1 + F.exp(-(F.col(f"{t}_evidence") + F.lit(models[t][2] if t in models else 0.0)))))
    own = checkpointed(own.select("doc_id", "h1", "h2", "host", "path", *(f"{t}_evidence" for t in TARGETS), *(value(t).alias(f"{t}_y") for t in TARGETS)))
    sums = lambda *by: own.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(f"{t}_y").alias(f"{t}_s") for t in TARGETS))
    paths = checkpointed(sums("host", "path"))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"{t}_s").alias(f"{t}_s") for t in TARGETS)))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"{t}_s").alias(f"{t}_s") for t in TARGETS)).first()
    few = F.broadcast if paths.count() <= FEW_SITES else lambda df: df  # more sites are joined by a shuffle, which AQE splits where one is hot
    scored = own.join(few(hosts.select("host", F.col("n").alias("hn"), *(F.col(f"{t}_s").alias(f"{t}_hs") for t in TARGETS))), "host")
    scored = scored.join(few(paths.select("host", "path", F.col("n").alias("pn"), *(F.col(f"{t}_s").alias(f"{t}_ps") for t in TARGETS))), ["host", "path"])
    both = paths.join(hosts.select("host", F.col("n").alias("hn"), *(F.col(f"{t}_s").alias(f"{t}_hs") for t in TARGETS)), "host")
    for t in TARGETS:
        if t not in models:
            scored = scored.withColumn(f"p_{t}", F.lit(1.0 if t == "quality" else 0.0))
            continue
        mean = total[f"{t}_s"] / total["n"]
        s_host = strength(hosts, f"{t}_s", "n", F.lit(mean))
        s_path = strength(both, f"{t}_s", "n", F.col(f"{t}_hs") / F.col("hn"))
        y = F.col(f"{t}_y")
        at_host = (s_host * mean + F.col(f"{t}_hs") - y) / (s_host + F.col("hn") - 1)
        at_path = (s_path * at_host + F.col(f"{t}_ps") - y) / (s_path + F.col("pn") - 1)
        scored = scored.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(f"{t}_evidence") + logit(at_path)))))
    return scored.select("doc_id", "h1", "h2", "p_quality", "p_toxic", ((F.col("p_quality") >= GOOD) & (F.col("p_toxic") <= TOXIC)).alias("kept"))


def row_parts(host: str, path: str) -> list[Column]:
    """What decides about a row besides its id; a null text counts as an empty one."""
    return [F.coalesce(F.col(c), F.lit("")) for c in ("text", host, path)]


def apply_decisions(docs: DataFrame, decisions: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    gone = decisions.where("not kept").select("doc_id", "h1", "h2").distinct()
    return beside(docs, gone, "left_anti", *row_parts(host, path)).select("_doc.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(documents(spark, sf_dir), labels)
    return scored.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), "kept")
