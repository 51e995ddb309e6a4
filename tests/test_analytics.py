"""Conversations, tags, snapshots, tasks, clusters and streams on small examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarn.operators import clusters, conversations, repositories, snapshots, tagging
from tarn.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 12)


def test_file_hash(spark):
    import hashlib

    df = spark.createDataFrame([("abc", 1700000000)], "c string, m long")
    want = hashlib.sha256((3).to_bytes(8, "little") + b"abc" + (1700000000).to_bytes(8, "little")).hexdigest()
    assert df.select(snapshots.file_hash(F.col("c"), F.col("m")).alias("h")).first()["h"] == want


def test_diff_is_a_partition(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("e", "3")], "path string, hash string")
    assert {r["path"]: r["status"] for r in snapshots.diff(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added", "e": "added"}
    renamed = {r["path"]: (r["status"], r["old_path"]) for r in snapshots.with_renames(old, new).collect()}
    assert renamed == {"a": ("unchanged", None), "b": ("modified", None), "d": ("added", None), "e": ("renamed", "c")}
    chunks = spark.createDataFrame([(p, p + "old") for p in "abc"], "path string, t string")
    come = spark.createDataFrame([(p, p + "new") for p in "abde"], "path string, t string")
    got = {(r["path"], r["t"]) for r in snapshots.incremental(chunks, come, snapshots.with_renames(old, new)).collect()}
    assert got == {("a", "aold"), ("b", "bnew"), ("d", "dnew"), ("e", "enew")}


def test_status(spark):
    now = dt.datetime(2024, 6, 1)
    rows = [("Active", now - dt.timedelta(minutes=31), False), ("Active", now - dt.timedelta(minutes=30), False), ("Completed", now - dt.timedelta(days=91), False), ("Active", now - dt.timedelta(days=9), True)]
    df = spark.createDataFrame(rows, "s string, at timestamp, m boolean")
    got = [r["x"] for r in df.select(conversations.status_after(F.col("s"), F.col("at"), F.expr("timestamp '2024-06-01'"), F.col("m")).alias("x")).collect()]
    assert got == ["Paused", "Active", "Archived", "Active"]


def test_history_keeps_system_and_one(spark):
    rows = [(1, 0, "system", "s" * 40), (1, 1, "user", "u" * 400), (1, 2, "assistant", "a" * 4000)]
    kept = conversations.truncate_history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 50)
    assert sorted(r["turn"] for r in kept.collect()) == [0, 2]


def test_tags(spark):
    df = spark.createDataFrame([("How do I fix the borrow checker? cargo build fails in main.rs, impl Trait", 25, 1)], "t string, n long, b long")
    tags = df.select(tagging.rule_tags(tagging.Conversation(F.col("t"), F.col("t"), F.col("n"), F.col("b"))).alias("x")).first()["x"]
    assert [t["source"] for t in tags] == ["rust_keywords", "error_debugging", "rust_files", "question_title", "branched_conversation", "long_conversation"]
    s = spark.createDataFrame([(1, 0, "a", 0.5, "x"), (1, 1, "a", 0.5, "y"), (1, 2, "b", 0.3, "z")], "k long, pos long, tag string, confidence double, source string")
    best = tagging.best_per_tag(s, "k")
    assert {(r["tag"], r["source"]) for r in best.collect()} == {("a", "x"), ("b", "z")}
    assert [r["tag"] for r in tagging.top_suggestions(best, "k").collect()] == ["a"]
    assert [r["x"] for r in spark.createDataFrame([(0.85,), (0.6,), (0.5,), (0.1,)], "c double").select(tagging.level(F.col("c")).alias("x")).collect()] == ["VeryHigh", "High", "Medium", "Low"]


def test_clusters(spark):
    rows = [(i, "w", [1.0, 0.01 * i]) for i in range(4)] + [(9, "w", [0.0, 1.0])]
    points = spark.createDataFrame(rows, "id long, g string, embedding array<double>")
    found = clusters.greedy_clusters(points, "g")
    assert sorted(r["id"] for r in found.collect()) == [0, 1, 2, 3]
    assert [r["id"] for r in clusters.outliers(points, found).collect()] == [9]
    assert clusters.cohesion(found, points).first()["cohesion"] > 0.99
    assert clusters.greedy_clusters(points.where("id < 3"), "g").count() == 0


def test_tasks(spark):
    rows = [(1, "Completed", []), (2, "Pending", [1]), (3, "Pending", [1, 2]), (4, "Pending", [])]
    tasks = spark.createDataFrame(rows, "task_id long, status string, dependencies array<long>")
    assert sorted(r["task_id"] for r in repositories.ready(tasks).collect()) == [2, 4]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {r["name"]: r["depth"] for r in repositories.reachable(edges, spark.createDataFrame([("a",)], "name string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_deltas(spark):
    call = lambda i, **k: {"index": i, "id": k.get("id"), "name": k.get("name"), "arguments": k.get("arguments")}
    rows = [("s", 2, "wer", None), ("s", 0, "<think>why", None), ("s", 1, "</think>ans", None), ("s", 3, None, [call(0, id="c1", name="f", arguments='{"a"')]), ("s", 4, None, [call(0, arguments=": 1}"), call(1, id="c2", name="g", arguments="{}")])]
    df = spark.createDataFrame(rows, "stream_id string, seq long, content string, tool_calls array<struct<index:int,id:string,name:string,arguments:string>>")
    r = jobs.accumulate(df).first()
    assert (r["content"], r["thinking"]) == ("answer", "why")
    assert [(c["index"], c["id"], c["name"], c["arguments"]) for c in r["tool_calls"]] == [(0, "c1", "f", '{"a": 1}'), (1, "c2", "g", "{}")]


def test_sse(spark):
    raw = spark.createDataFrame([("data: {\"a\":1}\n\ndata: [DONE]\n: note\ndata: x",)], "value string")
    assert [r["data"] for r in jobs.sse_events(raw).collect()] == ['{"a":1}', "x"]


@pytest.fixture
def stream(spark, tmp_path):
    rows = [("f", T0, "create"), ("f", T0 + dt.timedelta(seconds=1), "modify"), ("f", T0 + dt.timedelta(seconds=10), "remove"), ("g", T0 + dt.timedelta(hours=3), "create")]
    spark.createDataFrame(rows, "path string, ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "e"))
    return spark.readStream.schema("path string, ts timestamp, kind string").parquet(str(tmp_path / "e"))


def test_debounce_stream(stream, tmp_path):
    out = jobs.to_table(jobs.debounce(stream, "path", "ts", "kind"), f"{tmp_path}/rows", f"{tmp_path}/state")
    assert sorted((r["path"], r["kind"], r["n"]) for r in out.collect()) == [("f", "modify", 2), ("f", "remove", 1)]


def test_inactivity_stream(stream, tmp_path):
    out = jobs.to_table(jobs.inactivity(stream, "path", "ts"), f"{tmp_path}/rows", f"{tmp_path}/state")
    assert ("f", "Paused") in {(r["path"], r["status"]) for r in out.collect()}
