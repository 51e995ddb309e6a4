"""Stored indices and commits: equal to what is not stored, reading no more than they must, whole or not at all."""

import random
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import neighbours, search, tokens
from tarn.sources import clustered, commits, inverted, store


def texts(seed, n, words=300):
    rng = random.Random(seed)
    return [" ".join(f"w{min(int(rng.expovariate(0.02)), words)}" for _ in range(rng.choice([3, 20, 80, 400]))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def unstored(docs, query, k):
    terms = [r["term"] for r in query.collect()]
    post = tokens.postings(docs, "id", F.col("text"), only=terms)
    return [tuple(r) for r in search.topk(search.sparse_scores(post, query, "id", total=docs.count()), k).collect()]


def buckets_of(df):
    return {r[0].split("bucket=")[1].split("/")[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_index_equals_search_without_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "GROUP", 20)
    monkeypatch.setattr(inverted, "FIRST_GROUPS", 2)
    index = inverted.InvertedIndex(spark, str(tmp_path / "i"), 16)
    query = tokens.query_terms(spark, "w0 w7 w7 w150 unknown")
    assert index.total() == 0 and index.topk(query, 5).collect() == [] and index.postings(["w0"]).collect() == []
    held = dict(enumerate(texts(1, 300)))
    held[300] = ""
    put = lambda rows: index.upsert(tokens.postings(frame(spark, rows), "id", F.col("text")), frame(spark, rows))
    put(list(held.items()))
    changes = {i: t for i, t in zip(range(250, 350), texts(2, 100))}
    put(list(changes.items()))
    held |= changes
    index.delete(frame(spark, [(i, "") for i in range(0, 400, 7)]))
    held = {i: t for i, t in held.items() if i % 7}
    docs = frame(spark, list(held.items()))
    for compacted in (False, True):
        if compacted:
            index.compact()
            assert len(index.vacuum()) == 3
        got, seen = index._topk(query, 10)
        assert [tuple(r) for r in got.collect()] == unstored(docs, query, 10)
        assert seen["scored"] < seen["groups"]  # blocks that cannot reach the best are left out
        assert index.total() == len(held)
        terms = [f"w{i}" for i in range(0, 300, 11)]
        want = {r["term"]: r["df"] for r in tokens.document_frequency(tokens.postings(docs, "id", F.col("text"))).collect()}
        assert {r["term"]: r["df"] for r in index.frequencies(terms).collect()} == {t: want[t] for t in terms if t in want}
        asked = spark.createDataFrame([(t,) for t in ("w0", "w7")], "t string").select(index._bucket(F.col("t")))
        assert buckets_of(index.blocks(["w0", "w7"])) <= {str(r["bucket"]) for r in asked.collect()}
        plan = index.blocks(["w0", "w7"])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("bucket#", "bucket")
    everything = index.topk(query, 10_000).collect()
    assert [tuple(r) for r in everything] == unstored(docs, query, 10_000)


def test_index_after_a_failed_writer(spark, tmp_path):
    """What a writer that died has left is not read; two writers cannot both make the next version."""
    path = str(tmp_path / "i")
    index = inverted.InvertedIndex(spark, path, 4)
    index.upsert(tokens.postings(frame(spark, [(1, "a b"), (2, "b")]), "id", F.col("text")))
    (tmp_path / "i" / "segment-left").mkdir()
    (tmp_path / "i" / "_versions" / "draft-x").write_text("{")
    assert index.total() == 2 and index.log.versions() == [1]
    with pytest.raises(commits.Conflict):
        index.log.commit(0, {})
    assert index.vacuum() == ["segment-left"] and index.frequencies(["b"]).first()["df"] == 2
    index.delete(frame(spark, [(9, "")]))
    index.delete(frame(spark, [(1, ""), (2, "")]))
    assert index.total() == 0 and index.frequencies(["b"]).collect() == [] and index.topk(tokens.query_terms(spark, "b"), 3).collect() == []


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v] if v is not None else None) for i, v in enumerate(x)], "id long, embedding array<double>")


def groups(n, dim, each, spread, seed=1):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=(n, dim)), each, axis=0) + spread * rng.normal(size=(n * each, dim))


def test_lists_have_recall_and_an_exact_mode(spark, tmp_path):
    x = [*groups(30, 24, 40, 0.4), None, np.zeros(24), np.full(24, np.nan)]
    points = vectors(spark, x)
    index = clustered.ClusteredVectors(spark, str(tmp_path / "v"))
    index.build(points.where("id < 1000"), 32)
    index.add(points.where("id >= 1000"))
    assert index.rows().count() == len(x) - 1
    probes = index.calibrate(10)
    recall = []
    for i in range(3, 1200, 100):
        want = search.dense_topk(points.where("embedding is not null and not isnan(embedding[0])"), x[i], 10).collect()
        reached = index.reached(x[i], 10)
        assert index.search_exactly(x[i], 10).collect() == want and len(reached) < 32
        found = {r["id"] for r in index.search(x[i], 10).collect()}
        recall.append(len(found & {r["id"] for r in want}) / 10)
        read = {int(r[0].split("list=")[1].split("/")[0]) for r in index.rows(reached).select(F.input_file_name()).distinct().collect()}
        assert read <= {-1, *reached}
    assert np.mean(recall) >= 0.9 and probes < 32


@pytest.mark.parametrize("tile", [neighbours.TILE, 37])
def test_neighbours_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    x = groups(20, 16, 20, 0.2)
    x = np.vstack([x, x[:5], np.random.default_rng(2).normal(size=(40, 16))])
    points = vectors(spark, [*x, None, np.zeros(16)])
    best, share = neighbours.nearest_neighbours(points, 6, lists=60)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -9)
    want = {(i, int(j), float(s[i, j]), k + 1) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:6])}
    got = {tuple(r) for r in best.select("id", "other", "score", "rank").collect()}
    assert {(a, b, r) for a, b, _, r in got} == {(a, b, r) for a, b, _, r in want} and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got), sorted(want)))
    assert share < 0.5
    few, _ = neighbours.nearest_neighbours(vectors(spark, x[:3]), 6)
    assert few.count() == 6
    assert neighbours.nearest_neighbours(vectors(spark, [None]), 6)[0].count() == 0


def test_neighbours_copy_rows_once_a_tile(spark, monkeypatch):
    """Where no list can be left out, a row goes to as many places as there are tiles, not lists; copies tie by id."""
    x = np.random.default_rng(7).normal(size=(600, 24))
    x[100:200] = x[100]
    held = neighbours.Lists(neighbours.fitted(vectors(spark, x), 60), np.zeros(60), np.full(60, 2.0), np.full(60, 10))
    shelf = neighbours.shelved(held, 100)
    assert np.bincount(shelf).tolist() == [10] * 6 and neighbours.shelved(held, 5).max() == 59
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:6]}
    monkeypatch.setattr(neighbours, "TILE", 200)
    assert {(r["id"], r["other"]) for r in neighbours.nearest_neighbours(vectors(spark, x), 6, lists=60)[0].collect()} == want


@pytest.mark.parametrize("least", [-np.inf, 0.5])
def test_neighbours_hold_a_bounded_product(least):
    """The memory of a comparison does not grow with the tile."""
    x = np.random.default_rng(3).normal(size=(neighbours.TILE, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    tracemalloc.start()
    out = [np.concatenate(c) for c in neighbours._tops(ids[:512], x[:512], ids, x, 5, np.full(512, least))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20 and len(out[0]) == 5 * 512
    s = np.round(x[:3] @ x.T, 6)
    s[range(3), range(3)] = -9
    assert out[1][:15].tolist() == [int(j) for r in s for j in np.lexsort((ids, -r))[:5]]


def test_products_in_parts_equal_the_whole(monkeypatch):
    x = np.vstack([groups(6, 12, 20, 0.2), np.eye(12)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, centroids = np.arange(len(x)), x[::9]
    least = np.where(ids % 3 == 0, 0.9, -np.inf)
    run = lambda: [*map(np.concatenate, neighbours._tops(ids, x, ids, x, 4, least)), *neighbours.nearest_centroids(x, centroids)]
    whole = run()
    monkeypatch.setattr(neighbours, "CELLS", 300)
    assert len(list(neighbours.parts(len(x), len(ids)))) > 50 and [(p.start, p.stop) for p in neighbours.parts(5, 150)] == [(0, 2), (2, 4), (4, 5)]
    for a, b in zip(run(), whole):
        assert np.allclose(a, b, atol=2e-6)


POINTS = "id string, repo string, branch string, file_path string, language string, dense array<double>"


def test_store_commits_whole_versions(spark, tmp_path, monkeypatch):
    kept = store.VectorStore(spark, str(tmp_path / "s"), 2)
    points = lambda *rows: spark.createDataFrame([(*r, "go", [1.0, 0.0]) for r in rows], POINTS)
    kept.upsert(points(("a", "1", "feature/x", "p"), ("b", "1", "main", "p")))
    reader = kept.points()
    before = sorted(map(tuple, reader.select("id", "repo", "branch").collect()))
    assert before == [("a", "1", "feature/x"), ("b", "1", "main")]  # names stay strings

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "commit", dies)
        with pytest.raises(RuntimeError):
            kept.upsert(points(("a", "1", "main", "moved")))
    assert sorted(map(tuple, kept.points().select("id", "repo", "branch").collect())) == before
    kept.upsert(points(("a", "1", "main", "moved")))
    assert sorted(map(tuple, kept.points().select("id", "branch").collect())) == [("a", "main"), ("b", "main")]
    assert sorted(map(tuple, reader.select("id", "repo", "branch").collect())) == before  # who has begun to read goes on
    assert len(kept.vacuum()) == 2 and kept.count() == 2
    kept.delete_branch("1", "main")
    assert kept.count() == 0 and kept.exists() and kept.points().columns == POINTS.replace(" string", "").replace(" array<double>", "").split(", ")
    assert not store.VectorStore(spark, str(tmp_path / "s"), 3).ensure() and not kept.exists()


def test_payload_filter_skips_row_groups(spark, tmp_path):
    rows = [(str(i), "r", "main", f"path/{i % 500}/{'x' * 50}", "go", [float(i), 0.0]) for i in range(20_000)]
    kept = store.VectorStore(spark, str(tmp_path / "s"), 2, row_group=16_384)
    kept.upsert(spark.createDataFrame(rows, POINTS).coalesce(1))

    def read(df):
        """Rows that the scan hands on: row groups that are left out give none."""
        df.write.format("noop").mode("overwrite").save()
        rows_, plan = [], df._jdf.queryExecution().executedPlan()
        df.collect()
        stack = [plan]
        while stack:
            p = stack.pop()
            if p.nodeName().startswith("Scan parquet"):
                rows_.append(p.metrics().apply("numOutputRows").value())
            stack += [p.children().apply(i) for i in range(p.children().size())]
            if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                stack.append(p.executedPlan())
        return sum(rows_)

    path = f"path/77/{'x' * 50}"
    found = kept.points().where(F.col("file_path") == path)
    assert found.count() == 40
    assert 40 <= read(found) < 20_000 / 4
    missing = kept.points().where(F.col("file_path") == f"path/77/{'x' * 49}y")  # within the range of a group's paths
    assert missing.count() == 0 and read(missing) < 2_000


def test_leftovers_do_not_stay(spark):
    from tarn.session import folder, shared_folder

    with folder(spark, "test") as path:
        spark.range(3).write.parquet(f"{path}/x")
        assert Path(path).exists()
    assert not Path(path).exists() and path.startswith(shared_folder(spark))


def test_collection_of_both_sides(spark, tmp_path):
    from tarn.sources.collection import Collection

    rows = [(i, "r", "main", f"f{i}.rs", "go", t, [float(i % 5), 1.0]) for i, t in enumerate(texts(5, 60, 40))] + [(60, "r", "main", "e", "go", None, [0.0, 1.0])]
    points = spark.createDataFrame(rows, "id long, repo string, branch string, file_path string, language string, text string, dense array<double>")
    kept = Collection(spark, str(tmp_path / "c"), 2, 8)
    kept.upsert(points)
    kept.upsert(points.where("id < 20").withColumn("text", F.concat("text", F.lit(" fresh w3"))))
    kept.delete(F.col("id") % 7 == 0)
    held = points.withColumn("text", F.when(F.col("id") < 20, F.concat("text", F.lit(" fresh w3"))).otherwise(F.coalesce("text", F.lit("")))).where("id % 7 <> 0")
    for where in (None, F.col("id") > 9):
        some = held if where is None else held.where(where)
        post = tokens.postings(some, "id", F.col("text"))
        want = search.hybrid_search(some, post, "fresh w3 w5", [1.0, 1.0], vector_col="dense", total=some.count())
        assert kept.search("fresh w3 w5", [1.0, 1.0], where=where).collect() == want.collect()
    kept.compact()
    assert kept.count() == held.count() == kept.index.total()


def test_index_of_texts_counts_by_rows(spark, tmp_path):
    """Terms of a text are counted without a shuffle, as ``postings`` counts them; rows of one id are one document."""
    odd = ["", None, "'a' 'Ab '' \"x Y\" \"open", "/ // c\nd /* e */ f F f", "a/b//C 'D\n1.5.x ٣.٤ é😀Z_9 Z_9", "'", "w7 w7 W7"]
    docs = frame(spark, list(enumerate([*odd, *texts(3, 60)])))
    made = tokens.counted(docs, "id", F.col("text"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = sorted((r["id"], r["term"], r["tf"]) for r in tokens.postings(docs, "id", F.col("text")).collect())
    rows = made.collect()
    assert sorted((r["id"], t["term"], t["tf"]) for r in rows for t in r["terms"]) == want
    assert all(r["length"] == sum(t["tf"] for t in r["terms"]) for r in rows) and len(rows) == docs.count()
    shared = docs.unionByName(frame(spark, [(3, "w7 f"), (3, None), (200, "w7"), (None, "w7")]))
    index = inverted.build(spark, str(tmp_path / "i"), shared, "id", F.col("text"), buckets=4)
    assert index.total() == docs.count() + 1
    post = tokens.postings(shared.where("id is not null"), "id", F.col("text"))
    assert sorted(map(tuple, index.live_postings().select("id", "term", "tf").collect())) == sorted(map(tuple, post.select("id", "term", "tf").collect()))
    terms = ["w7", "f", "w0"]
    assert {r["term"]: r["df"] for r in index.frequencies(terms).collect()} == {r["term"]: r["df"] for r in tokens.document_frequency(post).where(F.col("term").isin(*terms)).collect()}
