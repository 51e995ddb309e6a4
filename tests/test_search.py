"""Tokens, vectors, fusion, stores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import vectors as V
from tarn.operators import search, tagging, tokens
from tarn.sources import files, store


def test_tokens(spark):
    code = "fn main() { let Mutex = 1; } // Example with Cap Keyword"
    got = spark.createDataFrame([(code,)], "c string").select(tokens.tokens(F.col("c")).alias("t")).first()["t"]
    assert [(t["text"], t["kind"]) for t in got[:7]] == [("fn", "Identifier"), ("main", "Identifier"), ("(", "Symbol"), (")", "Symbol"), ("{", "Symbol"), ("let", "Identifier"), ("mutex", "Identifier")]
    assert (got[-1]["text"], got[-1]["kind"]) == ("// Example with Cap Keyword", "Comment")
    odd = spark.createDataFrame([("für \"a b\" 'x' 1.5 ::",)], "c string").select(tokens.tokens(F.col("c")).alias("t")).first()["t"]
    assert [t["text"] for t in odd] == ["f", "ü", "r", '"a b"', "'x'", "1.5", "::"]
    wide = spark.createDataFrame([("a\u00a0b\u3000\u0664\u0665.\u0666\x85c\u200b",)], "c string").select(tokens.tokens(F.col("c"), keep_whitespace=True).alias("t")).first()["t"]
    assert [(t["text"], t["kind"]) for t in wide] == [("a", "Identifier"), ("\u00a0", "Whitespace"), ("b", "Identifier"), ("\u3000", "Whitespace"), ("\u0664\u0665.\u0666", "Literal"), ("\x85", "Whitespace"), ("c", "Identifier"), ("\u200b", "Unknown")]
    long = '"' + "x" * 50_000 + '" /* ' + "y" * 50_000 + " */"
    assert len(spark.createDataFrame([(long,)], "c string").select(tokens.tokens(F.col("c")).alias("t")).first()["t"]) == 2


def test_vocabulary(spark):
    terms = spark.createDataFrame([("hello",), ("world",), ("hello",), ("a",), ("ab",)], "term string")
    assert {r["term"]: r["term_id"] for r in tokens.vocabulary(terms).collect()} == {"a": 0, "ab": 1, "hello": 2, "world": 3}
    many = [f"common{i}" for i in range(3000)]
    got = tokens.vocabulary(spark.createDataFrame([(t,) for t in many], "term string"), range_terms=100).collect()
    assert {r["term"]: r["term_id"] for r in got} == {t: i for i, t in enumerate(sorted(many))}


@pytest.mark.parametrize(("a", "b", "cos", "l2", "l1"), [([1.0, 0.0], [0.0, 1.0], 0.0, math.sqrt(2), 2.0), ([1.0, 1.0], [2.0, 2.0], 1.0, math.sqrt(2), 2.0), ([0.0, 0.0], [1.0, 1.0], 0.0, math.sqrt(2), 2.0)])
def test_metrics(spark, a, b, cos, l2, l1):
    r = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.euclidean(F.col("a"), F.col("b")).alias("e"), V.manhattan(F.col("a"), F.col("b")).alias("m")).first()
    assert r["c"] == pytest.approx(cos) and r["e"] == pytest.approx(l2) and r["m"] == pytest.approx(l1)


def test_pooling_and_hash_embedding(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], "some text")], "v array<array<double>>, m array<int>, t string")
    r = df.select(V.mean_pool(F.col("v"), F.col("m")).alias("p"), V.hash_embedding(F.col("t")).alias("h")).first()
    assert r["p"] == pytest.approx([2 / math.sqrt(8), 2 / math.sqrt(8)])
    assert len(r["h"]) == 384 and math.sqrt(sum(x * x for x in r["h"])) == pytest.approx(1)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    b = spark.createDataFrame([(2, 7.0), (3, 1.0)], "id long, score double")
    got = {r["id"]: r["score"] for r in search.fuse_rrf([a, b]).collect()}
    assert got == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6), 3: round(1 / 62, 6)}
    flat = {r["id"]: r["score"] for r in search.fuse_dbsf([a.where("id = 1"), b]).collect()}
    assert flat[1] == 0.5 and flat[2] > flat[3]


def test_dedup_is_idempotent(spark):
    hits = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.9), (3, "a", 0.9), (4, "b", 0.1)], "id long, k string, score double")
    once = search.dedup_keep_max(hits, ["k"])
    assert sorted(r["id"] for r in once.collect()) == [2, 4]
    assert sorted(r["id"] for r in search.dedup_keep_max(once, ["k"]).collect()) == [2, 4]


def test_plans_stay_narrow(spark, sf_dir):
    """A dense top-k is one pass without a shuffle of the table; only needed columns are read."""
    df = search.dense_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), [0.1] * 64, 5, "cosine", "vec_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "label" not in plan


def test_sparse_search_reads_documents_once(spark, sf_dir):
    """The score and the document frequency share one scan, and only the query's terms are shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = tokens.query_terms(spark, "the tion der")
    terms = [r["term"] for r in asked.collect()]
    post = tokens.postings(docs, "doc_id", F.col("text"), only=terms)
    df = search.topk(search.sparse_scores(post, asked, "doc_id", total=200), 20)
    assert df.count() == 20
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    assert plan.index("INSET" if "INSET" in plan else " IN (") > 0


def test_similar_items_equals_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 8))
    x[50:60] = x[5]
    points = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {}
    for r in search.similar_items(points, 4, F.col("id") % 3 == 0, block=7, tile=11).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"], r["score"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    for i in range(0, 90, 3):
        want = sorted((j for j in range(90) if j != i), key=lambda j: (-scores[i, j], j))[:4]
        assert [got[i][k + 1][0] for k in range(4)] == want


def test_similar_pairs_and_overlaps(spark, sf_dir):
    import random

    from tarn.operators import clusters, tagging

    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    points = spark.createDataFrame(rows, "id long, g long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in clusters.similar_pairs(points, "g", 0.5, tile=7).collect()}
    cos = lambda a, b: sum(p * q for p, q in zip(a, b)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))
    assert got == {(i, j) for i, g, v in rows for j, h, w in rows if i < j and g == h and cos(v, w) >= 0.5}
    tags = [(i, t) for i in range(50) for t in {"all", *(f"t{rng.randrange(6)}" for _ in range(rng.randrange(4)))}]
    of = {}
    for i, t in tags:
        of.setdefault(i, set()).add(t)
    for least in (0.3, 0.5, 0.7):
        pairs = {(r["id"], r["other"], r["common"], r["score"]) for r in tagging.tag_overlap(spark.createDataFrame(tags, "id long, tag string"), least=least).collect()}
        want = {(i, j, len(of[i] & of[j]), round(len(of[i] & of[j]) / max(len(of[i]), len(of[j])), 6)) for i in of for j in of if i < j}
        assert pairs == {p for p in want if p[3] > least}


def test_store(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path / "c"), 2)
    points = lambda *rows: spark.createDataFrame(list(rows), "id string, repo string, branch string, file_path string, dense array<double>")
    assert not s.exists() and not s.ensure()
    s.upsert(points(("a", "r", "main", "x", [1.0, 0.0]), ("b", "r", "dev", "y", [0.0, 1.0])))
    s.upsert(points(("a", "r", "main", "x2", [0.6, 0.8]), ("c", "r", "main", "z", [1.0, 1.0])))
    assert s.count() == 3 and s.ensure()
    assert {r["id"]: r["file_path"] for r in s.points().collect()} == {"a": "x2", "b": "y", "c": "z"}
    assert [r["id"] for r in s.search([0.0, 1.0], 2).collect()] == ["b", "a"]
    s.delete_files("r", "main", ["z"])
    assert s.count() == 2
    s.delete_branch("r", "dev")
    assert [r["id"] for r in s.scroll().collect()] == ["a"]
    for bad in (("d", "r", "main", "x", [1.0]), ("d", "r", "main", "x", None), (None, "r", "main", "x", [1.0, 1.0])):
        with pytest.raises(ValueError):
            s.upsert(points(bad))
    s.upsert(points(("e", "r", "main", "p", [1.0, 0.0]), ("e", "r", "main", "q", [0.0, 1.0])))  # one id twice
    s.upsert(points(("a", "r", "other", "moved", [1.0, 0.0])))  # to another branch
    assert sorted((r["id"], r["branch"]) for r in s.points().collect()) == [("a", "other"), ("e", "main")]
    empty = store.VectorStore(spark, str(tmp_path / "n"), 2)
    empty.create("id string, repo string, branch string, file_path string, dense array<double>")
    assert empty.count() == 0
    assert store.collections(spark, str(tmp_path)) == ["c", "n"]


def test_folder(spark, tmp_path):
    for name in ("src/main.rs", "src/lib.py", ".git/x.rs", "target/y.rs", "README.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text of {name}\n")
    got = files.folder(spark, str(tmp_path))
    assert {(r["file_path"], r["language"]) for r in got.collect()} == {("src/main.rs", "rust"), ("src/lib.py", "python"), ("README.md", "markdown")}
    assert got.where("file_path = 'README.md'").first()["text"] == "text of README.md\n"
    assert files.folder(spark, str(tmp_path), ["RS"]).count() == 1
    assert [r["file_path"] for r in files.matching(got, "*.md").collect()] == ["README.md"]


def test_vocabulary_json(spark):
    v = spark.createDataFrame([("b", 1), ("a", 0)], "term string, term_id int")
    assert store.vocabulary_json(v) == '{"a": 0, "b": 1}'


def test_providers(spark):
    import numpy as np

    from tarn.functions import embedding

    p = embedding.HashedTokens(16, 3)
    ids, mask = p.tokenise(["One two", "one", "a b c d e"])
    assert ids.shape == (3, 3) and mask.tolist() == [[1, 1, 0], [1, 0, 0], [1, 1, 1]] and ids[0, 0] == ids[1, 0] and ids[1, 1] == 0
    v = p.embed_batch(["one two", "two ONE", "one"])
    assert np.allclose(v[0], v[1]) and np.allclose(np.linalg.norm(v, axis=1), 1)
    df = spark.createDataFrame([(1, " one two "), (2, "  "), (3, None), (4, "one")], "i long, text string")
    got = {r["i"]: r["v"] for r in df.select("i", embedding.embed(lambda: embedding.HashedTokens(16, 3))("text").alias("v")).collect()}
    assert got[2] is None and got[3] is None and np.allclose(got[1], v[0]) and np.allclose(got[4], embedding.query_vector("one", lambda: embedding.HashedTokens(16, 3)))
    with pytest.raises(ValueError):
        embedding.query_vector(" ")
    with pytest.raises(Exception, match="white space"):
        embedding.validated(df).collect()
    with pytest.raises(Exception, match="dimensions"):
        embedding.with_dimension(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2).collect()


def test_vectors_leave_some_at_a_time(spark):
    """No Arrow batch of texts is Python's lists of numbers at once."""
    import numpy as np
    import pandas as pd

    from tarn.functions import embedding

    texts = [f"word {i}" if i % 3 else " " for i in range(10)] + [None]
    parts = list(embedding.embed(lambda: embedding.HashedTokens(16), 4).func(iter([pd.Series(texts), pd.Series([], dtype=object)])))
    assert [len(p) for p in parts] == [4, 4, 3]
    got = [v for p in parts for v in p]
    assert [v is None for v in got] == [i % 3 == 0 for i in range(10)] + [True] and np.allclose(got[4], embedding.HashedTokens(16).embed_batch(["word 4"])[0])


def test_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace as N

    from tarn.session import shared_folder

    def session(master, conf=None, held=None):
        there = N(isDefined=lambda: held is not None, get=lambda: held)
        return N(sparkContext=N(master=master, getConf=lambda: N(get=lambda _: conf), _jsc=N(sc=lambda: N(getCheckpointDir=lambda: there))))

    assert shared_folder(session("spark://m", "hdfs://a")) == "hdfs://a" and shared_folder(session("yarn", None, "hdfs://b/x")) == "hdfs://b/x"
    assert shared_folder(session("local[2]")).endswith("tarn-checkpoints")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))


def test_bpe_token_counts(spark):
    pytest.importorskip("tiktoken")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tarn.operators import conversations

    rows = [("user", "hello there"), ("assistant", None), (None, "a" + " " * 1_500_000 + "b")]
    count = conversations.bpe_tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = [r["n"] for r in spark.createDataFrame(rows, "role string, content string").select(count("role", "content").alias("n")).collect()]
    assert got[0] == 4 + 1 + 2 and got[1] == 4 + 2 and got[2] > 5
    assert "".join(conversations.blank_runs("x" + " " * 2500 + "y\n")) == "x" + " " * 2500 + "y\n"


def test_page_cache(spark):
    from tarn.operators import symbols

    now = [0.0]
    cache = symbols.PageCache(most=2, seconds=10, clock=lambda: now[0])
    frame = spark.createDataFrame([(f"f{i}.rs", k) for i in range(7) for k in range(i)], "file_path string, name long")
    cache.keep("a", frame)
    assert [r["file_path"] for r in cache.page("a", 2, 3).collect()] == ["f3.rs", "f2.rs", "f1.rs"]
    now[0] = 11.0
    with pytest.raises(KeyError):
        cache.page("a", 1, 3)
    for key in "xyz":
        cache.keep(key, frame)
    assert cache.get("x") is None and cache.get("z") is frame


def test_ignored_paths(spark):
    from tarn.operators import snapshots

    paths = spark.createDataFrame([(p,) for p in ("a/.git/x", "b.log", "src/node_modules/y", "src/main.rs")], "p string")
    assert [r["x"] for r in paths.select(snapshots.ignored(F.col("p"), ["*.log", "node_modules"]).alias("x")).collect()] == [True, True, True, False]


@pytest.mark.parametrize("lane", [tagging.LANE, 4])
def test_overlaps_of_a_large_class_are_many_tasks(spark, monkeypatch, lane):
    monkeypatch.setattr(tagging, "LANE", lane)
    sets = {i: {"a", "b"} if i < 40 else {"a", "b", "c"} if i < 50 else {"d", str(i % 3)} for i in range(60)}
    tags = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, tag string")
    want = {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / max(len(sets[i]), len(sets[j])) > 0.5}
    pairs = tagging.tag_overlap(tags)
    got = [(r["id"], r["other"], r["common"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if lane == 4:
        assert max(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()) < len(want) * 2 / 3


def test_indexed_tokens_are_found_alone(spark):
    """One match for each indexed token, and the same terms as among all tokens, whatever lies between them."""
    rng = random.Random(7)
    odd = ["", " \n\t ", "a" + " " * 50_000, "'a' 'ab '\\n' '' ''' \"x\\\"Y\" \"open", "/ // c\nd /* e */ f /* g", "a/b//C 'D\n1.5.x ٣.٤ é😀Z_9  'é' ->::", "'", '"', "/", None]
    texts = odd + ["".join(rng.choice("aB_1.'\"/\\* \n٣é😀:-> ") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = tokens.token_rows(docs, ["id"], F.col("text")).where(F.col("kind").isin(*tokens.INDEXED)).select("id", "term")
    got = tokens.term_rows(docs, "id", F.col("text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    words = spark.createDataFrame([("-> ( " + "word = x; " * 1000,)], "text string")
    assert words.select(F.size(F.regexp_extract_all("text", F.lit(tokens.INDEXED_TOKEN), F.lit(1)))).first()[0] <= 2002  # of 6004 tokens
