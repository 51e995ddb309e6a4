"""Merkle trees, vocabularies that grow, padded batches, token counts: against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.functions import embedding
from tarn.operators import conversations, snapshots, tokens, trees

MANIFEST = "path string, hash string"


def brute_tree(files):
    """hash and number of files of each directory."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def of(prefix):
        names, n = {}, 0
        for path, h in files:
            if path.startswith(prefix):
                head, _, rest = path[len(prefix) :].partition("/")
                names.setdefault(head + "/" * bool(rest), []).append(h)
        entries = []
        for name, hashes in names.items():
            if name.endswith("/"):
                h, k = of(prefix + name)
                entries.append((name, h))
                n += k
            else:
                entries += [(name, h) for h in hashes]
                n += len(hashes)
        buckets = {}
        for name, h in sorted(entries):
            buckets.setdefault(sha(name)[:2], []).append(f"{name}:{h}")
        out[prefix.rstrip("/")] = (sha("\n".join(f"{b}:{sha(chr(10).join(x))}" for b, x in sorted(buckets.items()))), n)
        return out[prefix.rstrip("/")]

    out = {}
    of("")
    return out


def manifest(seed, n=400):
    rng = random.Random(seed)
    return {"/".join([*(rng.choice("abcd") for _ in range(rng.randrange(4))), f"f{i}"]): f"h{rng.randrange(50)}" for i in range(n)}


def test_trees(spark):
    old = manifest(1)
    new = {p: ("changed" if p.startswith("a/b/") else h) for p, h in old.items() if not p.startswith("c/d")} | {"new/deep/er/file": "x", "top": "y"}
    frame = lambda m: spark.createDataFrame(sorted(m.items()), MANIFEST).repartition(3)
    a, b = trees.merkle_tree(frame(old)), trees.merkle_tree(frame(new))
    for tree, files in ((a, old), (b, new)):
        assert {r["node"]: (r["hash"], r["files"]) for r in tree.where("not leaf").collect()} == brute_tree(sorted(files.items()))
    found, compared = trees.tree_difference(a, b)
    flat = snapshots.changed(snapshots.diff(frame(old), frame(new)))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in flat.collect()}
    below_equal = sum(p.startswith(("a/a/", "a/c/", "a/d/", "b/", "d/")) for p in old)
    assert 0 < compared < a.count() - below_equal + 30  # what is below equal directories is not compared
    assert trees.tree_difference(a, a)[1] == 1 and trees.tree_difference(a, a)[0].collect() == []
    none = trees.merkle_tree(frame({}) if False else spark.createDataFrame([], MANIFEST))
    assert none.count() == 0 and trees.tree_difference(none, a)[0].count() == len(old)
    one = trees.merkle_tree(spark.createDataFrame([("x", None), (None, "h")], MANIFEST))
    assert one.count() == 2


def test_vocabulary_grows(spark):
    rng = random.Random(4)
    rounds = [[f"t{rng.randrange(900)}" for _ in range(n)] for n in (300, 300, 300)]
    vocab = tokens.vocabulary(spark.createDataFrame([(t,) for t in rounds[0]], "term string"), 50)
    seen = {r["term"]: r["term_id"] for r in vocab.collect()}
    for terms in rounds[1:]:
        more = spark.createDataFrame([(t,) for t in terms], "term string")
        vocab = tokens.grown_vocabulary(vocab, more, 50)
        ids = {r["term"]: r["term_id"] for r in vocab.collect()}
        assert sorted(ids.values()) == list(range(len(ids)))
        assert {t: i for t, i in ids.items() if t in seen} == seen
        fresh = sorted(set(terms) - set(seen))
        assert [ids[t] for t in fresh] == list(range(len(seen), len(ids)))
        assert {r["term"]: r["term_id"] for r in tokens.grown_vocabulary(vocab, more, 50).collect()} == ids  # again
        seen = ids
    assert tokens.grown_vocabulary(vocab.where("false"), more).count() == len(set(rounds[2]))


def test_padded_batches(spark, monkeypatch):
    monkeypatch.setattr(embedding, "LANE", 150)
    rng = random.Random(6)
    texts = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(min(700, int(rng.expovariate(0.01)))))) for i in range(1500)]
    texts += [(7, None), (8, "  "), (9, "one two"), (9, "one two")]
    budget, most = 4096, 512
    made = embedding.padded_batches(spark.createDataFrame(texts, "id long, text string"), "id", budget=budget, most=most).collect()
    provider = embedding.HashedTokens()
    want = sorted((i, provider.tokenise([t or ""])[0][0][:most].tolist()) for i, t in texts if (t or "").strip())
    got, padded, real = [], 0, 0
    for r in made:
        ids, masks = np.array(r["ids"]), np.array(r["masks"])
        assert ids.shape == masks.shape == (r["n"], r["longest"]) and (ids.size <= budget or r["n"] == 1)
        assert ((ids > 0) == (masks == 1)).all()
        got += [(k, [int(x) for x, m in zip(row, mask) if m]) for k, row, mask in zip(r["keys"], ids, masks)]
        padded, real = padded + ids.size, real + int(masks.sum())
    assert sorted(got) == want
    assert padded <= 1.1 * real
    assert embedding.padded_batches(spark.createDataFrame([], "id long, text string"), "id").count() == 0


def test_bpe_tokens_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    said = [("user", "Hello there, it's 1234!"), (None, None), ("system", "ü€ 漢字 \n\n x"), ("assistant", "")]
    count = conversations.bpe_tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = spark.createDataFrame([(i, *s) for i, s in enumerate(said)], "i long, role string, text string").select("i", count("role", "text").alias("n")).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert {r["i"]: r["n"] for r in got} == {i: size(r) + size(t) + 4 for i, (r, t) in enumerate(said)}


def test_trending(spark):
    rows = [(0, 1, "alpha beta"), (0, 2, "alpha"), (1, 3, "beta beta gamma"), (1, 4, "beta"), (1, 5, None), (3, 6, "alpha")]
    got = conversations.rising_words(spark.createDataFrame(rows, "week long, conv_id long, text string"), "week", 2)
    assert {tuple(r) for r in got.collect()} == {(0, "alpha", 2, 0, 1.0), (0, "beta", 1, 0, 0.5), (1, "beta", 2, 1, 0.333333), (1, "gamma", 1, 0, 0.333333), (3, "alpha", 1, 0, 1.0)}
    assert isinstance(got.toPandas(), pd.DataFrame)


def test_padded_batches_leave_python_in_parts(spark, monkeypatch):
    """No part of ids that Python holds at once has more texts than ``PART``."""
    monkeypatch.setattr(embedding, "PART", 7)
    sizes = []
    plain = embedding.pa.RecordBatch.from_arrays

    class Batches:
        from_arrays = staticmethod(lambda arrays, names: sizes.append(len(arrays[0])) or plain(arrays, names))

    class Frame:
        schema = {"id": type("Kind", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "bigint")})})}
        select = lambda self, *names: self

        def mapInArrow(self, run, schema):
            batch = embedding.pa.RecordBatch.from_pydict({"id": list(range(100)), "text": ["word other"] * 99 + [None]})
            monkeypatch.setattr(embedding.pa, "RecordBatch", Batches)
            list(run(iter([batch])))
            monkeypatch.undo()
            raise StopIteration

    with pytest.raises(StopIteration):
        embedding.padded_batches(Frame(), "id")
    assert sum(sizes) == 100 and max(sizes) == 7
