"""Operators 11 to 13 against brute force, on small fixtures with odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import branch_merge, registry, substrings, vector_codes
from tests.oracle import connect, rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = ("key", "words", "at", "h", "d", "no_id", "segments", "masks", "kept", "row", "in_base", "left_lines", "base_lang", "label_error", "shard")


@pytest.mark.parametrize("name", ["op11_substrings", "op12_vector_codes", "op13_merge"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def made(spark, pairs, schema=DOCS):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in pairs], schema)
    for c in WIDE:
        df = df.withColumn(c, F.lit("clash"))
    return df


# 11 ----------------------------------------------------------------------------------------------------------------


def brute_repeats(pairs, width):
    seen, out = {}, {}
    for i, t in sorted(pairs):
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if seen.setdefault(x, (i, k)) != (i, k):
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def hostile_texts(rng, vocabulary=6):
    word = lambda: rng.choice(["a", "b", "é", "漢", "c.", "\x00", "d" * 40, "<s>"][:vocabulary])
    passage = " ".join(f"p{rng.randrange(50)}" for _ in range(60))
    texts = ["", " \t\n", "one two", passage, f"x {passage} y", "a " * 700, "a b " * 300, "\x0b".join(["q"] * 30), "z" * 300_000 + " " + passage]
    texts += [" ".join(word() for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(30))} {passage} {' '.join(f'v{rng.randrange(10**6)}' for _ in range(30))}" for _ in range(25)]
    return texts + texts[10:14] + [" ".join(f"w{rng.randrange(3000)}" for _ in range(20_000))]


@pytest.mark.parametrize("crowd", [substrings.CROWD, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "SHARD", 50)
    monkeypatch.setattr(substrings, "HELD", 7)
    pairs = list(enumerate(hostile_texts(random.Random(3))))
    for width in (20, 5):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(made(spark, pairs).repartition(5), width).collect()}
        assert got == brute_repeats(pairs, width)


def test_repeats_of_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    other = text + " more words"
    got = substrings.without_repeats(made(spark, [(None, text), (3, text), (3, text), (2, None), (2, other), (None, other)])).collect()
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got))
    # the row of least id keeps its words; equal rows are one document; rows without an id come last
    assert found == [(False, 2, 0, 0), (False, 2, 42, 0), (False, 3, 40, 40), (False, 3, 40, 40), (True, 0, 40, 40), (True, 0, 42, 42)]
    assert substrings.without_repeats(made(spark, []).where("false")).collect() == []
    first, second = (r["n_removed"] for r in substrings.without_repeats(made(spark, [(7, "x " + text), (7, "y " + text)])).collect())
    assert {first, second} == {0, 40}  # of rows that share an id one is the earlier


def test_one_row_for_each_wording(spark):
    """A task sends a crowded passage's windows once, whatever the number of its documents."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(200))
    pairs = [(i, f"{' '.join(f'u{rng.random()}' for _ in range(25))} {passage}") for i in range(300)]
    rows_ = substrings.rows_of(made(spark, pairs)).coalesce(1)
    counts = substrings.keys_of(rows_, 20).groupBy("key").count()
    shared, crowded = (spark.sparkContext.broadcast(substrings.KeyFilter(counts.where(f"count > {n}"), counts.where(f"count > {n}").count())) for n in (1, 200))
    sent = substrings.units(rows_, shared, crowded, 20)
    inner = sent.where("start >= 25")
    assert inner.count() == inner.select("words").distinct().count() <= 181


@pytest.mark.parametrize("bits", [substrings.FILTER_BITS, 1 << 15])
def test_filters_hold_their_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(substrings, "FILTER_BITS", bits)
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    made_of = substrings.KeyFilter(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key long"), 10_000)
    assert made_of.holds(keys[:10_000]).all() and len(made_of.bits) * 8 <= bits
    assert (made_of.holds(keys[10_000:]).mean() < 0.05) == (bits > 1 << 15)


@pytest.mark.parametrize("top", [1, 5, 3000])
def test_index_finds_what_occurs_twice(top):
    rng = np.random.default_rng(top)
    text = np.append(rng.integers(1, top + 1, 4000), 0)
    text[3000:3040] = text[100:140]
    depth = 12
    index = substrings.FmIndex(text, depth)
    ends = np.arange(depth, 4000)
    length, start = index.matches(text, ends, depth)
    packed = [tuple(text[e - depth + 1 : e + 1]) for e in ends]
    counts = pd.Series(packed).value_counts()
    assert [n == depth for n in length] == [counts[p] > 1 for p in packed]
    by_start = {}
    for p, n, s in zip(packed, length, start):
        if n == depth:
            assert by_start.setdefault(s, p) == p


def test_words_are_those_of_ascii_blanks():
    texts = ["a b c\x1cd\te", "", "  x", "y z\n"]
    data, offsets = substrings.flat(pa.array(texts)[1:])
    starts, ends = substrings.word_spans(data, offsets)
    assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [w for t in texts[1:] for w in t.encode().split()]
    h = substrings.word_hashes(*(lambda d, o: (d, *substrings.word_spans(d, o)))(*substrings.flat(pa.array(["ab cd ab " + "q" * 400_000 + " ab"]))))
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


# 12 ----------------------------------------------------------------------------------------------------------------


def brute_codes(vectors):
    kept = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, _, v in kept], object).reshape(len(kept), 16, -1)
    book = [x[:64, p].copy() for p in range(16)]
    near = lambda: [[min((int(((q - c) ** 2).sum()), k) for k, c in enumerate(book[p])) for q in x[:, p]] for p in range(16)]
    for _ in range(2):
        found = near()
        for p in range(16):
            for k in range(len(book[p])):
                own = [x[n, p] for n, (_, e) in enumerate(found[p]) if e == k]
                if own:
                    book[p][k] = [int(s) // len(own) for s in sum(own)]
    found = near()
    out = {i: ("".join(f"{found[p][n][1]:02x}" for p in range(16)), sum(found[p][n][0] for p in range(16))) for n, (i, _, _) in enumerate(kept)}
    return out, hashlib.sha256(",".join(str(int(v)) for p in book for e in p for v in e).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<double>, label int, code string, v string, of string"


@pytest.mark.parametrize("scale,n", [(0.3, 150), (3e6, 100), (1.0, 5)])
def test_codes_equal_brute_force(spark, tmp_path, scale, n):
    rng = np.random.default_rng(n)
    data = [(i, [float(v) for v in np.round(rng.normal(size=32) * scale, 1)], i % 3 or None, "x", "x", "x") for i in range(n)]
    data += [(n, None, 1, "x", "x", "x"), (n + 1, [1.0] * 31 + [None], 1, "x", "x", "x"), (n + 2, [float("nan")] * 32, 1, "x", "x", "x"), (n + 3, [float("inf")] * 32, 1, "x", "x", "x"), (n + 4, [], 1, "x", "x", "x")]
    data += [(n + 5, data[0][1], 1, "x", "x", "x"), (n + 6, [0.0] * 32, None, "x", "x", "x"), (n + 7, [-0.0] * 32, 2, "x", "x", "x")]
    spark.createDataFrame(data, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()}
    want, digest = brute_codes([(i, label, v) for i, v, label, *_ in data])
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == want
    assert {r["codebooks_sha256"] for r in got.values()} == {digest}
    labels = {i: label for i, _, label, *_ in data}
    for i, r in got.items():
        assert r["label_error"] == sum(want[j][1] for j in want if labels[j] == labels[i])


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(empty)[0].collect() == []
    mixed = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1), (3, [1.0] * 15, 1), (None, [2.0] * 16, 1), (1, [1.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.compress(mixed)
    assert sorted((r["vec_id"] or 0, r["error"]) for r in coded.collect()) == [(0, 0), (1, 0), (1, 0)]
    assert books.books.shape == (16, 3, 1)
    huge = spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")
    assert [r["error"] for r in vector_codes.compress(huge)[0].collect()] == [0, 0]


def test_trees_leave_entries_out():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-40, 40, (3000, 4))
    found = vector_codes.Search(centres, vector_codes.plant(centres), x)
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (found.entry == far.argmin(axis=1)).all() and (found.best == far.min(axis=1)).all()
    assert found.compared / len(x) < 32
    ties = np.repeat(centres[:8], 8, axis=0)  # each entry eight times: the first of them wins
    assert (vector_codes.Search(ties, vector_codes.plant(ties), x).entry % 8 == 0).all()


# 13 ----------------------------------------------------------------------------------------------------------------


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 17


def brute_branch(branch, doc_id, columns, lines):
    if code(branch, doc_id, "row") == 0:
        return None
    edit = lambda k, x, gone: {0: gone, 1: x + "!", 2: x + "?"}.get(k, x)
    codes = [code(branch, doc_id, k) for k in range(len(lines))]
    return {n: edit(code(branch, doc_id, n), v, "") for n, v in columns.items()}, [edit(k, x, None) for k, x in zip(codes, lines)], [{3: "!", 4: "?"}.get(k) for k in codes]


def brute_merge(doc_id, columns, lines):
    plain = columns, lines, [None] * len(lines)
    left, right = (brute_branch(b, doc_id, columns, lines) for b in "LR")
    if left is None and right is None:
        return (None, None, None, 1, 0, 0, 0)
    a, b = left or plain, right or plain
    n, state = dict.fromkeys(("clean", "edit", "cut", "met"), 0), []
    for base, x, y, kind in [*((columns[c], a[0][c], b[0][c], "edit") for c in columns), *(z for k, t in enumerate(lines) for z in ((t, a[1][k], b[1][k], "line"), (None, a[2][k], b[2][k], "met")))]:
        if x != base or y != base:
            kind = "clean" if x == y or x == base or y == base else ("cut" if None in (x, y) else "edit") if kind == "line" else kind
            n[kind] += 1
        state.append(x if x != base else y)
    whole = (*state[: len(columns)], "\n".join(s for s in state[len(columns) :] if s is not None))
    if left and right:
        return (*whole, n["clean"], n["edit"], n["cut"], n["met"])
    return (*(whole if left and n["clean"] else (None,) * 3), int(not n["clean"]), 0, int(n["clean"] > 0), 0)


def test_merge_equals_brute_force(spark):
    rng = random.Random(13)
    texts = ["\n".join(rng.choice(["", "x", "é y", "!", "long " * 50]) for _ in range(rng.randrange(1, 40))) for _ in range(300)] + [None, "", "\n\n", "one line " * 20_000, "n\n" * 20_000]
    rows_ = [(i, t, rng.choice([None, "", "en"]), rng.choice([None, "s"]), 0) for i, t in enumerate(texts)] + [(2**62, "far", "en", "s", 0), (-(2**63), "least", "en", "s", 0)]
    df = spark.createDataFrame(rows_, DOCS)
    for c in WIDE:
        df = df.withColumn(c, F.lit("clash"))
    want, added = {}, {"L": {}, "R": {}}
    for i, text, lang, source, _ in rows_:
        columns = {"lang": lang or "", "source": source or ""}
        want[i] = brute_merge(i, columns, (text or "").split("\n"))
        for b, step in (("L", -1), ("R", -5)):
            if code(b, i, "row") in (3, 4) and step - i < 2**63:
                added[b][step - i] = (*columns.values(), "!" if code(b, i, "row") == 3 else "?")
    for i in {*added["L"], *added["R"]}:
        a, b = added["L"].get(i), added["R"].get(i)
        clash = bool(a and b and a != b)
        want[i] = (*(a or b), int(not clash), 0, 0, int(clash))
    got = {r[0]: tuple(r)[1:] for r in branch_merge.merge(branch_merge.branches(df)).collect()}
    assert got == want and sum(w[5] for w in want.values()) and sum(w[6] for w in want.values())


def test_merge_of_repeated_and_nameless_rows(spark):
    df = spark.createDataFrame([(5, "a\nb", "en", "s", 0)] * 3 + [(5, "c", "en", "s", 0), (None, "d", None, None, 0)], DOCS)
    got = [tuple(r) for r in branch_merge.merge(branch_merge.branches(df)).collect() if r["doc_id"] in (5, None)]
    columns = {"lang": "en", "source": "s"}
    want = [(5, *brute_merge(5, columns, ["a", "b"]))] * 3 + [(5, *brute_merge(5, columns, ["c"])), (None, *brute_merge(None, {"lang": "", "source": ""}, ["d"]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert branch_merge.merge(branch_merge.branches(df.where("false"))).collect() == []


def test_merge_of_tables(spark):
    """Branches that are tables of their own."""
    branch = f"doc_id long, lang string, source string, lines {branch_merge.LINES}"
    base = spark.createDataFrame([(1, "one\ntwo\nthree", "en", "s"), (2, "gone", "en", "s"), (3, "kept", "en", "s")], "doc_id long, text string, lang string, source string")
    left = spark.createDataFrame([(1, "en", "s", [(-1, True, "top"), (0, False, None), (1, False, "TWO"), (2, False, None)]), (3, "de", "s", [(0, False, None)]), (9, "en", "s", [(-1, True, "new")])], branch)
    right = spark.createDataFrame([(1, "fr", "s", [(0, False, None), (2, False, None), (2, True, "four"), (2, True, "five")]), (2, "en", "s", [(0, False, None)]), (9, "en", "s", [(-1, True, "other")])], branch)
    got = {r[0]: tuple(r)[1:] for r in branch_merge.merge(branch_merge.aligned(base, left, right)).collect()}
    assert got == {
        1: ("fr", "s", "top\none\nTWO\nthree\nfour\nfive", 3, 0, 1, 0),
        2: (None, None, None, 1, 0, 0, 0),
        3: ("de", "s", "kept", 0, 0, 1, 0),
        9: ("en", "s", "new", 0, 0, 0, 1),
    }
