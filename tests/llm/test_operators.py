"""The ten corpus operators against brute force, libraries and round trips, odd inputs included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarn.llm import chat, components, embedding_dedup, fingerprints, line_dedup, minhash, packing, pii, quality, sentencepiece_codec, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows, ties, extra columns whose names clash with inner ones."""
    rng = random.Random(5)
    base = " ".join(words(rng, 120))
    lines = "\n".join(" ".join(words(rng, 14)) for _ in range(6))
    rows = [
        (0, None), (1, ""), (2, " \n\t"), (3, base), (4, base), (4, base), (5, base.replace(base.split()[60], "zz", 1)), (6, lines), (7, lines.replace("w", "v", 1)),
        (8, " ".join(words(rng, 60_000))), (9, "one two"), (10, "One TWO"), (None, "no id at all, but text"), (11, "mail a.b@c.org or +1 (415) 555-2671 from 10.0.0.1"), (12, "😀 ümläut\r\nx\n"),
    ]
    df = spark.createDataFrame([(i, t, "en", "src1", len(t) if t else 0) for i, t in rows], DOCS)
    for name in ("row", "_id", "_gone", "gone", "kept", "key", "id", "text_crc32", "email", "spans", "component", "host", "path", "range", "piece", "shard", "_cell", "tile", "g"):
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1 -----------------------------------------------------------------------------------------------------------------


def test_codec_equals_library():
    v = sentencepiece_codec.vocabulary(MODEL)
    rng = random.Random(1)
    pool = [" ", "\n", "\t", "a", "é", "▁", "漢", "😀", "\x00", "<s>", "</s>", "the ", "1", "  ", "<0x0A>", "ing", "​"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(150))) for _ in range(600)] + ["a" * 3000, "", " ", "▁", " a"]
    assert v.encode(texts) == v.library.encode(texts)
    assert v.encode([]) == []


def test_long_and_short_agendas_agree():
    v = sentencepiece_codec.vocabulary(MODEL)
    rng = random.Random(2)
    segments = ["▁" + "".join(rng.choices("etaoinshr", k=rng.randrange(1, 40))) for _ in range(300)]
    assert [np.frombuffer(b, np.int32).tolist() for b in v.merge_many(segments)] == [v.merge_long(s) for s in segments]


def test_transcode(odd, none):
    got = sentencepiece_codec.transcode(odd, MODEL).collect()
    sp = sentencepiece_codec.vocabulary(MODEL).library
    assert len(got) == odd.count()
    texts = Counter(plain(odd))
    assert Counter((r["doc_id"], tuple(r["piece_ids"]), r["decoded"]) for r in got) == Counter({(i, tuple(sp.encode(t)), sp.decode(sp.encode(t))): n for (i, t), n in texts.items()})
    assert sentencepiece_codec.transcode(none, MODEL).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------------


def test_escape_is_reversible():
    rng = random.Random(3)
    pool = ["<", "[", "\\", "|turn|>", "|end|>", "/s>", "s>", "INST]", "/INST]", "|image:12|>", "a", "\n", "<|says|>", "</s>", "[INST]"]
    for _ in range(20_000):
        x = "".join(rng.choices(pool, k=rng.randrange(9)))
        e = chat.escape(x)
        assert chat.unescape(e) == x and not re.search(r"<\|(?:turn|says|end|image:[0-9]+)\|>|</?s>|\[/?INST\]", e)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>\nthere"), (1, 1, "assistant", None), (None, 0, None, "x"), (2, 5, "assistant", "a"), (2, 3, "user", "b")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    order = {1: [("user", "hi"), ("assistant", "<|end|>\nthere"), ("assistant", "")], None: [("", "x")], 2: [("user", "b"), ("assistant", "a")]}
    for conv, expected in order.items():
        said = "".join(t for r, t in expected if r == "assistant")
        assert got[conv]["n_turns"] == len(expected)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in expected).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(turns.where("false"))).count() == 0


def test_parts(spark):
    parts = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    content = [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "s3://a.png", 700, 300, None, None), None, ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3)]
    r = chat.format_turns(spark.createDataFrame([(1, 0, "user", content)], f"conv_id long, turn long, role string, parts {parts}")).first()
    assert r["segment"] == "<|turn|>user<|says|>see <\\|image:0|><|image:0|><|audio:1|><|document:2|><|end|>\n"
    assert [(a["kind"], a["ordinal"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", 0, "s3://a.png", 3 * 144), ("audio", 1, "b.wav", 63), ("document", 2, "c.pdf", 768)]
    assert all(r["segment"][a["at"] :].startswith(f"<|{a['kind']}:{a['ordinal']}|>") for a in r["attachments"])
    assert r["expanded_tokens"] == 3 * 144 + 63 + 768 and r["mask_start"] is None


def test_odd_parts(spark):
    parts = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    odd = [("video", "x", "v.mp4", None, None, None, None), (None, None, "n", None, None, None, None), ("audio", None, "a", None, None, float("nan"), None), ("audio", None, "b", None, None, -1.0, None), ("audio", None, "c", None, None, float("inf"), None), ("image", None, None, -5, 0, None, None), ("document", None, "d", None, None, None, -2), ("document", None, "e", None, None, None, 2**31 - 1), ("text", "see <|other:0|>" + "y" * 500_000, None, None, None, None, None), ("text", None, None, None, None, None, None)]
    frame = spark.createDataFrame([(1, 0, "user", odd), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, parts {parts}")
    r = chat.format_turns(frame).where("turn = 0").first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("other", "v.mp4", 0), ("other", "n", 0), ("audio", "a", 0), ("audio", "b", 0), ("audio", "c", 0), ("image", None, 144), ("document", "d", 256), ("document", "e", (2**31 - 1) * 256)]
    assert r["expanded_tokens"] == 144 + 256 + (2**31 - 1) * 256 and "see <\\|other:0|>" in r["segment"]
    assert chat.read_back(chat.format_turns(frame)).first()["n_turns"] == 3


def test_loss_comes_from_the_mask(spark):
    rows = [(1, 0, "user", "<s> hi"), (1, 1, "assistant", "</s>[INST] " + "x" * 300_000), (1, 2, "user", "y" * 300_000), *((1, 3 + i, "assistant", f"turn {i}") for i in range(3000))]
    segments = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    said = "".join(t for _, _, r, t in rows if r == "assistant")
    of = lambda df: chat.read_back(df).first()
    right = of(segments)
    assert (right["loss_sha256"], right["loss_chars"]) == (hashlib.sha256(said.encode()).hexdigest(), len(said))
    shifted = of(segments.withColumn("mask_start", F.col("mask_start") + 1).withColumn("mask_end", F.col("mask_end") + 1))
    assert shifted["loss_sha256"] != right["loss_sha256"] and shifted["turns_sha256"] == right["turns_sha256"]
    assert of(segments.withColumn("mask_start", F.lit(None).cast("int")))["loss_chars"] == 0


def test_attachments_are_read_back(spark):
    content = [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "a", 700, 300, None, None), ("audio", None, "b", None, None, 2.5, None)]
    frame = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", content[:2])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = chat.read_back(chat.format_turns(frame)).first()
    assert (got["n_attachments"], got["expanded_tokens"]) == (3, 2 * 3 * 144 + 63)


# 3 -----------------------------------------------------------------------------------------------------------------


def test_training_rows_are_bounded(spark):
    rows = [(1, f"row {i}") for i in range(3000)] + [(2, "same")] * 500 + [(i, f"text {i}") for i in range(3, 100)]
    labels = quality.clean_labels(spark.createDataFrame([(i, i % 2, 0) for i in range(1, 100)], "doc_id long, quality int, toxic int"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.sample_of(docs, labels, 50).count() == 50
    assert quality.sample_of(docs, labels, 100_000).count() == 3000 + 1 + 97


def test_classifier(spark):
    rng = random.Random(7)
    good = [" ".join(words(rng, 60)) + "." for _ in range(150)]
    junk = [" ".join(w.upper() + "!!" for w in words(rng, 60)) for _ in range(60)]
    toxic = [" ".join([*words(rng, 60), "scum", "idiot"]) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 5}") for i, t in enumerate(good + junk + toxic)] + [(999, None, None, None), (999, None, None, None), (1000, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("host", F.lit(1)).withColumn("kept", F.lit(2))
    truth = [(i, 0 if 150 <= i < 210 else 1, int(i >= 210)) for i in range(270)]
    labels = spark.createDataFrame([t for t in truth if t[0] % 2] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert all(got[i] == (q == 1 and t == 0) for i, q, t in truth)
    assert quality.classify(docs, labels.where("false")).where("not kept").count() == 0
    assert quality.classify(docs.where("false"), labels).count() == 0
    kept = quality.apply_decisions(docs, quality.classify(docs, labels))
    assert kept.columns == docs.columns and kept.where("doc_id between 150 and 269").count() == 0


def test_sparse_sites_shrink(spark):
    """A site with one bad document of three is nearer to the global rate than one with a third of three hundred."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        site, bad = ("big", i % 3 == 0) if i < 300 else ("small", i == 300) if i < 303 else (f"o{i % 10}", False)
        rows.append((i, " ".join(words(rng, 30, 50)), "en", site))
        labels.append((i, int(not bad), 0))
    rows += [(2000, "w1 w2 w3", "en", "big"), (2001, "w1 w2 w3", "en", "small"), (2002, "w1 w2 w3", "en", "new")]
    p = {r["doc_id"]: r["p_quality"] for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert p[2000] < p[2001] < p[2002]


def test_posteriors_by_hand(spark, monkeypatch):
    """Evidence is given; sums, prior strengths, shrinkage and leaving out are recomputed in plain Python."""
    rng = random.Random(21)
    rows = [(i, f"t{i}", f"l{rng.randrange(3)}", f"h{min(rng.randrange(8), rng.randrange(8))}") for i in range(400)] + [(400, "alone", "l0", "sparse"), (401, None, None, None), (7, "same id", "l1", "h1")]
    given = {t: [rng.gauss(0, 1.5), rng.gauss(-1, 1)] for _, t, _, _ in rows}
    base = {"quality": 0.4, "toxic": -1.1}
    labels = {i: (float(rng.random() < 0.7), float(rng.random() < 0.1)) for i in range(0, 400, 3)}
    monkeypatch.setattr(quality, "train", lambda *_: {t: ({}, 0.0, b) for t, b in base.items()})
    table = spark.createDataFrame([(t, *v) for t, v in given.items()], "t string, quality_evidence double, toxic_evidence double")
    monkeypatch.setattr(quality, "evidence", lambda docs, models, columns: docs.join(table, docs["text"].eqNullSafe(table["t"])).select(*columns, "quality_evidence", "toxic_evidence"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r["doc_id"], r["h1"]): r for r in quality.classify(docs, spark.createDataFrame([(i, *map(int, v)) for i, v in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    want = []
    for k, target in enumerate(base):
        sigmoid = lambda x: 1 / (1 + math.exp(-x))
        y = [labels[i][k] if i in labels else sigmoid(given[t][k] + base[target]) for i, t, _, _ in rows]
        sites = [(h or "", p or "") for _, _, p, h in rows]
        mean = sum(y) / len(y)

        def sums(of):
            out = {}
            for site, v in zip(of, y):
                n, s = out.get(site, (0, 0.0))
                out[site] = n + 1, s + v
            return out

        paths, hosts = sums(sites), sums([h for h, _ in sites])

        def strength(groups, prior):
            n, nn = sum(c for c, _ in groups.values()), sum(c * c for c, _ in groups.values())
            v = sum(c * prior(g) * (1 - prior(g)) for g, (c, _) in groups.items()) / n
            between = (sum(c * (x / c - prior(g)) ** 2 for g, (c, x) in groups.items()) - (len(groups) - 1) * v) / (n - nn / n)
            return min(max(v / between - 1, 1.0), 1e4) if between > 0 else 1e4

        s_host, s_path = strength(hosts, lambda _: mean), strength(paths, lambda g: hosts[g[0]][1] / hosts[g[0]][0])
        for (i, t, _, _), site, own in zip(rows, sites, y):
            (hn, hs), (pn, ps) = hosts[site[0]], paths[site]
            at_host = (s_host * mean + hs - own) / (s_host + hn - 1)
            at_path = min(max((s_path * at_host + ps - own) / (s_path + pn - 1), 1e-4), 1 - 1e-4)
            want.append((target, i, t, sigmoid(given[t][k] + math.log(at_path / (1 - at_path)))))
    assert len(got) == len(rows)
    found = Counter((t, r["doc_id"], round(r[f"p_{t}"], 9)) for t in base for r in got.values())
    assert found == Counter((t, i, round(p, 9)) for t, i, _, p in want)


def test_quality_decides_by_row(spark):
    rng = random.Random(22)
    good, bad = [" ".join(words(rng, 60)) + "." for _ in range(60)], [" ".join(w.upper() + "!!" for w in words(rng, 60)) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    shared = [(500, good[0] + " more", "en", "s"), (500, bad[0] + " MORE!!", "en", "s"), (None, good[1] + " more", "en", "s"), (None, bad[1] + " MORE!!", "en", "s"), (501, good[2] * 3000, "en", "s")]
    docs = spark.createDataFrame(rows + shared, "doc_id long, text string, lang string, source string")
    kept = quality.apply_decisions(docs, quality.classify(docs, labels)).where("doc_id is null or doc_id >= 500").collect()
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in kept) == sorted([(500, len(shared[0][1])), (0, len(shared[2][1])), (501, len(shared[4][1]))])


# 4 -----------------------------------------------------------------------------------------------------------------


def test_ring(odd, none, spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"))
    a = {r["doc_id"]: r for r in sharding.assign(docs.select("doc_id"), ["doc_id"], 8).collect()}
    counts = Counter(r["shard"] for r in a.values())
    assert len(a) == 5000 and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in a.values() if r["shard"] == s) == list(range(counts[s]))
    b = {r["doc_id"]: r["shard"] for r in sharding.assign(docs.select("doc_id"), ["doc_id"], 9).collect()}
    moved = sum(b[i] != a[i]["shard"] for i in b)
    assert moved < 0.2 * 5000  # a ninth must move; hashing modulo the shards would move eight ninths
    assert sharding.assign(odd.select("doc_id", "text"), ["doc_id"], 3).count() == odd.count()
    assert sharding.assign(none.select("doc_id"), ["doc_id"], 3).count() == 0


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_ring_overflow_is_clockwise(spark, slack):
    """Every row is where a walk over the ring, row by row, puts it."""
    shards, nodes, cells = 5, 16, 1 << 10
    rows = [(i,) for i in range(700)] + [(7,)] * 400  # a hot key
    docs = spark.createDataFrame(rows, "doc_id long").withColumn("extra", F.monotonically_increasing_id())
    got = sharding.assign(docs, ["doc_id"], shards, nodes, slack, cells).withColumn("hash", F.xxhash64("doc_id")).collect()
    width = sharding.RING // cells
    points = sharding.ring_points(shards, nodes)
    limits = sharding.bounds(len(rows), shards, slack)
    # rows that are on their way, in clockwise order; each round a point admits what has reached it while its shard has room
    on_the_way = sorted((((r["hash"] % 2**64) >> 44) // width, r["hash"], r["doc_id"], r["extra"]) for r in got)
    at = {row: next((k for k, (p, _) in enumerate(points) if p >= row[0] * width), 0) for row in on_the_way}
    load, where = Counter(), {}
    while on_the_way:
        late = []
        for row in on_the_way:
            shard = points[at[row]][1]
            if load[shard] < limits[shard]:
                where[row[2:]] = shard, load[shard]
                load[shard] += 1
            else:
                late.append(row)
        for row in late:
            while load[points[at[row]][1]] >= limits[points[at[row]][1]]:
                at[row] = (at[row] + 1) % len(points)
        on_the_way = late
    assert {(r["doc_id"], r["extra"]): (r["shard"], r["slot"]) for r in got} == where
    assert all(load[s] <= limits[s] for s in range(shards))


# 5 -----------------------------------------------------------------------------------------------------------------


def test_plan_uses_every_piece():
    rng = random.Random(4)
    counts = Counter(rng.randrange(1, 129) for _ in range(5000))
    plan = packing.plan_bins(counts, 128)
    used = Counter()
    for taken, times in plan:
        assert sum(taken) <= 128
        for t in taken:
            used[t] += times
    assert used == counts
    assert sum(n for _, n in plan) <= 1.01 * sum(k * n for k, n in counts.items()) / 128 + 1
    assert packing.plan_bins({}, 128) == []


def test_pair_replaces_the_smallest():
    # greedy: 6 + 3 leaves 1; the pair 2 + 2 fits the gap of 4 exactly
    assert sorted(packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0][0]) == [2, 2, 6]


def test_plan_equals_document_by_document():
    """Bins made one by one over single documents: greedy, then two for the smallest while they fit more tightly."""
    for seed in range(12):
        rng = random.Random(seed)
        capacity = rng.choice([20, 50, 128])
        sizes = [rng.randrange(1, capacity + 1) if rng.random() < 0.7 else rng.randrange(1, capacity // 4) for _ in range(300)]
        left, bins = sorted(sizes, reverse=True), []
        while left:
            taken, gap = [], capacity
            while fits := [x for x in left if x <= gap]:
                taken.append(max(fits))
                left.remove(max(fits))
                gap -= taken[-1]
            while gap and len(taken) > 1:
                smallest = min(taken)
                pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if smallest < a + b <= gap + smallest]
                if not pairs:
                    break
                total, a, b = max(pairs)
                for x in (a, b):
                    left.remove(x)
                left.append(smallest)
                taken.remove(smallest)
                taken += [a, b]
                gap += smallest - total
            bins.append(gap)
        plan = packing.plan_bins(Counter(sizes), capacity)
        assert Counter(x for t, n in plan for x in t * n) == Counter(sizes)
        # pairs of one sum may be chosen otherwise, so single bins may differ but hardly their number
        assert abs(sum(n for _, n in plan) - len(bins)) <= 1


@pytest.mark.parametrize("lane", [packing.LANE, 3])
def test_packing(odd, none, monkeypatch, lane):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "LANE", lane)
    t = Tokenizer.from_file(BYTES)
    odd = odd.select("doc_id", "text").unionByName(odd.sparkSession.createDataFrame([(50, "x <|endoftext|> y"), (51, " " * 3_000_000), (51, " " * 3_000_000)], "doc_id long, text string"))
    got = packing.pack(odd, BYTES).collect()
    texts = plain(odd)
    assert {r["doc_id"] for r in got} == {i for i, _ in texts}
    want = Counter()
    for i, x in texts:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none, BYTES).count() == 0


# 6 -----------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_join_misses_nothing(edits):
    rng = random.Random(edits)
    for _ in range(2000):
        a = "".join(rng.choices("abc", k=rng.randrange(16)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choices("abc", k=rng.randrange(2))
        b = "".join(b)
        near = distance(a, b) <= edits
        assert line_dedup.within(a, b, edits) is near
        if near:
            x, y = sorted((a, b), key=len)
            assert {(len(x), i, x[s : s + n]) for i, (s, n) in enumerate(line_dedup.segments(len(x), edits))} & {(o, i, y[s : s + n]) for o, i, s, n in line_dedup.probes(len(y), edits)}


def brute_lines(docs, least=20, edits_from=(40, 40)):
    """(row number, line number) of what goes: rows in the order given, which must be that of places."""
    occurrences = [(i, k, line) for i, (_, t) in enumerate(docs) for k, line in enumerate(t.split("\n")) if len(line) >= least and (len(line) >= 20 or line.strip())]
    first = {}
    for i, k, line in occurrences:
        first.setdefault(line, (i, k))
    root = {line: line for line in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = sorted((x for x in first if len(x) >= min(edits_from)), key=len)
    for n, a in enumerate(long):
        edits = sum(len(a) >= m for m in edits_from)
        for b in long[n + 1 :]:
            if len(b) - len(a) > edits:
                break
            if find(a) != find(b) and line_dedup.within(a, b, edits):
                assert distance(a, b) <= edits
                root[find(a)] = find(b)
    best = {}
    for line, at in first.items():
        best[find(line)] = min(at, best.get(find(line), at))
    return {(i, k) for i, k, line in occurrences if best[find(line)] != (i, k)}


def test_sketches_let_all_near_lines_through():
    rng = random.Random(15)
    for _ in range(400):
        a = "".join(rng.choices("abcdé漢 ", k=rng.randrange(10, 60)))
        b = list(a)
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(2)] = rng.choices("xyz", k=rng.randrange(2))
        marks = line_dedup.sketches([a, "".join(b)])
        assert np.bitwise_count(marks[0] ^ marks[1]).sum() <= 4 * max(1, distance(a, "".join(b)))


def test_lines_of_rows_that_share_ids(spark):
    """What occurs once stays, whoever has the same id; of what repeats, one occurrence stays."""
    import corpus_pipeline

    rng = random.Random(16)
    pool = [f"{k} {' '.join(words(rng, 6))}" for k in range(30)]
    rows = [(1, "L"), (2, "U\nzz"), (2, "L\nyy"), (None, "null L\nzz of null"), (None, "head\nnull L"), (None, "x\nU of null"), (9, "same\nplace one"), (9, "same\nplace two"), (3, None), (3, "")]
    rows += [(rng.choice([None, 4, 5, 6]), "\n".join(rng.choices(pool, k=3))) for _ in range(60)]
    rows.append((7, "\n".join(f"line {k} of many, long enough to be its own {k * 7919}" for k in range(3000))))
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_was", F.col("text"))
    out = [(r["doc_id"], r["text_was"], r["text"]) for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()]
    assert Counter((i, t) for i, t, _ in out) == Counter(rows)
    count = lambda texts: Counter(x for t in texts for x in (t or "").split("\n") if x.strip())
    before, after = count(t for _, t in rows), count(t for _, _, t in out)
    assert set(after.values()) == {1} and all(t is not None for _, was, t in out if was is not None)
    far = lambda x: all(x == y or distance(x, y) > 1 for y in before)
    assert all(x in after for x in ("L", "U", "zz", "yy", "zz of null", "head", "U of null", "same", "place one", "place two"))
    assert all(x in after for x in before if x in pool and far(x)) and sum(x.startswith("line ") for x in after) > 0


def test_lines(spark, odd, none):
    rng = random.Random(11)
    base = [" ".join(words(rng, 12)) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = [rng.choice(base) for _ in range(4)]
        lines = [x if rng.random() < 0.5 else x[: (k := rng.randrange(len(x)))] + rng.choice("xyz") + x[k + rng.randrange(2) :] for x in lines]
        docs.append((i, "\n".join([*lines, "short line"])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("gone", F.lit(1))
    decisions = line_dedup.line_decisions(df)
    assert {(r["doc_id"], r["line_no"]) for r in decisions.collect()} == brute_lines(docs)  # ids are row numbers here
    kept = line_dedup.apply_decisions(df, decisions)
    gone = brute_lines(docs)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}
    rest = line_dedup.apply_decisions(odd, line_dedup.line_decisions(odd))
    assert rest.columns == odd.columns and rest.count() == odd.count()
    assert rest.where("doc_id = 0").first()["text"] is None
    assert line_dedup.line_decisions(none).count() == 0


def test_short_lines(spark, tmp_path):
    """The query and the pipeline's stage against brute force over every line that is not blank."""
    import corpus_pipeline

    rng = random.Random(14)
    base = ["".join(rng.choices("abcd ", k=n - 1)) + "e" for n in (1, 2, 5, 9, 10, 11, 12, 15, 19, 20, 21, 30, 38, 39, 40, 41, 42, 60) for _ in range(3)]
    base += ["漢字を学ぶ", "Home | About", "", " ", "\t ", "\u3000"]
    docs = []
    for i in range(60):
        lines = [list(rng.choice(base)) for _ in range(6)]
        for x in lines:
            for _ in range(rng.randrange(4) if len(x) > 4 and rng.random() < 0.6 else 0):
                k = rng.randrange(len(x))
                x[k : k + rng.randrange(2)] = rng.choices("abz,", k=rng.randrange(2))
        docs.append((i, "\n".join("".join(x) for x in lines)))
    first, occurrences = {}, []
    for i, t in docs:
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                occurrences.append((i, k, line))
                first.setdefault(line, (i, k))
    root, texts = {x: x for x in first}, sorted(first, key=len)
    for n, a in enumerate(texts):
        edits = 2 if len(a) >= 40 else 1 if len(a) >= 10 else 0
        for b in texts[n + 1 :]:
            if edits and len(b) - len(a) <= edits and root[a] != root[b] and distance(a, b) <= edits:
                old, new = root[b], root[a]
                root = {x: new if r == old else r for x, r in root.items()}
    best = {}
    for line, at in first.items():
        best[root[line]] = min(at, best.get(root[line], at))
    gone = {(i, k) for i, k, line in occurrences if best[root[line]] != (i, k)}
    assert any(len(x) < 10 for i, k, x in occurrences if (i, k) in gone) and any(10 <= len(x) < 40 and first[x] == (i, k) for i, k, x in occurrences if (i, k) in gone)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], int(k)) for r in got for k in r["removed_lines"].split(",") if k} == gone
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, df, str(tmp_path)).collect()}
    assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


# 7 -----------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0


GOOD = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": luhn, "phone": lambda s: 9 <= sum(c.isdigit() for c in s) <= 15}
HARD = ["a.b@c.d@e.f x_y@z.w_d@q.r", "😀 1.2.3.4.5 300.1.1.1 1.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (415) 555-2671 +12 +123456789012345678", "a" * 5000 + "@", "1" * 9000, "+1((((((" * 200, "x@y", "a@b.c," * 50, "1 " * 20_000, None, "", "@@@a@@b.c.", "+1 2 3 4 5 6 7 8 9  0"]


def seeds_of(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if GOOD[k](m.group())]


def test_seeds(spark, odd, none):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = pii.extract(df.withColumn("seen", F.lit(1)))
    assert Counter((r["doc_id"], tuple((k, x["s"], x["e"]) for k in pii.KINDS for x in r[k])) for r in got.collect()) == Counter((i, tuple(seeds_of(t))) for i, t in plain(df))
    assert pii.extract(none).count() == 0


def test_contexts_discover(spark):
    rng = random.Random(2)
    known = [(i, f"please write to: user{i}@mail.example.org today about {rng.random()}") for i in range(30)]
    unseen = [(100, "please write to: bob@localhost today about it"), (101, "the ratio a@b is a symbol of something else")]
    got = {r["doc_id"]: r["added"] for r in pii.extract(spark.createDataFrame(known + unseen, "doc_id long, text string")).collect()}
    assert [(x["kind"], x["s"], x["e"]) for x in got[100]] == [("email", 17, 30)]
    assert not got[101] and not got[0]


def planted(rng):
    """Texts with identifiers that the patterns match and, in the same contexts, ones that they do not; and decoys elsewhere."""
    plain = words(rng, 40, 3000)
    filler = lambda: " ".join(rng.choices(plain, k=rng.randrange(5, 15)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def card(good):
        while True:
            x = "4" + digits(15)
            if luhn(x) is good:
                return x

    kinds = {
        "email": (["write to", "e-mail:", "reach {} directly"], lambda i: f"user{i}@host{i % 7}.example.org", lambda i: f"user{i}@intranet{i % 5}"),
        "phone": (["call us on", "tel.:", "phone {} or come"], lambda i: f"+1 415 {digits(3)} {digits(4)}", lambda i: f"(0{digits(2)}) {digits(3)}-{digits(4)}"),
        "card": (["card number", "pay with {} visa"], lambda i: card(True), lambda i: card(False)),
        "secret": (["password ="], lambda i: f'"{digits(16)}{"abcdef"[i % 6] * 20}"', lambda i: f"Key_{digits(10)}_{'xyz'[i % 3]}_{digits(6)}"),
    }
    rows, want = [], set()
    for kind, (contexts, seen, unseen) in kinds.items():
        for i in range(160):
            new, context = i // 6 % 2, contexts[i % len(contexts)]
            value = (unseen if new else seen)(i)
            before, _, after = context.partition("{}") if "{}" in context else (context + " ", "", "")
            text = f"{filler()} {before}"
            if new:
                want.add((len(rows), kind, len(text), len(text) + len(value)))
            rows.append(f"{text}{value}{after} {filler()}")
    for i in range(200):  # in no context of their own
        rows.append(f"{filler()} {rng.choice([card(False), card(True), '0' + digits(8), f'x{i}@y'])} {filler()}")
    for i in range(120):  # where one in ten passes the check by chance
        rows.append(f"{filler()} order no. {card(i % 10 == 0)} {filler()}")
    return rows, want


def test_unseen_identifiers_are_found(spark):
    rows, want = planted(random.Random(31))
    got = pii.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    secret_seeds = {(i, "secret", m.start(), m.end()) for i, t in enumerate(rows) for m in re.finditer(r'(?<=")[0-9a-f]{32,}(?=")', t)}
    found = {(r["doc_id"], x["kind"], x["s"], x["e"]) for r in got for x in r["added"]} - secret_seeds
    assert len(found & want) >= 0.9 * len(want)
    assert len(found - want) <= 0.02 * len(want)


def test_graph_scores_equal_a_naive_computation(spark):
    rows, _ = planted(random.Random(32))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    occurrences = pii.marked_rows(docs).select("row", F.inline("seen"))
    edges = pii.graph(occurrences)
    places = pii.phrase_counts(docs, edges.select("phrase").distinct())
    got = {(r["side"], r["phrase"], r["kind"], r["value"]): (r["purity"], r["score"]) for r in pii.scored(edges, places).collect()}

    corpus = Counter()
    for t in rows:
        w = [x for x in re.split(r"[^\w:=#]+", t.lower())]
        corpus.update([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
    held = Counter()
    seed = {}
    for r in occurrences.collect():
        seed[(r["kind"], r["value"])] = seed.get((r["kind"], r["value"]), False) or r["seed"]
        for side in ("left", "right"):
            for phrase in r[side]:
                held[(side, phrase, r["kind"], r["value"])] += 1
    of = {}
    for side, phrase, kind, value in held:
        of.setdefault((side, phrase, kind), []).append((kind, value))
    of = {p: v for p, v in of.items() if len(v) > pii.SUPPORT and any(not seed[x] for x in v)}
    purity = {p: (n := sum(held[(p[0], p[1], *x)] for x in v)) / max(n, corpus[p[1]]) for p, v in of.items()}
    score = {x: float(s) for x, s in seed.items()}
    for _ in range(pii.ROUNDS):
        best = {}
        for p, v in of.items():
            known, share = sum(score[x] >= pii.CONFIDENT for x in v), sum(score[x] for x in v) / len(v)
            trust = purity[p] * min(1.0, share / pii.SHARE)
            if known >= pii.SUPPORT and trust >= pii.TRUSTED:
                for x in v:
                    best[(x, p[0])] = max(trust, best.get((x, p[0]), 0.0))
        score = {x: 1.0 if s else 1 - (1 - best.get((x, "left"), 0.0)) * (1 - best.get((x, "right"), 0.0)) for x, s in seed.items()}
    want = {(*p, x[1]): (purity[p], score[x]) for p, v in of.items() for x in v}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_what_is_found_finds_more(spark):
    """Numbers that one context reveals make another one known, which reveals numbers that only it holds."""
    both = [f"0{30 + i} {1000 + i} {2000 + i}" for i in range(12)]
    only = [f"0{60 + i} {5000 + i} {7000 + i}" for i in range(4)]
    rows = [f"call us on +1 415 555 {1000 + i}" for i in range(10)] + [f"call us on {x}" for x in both] + [f"ring bella under {x}" for x in both + only]
    got = pii.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["added"]} == set(range(10, len(rows)))


def test_redact_many(spark):
    rng = random.Random(33)
    texts = []
    for n in (0, 1, 3, 400, 3000):
        parts = [rng.choice(["é漢😀 and ", "mail a.b@c.org,", "from 10.0.0.1 ", "4111 1111 1111 1111;", "+1 (415) 555-2671. ", "1.2.3.4@x.org ", "x" * rng.randrange(5000)]) for _ in range(n)]
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: sorted([(x["s"], x["e"], k) for k in pii.KINDS for x in r[k]] + [(x["s"], x["e"], x["kind"]) for x in r["added"]]) for r in pii.extract(df).collect()}
    for r in pii.redact(df).collect():
        t, out, at = texts[r["doc_id"]], [], 0
        merged = []
        for s, e, k in spans[r["doc_id"]]:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e, k])
        for s, e, k in merged:
            out += [t[at:s], f"<{k.upper()}>"]
            at = e
        assert r["text"] == "".join([*out, t[at:]])


def test_redact(spark, odd, none):
    df = spark.createDataFrame([(1, "x a@b.co, 10.0.0.1!", 3), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long").withColumn("email", F.lit("e"))
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["email"]) for r in pii.redact(df).collect()}
    assert got == {1: ("x <EMAIL>, <IP>!", 16, "e"), 2: ("clean", 5, "e"), 3: (None, None, "e")}
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert pii.redact(none).count() == 0


def test_redact_by_row(spark):
    """Discovered spans are hidden where the id is null, and only in the text that has them where rows share an id."""
    known = [(i, f"please write to: user{i}@mail.example.org today about it") for i in range(30)]
    rows = [
        (None, "please write to: bob@localhost today about it"), (None, "or, if that fails, please write to: al@localhost today about it"), (None, "nothing to hide in this row, whatever the others have"),
        (100, "please write to: eve@localhost today about it"), (100, "please do not hide words of this row for the other one"), (101, "twice: please write to: joe@localhost today"), (101, "twice: please write to: joe@localhost today"), (102, None),
    ]
    got = Counter((r["doc_id"], r["text"]) for r in pii.redact(spark.createDataFrame(known + rows, "doc_id long, text string")).collect())
    assert got == Counter((i, t and re.sub(r"\w+@[\w.]+", "<EMAIL>", t)) for i, t in known + rows)


# 8 -----------------------------------------------------------------------------------------------------------------


def test_likeness_is_generalised_jaccard():
    rng = random.Random(0)
    errors = []
    for i in range(150):
        a = [f"{i}x{rng.randrange(40)}" for _ in range(200)]
        b = a[: rng.randrange(20, 200)] + [f"{i}x{rng.randrange(60)}" for _ in range(rng.randrange(1, 150))]
        x, y = Counter(a), Counter(b)
        _, s = fingerprints.fingerprints([" ".join(a), " ".join(b)])
        errors.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def naive_signature(text):
    """The samples of a text, drawn word by word."""
    own, out = fingerprints.sampler(), []
    for seed in own.seeds.tolist():
        least = None
        for word, n in Counter(text.lower().split()).items():
            z = fingerprints.xxhash.xxh64_intdigest(word.encode()) ^ seed
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ z >> shift) * factor % 2**64
            z ^= z >> 31
            r, ln_c, b = own.r[z >> 46], own.ln_c[(z >> 26) % 2**20], np.float32(z % 2**24) * np.float32(2**-24)
            t = np.floor(np.log(np.float32(n)) / r + b)
            ln_a = ln_c - r * (t + 1 - b)
            least = ln_a if least is None or ln_a < least else least
        bits = 0 if least is None else int(np.float32(least + np.float32(0)).view(np.uint32)) * 0x9E3779B97F4A7C15 % 2**64 >> 48
        out.append(max(bits, least is not None))
    return out


def test_samples_equal_naive_draws(spark, monkeypatch):
    rng = random.Random(41)
    texts = [" ".join(words(rng, rng.randrange(60), 30)) for _ in range(30)] + ["", "Ä ä", texts_of_many(rng)]
    assert fingerprints.fingerprints(texts)[1].tolist() == [naive_signature(t) for t in texts]
    monkeypatch.setattr(fingerprints, "BLOCK", 16)
    assert fingerprints.fingerprints(texts)[1].tolist() == [naive_signature(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints.fingerprint_documents(rows).collect():
        a, after = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        x, y, z = map(naive_signature, (a, fingerprints.edited(a, after), after))
        assert r["near_edited"] == np.mean([p == q for p, q in zip(x, y)]) and r["near_next"] == np.mean([p == q for p, q in zip(x, z)])
        assert r["fingerprint"] == "".join(f"{v:04x}" for v in x)


def texts_of_many(rng):
    return " ".join(words(rng, 300, 250))


def test_hot_ids_are_several_ranges():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.full(5000, 7), rng.integers(0, 20, 2000)])
    hashes = rng.integers(-(2**63), 2**63 - 1, len(ids))
    edges = np.sort(np.quantile(ids, np.arange(1, 20) / 20, method="nearest"))
    got = fingerprints.range_numbers(ids, hashes, edges)
    order = np.lexsort((hashes, ids))
    assert (np.diff(got[order]) >= 0).all() and np.bincount(got).max() < 1500


def test_successors(odd, none):
    hashed = {t: h for t, h in odd.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    rows = [(i, t) for i, _, t in sorted((i if i is not None else -(2**63), hashed[t], t) for i, t in plain(odd))]
    want = Counter((i, len(t), hashlib.sha256(fingerprints.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    got = fingerprints.fingerprint_documents(odd).collect()
    assert Counter((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] and by[3]["near_next"] == 1.0
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == by[2]["fingerprint"]
    assert fingerprints.fingerprint_documents(none).count() == 0
    alone = fingerprints.fingerprint_documents(odd.where("doc_id = 9")).first()
    assert alone["near_next"] == 1.0


# 9 -----------------------------------------------------------------------------------------------------------------


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    for i in range(60):
        x[200 + i] = x[i % 20] + rng.standard_normal(16) * (0.05 if i % 2 else 0.12)
    x[280:290] = x[3]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [float("nan")] * 16), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("n", F.lit(1))
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    component = list(range(300))
    for i, j in zip(*np.nonzero(near)):
        a, b = component[i], component[j]
        component = [min(a, b) if c in (a, b) else c for c in component]
    for i in range(300):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, component[i], component[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in (900, 901, 902, 903, 904, 907))
    assert (got[905]["n_links"], got[906]["component_id"]) == (1, 905)
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------


def brute_components(docs, width, percent=80):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("tile", "chars"), [(512, 10**7), (8, 10**7), (512, 9000)])
def test_near_duplicates(spark, monkeypatch, tile, chars):
    monkeypatch.setattr(components, "TILE", tile)
    monkeypatch.setattr(components, "TILE_CHARS", chars)
    rng = random.Random(6)
    docs, base = [], words(rng, 150)
    for i in range(60):  # one large group of near copies, some of them only linked through others
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(150)] = "new" + str(rng.randrange(9))
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(words(rng, rng.randrange(1, 90), 9000))) for i in range(40)]
    docs += [(200, docs[5][1]), (201, "A b"), (202, "a B"), (203, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("g", F.lit(0))
    want, sizes = brute_components(docs, 4)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, 4).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_of_rows_that_share_ids(spark):
    """Every text stays, in some row, unless an earlier row is like it."""
    rng = random.Random(51)
    a, b, c, d = (" ".join(words(rng, 80, 9000)) for _ in range(4))
    near = a.replace(a.split()[40], "other", 1)
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (5, c, 4), (5, d, 5), (6, d + " more", 6), (None, near, 7), (None, b, 8), (None, "only here without an id", 9), (None, "only here without an id", 10), (5, c, 11), (8, "", 12), (8, None, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 long").withColumn("_id", F.lit("x"))
    got = minhash.near_duplicates(df)
    kept = minhash.apply_decisions(df, got)
    assert kept.columns == df.columns
    names = [r["h1"] for r in kept.collect()]
    assert {1, 3, 5} <= set(names) and not {2, 6, 7, 8} & set(names)
    assert len({4, 11} & set(names)) == 1 and len({9, 10} & set(names)) == 1 and len({12, 13} & set(names)) == 1
    strings = spark.createDataFrame([("x", a), ("a", near), ("b", b)], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(strings).collect()} == {"x": "a", "a": "a", "b": "b"}


def test_near_duplicates_of_odd_rows(odd, none):
    got = minhash.near_duplicates(odd)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert by[4] == 3 and by[5] == 3 and by[0] == 0 and by[1] == 1 and by[10] == 9 and by[None] is None
    kept = minhash.apply_decisions(odd, got)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 8").count() == 1
    assert minhash.near_duplicates(none).count() == 0
    twice = odd.where("doc_id in (4, 9)")
    assert sorted(r["doc_id"] for r in minhash.apply_decisions(twice, minhash.near_duplicates(twice)).collect()) == [4, 9]


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# all ---------------------------------------------------------------------------------------------------------------


def test_registered(spark, sf_dir):
    from tarn.llm import registry
    from tests.oracle import connect, rows

    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{n}" for n in range(1, 14)]
    db = connect(sf_dir)
    for name, f in registry.QUERIES.items():
        got = f(spark, sf_dir).toPandas()
        assert len(got)
        if name in registry.ORACLE_SQL:
            assert rows(got) == rows(db.execute(registry.ORACLE_SQL[name]).fetchdf()), name
