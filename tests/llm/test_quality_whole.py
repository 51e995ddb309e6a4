"""Operator 3 as a whole against a plain numpy program: sample, features that count, both models, posteriors of sites."""

import math
import random
from collections import Counter

import numpy as np

from tarn.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string"


def test_features_by_hand():
    words = "Cat cat, sitting sitter dogs! THE cat"
    got = quality.features(words)
    assert {"w:cat", "w:sitting", "w:sitter", "w:dogs", "w:the"} <= got and not any(f.startswith("w:cat,") for f in got)
    assert {"p:sitti:1", "p:sitte:1"} <= got and "p:dogs:1" not in got
    n, distinct = 7, 7  # "Cat", "cat,", "sitting", "sitter", "dogs!", "THE", "cat"
    assert {f for f in got if f.startswith("caps>")} == {f"caps>{s}" for s in quality.STEPS if 1 / distinct >= s}
    assert {f for f in got if f.startswith("odd>")} == {f"odd>{s}" for s in quality.STEPS if 1 / distinct >= s}
    assert not any(f.startswith(("rep>", "line>", "pipe>")) for f in got)
    assert {f for f in got if f.startswith("len>")} == {f"len>{k}" for k in range(1, int(math.log2(n)) + 1)}
    assert quality.features(None) == quality.features(" \n") == {"empty"}
    assert "rep>0.5" in quality.features("a a a a") and "line>0.5" in quality.features("x y\nx y")


def newton(x, y):
    """The ridge logistic model by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1], quality.RIDGE), 0.0)
    w = np.append(np.zeros(x.shape[1]), math.log(y.sum() / (len(y) - y.sum())))
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x1 @ w)))
        h = x1.T @ (x1 * (p * (1 - p))[:, None]) + np.diag(ridge) + 1e-12 * np.eye(len(w))
        w = w - np.linalg.solve(h, x1.T @ (p - y) + ridge * w)
    return w[:-1], w[-1]


def loss(w, bias, x, y):
    z = x @ w + bias
    return np.logaddexp(0, z).sum() - y @ z + quality.RIDGE / 2 * w @ w


def test_fit_is_near_the_least_loss():
    rng = np.random.default_rng(2)
    x = (rng.random((800, 60)) < 0.2).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(-(x @ rng.normal(size=60) - 0.5)))).astype(float)
    at, columns = np.nonzero(x)
    own, best = loss(*quality.fit(at, columns, y, 60), x, y), loss(*newton(x, y), x, y)
    assert best <= own + 1e-9 and own <= best * 1.0001


def g2(p, a, q, b):
    ll = lambda k, m: sum(v * math.log(v / m) for v in (k, m - k) if v > 0)
    return 2 * (ll(p, a) + ll(q, b) - ll(p + q, a + b))


def strength(groups):
    """Prior weight of (n, sum, prior) by the method of moments."""
    n, s, prior = (np.array(c, float) for c in zip(*groups))
    v = (n * prior * (1 - prior)).sum() / n.sum()
    if len(n) < 2 or not v:
        return 1e4
    between = ((n * (s / n - prior) ** 2).sum() - (len(n) - 1) * v) / max(n.sum() - (n**2).sum() / n.sum(), 1e-9)
    return min(max(v / between - 1, 1.0), 1e4) if between > 0 else 1e4


def brute(docs, labels):
    """p_quality and p_toxic of each row."""
    found = [quality.features(t) for _, t, _, _ in docs]
    out = []
    for target in (0, 1):
        known = [(k, labels[d][target]) for k, (d, *_) in enumerate(docs) if d in labels and labels[d][target] is not None]
        seen = {}
        known = [(k, y) for k, y in known if seen.setdefault(docs[k][:2], k) == k]  # equal rows are one of the sample
        y = np.array([float(v >= 0.5) for _, v in known])
        pos, neg = Counter(), Counter()
        for (k, _), v in zip(known, y):
            (pos if v else neg).update(found[k])
        names = sorted(f for f in {*pos, *neg} if pos[f] + neg[f] >= quality.LEAST_DOCS and g2(pos[f], y.sum(), neg[f], len(y) - y.sum()) >= quality.LEAST_G)
        at = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(docs), len(names)))
        for k, fs in enumerate(found):
            x[k, [at[f] for f in fs if f in at]] = 1
        rows, columns = np.nonzero(x[[k for k, _ in known]])
        w, bias = quality.fit(rows, columns, y, len(names))
        base = math.log(y.sum() / (len(y) - y.sum()))
        evidence = x @ w + bias - base
        value = np.array([float(labels[d][target]) if d in labels and labels[d][target] is not None else 1 / (1 + math.exp(-(evidence[k] + base))) for k, (d, *_) in enumerate(docs)])
        host = [h or "" for *_, h in docs]
        path = [(h or "", p or "") for _, _, p, h in docs]
        sums = lambda keys: {g: (sum(k == g for k in keys), sum(v for k, v in zip(keys, value) if k == g)) for g in set(keys)}
        hosts, paths = sums(host), sums(path)
        mean = value.mean()
        s_host = strength([(n, s, mean) for n, s in hosts.values()])
        s_path = strength([(n, s, hosts[g[0]][1] / hosts[g[0]][0]) for g, (n, s) in paths.items()])
        p = []
        for k in range(len(docs)):
            (hn, hs), (pn, ps) = hosts[host[k]], paths[path[k]]
            at_host = (s_host * mean + hs - value[k]) / (s_host + hn - 1)
            at_path = min(max((s_path * at_host + ps - value[k]) / (s_path + pn - 1), 1e-4), 1 - 1e-4)
            p.append(1 / (1 + math.exp(-(evidence[k] + math.log(at_path / (1 - at_path))))))
        out.append(p)
    return out


def test_whole_query_equals_numpy(spark, tmp_path):
    rng = random.Random(11)
    good = lambda: " ".join(f"word{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))) + "."
    bad = lambda: " ".join(f"JUNK{rng.randrange(12)}!!" for _ in range(rng.randrange(5, 60)))
    mean = lambda: good() + " " + " ".join(rng.choice(["scum", "idiot", "trash"]) for _ in range(4))
    docs, labels = [], {}
    for i in range(420):
        kind = rng.choices([good, bad, mean], [6, 3, 2])[0]
        site = rng.choice(["a", "b", "c", "d", None, ""]) if kind is not bad else rng.choice(["a", "spam", "spam"])
        docs.append((i, kind(), rng.choice(["en", "de", None]), site))
        if i % 3:
            labels[i] = (int(kind is not bad), int(kind is mean))
    docs += [(500, None, "en", "a"), (500, "", "en", "a"), (501, "x " * 200_000, "en", "a"), (None, good(), "en", "b"), docs[0], (7, good(), "en", "a")]
    labels[500] = (0, None)
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["p_quality"], r["p_toxic"], r["kept"]) for r in quality.op3_quality(spark, str(tmp_path)).collect()))
    q, t = brute([(d, x or "", p, h) for d, x, p, h in docs], labels)
    want = sorted((d is None, d or 0, a, b) for (d, *_), a, b in zip(docs, q, t))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 2e-6 and abs(g[3] - w[3]) < 2e-6, (g, w)
        if abs(w[2] - quality.GOOD) > 1e-5 and abs(w[3] - quality.TOXIC) > 1e-5:
            assert g[4] == (w[2] >= quality.GOOD and w[3] <= quality.TOXIC)
