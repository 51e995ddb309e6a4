"""Greedy clusters in rounds against the sequential definition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import clusters


def sequential(pairs, most):
    near = {}
    for g, a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    of, free, out = {x: g for g, a, b in pairs for x in (a, b)}, set(near), set()
    for i in sorted(near):
        some = [j for j in sorted(near[i]) if j in free][: most - 1] if i in free else []
        if some:
            free -= {i, *some}
            out |= {(of[i], i, j) for j in (i, *some)}
    return out


@pytest.mark.parametrize("rounds", [clusters.ROUNDS, 1])
@pytest.mark.parametrize("nodes,edges,most", [(200, 150, 20), (200, 1500, 4), (60, 1200, 20), (300, 299, 3)])
def test_rounds_equal_the_sequence(spark, nodes, edges, most, rounds):
    rng = random.Random(nodes + edges)
    if edges == nodes - 1:
        found = {(0, i, i + 1) for i in range(edges)}  # a chain in order
    else:
        found = {(a % 2, a, b) for a, b in (sorted(rng.sample(range(nodes), 2)) for _ in range(edges)) if a % 2 == b % 2}
    got = clusters.gathered(spark.createDataFrame(sorted(found), "g int, a long, b long"), most, rounds, 0)
    assert {tuple(r) for r in got.collect()} == sequential(found, most)


def test_no_pairs(spark):
    assert clusters.gathered(spark.createDataFrame([], "g string, a long, b long")).collect() == []


def test_one_workspace_is_many_tasks(spark):
    """Nothing of a large group meets in one task but the rows of a pair of tiles."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 12)), 20, axis=0) + 0.1 * rng.normal(size=(1200, 12))
    rows = spark.createDataFrame([(i, "one", [float(c) for c in v]) for i, v in enumerate(x)], "id long, w string, embedding array<double>")
    got = {tuple(r) for r in clusters.greedy_clusters(rows, "w").collect()}
    found = clusters.similar_pairs(rows, "w", clusters.LEAST).withColumn("g", F.lit("one"))
    assert {tuple(r) for r in clusters.gathered(found, alone=10).collect()} == got
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(np.round(unit @ unit.T, 6) >= clusters.LEAST, 1))
    assert got == sequential({("one", int(i), int(j)) for i, j in zip(a, b)}, clusters.LARGEST)
    few = rows.where(F.col("id") < 4)
    assert clusters.greedy_clusters(few, "w").collect() == []  # too few rows


@pytest.mark.parametrize("least,most_rows,step", [(0.2, 700, 37), (-2.0, 90, 512), (0.75, 300, 16)])
def test_walk_equals_the_sequence(spark, least, most_rows, step):
    """Dense groups are decided in one pass without their pairs; groups begin and end inside batches."""
    rng = np.random.default_rng(most_rows)
    x = rng.normal(size=(most_rows, 12))
    x[::7] = x[0]
    rows = spark.createDataFrame([(f"g{i % 3}", i, [float(c) for c in v]) for i, v in enumerate(x)], "g string, id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(np.round(unit @ unit.T, 6) >= least, 1))
    want = sequential({(f"g{i % 3}", int(i), int(j)) for i, j in zip(a, b) if i % 3 == j % 3}, clusters.LARGEST)
    got = [tuple(r) for r in clusters.walked(rows, least, parts=2, step=step).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dense_groups_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    rows = spark.createDataFrame([(i, "dense" if i < 300 else "few", [float(c) for c in v]) for i, v in enumerate(x)], "id long, w string, embedding array<double>")
    whole = {tuple(r) for r in clusters.greedy_clusters(rows, "w", 0.2).collect()}
    seen = []
    plain = clusters.gathered
    monkeypatch.setattr(clusters, "gathered", lambda pairs, *a: seen.append({r["g"] for r in pairs.select("g").distinct().collect()}) or plain(pairs, *a))
    assert {tuple(r) for r in clusters.greedy_clusters(rows, "w", 0.2, alone=4000).collect()} == whole and seen == [{"few"}]
