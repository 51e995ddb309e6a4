"""The stages, each on what the one before it kept."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarn.llm import pii
from tarn.llm.common import checkpointed, shared_folder
from tests.llm.test_operators import brute_components, brute_lines, seeds_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "personal_data", "packing"]

    good = checkpointed(stages["quality"](spark, docs, sf_dir))
    assert good.columns == docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = labels.join(good.select("doc_id"), "doc_id", "left_semi")
    assert marked.where("quality = 1 and toxic = 0").count() >= 0.97 * labels.where("quality = 1 and toxic = 0").count()
    assert marked.where("quality = 0 or toxic = 1").count() <= 0.3 * labels.where("quality = 0 or toxic = 1").count()

    lines = checkpointed(stages["lines"](spark, good, sf_dir))
    before = {r["doc_id"]: r["text"] for r in good.collect()}
    gone = {(list(sorted(before))[i], k) for i, k in brute_lines(sorted(before.items()), 1, (10, 40))}
    after = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert after == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before.items()}
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0

    # without the line stage before it, there are copies to find
    unique = checkpointed(stages["near_duplicates"](spark, good, sf_dir))
    root, _ = brute_components(list(before.items()), 5)
    assert {r["doc_id"] for r in unique.collect()} == {i for i, c in root.items() if i == c}

    clean = checkpointed(stages["personal_data"](spark, unique, sf_dir))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert not any(seeds_of(t) for t in texts.values())
    assert all(texts[i] == before[i] for i in texts if not seeds_of(before[i]) and not any(f"<{k.upper()}>" in texts[i] for k in pii.ALL_KINDS))

    packed = stages["packing"](spark, clean, sf_dir)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_empty_and_odd(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "x", 0)], docs.schema)).withColumn("gone", F.lit(1))
    for frame in (docs.where("false"), rows):
        out = frame
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf_dir)
        assert (out.count() > 0) == (frame is rows)


def test_run_leaves_its_input_alone(spark, sf_dir, tmp_path):
    """The input's folder looks like one of the pipeline's own; the sequences hold the cleaned texts."""
    place = tmp_path / "tarn-x"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(3, "an own text", "en", "s", 0), (None, None, "en", "s", 0)], docs.schema)
    docs.where("doc_id < 60").unionByName(odd).write.parquet(f"{place}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{place}/labels.parquet")
    before, shared = sorted(p.name for p in place.rglob("*")), set(os.listdir(shared_folder(spark)))
    packed = corpus_pipeline.run(spark, str(place)).collect()
    assert sorted(p.name for p in place.rglob("*")) == before
    assert not [n for n in set(os.listdir(shared_folder(spark))) - shared if n.startswith("tarn-")]

    clean = spark.read.parquet(f"{place}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        clean = checkpointed(stage(spark, clean, str(place)))
    sequences = defaultdict(dict)
    for r in packed:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]][r["offset"]] = r
    pieces = defaultdict(dict)
    for placed in sequences.values():
        at = 0
        for offset in sorted(placed):
            r = placed[offset]
            assert offset == at
            at += r["length"]
            pieces[r["doc_id"], r["row"]][r["piece"]] = r["ids"]
        assert at <= 1024
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = []
    for (doc_id, _), found in pieces.items():
        ids = [i for k in sorted(found) for i in found[k]]
        assert ids[-1] == 2
        got.append((doc_id, library.decode(ids[:-1], skip_special_tokens=False)))
    assert sorted(got, key=str) == sorted(((r["doc_id"], r["text"] or "") for r in clean.collect()), key=str)


def test_a_failing_stage_leaves_nothing(spark, sf_dir, monkeypatch):
    def fails(spark, docs, sf_dir):
        return docs.withColumn("text", F.raise_error(F.lit("stage")).cast("string"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda spark, docs, sf_dir: docs), ("second", fails), *corpus_pipeline.STAGES[2:]])
    shared = {n for n in os.listdir(shared_folder(spark)) if n.startswith("tarn-")}
    with pytest.raises(Exception, match="stage"):
        corpus_pipeline.run(spark, sf_dir)
    assert {n for n in os.listdir(shared_folder(spark)) if n.startswith("tarn-")} == shared
