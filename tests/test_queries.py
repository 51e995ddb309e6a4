"""Every registered query runs; those with SQL equal it."""

import re

import pytest

from tarn.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import connect, rows


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, db, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_only_parsers_have_no_sql():
    assert sorted(set(QUERIES) - set(ORACLE_SQL)) == ["code_chunk_rows", "message_bpe_tokens"]


def test_code_chunks_are_parts_of_their_files(spark, sf_dir):
    """Every chunk is whole lines of its file, no chunk comes twice, and declarations at the beginning of a line are in chunks."""
    import hashlib

    from tarn.plans.code_queries import source_files

    files = {r["file_path"]: r["text"] for r in source_files(spark, sf_dir).collect()}
    got = [tuple(r) for r in QUERIES["code_chunk_rows"](spark, sf_dir).select("file_path", "language", "start_line", "end_line", "element_type", "content").collect()]
    assert got and len(set(got)) == len(got)
    starts = {"python": r"^(?:async\s+)?def |^class ", "rust": r"^pub fn ", "go": r"^func |^type "}  # a last block of Ruby may lack its end
    covered = {}
    for path, language, first, last, kind, digest in got:
        lines = files[path].split("\n")
        assert 1 <= first <= last <= len(lines)
        whole = "\n".join(lines[first - 1 : last])
        owners = {x.split("{")[0].strip() for x in lines[:first] if x.startswith("impl")} if language == "rust" and kind == "function" else set()
        assert digest in {hashlib.sha256(c.encode()).hexdigest() for c in (whole, *(f"{o}\n...\n{whole}" for o in owners), *(f"{o} {{\n...\n{whole}" for o in owners))} or kind.startswith("fallback") or language in ("markdown", "vue", "yaml")
        covered.setdefault(path, set()).update(range(first, last + 1))
    for path, text in files.items():
        pattern = starts.get(path.rsplit(".", 1)[-1].replace("py", "python").replace("rs", "rust"))
        if pattern:
            assert all(i in covered.get(path, ()) for i, x in enumerate(text.split("\n"), 1) if re.match(pattern, x))


@pytest.mark.parametrize("name", ["debounce_stream", "windowed_counts_stream", "inactivity_stream", "delta_accumulate_stream", "stream_pairs"])
def test_streams_read_folders(spark, sf_dir, tmp_path, name):
    for table in ("events", "conversations"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) and rows(got) == rows(want)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
