"""Stateful streams: the same rows however input is cut, restarts from a checkpoint, state that ends."""

import json
import random
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.streaming import machines
from tarn.streaming.machines import DeltaFold, EventDecoder, SyncMachine, SyncRules


def test_events_are_the_same_wherever_chunks_are_cut():
    body = "event: x\r\ndata: {\"a\": \"ü€😀\"}\r\n\r\n: note\ndata: one\ndata: two\n\ndata:three\r\rdata: [DONE]\n\n".encode()
    whole = EventDecoder().feed(body)
    assert whole == ['{"a": "ü€😀"}', "one\ntwo", "three", "[DONE]"]
    for size in range(1, len(body)):
        for first in range(size):
            d, out = EventDecoder(), []
            cuts = [body[:first], *(body[i : i + size] for i in range(first, len(body), size))]
            for c in cuts:
                out += d.feed(c)
            assert out == whole and (d.rest, d.data) == (b"", [])


def test_deltas_fold():
    text = "a <think>of it</think> b <thinking>more</thinking> c"
    for size in range(1, len(text)):
        f = DeltaFold()
        for i in range(0, len(text), size):
            f.add(text[i : i + size], [{"index": 1, "id": "x" if i == 0 else None, "name": "f", "arguments": str(i % 10)}])
        assert f.whole()[:2] == ("a  b  c", "of itmore") and f.whole()[2][0]["id"] == "x"
    assert machines.delta_of("nonsense") is None and machines.delta_of('{"choices": []}') is None
    assert machines.delta_of('{"choices":[{"delta":{"content":"Hello"}}]}') == ("Hello", [])


def test_sync_machine():
    rules = SyncRules(quiet=10, backoff=100, retries=2, most=4)
    m = SyncMachine()
    assert m.advance([(0, "a", 0), (5, "b", 0)], 14, rules) == []
    assert m.advance([], 15, rules) == [(15, 0, 2, "FullySynced")]
    assert m.advance([(100, "a", 1)], 1000, rules) == [(110, 0, 1, "Retrying"), (210, 1, 1, "FullySynced")]
    assert m.advance([(2000, "a", 9)], 9000, rules) == [(2010, 0, 1, "Retrying"), (2110, 1, 1, "Retrying"), (2310, 2, 1, "Failed")]
    assert m.advance([(9001, "b", 1), (9050, "c", 0)], 9100, rules) == [(9011, 0, 2, "Retrying"), (9060, 0, 3, "FullySynced")]  # what failed waits on
    full = SyncMachine()
    assert full.advance([(i, f"p{i}", 0) for i in range(5)], 100, rules) == [(14, 0, 2, "FullySynced")]  # of five the oldest two stay


def start(spark, make, source, place, schema):
    df = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    with machines.keyed_state(spark):
        q = df.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/rows"), q


def put(spark, rows, schema, path, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)


CHUNKS = "stream_id long, seq long, chunk binary"


def test_streams_of_chunks_end(spark, tmp_path):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(6):
        events = [json.dumps({"i": i, "t": "ü€" * rng.randrange(4)}) for i in range(rng.randrange(1, 6))]
        body = "".join(f"data: {e}\r\n\r\n" for e in events).encode() + b"data: [DONE]\n\n"
        want[s] = events
        size = rng.randrange(1, 9)
        rows += [(s, k, body[i : i + size]) for k, i in enumerate(range(0, len(body), size))]
    rng.shuffle(rows)
    source, place = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, rows[::2], CHUNKS, source)
    first, q = start(spark, machines.sse_stream, source, place, CHUNKS)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] > 0
    put(spark, rows[1::2], CHUNKS, source)
    got, q = start(spark, machines.sse_stream, source, place, CHUNKS)  # goes on from the checkpoint
    assert {s: [r["data"] for r in sorted(got.where(f"stream_id = {s}").collect(), key=lambda r: r["n"])] for s in want} == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_answers_are_given_once(spark, tmp_path):
    call = "array<struct<index:int,id:string,name:string,arguments:string>>"
    schema = f"stream_id long, seq long, content string, tool_calls {call}, final boolean"
    rows = [(1, 0, "<thi", None, False), (1, 1, "nk>x</think>y", [(0, "c", "f", "{")], False), (1, 2, None, [(0, None, None, "}")], True), (2, 0, "open", None, None), (3, 1, "b", None, True)]
    source, place = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, rows[::-1], schema, source)
    got, _ = start(spark, machines.answers, source, place, schema)
    assert [tuple(r)[:3] for r in got.collect()] == [(1, "y", "x")] and got.first()["tool_calls"][0]["arguments"] == "{}"
    put(spark, [(3, 0, "a", None, False), (2, 1, "ed", None, True)], schema, source)
    got, q = start(spark, machines.answers, source, place, schema)
    assert sorted((r["stream_id"], r["content"]) for r in got.collect()) == [(1, "y"), (2, "opened"), (3, "ab")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_syncs_do_not_depend_on_batches(spark, tmp_path, parts):
    rng = random.Random(2)
    rows = sorted((rng.randrange(3), f"p{rng.randrange(9)}", rng.randrange(200_000), rng.choice([0, 0, 1, 3, 5])) for _ in range(300))
    rows.sort(key=lambda r: r[2])
    rules = SyncRules(quiet=400_000_000, backoff=300_000_000, retries=2)
    frame = [(f"r{r}", p, datetime.fromtimestamp(t, UTC), f) for r, p, t, f in rows]
    schema = "repo string, path string, ts timestamp, failures int"
    source, place = str(tmp_path / "in"), str(tmp_path / "out")
    got = None
    for k in range(parts):
        part = frame[k * len(frame) // parts : (k + 1) * len(frame) // parts]
        rng.shuffle(part)
        put(spark, part, schema, source)
        got, q = start(spark, lambda df: machines.syncs(df, rules), source, place, schema)
    mark = max(t for *_, t, _ in rows) * 1_000_000 - 600_000_000
    want = set()
    for repo in range(3):
        changes = [(t * 1_000_000, p, f) for r, p, t, f in sorted(rows, key=lambda r: (r[2], r[1])) if r == repo and t * 1_000_000 <= mark]
        want |= {(f"r{repo}", pd.Timestamp(at, unit="us"), *x) for at, *x in SyncMachine().advance(changes, mark, rules)}
    assert {(r["repo"], pd.Timestamp(r["us"], unit="us"), r["attempt"], r["changes"], r["state"]) for r in got.withColumn("us", F.unix_micros("at")).collect()} == want
    assert got.select(F.count_distinct("state")).first()[0] == 3


def test_syncs_read_a_slot_at_a_time(monkeypatch):
    """A repository's changes are held in packs by time and read back one slot after another, with the same attempts."""

    class Value(dict):
        exists, get, clear = (lambda s: "v" in s), (lambda s: s["v"]), (lambda s: s.pop("v", None))
        update = lambda s, v: s.__setitem__("v", v)

    class Map(dict):
        read = ()
        updateValue, removeKey, keys = dict.__setitem__, dict.__delitem__, (lambda s: list(dict.keys(s)))  # noqa: N815

        def getValue(self, k):  # noqa: N802
            self.read += (k[0],)
            return self[k]

    class Handle:
        getMapState, getValueState = (lambda s, *a: Map()), (lambda s, *a: Value())  # noqa: N815
        registerTimer = lambda s, t: timers.append(t)  # noqa: E731, N815

    timers, now = [], [0]
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda s: now[0]})()
    rng = random.Random(4)
    rules = SyncRules(quiet=900_000_000, backoff=600_000_000, retries=2)
    changes = [(rng.randrange(40 * machines.SLOT), f"p{rng.randrange(9)}", rng.choice([0, 0, 2])) for _ in range(400)]
    pdfs = [pd.DataFrame({"ts": pd.to_datetime([c[0] for c in changes[i::4]], unit="us"), "path": [c[1] for c in changes[i::4]], "failures": [c[2] for c in changes[i::4]]}) for i in range(4)]
    p = machines.SyncProcessor("repo", rules)
    p.init(Handle())
    assert list(p.handleInputRows(("r",), iter(pdfs), clock)) == []
    got = []
    for at in (10.5, 39, 60):
        now[0] = int(at * machines.SLOT // 1000)
        got += [tuple(r) for out in p.handleExpiredTimer(("r",), clock, None) for r in out[["at", "attempt", "changes", "state"]].itertuples(index=False)]
    want = SyncMachine().advance(sorted(changes), now[0] * 1000, rules)
    assert [(t.value // 1000, *x) for t, *x in got] == want
    assert list(p.early.read) == sorted(p.early.read) and len(set(p.early.read)) == 40  # one slot after another
    assert not p.early and not p.packs.exists()
