"""Stateful streams with timers and keyed lists: repositories that sync, server-sent events, deltas of answers.

Each has a plain machine (a small class that is fed in order) and a processor that keeps it for each key, puts what comes in
order, and drops the state when a key is done. Results do not depend on how rows are dealt to micro-batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that these processors need, for streams started in the block."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


# repositories ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SyncRules:
    """Microseconds of quiet before a sync and of the first back-off (doubled each time), retries, changes that are held."""

    quiet: int = 2_000_000
    backoff: int = 60_000_000
    retries: int = 3
    most: int = 1000


@dataclass
class SyncMachine:
    """A repository: changes that wait (the last time of each path), the next attempt, and how far attempts have come.

    A change makes the next attempt due after a time of quiet. An attempt fails while it is no later than the failures that
    the burst's changes carry; it is repeated after a back-off. A success clears what waits. A new change cancels outstanding
    retries; what waits stays. When more than ``most`` paths wait, the newest half goes (the rule of the watcher mirrored).
    """

    pending: dict[str, int] = field(default_factory=dict)
    due: int | None = None
    attempt: int = 0
    failures: int = 0

    def change(self, at: int, path: str, failures: int, rules: SyncRules) -> None:
        if self.attempt or self.due is None:  # a new burst
            self.attempt = self.failures = 0
        self.pending[path] = max(at, self.pending.get(path, at))
        if len(self.pending) > rules.most:
            oldest = sorted(self.pending.items(), key=lambda x: (x[1], x[0]))
            self.pending = dict(oldest[: rules.most // 2])
        self.failures += failures
        self.due = at + rules.quiet

    def attempts(self, before: int, rules: SyncRules) -> Iterator[tuple[int, int, int, str]]:
        """(at, attempt, changes, state) of the attempts that are due before a time."""
        while self.due is not None and self.due < before:
            at, n, tried = self.due, len(self.pending), self.attempt
            if tried >= self.failures:
                self.pending, self.due, self.attempt, state = {}, None, 0, "FullySynced"
            elif tried >= rules.retries:
                self.due, self.attempt, state = None, 0, "Failed"
            else:
                self.due, self.attempt, state = at + rules.backoff * 2**tried, tried + 1, "Retrying"
            yield at, tried, n, state

    def advance(self, changes: list[tuple[int, str, int]], now: int, rules: SyncRules) -> list[tuple[int, int, int, str]]:
        """Applies changes (in order, none after ``now``) and all attempts up to ``now``."""
        out = []
        for at, path, failures in changes:
            out += self.attempts(at, rules)
            self.change(at, path, failures, rules)
        return out + list(self.attempts(now + 1, rules))


#: Microseconds of changes that are read back together.
SLOT = 3_600_000_000
SYNCED = "at timestamp, attempt int, changes int, state string"


class SyncProcessor(StatefulProcessor):
    """Holds changes until the watermark has passed them, then lets the machine see them in order.

    They are held in packs: those of a slot of time that came in one Arrow batch. Slots are read one after another, so Python
    holds one batch, or the changes of one slot, of a repository at a time.
    """

    def __init__(self, key: str, rules: SyncRules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "slot long, pack long", "changes string")
        self.packs = handle.getValueState("packs", "n long")
        self.machine = handle.getValueState("machine", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, first = self.packs.get()[0] if self.packs.exists() else 0, None
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            slots = at[order] // SLOT
            for own in np.split(order, np.flatnonzero(np.diff(slots)) + 1):
                some = pdf.iloc[own]
                self.early.updateValue((int(at[own[0]] // SLOT), n), (json.dumps([at[own].tolist(), some["path"].tolist(), [int(f) for f in some["failures"]]]),))
            n, first = n + 1, int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self.packs.update((n,))
            self.handle.registerTimer(max(first // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs() * 1000
        machine = SyncMachine(**json.loads(self.machine.get()[0])) if self.machine.exists() else SyncMachine()
        packs: dict[int, list[int]] = {}
        for slot, n in self.early.keys():
            packs.setdefault(slot, []).append(n)
        following = min((slot * SLOT for slot in packs if slot * SLOT > now), default=None)
        for slot in sorted(slot for slot in packs if slot * SLOT <= now):
            held = sorted(x for n in packs[slot] for x in zip(*json.loads(self.early.getValue((slot, n))[0])))
            ready, later = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
            for n in packs[slot]:
                self.early.removeKey((slot, n))
            if later:  # of the slot that the watermark is in
                self.early.updateValue((slot, packs[slot][0]), (json.dumps(list(zip(*later))),))
                following = later[0][0]
            if made := machine.advance(ready, min(now, (slot + 1) * SLOT - 1), self.rules):
                yield self.frame(key[0], made)
        if made := machine.advance([], now, self.rules):
            yield self.frame(key[0], made)
        if following is None and self.packs.exists():
            self.packs.clear()
        if machine.due is None and not machine.pending:
            if self.machine.exists():
                self.machine.clear()  # nothing to remember of a repository that is in sync
        else:
            self.machine.update((json.dumps(asdict(machine)),))
        due = [x for x in (machine.due, following) if x is not None]
        if due:
            self.handle.registerTimer(max(-(-min(due) // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def frame(self, key, rows: list[tuple[int, int, int, str]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key] * len(rows), "at": pd.to_datetime([r[0] for r in rows], unit="us"), "attempt": [r[1] for r in rows], "changes": [r[2] for r in rows], "state": [r[3] for r in rows]})

    def close(self) -> None:
        pass


def syncs(changes: DataFrame, rules: SyncRules = SyncRules(), key: str = "repo", late: str = "10 minutes") -> DataFrame:
    """(repo, at, attempt, changes, state): the attempts to sync that a stream of ``changes`` (repo, path, ts, failures) leads to."""
    kind = changes.schema[key].dataType.simpleString()
    seen = changes.select(key, "path", "ts", F.col("failures").cast("int").alias("failures")).withWatermark("ts", late)
    return seen.groupBy(key).transformWithStateInPandas(SyncProcessor(key, rules), f"{key} {kind}, {SYNCED}", "append", "eventTime")


# server-sent events and deltas -----------------------------------------------------------------------------------------


@dataclass
class EventDecoder:
    """Data of server-sent events from bytes that are cut anywhere. An event ends with a blank line."""

    rest: bytes = b""
    data: list[str] = field(default_factory=list)

    def feed(self, chunk: bytes) -> list[str]:
        text, out = self.rest + chunk, []
        lines = re.split(rb"\r\n|\n|\r(?!\Z)", text)  # a last \r may be half of an end
        self.rest = lines.pop()
        for line in lines:
            if not line:
                if self.data:
                    out.append("\n".join(self.data))
                    self.data = []
            elif line.startswith(b"data:"):
                value = line[5:].decode("utf-8", "replace")
                self.data.append(value.removeprefix(" "))
        return out


THOUGHT = re.compile(r"(?s)<think(?:ing)?>(.*?)(?:</think(?:ing)?>|\Z)")


@dataclass
class DeltaFold:
    """What the deltas of one answer add up to: text, thinking (also where a tag is cut), calls of tools by their index."""

    text: str = ""
    calls: dict[str, dict[str, str]] = field(default_factory=dict)

    def add(self, content: str | None, calls) -> None:
        self.text += content or ""
        for c in calls if calls is not None else ():
            held = self.calls.setdefault(str(c["index"]), {"id": "", "name": "", "arguments": ""})
            held["id"] = held["id"] or c.get("id") or ""
            held["name"] = held["name"] or c.get("name") or ""
            held["arguments"] += c.get("arguments") or ""

    def whole(self) -> tuple[str, str, list[dict]]:
        calls = [{"index": int(i), "id": c["id"] or None, "name": c["name"] or None, "arguments": c["arguments"]} for i, c in sorted(self.calls.items(), key=lambda x: int(x[0]))]
        return THOUGHT.sub("", self.text), "".join(THOUGHT.findall(self.text)), calls


def delta_of(data: str) -> tuple[str | None, list[dict]] | None:
    """Content and tool calls of an event's JSON; None for what is no such JSON."""
    try:
        delta = json.loads(data)["choices"][0]["delta"]
        calls = [{"index": c["index"], "id": c.get("id"), **{k: (c.get("function") or {}).get(k) for k in ("name", "arguments")}} for c in delta.get("tool_calls") or [] if "index" in c]
        return delta.get("content"), calls
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return None


DONE = "[DONE]"
ANSWER = "content string, thinking string, tool_calls array<struct<index:int,id:string,name:string,arguments:string>>"


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``take`` in the order of ``seq`` (0, 1, ..); what comes early waits. A key that is done is forgotten."""

    columns: tuple[str, ...]
    waiting: str

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getMapState("early", "seq long", self.waiting)
        self.held = handle.getValueState("held", "next long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        following, state = self.held.get() if self.held.exists() else (0, "")
        if following < 0:
            return
        come = {int(r[0]): tuple(r[1:]) for pdf in rows for r in pdf[["seq", *self.columns]].itertuples(index=False, name=None)}
        machine, out, done = self.load(state), [], False
        while not done:
            if following in come:
                row = come.pop(following)
            elif self.early.containsKey((following,)):
                row = tuple(self.early.getValue((following,)))
                self.early.removeKey((following,))
            else:
                break
            following += 1
            done = self.take(machine, row, out)
        if done:
            for k in list(self.early.keys()):
                self.early.removeKey(k)
            self.held.clear()
        else:
            for seq, row in come.items():
                if seq > following:
                    self.early.updateValue((seq,), row)
            self.held.update((following, self.save(machine)))
        if out:
            yield self.frame(key[0], out)

    def close(self) -> None:
        pass


class EventsProcessor(InOrder):
    """Events of chunks: a row for each, in order."""

    columns, waiting = ("chunk",), "chunk binary"

    def load(self, state):
        kept = json.loads(state) if state else {"rest": "", "data": [], "n": 0}
        return {"decoder": EventDecoder(bytes.fromhex(kept["rest"]), kept["data"]), "n": kept["n"]}

    def save(self, m) -> str:
        return json.dumps({"rest": m["decoder"].rest.hex(), "data": m["decoder"].data, "n": m["n"]})

    def take(self, m, row, out) -> bool:
        for data in m["decoder"].feed(bytes(row[0] or b"")):
            if data.strip() == DONE:
                return True
            out.append((m["n"], data))
            m["n"] += 1
        return False

    def frame(self, key, out) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key] * len(out), "n": [n for n, _ in out], "data": [d for _, d in out]})


class AnswersProcessor(InOrder):
    """Answers of deltas: one row for each that is final."""

    columns, waiting = ("content", "tool_calls", "final"), "content string, tool_calls string, final boolean"

    def load(self, state):
        return DeltaFold(**json.loads(state)) if state else DeltaFold()

    def save(self, fold) -> str:
        return json.dumps(asdict(fold))

    def take(self, fold, row, out) -> bool:
        content, calls, final = row
        fold.add(content, json.loads(calls) if calls else None)
        if final:
            out.append(fold.whole())
        return bool(final)

    def frame(self, key, out) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key], "content": [out[0][0]], "thinking": [out[0][1]], "tool_calls": [out[0][2]]})


def sse_stream(chunks: DataFrame, key: str = "stream_id") -> DataFrame:
    """(stream_id, n, data): the events of streams of bytes, from ``chunks`` (stream_id, seq from 0, chunk) cut anywhere, in any order.

    A stream ends with the event ``[DONE]``; nothing of it is kept then.
    """
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(key, F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    return rows.groupBy(key).transformWithStateInPandas(EventsProcessor(key), f"{key} {kind}, n long, data string", "append", "none")


def answers(deltas: DataFrame, key: str = "stream_id") -> DataFrame:
    """(stream_id, content, thinking, tool_calls): each answer once, when its final delta has come and none before it is missing.

    ``deltas``: stream_id, seq from 0, content, tool_calls, final. Only answers that are not final are kept as state.
    """
    kind = deltas.schema[key].dataType.simpleString()
    rows = deltas.select(key, F.col("seq").cast("long").alias("seq"), "content", F.to_json("tool_calls").alias("tool_calls"), F.coalesce("final", F.lit(False)).alias("final"))
    return rows.groupBy(key).transformWithStateInPandas(AnswersProcessor(key), f"{key} {kind}, {ANSWER}", "append", "none")
