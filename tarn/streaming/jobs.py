"""Structured Streaming jobs over event and message streams. State is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late events may come.
LATE = "10 minutes"


def debounce(events: DataFrame, key: str, ts: str, value: str, quiet: str = "2 seconds", late: str = LATE) -> DataFrame:
    """(key, value, first_ts, last_ts, n): one row per burst, with the value of its last event."""
    burst = events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, quiet))
    return burst.agg(F.max_by(value, ts).alias(value), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")).drop("session_window")


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """(start, end, by, n) in tumbling or sliding windows."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def inactivity(events: DataFrame, key: str, ts: str, idle_seconds: int = 1800, late: str = LATE) -> DataFrame:
    """(key, status, at): Active when a key appears or comes back, Paused when it has been idle for that long."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "status": ["Paused"], "at": [pd.Timestamp(last + idle_seconds * 1_000_000, unit="us")]})
            return
        times = sorted(int(t.value // 1000) for pdf in batches for t in pdf[ts])
        if not times:
            return
        rows = []
        last = state.get[0] if state.exists else None
        for t in times:
            if last is not None and t - last > idle_seconds * 1_000_000:
                rows.append(("Paused", last + idle_seconds * 1_000_000))
                last = None
            if last is None:
                rows.append(("Active", t))
            last = max(t, last or t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if rows:  # an empty frame has no types
            yield pd.DataFrame({key: [keys[0]] * len(rows), "status": [r[0] for r in rows], "at": [pd.Timestamp(r[1], unit="us") for r in rows]})

    kind = events.schema[key].dataType.simpleString()
    seen = events.select(key, ts).withWatermark(ts, late)
    return seen.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def sse_events(raw: DataFrame, text: str = "value") -> DataFrame:
    """Data of server-sent event lines, without blank ones and the closing ``[DONE]``."""
    lines = raw.select(*(c for c in raw.columns if c != text), F.posexplode(F.split(text, r"\r?\n")).alias("line", "_l")).where(F.col("_l").startswith("data:"))
    data = F.trim(F.substring("_l", 6, 1 << 30))
    return lines.withColumn("data", data).where((F.col("data") != "") & (F.col("data") != "[DONE]")).drop("_l")


DELTA = "content string, tool_calls array<struct<index:int,id:string,name:string,arguments:string>>"


def accumulate(deltas: DataFrame, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """(stream, content, thinking, tool_calls): deltas of each stream joined in order.

    ``deltas``: stream, seq, content, tool_calls. What stands in ``<think>`` or ``<thinking>`` is thinking; pieces of a
    tool call are joined by its index. Works on tables and, in update or complete mode, on streams.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.coalesce("content", F.lit("")).alias("content"), "tool_calls")))
    whole = deltas.groupBy(stream).agg(ordered.alias("d"))
    text = F.array_join(F.transform("d", lambda x: x["content"]), "")
    thought = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<think(?:ing)?>(.*?)(?:</think(?:ing)?>|\z)"), F.lit(1)), "")
    plain = F.regexp_replace(text, r"(?s)<think(?:ing)?>.*?(?:</think(?:ing)?>|\z)", "")
    calls = F.flatten(F.transform(F.filter("d", lambda x: x["tool_calls"].isNotNull()), lambda x: x["tool_calls"]))
    indices = F.array_sort(F.array_distinct(F.transform(calls, lambda c: c["index"])))

    def one(i):
        mine = F.filter(calls, lambda c: c["index"] == i)
        first = lambda f: F.get(F.filter(F.transform(mine, lambda c: c[f]), lambda x: x.isNotNull() & (x != "")), 0)
        return F.struct(i.alias("index"), first("id").alias("id"), first("name").alias("name"), F.array_join(F.transform(mine, lambda c: F.coalesce(c["arguments"], F.lit(""))), "").alias("arguments"))

    return whole.select(stream, plain.alias("content"), thought.alias("thinking"), F.transform(indices, one).alias("tool_calls"))


def sync_batches(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream writer that hands every batch, one row per path (the last change), to ``apply(batch, epoch)``."""

    def each(batch: DataFrame, epoch: int) -> None:
        apply(last_changes(batch), epoch)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)


def last_changes(changes: DataFrame) -> DataFrame:
    """(repo, path, change_type, ts): the last change of each path; of changes of one time the type that comes last by name."""
    last = F.max(F.struct("ts", "change_type"))
    return changes.groupBy("repo", "path").agg(last.alias("c")).select("repo", "path", "c.change_type", "c.ts")


def latest_table(df: DataFrame, path: str) -> DataFrame:
    """Runs a stream of whole results (complete mode) over what there is: the last batch's rows, as a table in ``path``."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    query = df.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is into Parquet files and reads them."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pair_streams(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Rows of two streams with the same key, the right one no earlier than the left one and no more than ``within`` after it.

    Columns of the right side get the ending ``_after``. Watermarks bound what either side remembers.
    """
    a = left.withWatermark(left_ts, late)
    b = right.select(*(F.col(c).alias(f"{c}_after") for c in right.columns)).withWatermark(f"{right_ts}_after", late)
    near = F.expr(f"{key} = {key}_after and {right_ts}_after >= {left_ts} and {right_ts}_after <= {left_ts} + interval {within}")
    return a.join(b, near)
