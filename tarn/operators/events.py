"""Event tables in batch: debouncing, gaps, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, ts: str, quiet: float, value: str) -> DataFrame:
    """The last event of each burst: an event with no follower of its key within ``quiet`` seconds."""
    w = W.partitionBy(key).orderBy(ts, value)
    following = F.lead(ts).over(w)
    gap = F.unix_micros(following) - F.unix_micros(ts)
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > int(quiet * 1e6))).drop("_gap")


def sessions(events: DataFrame, key: str, ts: str, gap: float) -> DataFrame:
    """(key, session, first, last, n): rows of a key that are no more than ``gap`` seconds apart."""
    w = W.partitionBy(key).orderBy(ts)
    new = F.coalesce(F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w)) > int(gap * 1e6), F.lit(True))
    numbered = events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def daily(events: DataFrame, ts: str) -> DataFrame:
    """(day, n, tokens) with 100 tokens for each event."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n")).withColumn("tokens", F.col("n") * 100)


def change_kind(name):
    """Create, modify or remove; null for others."""
    return F.when(name.rlike("(?i)^creat"), "create").when(name.rlike("(?i)^modif"), "modify").when(name.rlike("(?i)^(remove|delet)"), "remove")


def stuck(progress: DataFrame, key: str, ts: str, timeout: float) -> DataFrame:
    """(key, at, waited): places where nothing was reported for more than ``timeout`` seconds."""
    w = W.partitionBy(key).orderBy(ts)
    waited = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6
    return progress.withColumn("waited", waited).where(F.col("waited") > timeout).select(key, F.col(ts).alias("at"), F.round("waited", 6).alias("waited"))


def watched(path, patterns):
    """Whether a path is watched: no folder prefix (``dir/``), ``*.ext``, ``prefix*`` or (part of the) name excludes it."""
    out = F.lit(True)
    for p in patterns:
        if p.endswith("/"):
            hit = path.startswith(p) | path.contains("/" + p)
        elif p.startswith("*"):
            hit = path.endswith(p[1:])
        elif p.endswith("*"):
            hit = F.regexp_extract(path, "[^/]*$", 0).startswith(p[:-1])
        else:
            hit = (path == p) | path.endswith("/" + p)
        out = out & ~hit
    return out


def rfc3339(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def cached(files: DataFrame, cache: DataFrame, now, model: str, days: int = 7) -> DataFrame:
    """``files`` (path, modified, size) with ``hit``: whether the cache (path, model, hash, at) has them unchanged and fresh.

    The hash is modified * 31 + size.
    """
    found = files.join(cache.withColumnRenamed("hash", "_hash"), "path", "left")
    fresh = (F.col("model") == model) & (F.col("_hash") == F.col("modified") * 31 + F.col("size")) & (now - F.col("at") < F.make_dt_interval(F.lit(days)))
    return found.select("path", F.coalesce(fresh, F.lit(False)).alias("hit"))


def bounded_buffer(changes: DataFrame, key: str, ts: str, most: int = 1000) -> DataFrame:
    """Pending changes (one per key and path, the last) of keys whose buffer is not full; of a full one, the oldest half.

    A buffer is full when it holds ``most``; which half stays follows the watcher that this mirrors. Streams need no such
    bound: their state is held by watermarks.
    """
    last = changes.groupBy(key, "path").agg(F.max(ts).alias(ts))
    w = W.partitionBy(key)
    placed = last.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(ts, "path")))
    return placed.where((F.col("_n") < most) | (F.col("_at") <= most // 2)).drop("_n", "_at")


def sync_states(steps: DataFrame, key: str = "repo") -> DataFrame:
    """(key, state, level, message): where a repository's last sync ended.

    ``steps``: key, attempt, local_ok, has_remote, remote_ok, error (authentication, network or another word). Of several
    attempts the last counts; a repository whose local part failed has failed, whatever the remote did.
    """
    last = steps.groupBy(key).agg(F.max(F.struct("attempt", "local_ok", "has_remote", "remote_ok", "error")).alias("s")).select(key, "s.*")
    state = F.when(~F.col("local_ok"), "Failed").when(~F.col("has_remote"), "LocalOnly").when(F.col("remote_ok"), "FullySynced").otherwise("LocalIndexedRemoteFailed")
    level = F.when(F.col("state") == "FullySynced", "Success").when(F.col("state") == "LocalOnly", "Info").when(F.col("state") == "Failed", "Error").otherwise("Warning")
    why = F.when(F.col("error") == "authentication", "Authentication failed").when(F.col("error") == "network", "Network error").otherwise("Remote sync failed")
    message = F.when(F.col("state") == "Failed", F.coalesce("error", F.lit("Sync failed"))).when(F.col("state") == "LocalIndexedRemoteFailed", why).otherwise(F.col("state"))
    return last.withColumn("state", state).select(key, "state", level.alias("level"), message.alias("message"))


def sync_queue(requests: DataFrame, key: str = "repo", ts: str = "ts") -> DataFrame:
    """(key, ts, position): repositories that wait, each once, by their first request."""
    first = requests.groupBy(key).agg(F.min(ts).alias(ts)).withColumn("_hour", F.date_trunc("hour", ts))
    # places within an hour, behind those of all hours before: the window over all rows is one over hours
    before = W.orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    hours = first.groupBy("_hour").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).select(F.col("_hour").alias("_h"), "_base")
    placed = first.withColumn("_n", F.row_number().over(W.partitionBy("_hour").orderBy(ts, key))).join(hours, F.col("_hour").eqNullSafe(F.col("_h")))
    return placed.select(key, ts, (F.col("_base") + F.col("_n")).cast("int").alias("position"))
