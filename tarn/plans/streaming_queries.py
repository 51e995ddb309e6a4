"""Streaming jobs run over a table's files to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.register import query
from tarn.session import checkpointed, folder, table
from tarn.streaming import jobs, machines


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _appended(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    with folder(spark, f"stream-{what}") as place:
        return checkpointed(jobs.to_table(df, f"{place}/rows", f"{place}/state"))


def _kept(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """``_appended`` for streams of ``machines``."""
    with machines.keyed_state(spark):
        return _appended(spark, df, what)


# what a stream has closed when its input ends: the watermark is ten minutes behind the last event, in whole milliseconds
_MARK = "mark as (select (epoch_us(max(ts)) // 1000 - 600000) * 1000 m from events)"


@query(f"""with {_MARK}, e as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w > 3600000000, true)::int fresh from events window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by user_id order by ts) burst from e)
    select user_id, arg_max(event_type, ts) event_type, min(ts) first_ts, max(ts) last_ts, count(*) n from s, mark group by user_id, burst, m having epoch_us(max(ts)) + 3600000000 <= m""")
def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, jobs.debounce(_events(spark, sf_dir), "user_id", "ts", "event_type", "1 hour"), "debounce")


@query("select event_type as by_type, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as start, count(*) n from events group by all")
def windowed_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = jobs.windowed_counts(_events(spark, sf_dir), "ts", "event_type", "1 day")
    with folder(spark, "stream-counts") as place:
        return checkpointed(jobs.latest_table(counts, place).select(F.col("event_type").alias("by_type"), "start", "n"))


@query(f"""with {_MARK}, e as (select user_id, epoch_us(ts) t, lag(epoch_us(ts)) over w before, lead(epoch_us(ts)) over w after from events window w as (partition by user_id order by ts))
    select user_id, 'Active' status, make_timestamp(t) as at from e where before is null or t - before > 1800000000
    union all select user_id, 'Paused', make_timestamp(t + 1800000000) from e where after - t > 1800000000
    union all select user_id, 'Paused', make_timestamp(t + 1800000000) from e, mark where after is null and (t // 1000 + 1800000) * 1000 < m""")
def inactivity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, jobs.inactivity(_events(spark, sf_dir), "user_id", "ts"), "inactivity")


@query("select conv_id stream_id, string_agg(coalesce(text, ''), '' order by turn) as content from conversations group by conv_id")
def delta_accumulate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as deltas, each conversation's last one final."""
    turns = _stream(spark, sf_dir, "conversations")
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    deltas = turns.join(last, "conv_id").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("content"), F.lit(None).cast("array<struct<index:int,id:string,name:string,arguments:string>>").alias("tool_calls"), (F.col("turn") == F.col("last")).alias("final"))
    return _kept(spark, machines.answers(deltas), "deltas").select("stream_id", "content")


@query("""select conv_id * 1000 + turn stream_id, k n, case k when 0 then '{"turn":' || turn || '}' else 'say' || chr(10) || coalesce(text, '') end as data
    from conversations, range(2) r(k) where not contains(coalesce(text, ''), chr(10)) and not contains(coalesce(text, ''), chr(13))""")
def sse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one line as streams of bytes, cut into pieces of five."""
    text = F.coalesce("text", F.lit(""))
    turns = _stream(spark, sf_dir, "conversations").where(~text.contains("\n") & ~text.contains("\r"))
    body = F.concat(F.lit('event: x\r\ndata: {"turn":'), F.col("turn"), F.lit("}\r\n\r\ndata: say\ndata: "), text, F.lit("\n\ndata: [DONE]\n\n")).cast("binary")
    cut = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), body.alias("body"))
    pieces = cut.select("stream_id", "body", F.explode(F.sequence(F.lit(0), ((F.octet_length("body") - 1) / 5).cast("int"))).alias("seq"))
    chunks = pieces.select("stream_id", "seq", F.substring("body", F.col("seq") * 5 + 1, F.lit(5)).alias("chunk"))
    return _kept(spark, machines.sse_stream(chunks), "events")


_QUIET, _BACK, _RETRIES = 1800, 900, 2


@query(f"""with {_MARK}, e as (select 'r' || user_id % 7 repo, 'p' || user_id path, epoch_us(ts) t, (event_type = 'error' and value > 8)::int f from events, mark where epoch_us(ts) <= m),
    b as (select *, (t - coalesce(lag(t) over (partition by repo order by t), -9000000000000000) > {_QUIET * 10**6})::int fresh from e), n as (select *, sum(fresh) over (partition by repo order by t, path) burst from b),
    bursts as (select repo, burst, min(t) first, max(t) + {_QUIET * 10**6} due, sum(f)::bigint f from n group by all),
    ahead as (select *, lead(first) over (partition by repo order by burst) next from bursts),
    tries as (select *, unnest(range(least(f, {_RETRIES}) + 1)) i from ahead),
    made as (select *, due + {_BACK * 10**6} * (pow(2, i)::bigint - 1) a from tries), done as (select made.* from made, mark where a <= m and (next is null or a < next)),
    good as (select repo, burst, max((i = f)::int) ok from done group by all), spans as (select ahead.repo, ahead.burst, sum(coalesce(ok, 0)) over (partition by ahead.repo order by ahead.burst) - coalesce(ok, 0) since from ahead left join good using (repo, burst)),
    sizes as (select x.repo, x.burst, count(distinct n.path) changes from spans x join spans y on x.repo = y.repo and x.since = y.since and y.burst <= x.burst join n on n.repo = y.repo and n.burst = y.burst group by all)
    select repo, make_timestamp(a) as at, i::int attempt, changes::int changes, case when i = f then 'FullySynced' when i = {_RETRIES} then 'Failed' else 'Retrying' end state from done join sizes using (repo, burst)""")
def sync_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that sync after half an hour of quiet, with retries while errors of the burst last."""
    u = F.col("user_id")
    changes = _events(spark, sf_dir).select(F.concat(F.lit("r"), u % 7).alias("repo"), F.concat(F.lit("p"), u).alias("path"), "ts", ((F.col("event_type") == "error") & (F.col("value") > 8)).cast("int").alias("failures"))
    rules = machines.SyncRules(_QUIET * 10**6, _BACK * 10**6, _RETRIES, 10**9)
    return _kept(spark, machines.syncs(changes, rules), "syncs")


_TURN = "select conv_id, turn, case turn % 3 when 0 then 'a <think>of ' || turn || '</think> b' when 1 then '<thinking>more' else '</thinking>c' || turn end x from conversations"


@query(f"""with t as ({_TURN}), w as (select conv_id, string_agg(x, '' order by turn) x from t group by conv_id),
    c as (select conv_id, turn % 2 i, string_agg('{{' || turn || '}}', '' order by turn) arguments, min(turn) f from conversations group by conv_id, turn % 2)
    select w.conv_id stream_id, regexp_replace(x, '(?s)<think(?:ing)?>.*?(?:</think(?:ing)?>|\\z)', '', 'g') as content,
    array_to_string(regexp_extract_all(x, '(?s)<think(?:ing)?>(.*?)(?:</think(?:ing)?>|\\z)', 1), '') thinking, (select string_agg(i || ':f' || f || ':' || arguments, ';' order by i) from c where c.conv_id = w.conv_id) calls from w""")
def delta_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    text = F.when(turn % 3 == 0, F.concat(F.lit("a <think>of "), turn, F.lit("</think> b"))).when(turn % 3 == 1, "<thinking>more").otherwise(F.concat(F.lit("</thinking>c"), turn))
    call = F.array(F.struct((turn % 2).cast("int").alias("index"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("f"), turn).alias("name"), F.concat(F.lit("{"), turn, F.lit("}")).alias("arguments")))
    whole = jobs.accumulate(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), turn.alias("seq"), text.alias("content"), call.alias("tool_calls")))
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat_ws(":", c["index"], c["name"], c["arguments"])), ";")
    return whole.select("stream_id", "content", "thinking", calls.alias("calls"))


@query("""with l as (select conv_id, turn, unnest(string_split_regex('event: x' || chr(13) || chr(10) || 'data: ' || turn || chr(10) || chr(10) || 'data:[DONE]' || chr(10) || 'data:  y ' || role, '\r?\n')) l from conversations)
    select conv_id, turn, trim(substr(l, 6)) as data from l where starts_with(l, 'data:') and trim(substr(l, 6)) not in ('', '[DONE]')""")
def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("event: x\r\ndata: "), F.col("turn"), F.lit("\n\ndata:[DONE]\ndata:  y "), F.col("role"))
    return jobs.sse_events(table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("value"))).drop("line")


@query("""select a.user_id, a.event_id, b.event_id event_id_after from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour""")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    pairs = jobs.pair_streams(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", "ts", "1 hour")
    return _appended(spark, pairs.select("user_id", "event_id", "event_id_after"), "pairs")


@query("""with c as (select 'r' || user_id % 5 repo, 'p' || user_id path, ts, event_type from events) select repo, path, event_type change_type, ts from c qualify row_number() over (partition by repo, path order by ts desc, event_type desc) = 1""")
def sync_batches_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    changes = _events(spark, sf_dir).select(F.concat(F.lit("r"), u % 5).alias("repo"), F.concat(F.lit("p"), u).alias("path"), F.col("event_type").alias("change_type"), "ts")
    with folder(spark, "stream-sync") as place:
        jobs.sync_batches(changes, lambda batch, epoch: batch.write.mode("append").parquet(f"{place}/rows"), f"{place}/state").trigger(availableNow=True).start().awaitTermination()
        return checkpointed(jobs.last_changes(spark.read.parquet(f"{place}/rows")))
