"""Usage, sessions, debouncing and states over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import conversations as conv
from tarn.operators import events as ev
from tarn.operators import repositories
from tarn.plans.register import query
from tarn.session import table

NOW = "timestamp '2024-02-01 00:00:00'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a column without a zone reads as one: times are UTC
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""with h as (select hour(ts)::int as hour, count(*) n from events group by 1), a as (select x::int as hour, coalesce(n, 0) n from generate_series(0, 23) g(x) left join h on h.hour = x)
    select hour, n from a where n >= (select floor(max(n) * 8 / 10.0) from h)""")
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.peak_hours(_events(spark, sf_dir))


@query("select ts::date as day, count(*) n, count(*) * 100 tokens from events group by 1")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.daily(_events(spark, sf_dir), "ts")


@query(f"select user_id, count(*) filter (ts >= {NOW} - interval 7 days) n_recent from events group by user_id having count(*) filter (ts >= {NOW} - interval 7 days) > 5")
def trending_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.trending(_events(spark, sf_dir), "user_id", "ts", F.expr(NOW))


@query(f"""with u as (select user_id, case when user_id % 2 = 0 then 'Active' else 'Completed' end s, max(ts) last, user_id % 10 = 0 manual from events group by user_id)
    select user_id, case when manual then s when s = 'Active' and {NOW} - last > interval 30 minutes then 'Paused' when s = 'Completed' and {NOW} - last > interval 90 days then 'Archived' else s end status from u""")
def inactivity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last"))
    status = F.when(F.col("user_id") % 2 == 0, "Active").otherwise("Completed")
    return u.select("user_id", conv.status_after(status, F.col("last"), F.expr(NOW), F.col("user_id") % 10 == 0).alias("status"))


@query("""with w as (select *, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) gap from events) select event_id, user_id, event_type from w where gap is null or gap > 3600 * 1000000::bigint""")
def debounce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.debounce(_events(spark, sf_dir), "user_id", "ts", 3600, "event_id").select("event_id", "user_id", "event_type")


@query("""with w as (select user_id, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) > 21600 * 1000000::bigint)::int, 1) n from events),
    s as (select user_id, ts, sum(n) over (partition by user_id order by ts rows between unbounded preceding and current row) session from w)
    select user_id, session::bigint as session, min(ts) first_ts, max(ts) last_ts, count(*) n from s group by user_id, session""")
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(_events(spark, sf_dir), "user_id", "ts", 21600)


@query("select event_type, case when event_type = 'signup' then 'create' when event_type = 'purchase' then 'modify' when event_type = 'error' then 'remove' end kind, count(*) n from events group by all")
def event_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "purchase", "MODIFIED").when(F.col("event_type") == "error", "Removed").otherwise(F.col("event_type"))
    return _events(spark, sf_dir).groupBy("event_type", ev.change_kind(name).alias("kind")).agg(F.count("*").alias("n"))


@query("with w as (select event_type, ts, (epoch_us(ts) - epoch_us(lag(ts) over (partition by event_type order by ts))) / 1000000.0::double waited from events) select event_type, ts as at, round(waited, 6) waited from w where waited > 7200")
def progress_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stuck(_events(spark, sf_dir), "event_type", "ts", 7200)


@query("""with u as (select user_id id, min(ts) s, max(ts) e, 60 * (1 + user_id % 24) m from events group by user_id), r as (select id, s, e, m, unnest(generate_series(0, 9)) n from u)
    select id, n::int n, s + (n * m * 60) * interval 1 second as at from r where s + (n * m * 60) * interval 1 second <= e""")
def schedule_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), (60 * (1 + F.first("user_id") % 24)).alias("minutes"))
    return repositories.occurrences(u, 10)


@query("select event_id, ts + case event_id % 3 when 0 then interval 2 hours when 1 then interval 28 days else interval 60 days end nxt from events")
def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    k = F.col("event_id") % 3
    run = lambda n, unit: repositories.next_run(F.col("ts"), F.lit(n), unit)
    return e.select("event_id", F.when(k == 0, run(2, "hours")).when(k == 1, run(4, "weeks")).otherwise(run(2, "monthly")).alias("nxt"))


@query(f"select bucket, count(*) n from (select case when d <= 0 then 'Today' when d = 1 then 'Yesterday' when d < 7 then 'This Week' when d < 30 then 'This Month' else 'Older' end bucket from (select date_diff('day', ts::date, {NOW}::date) d from events)) group by bucket")
def recency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(conv.grouped_by_recency(F.col("ts"), F.expr(NOW)).alias("bucket")).agg(F.count("*").alias("n"))


@query("select event_type, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as start, count(*) n, round(sum(value), 4) total from events group by all")
def windowed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "1 day")
    return _events(spark, sf_dir).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("select (props::json->>'k')::bigint k, count(*) n from events group by 1")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))
