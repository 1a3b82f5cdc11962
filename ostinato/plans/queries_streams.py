"""Queries: the streaming jobs, each run over the stored events until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.plans.queries_interactions import _TRAIL, EVENT_SQL, analytics
from ostinato.plans.registry import ORACLES, query
from ostinato.plans.views import Tables
from ostinato.session import fresh_path
from ostinato.streaming import ingest, limiter, monitor
from ostinato.streaming.state import KeyedTable


def event_stream(t: Tables):
    """The events file as a stream."""
    schema = t.base("events").schema
    s = ingest.file_stream(t.spark, t.folder, schema, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def closed(t: Tables, stream):
    """The stream and a closing row long after it, as a finished log is replayed: it moves the watermark past all events."""
    row = t.spark.range(1).select(*[(F.lit("2200-01-01").cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in stream.schema])
    path = fresh_path(t.spark, "closing")
    row.write.parquet(path)
    return stream.unionByName(ingest.file_stream(t.spark, path, stream.schema))


def drained(t: Tables, stream, name: str):
    out = fresh_path(t.spark, name)
    ingest.drain(stream, out, fresh_path(t.spark, f"{name}-checkpoint"))
    return t.spark.read.schema(stream.schema).parquet(out)


@query("r1_violation_alerts", "", f"SELECT event_id, user_id FROM ({_TRAIL.format(kind='error', n=2)})")
def _(t: Tables):
    s = event_stream(t).filter("event_type = 'error'")
    return drained(t, monitor.repeated_violation_stream(closed(t, s), 2, 360, client="user_id"), "violations").select("event_id", "user_id")


@query("r2_brute_force_alerts", "", f"SELECT event_id, user_id FROM ({_TRAIL.format(kind='signup', n=3)})")
def _(t: Tables):
    s = event_stream(t).filter("event_type = 'signup'")
    return drained(t, monitor.brute_force_stream(closed(t, s), 3, 360, client="user_id"), "failures").select("event_id", "user_id")


BUCKET_SQL = """WITH RECURSIVE ev AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 b AS (SELECT user_id, event_id, t, i, true AS allowed, CAST(1.0 AS DOUBLE) AS tokens, t AS last, CAST(1 AS INT) AS remaining, CAST(NULL AS BIGINT) AS retry_after FROM ev WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, n >= 1, CASE WHEN n >= 1 THEN n - 1 ELSE tokens END, CASE WHEN n >= 1 THEN e.t ELSE last END,
   CAST(CASE WHEN n >= 1 THEN floor(n - 1) ELSE 0 END AS INT), CASE WHEN n < 1 THEN CAST(floor((1 - n) * (21600 / 2)) AS BIGINT) END
  FROM (SELECT e.*, b.tokens, b.last, least(2.0::DOUBLE, b.tokens + (e.t - b.last) * (2.0::DOUBLE / 21600)) AS n FROM b JOIN ev e ON e.user_id = b.user_id AND e.i = b.i + 1) e)
SELECT event_id, user_id, allowed, remaining, retry_after FROM b"""


@query("r4_token_bucket_replay", "", BUCKET_SQL)
def _(t: Tables):
    return limiter.replay(t.events, 2, 21600, "user_id").select("event_id", "user_id", "allowed", "remaining", "retry_after")


@query("r4_token_bucket_stream", "", BUCKET_SQL)
def _(t: Tables):
    s = limiter.limit_stream(closed(t, event_stream(t)), 2, 21600, "user_id")
    return drained(t, s, "limits").select("event_id", "user_id", "allowed", "remaining", "retry_after")


@query("r5_keyed_upserts", "", """SELECT user_id, k, event_type, event_id FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, event_id FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS INT) ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'""")
def _(t: Tables):
    s = event_stream(t).select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "ts", "event_id", "event_type")
    table = KeyedTable(t.spark, fresh_path(t.spark, "saved"), ["user_id", "k"], ["ts", "event_id"], "event_type = 'error'")
    table.follow(s, fresh_path(t.spark, "saved-checkpoint"), availableNow=True).awaitTermination()
    return table.current().select("user_id", "k", "event_type", "event_id")


@query("r7_ingest_events", "", EVENT_SQL)
def _(t: Tables):
    class Streamed(Tables):
        events = property(lambda self: event_stream(self))

    s = ingest.ingest(analytics(Streamed(t.spark, t.folder)))
    return drained(t, s, "analytics").select("event_id", "event_type", "platform", "work_id", "query", "result_count")


@query("r3_hourly_stream", "", """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS "start", CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS rate_limit_violations,
 CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS auth_failures FROM events GROUP BY 1""")
def _(t: Tables):
    out = drained(t, monitor.hourly_summary_stream(closed(t, event_stream(t)), "error", "signup", "event_type"), "hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rate_limit_violations", "auth_failures")


@query("r8_windowed_stream", "", """SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS "start", event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def _(t: Tables):
    # windows are final, and emitted, once the watermark has passed them
    out = drained(t, ingest.count_stream(closed(t, event_stream(t))), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("r8_session_stream", "", ORACLES["r8_session_counts"])
def _(t: Tables):
    out = drained(t, ingest.session_stream(closed(t, event_stream(t)), "2 hours"), "sessions")
    return out.filter("user_id IS NOT NULL").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("r8_funnel_stream", "", ORACLES["r8_funnel"])
def _(t: Tables):
    e = event_stream(t).withColumn("work_id", F.get_json_object("props", "$.k").cast("bigint"))
    found = drained(t, ingest.funnel_stream(closed(t, e), horizon="40 days", then_watermark="1 hour"), "funnel")
    return ingest.funnel_figures(found).withColumn("conversion_rate", F.round("conversion_rate", 6))
