"""Queries: interactions and monitoring in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import interactions as it
from ostinato.operators import monitor
from ostinato.plans.registry import query
from ostinato.plans.views import Tables

LATEST = {"latest": """SELECT user_id, work_id, saved_at, seq, rank, rating, vibe FROM history QUALIFY row_number() OVER (PARTITION BY user_id, work_id ORDER BY saved_at DESC, seq DESC, rank DESC, rating DESC, vibe DESC) = 1"""}


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def latest_saved(t: Tables):
    cols = ["user_id", "work_id", "saved_at", "seq", "rank", "rating", "vibe"]
    return it.latest_per_key(t.history.select(*cols), ["user_id", "work_id"], ["saved_at", "seq", "rank"], F.col("rating") == -1)


@query("w4_latest_saved", "history", "SELECT user_id, work_id, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at, seq, rank, vibe FROM latest WHERE rating <> -1", LATEST)
def _(t: Tables):
    return latest_saved(t).select("user_id", "work_id", _text("saved_at"), "seq", "rank", "vibe")


@query("w4_latest_feedback", "history", """SELECT user_id, work_id, vibe, rating FROM history QUALIFY row_number() OVER (PARTITION BY user_id, work_id, vibe ORDER BY saved_at DESC, seq DESC, rank DESC, rating DESC) = 1""")
def _(t: Tables):
    cols = ["user_id", "work_id", "vibe", "saved_at", "seq", "rank", "rating"]
    return it.latest_per_key(t.history.select(*cols), ["user_id", "work_id", "vibe"], ["saved_at", "seq", "rank"]).select("user_id", "work_id", "vibe", "rating")


@query("t4_saved_pieces", "history", """SELECT work_id, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at, CAST(count(*) OVER () AS BIGINT) AS saved_count FROM latest WHERE rating <> -1 AND user_id = 100""", LATEST)
def _(t: Tables):
    return it.saved_pieces(latest_saved(t), 100).select("work_id", _text("saved_at"), "saved_count")


@query("a17_feedback_stats", "history", """SELECT work_id, CAST(count(*) FILTER (rating = 1) AS BIGINT) AS thumbs_up_count, CAST(count(*) FILTER (rating = -1) AS BIGINT) AS thumbs_down_count, CAST(count(*) AS BIGINT) AS total_feedbacks,
 round(avg(rating), 6) AS avg_rating, max(CASE WHEN user_id = 100 AND vibe = '5-LOW' THEN rating END) AS user_rating FROM history GROUP BY 1""")
def _(t: Tables):
    return it.feedback_stats(t.history, (100, "5-LOW")).withColumn("avg_rating", F.round("avg_rating", 6))


def request_log(t: Tables):
    return t.events.select((F.col("value") / 1000).alias("latency_s"), (F.col("event_type") == "view").alias("cached"), (F.col("event_type") == "error").alias("error"), "user_id")


@query("a21_service_metrics", "", """SELECT CAST(count(*) AS BIGINT) AS total_requests, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS successful_recommendations, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors,
 CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS cache_hits, round(avg(value), 6) AS avg_latency_ms, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS cache_hit_rate, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events""")
def _(t: Tables):
    m = it.service_metrics(request_log(t))
    return m.select(*[F.round(c, 6).alias(c) if c in ("avg_latency_ms", "cache_hit_rate", "error_rate") else c for c in m.columns])


_NAME = "CASE event_type WHEN 'view' THEN 'recommendation_fetch' WHEN 'click' THEN 'search_fetch' WHEN 'purchase' THEN 'save_action' WHEN 'error' THEN 'api_search' ELSE 'other' END"
_LIMITS = "CASE event_type WHEN 'click' THEN 800 WHEN 'purchase' THEN 300 ELSE 1000 END", "CASE event_type WHEN 'click' THEN 2000 WHEN 'purchase' THEN 1000 ELSE 3000 END"


@query("a22_latency_summary", "", f"""SELECT {_NAME} AS name, CAST(count(*) FILTER (CASE WHEN event_type = 'error' THEN v < 1000 ELSE v <= {_LIMITS[0]} END) AS BIGINT) AS good,
 CAST(count(*) FILTER (CASE WHEN event_type = 'error' THEN v >= 1000 AND v < 3000 ELSE v > {_LIMITS[0]} AND v <= {_LIMITS[1]} END) AS BIGINT) AS needs_improvement,
 CAST(count(*) FILTER (CASE WHEN event_type = 'error' THEN v >= 3000 ELSE v > {_LIMITS[1]} END) AS BIGINT) AS poor, round(avg(v), 5) AS avg FROM (SELECT *, value * 20 AS v FROM events) GROUP BY 1""")
def _(t: Tables):
    s = t.events.select(F.expr(_NAME).alias("name"), (F.col("value") * 20).alias("value"))
    return it.latency_summary(s).withColumn("avg", F.round("avg", 5))


@query("w3_last_events", "", """SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS recency FROM events QUALIFY recency <= 20""")
def _(t: Tables):
    return it.last_events(t.events, 20).select("user_id", "event_id", "recency")


_TRAIL = """SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent
 FROM events WHERE event_type = '{kind}') WHERE recent >= {n}"""


@query("w5_repeated_violations", "", _TRAIL.format(kind="error", n=2))
def _(t: Tables):
    return monitor.repeated_violations(t.events.filter("event_type = 'error'"), 2, 360).select("event_id", "user_id", "recent")


@query("w5_brute_force", "", _TRAIL.format(kind="signup", n=3))
def _(t: Tables):
    return monitor.brute_force(t.events.filter("event_type = 'signup'"), 3, 360).select("event_id", "user_id", "recent")


@query("w5_trailing_counts_all_events", "", """SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events""")
def _(t: Tables):
    return monitor.trailing_counts(t.events, 86400).select("event_id", "recent")


_RECENT = "FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR"


@query("r3_security_summary", "", f"""SELECT 24.0::DOUBLE AS period_hours, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS rate_limit_violations, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS auth_failures,
 CAST(count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS BIGINT) AS rate_limit_clients, CAST(count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS BIGINT) AS auth_failure_clients {_RECENT}""")
def _(t: Tables):
    return monitor.summary(t.events)


@query("t3_top_violators", "", f"SELECT user_id, CAST(count(*) AS BIGINT) AS violation_count {_RECENT} AND event_type = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t: Tables):
    return monitor.top_violators(t.events)


@query("r6_retention", "", """SELECT CAST(count(*) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS BIGINT) AS kept, CAST(count(*) AS BIGINT) AS total,
 CAST(count(*) FILTER (ts <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS BIGINT) AS dropped FROM events""")
def _(t: Tables):
    return monitor.retention_figures(t.events)


@query("r6_idle_clients", "", """SELECT user_id FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY 1) WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(m) > 3600000000""")
def _(t: Tables):
    return monitor.idle_clients(t.events).select("user_id")


@query("r8_tumbling_counts", "", """SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS "start", event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def _(t: Tables):
    return it.tumbling_counts(t.events).select(_text("start"), "event_type", "n")


@query("r8_sliding_counts", "", """SELECT strftime(time_bucket(INTERVAL '12 hours', ts) - o * INTERVAL '12 hours', '%Y-%m-%d %H:%M:%S') AS "start", event_type, CAST(count(*) AS BIGINT) AS n FROM events CROSS JOIN (VALUES (0), (1)) AS x(o) GROUP BY 1, 2""")
def _(t: Tables):
    return it.tumbling_counts(t.events, "1 day", "12 hours").select(_text("start"), "event_type", "n")


@query("r8_session_counts", "", """, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events),
 s AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, sid""".replace(", g AS", "WITH g AS", 1))
def _(t: Tables):
    return it.session_counts(t.events, "2 hours").select("user_id", _text("start"), "n")


@query("r8_funnel", "", """, p AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, max(ts) FILTER (event_type = 'purchase') AS b FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS work_id FROM events) GROUP BY user_id, work_id)
SELECT CAST(count(a) AS BIGINT) AS viewed, CAST(count(*) FILTER (b >= a) AS BIGINT) AS converted, round(count(*) FILTER (b >= a) / count(a), 6) AS conversion_rate FROM p""".replace(", p AS", "WITH p AS", 1))
def _(t: Tables):
    e = t.events.withColumn("work_id", F.get_json_object("props", "$.k").cast("bigint"))
    return it.funnel(e).withColumn("conversion_rate", F.round("conversion_rate", 6))


KIND = "CASE event_type WHEN 'view' THEN 'recommendation_viewed' WHEN 'purchase' THEN 'piece_saved' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'share' ELSE 'piece_unsaved' END"


def analytics(t: Tables):
    """Analytics events with a payload made from the event's own number."""
    k = F.get_json_object("props", "$.k")
    kind = F.expr(KIND)
    payload = F.to_json(F.struct(
        k.alias("work_id"), F.concat(F.lit("mood "), k).alias("query"), k.cast("int").alias("result_count"),
        F.when(kind == "share", "twitter").alias("platform"), F.when(kind == "share", "success").alias("status")))
    return t.events.select("event_id", "ts", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), kind.alias("event_type"), payload.alias("event_data"),
                           F.concat(F.lit("10.0.0."), F.col("user_id"), F.lit(", 192.168.0.1")).alias("forwarded_for"), F.lit("host").alias("host"))


EVENT_SQL = f"""SELECT event_id, kind AS event_type, CASE WHEN kind = 'share' THEN 'twitter' END AS platform, CASE WHEN kind <> 'search' THEN k END AS work_id,
 CASE WHEN kind IN ('share', 'search', 'recommendation_viewed') THEN concat('mood ', k) END AS query, CASE WHEN kind = 'search' THEN CAST(k AS INT) END AS result_count
 FROM (SELECT event_id, {KIND} AS kind, json_extract_string(props, '$.k') AS k FROM events)"""


@query("f17_type_events", "", EVENT_SQL)
def _(t: Tables):
    return it.type_events(analytics(t)).select("event_id", "event_type", "platform", "work_id", "query", "result_count")


@query("f18_migrate_saved", "history", """SELECT CAST(count(*) FILTER (NOT k AND w IS NOT NULL) AS BIGINT) AS migrated, CAST(count(*) FILTER (k AND w IS NOT NULL) AS BIGINT) AS skipped, CAST(count(*) FILTER (w IS NULL) AS BIGINT) AS errors
 FROM (SELECT CASE WHEN vibe = '5-LOW' THEN NULL ELSE work_id END AS w, coalesce(c.rating, 0) <> 0 AS k FROM history h LEFT JOIN (SELECT DISTINCT user_id AS u, work_id AS i, 1 AS rating FROM latest WHERE rating <> -1 AND seq > 7000) c ON u = user_id AND i = work_id)""", LATEST)
def _(t: Tables):
    piece = F.struct(F.when(F.col("vibe") != "5-LOW", F.col("work_id").cast("string")).alias("id"), F.lit("t").alias("title"), "vibe")
    docs = t.history.select("user_id", F.to_json(F.struct(F.struct(F.array(piece).alias("pieces")).alias("state"), F.lit(0).alias("version"))).alias("document"))
    current = latest_saved(t).filter("seq > 7000").select("user_id", F.col("work_id").cast("string").alias("work_id"))
    return it.migrate_saved(docs, current)[1]


@query("r7_client_id", "", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN concat('10.0.0.', user_id) WHEN user_id % 3 = 1 THEN 'host' ELSE 'unknown' END AS client_id FROM events""")
def _(t: Tables):
    r = F.col("user_id") % 3
    header = F.when(r == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id"), F.lit(" , 192.168.0.1")))
    return t.events.select("event_id", it.client_id(header, F.when(r == 1, F.lit("host"))).alias("client_id"))
