"""User interactions: feedback, saved pieces, request logs, analytics events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.functions.fixed_values import DEFAULT_LATENCY_LIMITS, LATENCY_LIMITS
from ostinato.operators.shape import numbered, ranked


def latest_per_key(log: DataFrame, keys: list[str], order: list[str], tombstone: Column | None = None) -> DataFrame:
    """The last row of each key by the order columns; deleted keys vanish.

    The last row is kept as a running maximum, so a hot key is reduced before the shuffle.
    """
    rest = [c for c in log.columns if c not in keys and c not in order]
    last = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_l"))
    out = last.select(*keys, "_l.*").select(*log.columns)
    return out if tombstone is None else out.filter(~F.coalesce(tombstone, F.lit(False)))


def feedback_stats(feedback: DataFrame, own: tuple | None = None) -> DataFrame:
    """Per work: thumbs up and down, total, mean rating; with ``own = (user, vibe)`` also that user's rating."""
    aggs = [
        F.count_if(F.col("rating") == 1).alias("thumbs_up_count"), F.count_if(F.col("rating") == -1).alias("thumbs_down_count"),
        F.count("*").alias("total_feedbacks"), F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating")]
    if own is not None:
        mine = (F.col("user_id") == F.lit(own[0])) & (F.col("vibe") == F.lit(own[1]))
        aggs.append(F.max(F.when(mine, F.col("rating"))).alias("user_rating"))
    return feedback.groupBy("work_id").agg(*aggs)


def saved_pieces(saved: DataFrame, user_id) -> DataFrame:
    """A user's saved pieces, newest first, each with the total count."""
    rows = saved.filter(F.col("user_id") == F.lit(user_id))
    return rows.withColumn("saved_count", F.count("*").over(Window.partitionBy("user_id"))).orderBy(F.desc("saved_at"), "work_id")


def last_events(events: DataFrame, n: int = 100, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last n events of each user."""
    return ranked(events, [user], [F.desc(ts), F.desc(tie)], n, "recency")


def service_metrics(requests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Request figures over rows ``(latency_s, cached, error)``, in all or per key."""
    row = requests.groupBy(*(keys or [])).agg(
        F.count("*").alias("total_requests"), F.count_if(~F.col("error")).alias("successful_recommendations"),
        F.count_if("error").alias("errors"), F.count_if("cached").alias("cache_hits"), F.sum("latency_s").alias("_lat"))
    n = F.col("total_requests")

    def per(c):
        return F.when(n > 0, F.col(c) / n).otherwise(F.lit(0.0))

    return row.select(
        *(keys or []), "total_requests", "successful_recommendations", "errors", "cache_hits",
        (F.coalesce(per("_lat"), F.lit(0.0)) * 1000).alias("avg_latency_ms"), per("cache_hits").alias("cache_hit_rate"),
        per("errors").alias("error_rate"))


def latency_rating(metric: Column, value: Column) -> Column:
    """good / needs-improvement / poor; names starting with ``api_`` use strict limits."""
    def rate(good: float, poor: float) -> Column:
        return F.when(value <= good, "good").when(value <= poor, "needs-improvement").otherwise("poor")

    api = F.when(value < 1000, "good").when(value < 3000, "needs-improvement").otherwise("poor")
    named = reduce(lambda acc, kv: acc.when(metric == kv[0], rate(*kv[1])), LATENCY_LIMITS.items(), F.when(metric.startswith("api_"), api))
    return named.otherwise(rate(*DEFAULT_LATENCY_LIMITS))


def latency_summary(samples: DataFrame) -> DataFrame:
    """Per metric name: counts by rating and mean, over rows ``(name, value)``."""
    r = samples.withColumn("_r", latency_rating(F.col("name"), F.col("value")))
    return r.groupBy("name").agg(
        F.count_if(F.col("_r") == "good").alias("good"), F.count_if(F.col("_r") == "needs-improvement").alias("needs_improvement"),
        F.count_if(F.col("_r") == "poor").alias("poor"), F.avg("value").alias("avg"))


def history_rows(results: DataFrame, session: list[str], order: list[Column]) -> DataFrame:
    """Recommendation history rows: each session's results with rank 1..n and the query as vibe."""
    rows = numbered(results, session, order, "rank")
    return rows.withColumn("vibe", F.col("query"))


# --- analytics events --------------------------------------------------------------------------------

PAYLOAD = "platform string, status string, work_id string, workId string, query string, result_count int, resultCount int"


def type_events(events: DataFrame, payload: str = "event_data") -> DataFrame:
    """Flatten analytics payloads to one typed row shape; fields foreign to an event type are null."""
    p = F.from_json(payload, PAYLOAD)
    e = events.withColumn("_p", p)
    kind = F.col("event_type")
    work = F.coalesce("_p.work_id", "_p.workId")
    count = F.coalesce("_p.result_count", "_p.resultCount")
    return e.select(
        *events.columns,
        F.when(kind == "share", F.col("_p.platform")).alias("platform"),
        F.when(kind == "share", F.col("_p.status")).alias("status"),
        F.when(kind.isin("share", "recommendation_viewed", "piece_saved", "piece_unsaved"), work).alias("work_id"),
        F.when(kind.isin("share", "search", "recommendation_viewed"), F.col("_p.query")).alias("query"),
        F.when(kind == "search", count).alias("result_count"),
    )


def client_id(forwarded: Column, host: Column) -> Column:
    """First hop of the forwarding header, else the host, else ``unknown``."""
    hop = F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit(""))
    return F.coalesce(hop, F.nullif(host, F.lit("")), F.lit("unknown"))


LEGACY = ("state struct<pieces:array<struct<id:string,title:string,composer:string,vibe:string,explanation:string>>>, version int")


def migrate_saved(legacy: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old saved-list documents ``(user_id, document)`` to upsert rows, and the counts of the run.

    Pieces already saved are skipped; pieces without id and unreadable documents are errors.
    """
    doc = legacy.select("user_id", F.from_json("document", LEGACY).alias("d"), F.col("document"))
    unreadable = F.col("d.state").isNull() & F.col("document").isNotNull()
    pieces = doc.select("user_id", F.explode("d.state.pieces").alias("p")).select(
        "user_id", F.col("p.id").alias("work_id"), "p.title", "p.composer", "p.vibe", "p.explanation")
    known = current.select("user_id", "work_id").distinct().withColumn("_known", F.lit(True))
    j = pieces.join(known, ["user_id", "work_id"], "left")
    state = F.when(F.col("work_id").isNull(), "errors").when(F.col("_known"), "skipped").otherwise("migrated")
    j = j.withColumn("outcome", state)
    bad_docs = doc.filter(unreadable).select(F.lit("errors").alias("outcome"))
    counts = j.select("outcome").unionByName(bad_docs).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("migrated", "skipped", "errors")])
    rows = j.filter("outcome = 'migrated'").drop("_known", "outcome")
    return rows, counts


def funnel(events: DataFrame, first: str = "view", then: str = "purchase", keys: list[str] | None = None) -> DataFrame:
    """One row: keys with a first event, those with a later second one, and the rate.

    Earliest first and latest second event per key settle it; no events are joined.
    """
    keys = keys or ["user_id", "work_id"]
    per = events.filter(F.col("event_type").isin(first, then)).groupBy(*keys).agg(
        F.min(F.when(F.col("event_type") == first, F.col("ts"))).alias("a"), F.max(F.when(F.col("event_type") == then, F.col("ts"))).alias("b"))
    row = per.agg(F.count("a").alias("viewed"), F.count_if(F.col("b") >= F.col("a")).alias("converted"))
    return row.withColumn("conversion_rate", F.coalesce(F.col("converted") / F.nullif(F.col("viewed"), F.lit(0)), F.lit(0.0)))


def tumbling_counts(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events per type and time window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: start, end, events."""
    return events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", "s.start", "s.end", "n")
