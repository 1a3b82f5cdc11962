"""Append-only event ingestion and windowed counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ostinato.operators.interactions import client_id, session_counts, tumbling_counts, type_events


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", **options) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    for k, v in options.items():
        r = r.option(k, v)
    return r.parquet(folder)


def ingest(events: DataFrame, ts: str = "ts", event_id: str = "event_id", payload: str = "event_data", watermark: str = "10 minutes") -> DataFrame:
    """Typed analytics events, each event id once within the watermark.

    Anonymous events keep a null user.  With the columns ``forwarded_for`` and ``host`` the client id
    is added.
    """
    e = type_events(events, payload)
    if {"forwarded_for", "host"} <= set(events.columns):
        e = e.withColumn("client_id", client_id(F.col("forwarded_for"), F.col("host")))
    return e.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([event_id])


def count_stream(events: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    return tumbling_counts(events.withWatermark("ts", watermark), width, slide)


def session_stream(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Sessions per user, each emitted once, when the watermark has passed its last event by the gap."""
    return session_counts(events.withWatermark("ts", watermark), gap)


def funnel_stream(events: DataFrame, first: str = "view", then: str = "purchase", keys: list[str] | None = None, horizon: str = "30 days",
                  slot: str = "1 day", watermark: str = "10 minutes", then_watermark: str | None = None) -> DataFrame:
    """Stream of ``(keys, first_ts, then_ts)``: a key's first events of each slot, joined with its last second events of the slots up to ``horizon`` later.

    Both sides are reduced to one row a key and slot before they meet, so a busy key makes pairs of slots, not of events. A row without
    ``then_ts`` says that no second event came within the horizon. Each side has its own watermark; state goes when both have passed the horizon.
    """
    keys = keys or ["user_id", "work_id"]

    def side(kind: str, delay: str, value, name: str, prefix: str) -> DataFrame:
        e = events.withWatermark("ts", delay)
        # all events move the clock: a condition on the time itself is not moved below the watermark
        mine = e.filter(F.when(F.col("ts").isNotNull(), F.col("event_type") == kind).otherwise(False))
        per = mine.groupBy(F.window("ts", slot).alias("w"), *keys).agg(value("ts").alias(name))
        return per.select(*[F.col(k).alias(prefix + k) for k in keys], F.window_time("w").alias(f"{prefix}slot"), name)

    a = side(first, watermark, F.min, "first_ts", "a_")
    b = side(then, then_watermark or watermark, F.max, "then_ts", "b_")
    same = reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    near = (F.col("b_slot") >= F.col("a_slot")) & (F.col("b_slot") <= F.col("a_slot") + F.expr(f"INTERVAL {horizon}"))
    met = a.join(b, same & near & (F.col("then_ts") >= F.col("first_ts")), "leftOuter")
    return met.select(*[F.col(f"a_{k}").alias(k) for k in keys], "first_ts", "then_ts")


def funnel_figures(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row over what a funnel stream has written: keys with a first event, those with a later second one, and the rate."""
    per = found.groupBy(*(keys or ["user_id", "work_id"])).agg(F.max("then_ts").alias("b"))
    row = per.agg(F.count("*").alias("viewed"), F.count("b").alias("converted"))
    return row.withColumn("conversion_rate", F.coalesce(F.col("converted") / F.nullif(F.col("viewed"), F.lit(0)), F.lit(0.0)))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything available now into a Parquet folder and wait for it."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
