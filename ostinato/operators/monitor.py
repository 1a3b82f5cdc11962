"""Security monitoring over event logs (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators.shape import one_row


def trailing_counts(events: DataFrame, window_seconds: float, client: str = "user_id", ts: str = "ts", name: str = "recent") -> DataFrame:
    """At each event the client's events in ``(ts - window, ts]``, this one included.

    Time is cut into slots of the window's length and each event is also shown to the next slot, so
    the ordered pass runs per client and slot: a client with very many events is many groups.
    """
    w = int(window_seconds * 1_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(us / w)
    shown = F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))))
    rows = events.select("*", us.alias("_us"), shown.alias("_s")).select("*", F.col("_s.slot").alias("_slot"), F.col("_s.own").alias("_own")).drop("_s")
    frame = Window.partitionBy(client, "_slot").orderBy("_us").rangeBetween(-(w - 1), 0)
    return rows.withColumn(name, F.count("*").over(frame)).filter("_own").drop("_us", "_slot", "_own")


def alerts(events: DataFrame, threshold: int, window_seconds: int, client: str = "user_id", ts: str = "ts") -> DataFrame:
    """Events at which the trailing count reaches the threshold."""
    return trailing_counts(events, window_seconds, client, ts).filter(F.col("recent") >= threshold)


def repeated_violations(violations: DataFrame, threshold: int = 5, window_minutes: float = 10, client: str = "user_id") -> DataFrame:
    return alerts(violations, threshold, int(window_minutes * 60), client)


def brute_force(failures: DataFrame, threshold: int = 10, window_minutes: float = 5, client: str = "user_id") -> DataFrame:
    return alerts(failures, threshold, int(window_minutes * 60), client)


def since(events: DataFrame, hours: float, now: Column | None = None, ts: str = "ts") -> DataFrame:
    """Events of the last hours before ``now`` (by default the newest event)."""
    if now is None:
        newest = events.agg(F.max(ts).alias("m")).first()["m"]  # one value
        now = F.lit(newest)
    return events.filter(F.col(ts) > now - F.make_dt_interval(hours=F.lit(0), mins=F.lit(0), secs=F.lit(float(hours) * 3600).cast("decimal(18,6)")))


def summary(
    events: DataFrame, hours: float = 24, violation: str = "error", failure: str = "signup", client: str = "user_id",
    now: Column | None = None,
) -> DataFrame:
    """One row: violations and failures of the last hours, and the clients behind them."""
    recent = since(events, hours, now)
    v, f = F.col("event_type") == violation, F.col("event_type") == failure
    return recent.agg(
        F.count_if(v).alias("rate_limit_violations"), F.count_if(f).alias("auth_failures"),
        F.count_distinct(F.when(v, F.col(client))).alias("rate_limit_clients"),
        F.count_distinct(F.when(f, F.col(client))).alias("auth_failure_clients"),
    ).select(F.lit(float(hours)).alias("period_hours"), "*")


def top_violators(events: DataFrame, hours: float = 24, n: int = 5, violation: str = "error", client: str = "user_id", now: Column | None = None) -> DataFrame:
    recent = since(events, hours, now).filter(F.col("event_type") == violation)
    return recent.groupBy(client).agg(F.count("*").alias("violation_count")).orderBy(F.desc("violation_count"), client).limit(n)


def retain(events: DataFrame, days: float = 7, now: Column | None = None) -> DataFrame:
    return since(events, days * 24, now)


def idle_clients(events: DataFrame, max_age_seconds: float = 3600, client: str = "user_id", now: Column | None = None) -> DataFrame:
    """Clients whose last event is older than the limit (their buckets may go)."""
    last = events.groupBy(client).agg(F.max("ts").alias("last_ts"))
    if now is None:
        now = F.lit(events.agg(F.max("ts").alias("m")).first()["m"])
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    return last.filter(age > max_age_seconds)


def retention_figures(events: DataFrame, days: float = 7) -> DataFrame:
    return one_row(retain(events, days).agg(F.count("*").alias("kept")), events.agg(F.count("*").alias("total"))).withColumn(
        "dropped", F.col("total") - F.col("kept"))
