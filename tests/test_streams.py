import datetime as dt
import random

from pyspark.sql import functions as F

from ostinato.operators import interactions as it
from ostinato.operators import monitor as batch
from ostinato.streaming import ingest, limiter, monitor
from ostinato.streaming.state import KeyedTable

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), c) for i, (s, c) in enumerate(rows)], "event_id bigint, ts timestamp, client_id string")


def write_parts(df, path, order="ts", parts=3):
    """Several files in time order, so that the stream runs over several micro-batches."""
    n = df.count()
    for p in range(parts):
        df.orderBy(order, "event_id").offset(p * n // parts).limit((p + 1) * n // parts - p * n // parts).coalesce(1).write.mode("append").parquet(path)


CLOSE = dt.datetime(2200, 1, 1)


def stream(spark, df, path, order="ts"):
    """The rows in several files, in order of arrival, and a closing row that moves the watermark past them."""
    write_parts(df, path, order)
    last = df.limit(1).select(*[(F.lit(CLOSE) if c == "ts" else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes])
    last.coalesce(1).write.mode("append").parquet(path)
    return ingest.file_stream(spark, path, df.schema, maxFilesPerTrigger=1)


def test_alert_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.randrange(0, 4000), rng.choice("abc")) for _ in range(150)) + [(4000, "d")] * 6
    df = events(spark, rows)
    want = {r.event_id for r in batch.alerts(df, 4, 300, "client_id").collect()}
    s = monitor.alert_stream(stream(spark, df, str(tmp_path / "in")), 4, 300)
    ingest.drain(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_streams_do_not_depend_on_arrival(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(0, 5000), rng.choice("abc")) for _ in range(200)] + [(2000, "d")] * 5
    df = events(spark, rows)
    late = {i: s + rng.randrange(0, 550) for i, (s, _) in enumerate(rows)}  # inside the watermark of ten minutes
    arrival = F.create_map(*[F.lit(x) for kv in late.items() for x in kv])[F.col("event_id")]
    df = df.withColumn("arrival", arrival)
    want = {r.event_id for r in batch.alerts(df, 4, 300, "client_id").collect()}
    s = monitor.alert_stream(stream(spark, df, str(tmp_path / "in"), "arrival"), 4, 300)
    ingest.drain(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(got) == want and len(got) == len(want) > 0
    decided = {r.event_id: r.allowed for r in limiter.replay(df, 3, 100).collect()}
    s = limiter.limit_stream(ingest.file_stream(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger=1), 3, 100)
    ingest.drain(s, str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == decided and not all(decided.values())


def test_trailing_window_is_strict(spark):
    df = events(spark, [(0, "a"), (600, "a"), (601, "a"), (1199.999999, "a")])
    got = {r.event_id: r.recent for r in batch.trailing_counts(df, 600, "client_id").collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3}


def test_hot_client(spark):
    df = spark.range(60000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"),
                                   F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("client_id"))
    r = batch.trailing_counts(df, 600, "client_id").filter("client_id = 'hot'").agg(F.max("recent"), F.count("*")).first()
    assert tuple(r) == (200, 20000)


def twin(rows, rate, period):
    buckets, out = {}, {}
    for i, (t, c) in enumerate(rows):
        last, tokens = buckets.get(c, (t, float(rate)))
        tokens = min(rate, tokens + (t - last) * rate / period)
        if tokens >= 1:
            buckets[c] = (t, tokens - 1)
        out[i] = tokens >= 1
    return out


def test_token_bucket(spark, tmp_path):
    rng = random.Random(4)
    rows = [(0.0, "a")] * 61 + [(30.0, "a")] * 40 + sorted((rng.uniform(40, 900), rng.choice("ab")) for _ in range(200))
    rows.sort(key=lambda r: r[0])
    df = events(spark, rows)
    want = twin(rows, 60, 60)
    got = {r.event_id: r.allowed for r in limiter.replay(df).collect()}
    assert got == want and not all(got.values())
    first = limiter.replay(df).filter("event_id = 60").first()
    assert (first.allowed, first.remaining, first.retry_after) == (False, 0, 1)
    s = limiter.limit_stream(stream(spark, df, str(tmp_path / "in")))
    ingest.drain(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    small = limiter.replay(df, 2, 20)
    assert {r.event_id: r.allowed for r in small.collect()} == twin(rows, 2, 20)


def test_keyed_table(spark, tmp_path):
    rows = [(1, "a", "save"), (2, "b", "save"), (3, "a", "delete"), (4, "a", "save"), (5, "b", "delete"), (6, "c", "save")]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), k, o) for i, k, o in rows], "event_id bigint, ts timestamp, k string, op string")
    s = stream(spark, df, str(tmp_path / "in")).filter("k IS NOT NULL")
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["ts", "event_id"], "op = 'delete'")
    table.follow(s, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    want = {(r.k, r.event_id) for r in it.latest_per_key(df, ["k"], ["ts", "event_id"], F.col("op") == "delete").collect()}
    assert {(r.k, r.event_id) for r in table.current().collect()} == want == {("a", 4), ("c", 6)}
    small = table.compact(str(tmp_path / "t2"))
    small.merge(df.filter("event_id = 6").withColumns({"op": F.lit("delete"), "event_id": F.lit(7).cast("bigint")}), 99)
    small.merge(df.filter("event_id = 6").withColumns({"op": F.lit("delete"), "event_id": F.lit(7).cast("bigint")}), 99)  # a repeated batch
    assert {r.k for r in small.current().collect()} == {"a"}


def test_ingest(spark, tmp_path):
    rows = [(1, 0, "search", '{"query":"q","resultCount":3}'), (1, 1, "search", '{"query":"q","resultCount":3}'), (2, 5, "piece_saved", '{"workId":"w","query":"no"}'),
            (3, 7200, "share", '{"platform":"twitter","status":"failed"}'), (4, 10, "search", "late"), (5, 7201, "piece_unsaved", '{"work_id":"w"}'), (6, 7202, "search", "{}")]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), None, t, p, " 1.2.3.4 , 9.9.9.9", "h") for i, s, t, p in rows],
                               "event_id bigint, ts timestamp, user_id string, event_type string, event_data string, forwarded_for string, host string")
    # files in arrival order: the late row comes in the last file, behind the watermark that the batch before has used
    for ids in ([1, 2], [3], [6], [4, 5]):
        df.filter(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = ingest.file_stream(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger=1)
    ingest.drain(ingest.ingest(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6]
    assert got[1].result_count == 3 and got[2].work_id == "w" and got[2].query is None and got[3].platform == "twitter" and got[5].work_id == "w"
    assert got[1].client_id == "1.2.3.4" and got[1].user_id is None


def test_client_id(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "h"), ("", "h"), (None, "h"), (None, None)], "f string, h string")
    assert [r[0] for r in df.select(it.client_id(F.col("f"), F.col("h"))).collect()] == ["1.1.1.1", "h", "h", "unknown"]


def test_migration(spark):
    docs = spark.createDataFrame([("u", '{"state":{"pieces":[{"id":"1","title":"t"},{"id":"2"},{"title":"x"}]},"version":0}'), ("v", "broken")], "user_id string, document string")
    current = spark.createDataFrame([("u", "2")], "user_id string, work_id string")
    rows, counts = it.migrate_saved(docs, current)
    assert [r.work_id for r in rows.collect()] == ["1"]
    assert tuple(counts.first()) == (1, 1, 2)


def test_latency_ratings(spark):
    df = spark.createDataFrame([("search_fetch", 800.0), ("search_fetch", 2000.0), ("save_action", 301.0), ("other", 3001.0), ("api_x", 1000.0), ("api_x", 3000.0)], "n string, v double")
    assert [r[0] for r in df.select(it.latency_rating(F.col("n"), F.col("v"))).collect()] == ["good", "needs-improvement", "needs-improvement", "poor", "needs-improvement", "poor"]


def test_bucket_is_not_forgotten_before_its_period(spark, tmp_path):
    """Pauses longer than the idle time and shorter than the period, over many micro-batches."""
    rng = random.Random(7)
    rows = sorted((rng.randrange(0, 40) * 3700.0 + rng.randrange(0, 50), rng.choice("abc")) for _ in range(160))
    df = events(spark, rows)
    decided = {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in limiter.replay(df, 2, 21600).collect()}
    assert {i: a for i, (a, _, _) in decided.items()} == twin(rows, 2, 21600)
    write_parts(df, str(tmp_path / "in"), parts=8)
    last = df.limit(1).select(*[(F.lit(CLOSE) if c == "ts" else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes])
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = limiter.limit_stream(ingest.file_stream(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger=1), 2, 21600)
    ingest.drain(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == decided


def test_periods_below_and_between_seconds(spark):
    rng = random.Random(8)
    rows = sorted((round(rng.uniform(0, 30), 3), rng.choice("ab")) for _ in range(300))
    df = events(spark, rows)
    for rate, period in ((1, 0.5), (2, 2.5)):
        assert {r.event_id: r.allowed for r in limiter.replay(df, rate, period).collect()} == twin(rows, rate, period)


def test_hot_client_in_one_batch(spark, tmp_path):
    """A client with most of the rows: its state is many parts, its answers many frames, and equal to the batch forms."""
    n = 120_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 2000).alias("ts"),
                               F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("client_id"))
    df = df.union(spark.createDataFrame([(None, CLOSE, None)], "event_id bigint, ts timestamp, client_id string"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    source = ingest.file_stream(spark, str(tmp_path / "in"), df.schema)
    ingest.drain(monitor.alert_stream(source, 1000, 30), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = batch.alerts(df.filter("event_id IS NOT NULL"), 1000, 30, "client_id").agg(F.count("*"), F.sum("event_id")).first()
    assert tuple(spark.read.parquet(str(tmp_path / "out")).agg(F.count("*"), F.sum("event_id")).first()) == tuple(want) and want[0] > 80_000
    ingest.drain(limiter.limit_stream(source, 100, 10), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    figures = [F.count("*"), F.count_if("allowed"), F.sum(F.when(F.col("allowed"), F.col("event_id")))]
    want = limiter.replay(df.filter("event_id IS NOT NULL"), 100, 10).agg(*figures).first()
    assert tuple(spark.read.parquet(str(tmp_path / "out2")).agg(*figures).first()) == tuple(want)


def shuffled(spark, df, path, delays, parts=4):
    """Files in order of arrival: each row comes late by its delay, inside the watermark; a closing row ends the log."""
    late = F.unix_micros("ts") + F.element_at(F.array(*[F.lit(x) for x in delays]), (F.col("event_id") % len(delays) + 1).cast("int")) * 1_000_000
    write_parts(df.withColumn("arrival", late), path, "arrival", parts)
    spark.read.parquet(path).limit(1).select(*[(F.lit(CLOSE) if c == "ts" else F.lit(None).cast(t)).alias(c) for c, t in [*df.dtypes, ("arrival", "bigint")]]).coalesce(1).write.mode("append").parquet(path)
    return ingest.file_stream(spark, path, df.schema, maxFilesPerTrigger=1)


def test_session_and_funnel_streams_equal_batch(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randrange(0, 5 * 86400)), rng.choice([1, 2, 3, None]), rng.choice([7, 8, 9]), rng.choice(["view", "purchase", "click"])) for i in range(260)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, work_id bigint, event_type string")
    s = shuffled(spark, df, str(tmp_path / "in"), [0, 500, 120, 590, 30])
    ingest.drain(ingest.session_stream(s, "1 hour"), str(tmp_path / "s"), str(tmp_path / "s-cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).collect() if r.start < CLOSE}
    assert got == {tuple(r) for r in it.session_counts(df, "1 hour").collect()} and len(got) > 100
    ingest.drain(ingest.funnel_stream(s, horizon="20 days", then_watermark="15 minutes"), str(tmp_path / "f"), str(tmp_path / "f-cp"))
    found = spark.read.parquet(str(tmp_path / "f"))
    assert tuple(ingest.funnel_figures(found).first()) == tuple(it.funnel(df).first())
    assert found.filter("then_ts < first_ts").isEmpty() and found.count() == found.distinct().count()


def test_funnel_horizon(spark, tmp_path):
    rows = [(0, 0, "view"), (1, 1, "purchase"), (2, 9, "purchase"), (3, 12, "view"), (4, 20, "click")]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(days=d), 1, 1, k) for i, d, k in rows], "event_id bigint, ts timestamp, user_id bigint, work_id bigint, event_type string")
    s = shuffled(spark, df, str(tmp_path / "in"), [0])
    ingest.drain(ingest.funnel_stream(s, horizon="3 days"), str(tmp_path / "f"), str(tmp_path / "f-cp"))
    got = sorted((r.first_ts.day, r.then_ts and r.then_ts.day) for r in spark.read.parquet(str(tmp_path / "f")).collect())
    assert got == [(1, 2), (13, None)]


def test_keyed_table_folds_and_survives_a_crash(spark, tmp_path, monkeypatch):
    """Deltas stay few; a crash between the new base and its manifest, or a repeated batch, changes nothing."""
    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randrange(0, 900)), rng.choice("abcdefgh"), rng.choice(["save", "save", "delete"])) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, k string, op string")
    write_parts(df, str(tmp_path / "in"), "event_id", 9)
    s = ingest.file_stream(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger=1)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["ts", "event_id"], "op = 'delete'", fold_every=3)
    crashes, create = [], spark.createDataFrame

    class Crash(Exception):
        pass

    def failing(*a, **kw):
        if len(crashes) < 1 and table.manifest()[0] == 1:
            crashes.append(1)
            raise Crash  # the second base is written, its manifest is not
        return create(*a, **kw)

    monkeypatch.setattr(spark, "createDataFrame", failing)
    try:
        table.follow(s, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    except Exception:  # noqa: BLE001
        pass
    monkeypatch.undo()
    assert crashes and table.manifest()[0] == 1 and len(table.pending(table.manifest()[1])) >= 3
    table.follow(s, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    want = {(r.k, r.event_id) for r in it.latest_per_key(df, ["k"], ["ts", "event_id"], F.col("op") == "delete").collect()}
    assert {(r.k, r.event_id) for r in table.current().collect()} == want
    version, folded, _ = table.manifest()
    assert version == 3 and len(table.pending(folded)) < 3 and len(list((tmp_path / "t" / "deltas").glob("batch=*"))) <= 6
    assert len(list((tmp_path / "t" / "base").glob("v=*"))) == 2
    table.merge(df.limit(1).withColumn("ts", F.lit(CLOSE)), 0)  # an old batch again
    assert {(r.k, r.event_id) for r in table.current().collect()} == want


def test_bucket_stream_has_one_timer_a_client(spark, tmp_path):
    """Requests in many time slots: timers grow with the clients and batches, not with the slots."""
    df = events(spark, [(70.0 * i, "ab"[i % 2]) for i in range(300)])
    s = limiter.limit_stream(stream(spark, df, str(tmp_path / "in")), 2, 21600)
    q = (s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    timers = sum(op["customMetrics"].get("numRegisteredTimers", 0) for p in q.recentProgress for op in p["stateOperators"])
    assert 0 < timers < 60
    got = {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.event_id: r.allowed for r in limiter.replay(df, 2, 21600).collect()}


def test_alert_stream_state_does_not_grow_with_clients_and_slots(spark, tmp_path, monkeypatch):
    """Each event has its own client and slot: timers and state calls grow with the groups and batches, not with the events."""
    monkeypatch.setattr(monitor, "GROUPS", 8, raising=False)
    df = events(spark, [x for i in range(200) for x in ((400 * i, f"c{i}"), (400 * i + 1, f"c{i}"))])
    s = monitor.alert_stream(stream(spark, df, str(tmp_path / "in")), 2, 300)
    q = (s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    timers = sum(op["customMetrics"].get("numRegisteredTimers", 0) for p in q.recentProgress for op in p["stateOperators"])
    assert 0 < timers <= 2 * 8 * len(q.recentProgress)
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [2 * i + 1 for i in range(200)]


def test_alert_stream_over_cells_and_batches(spark, tmp_path, monkeypatch):
    """Two groups, slots judged one after the other; bounds of slots, events without client or id; a late row does not count."""
    monkeypatch.setattr(monitor, "GROUPS", 2, raising=False)
    rng = random.Random(21)
    start = dt.datetime(1970, 1, 3, 22)
    at = sorted([rng.randrange(0, 14400) for _ in range(300)] + [300 * rng.randrange(0, 48) for _ in range(60)] + [7199, 7200] * 3)
    rows = [(None if i == 70 else i, start + dt.timedelta(seconds=s), rng.choice(["a", "b", "c", None])) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, client_id string")
    want = sorted((str(r.event_id), str(r.client_id)) for r in batch.alerts(df, 3, 300, "client_id").collect())
    for p in range(0, len(rows), 75):
        here = rows[p:p + 75]
        rng.shuffle(here)
        spark.createDataFrame(here, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for last in ([(1000, start, "a"), (1001, CLOSE, None)], [(1002, start + dt.timedelta(seconds=i), "a") for i in range(9)]):
        spark.createDataFrame(last, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = monitor.alert_stream(ingest.file_stream(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger=1), 3, 300)
    ingest.drain(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((str(r.event_id), str(r.client_id)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and len(got) > 50


def test_reached():
    import numpy as np

    rng = random.Random(5)
    rows = sorted((rng.randrange(4), rng.randrange(60)) for _ in range(80))
    group, us = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for n in (0, 1, 2, 5, 90):
        for width in (1, 7, 100):
            want = [sum(g == h and t - width < u <= t for h, u in rows) >= n for g, t in rows]
            assert monitor.reached(group, us, n, width).tolist() == want
    assert monitor.reached(group[:0], us[:0], 1, 7).tolist() == []
