"""Token bucket per client over a request log: batch replay and stream."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ostinato.operators.monitor import trailing_counts
from ostinato.streaming.state import FRAME, keyed_rows, keyed_state, order_key


def spend(times, rate: float, period: float, tokens: float | None, last: float | None, keys=None, current=None):
    """Run a bucket over ordered request times (seconds).

    Refill ``dt * rate / period`` up to ``rate``; a request takes one token when there is one.  A
    denied request leaves the bucket untouched.  With ``keys``, a new key (first ``current``) starts a
    full bucket.  Returns the decisions and the bucket after them.
    """
    allowed, remaining, retry = [], [], []
    for n, t in enumerate(times):
        if keys is not None and keys[n] != current:
            current, last = keys[n], None
        if last is None:
            tokens, last = float(rate), t
        now = min(float(rate), tokens + (t - last) * (rate / period))
        if now >= 1:
            tokens, last = now - 1, t
            allowed.append(True)
            remaining.append(int(tokens))
            retry.append(None)
        else:
            allowed.append(False)
            remaining.append(0)
            retry.append(int((1 - now) * (period / rate)))
    return allowed, remaining, retry, tokens, last


def independent_runs(requests: DataFrame, period: float, client: str, ts: str) -> DataFrame:
    """Number each client's runs of requests; after a pause of a full period the bucket is full again.

    Runs are found and numbered per client and time slot, so a busy client is many groups.
    """
    w = int(period * 1_000_000)
    us = F.unix_micros(F.col(ts))
    c = trailing_counts(requests, period, client, ts, "_recent").withColumn("_slot", F.floor(us / w))
    c = c.withColumn("_start", F.when(F.col("_recent") == 1, 1).otherwise(0))
    slots = c.groupBy(client, "_slot").agg(F.sum("_start").alias("_n"))
    before = Window.partitionBy(client).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(client, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(client, "_slot").orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    j = c.withColumn("_in", F.sum("_start").over(inside)).join(slots, [client, "_slot"])
    return j.withColumn("_run", F.col("_before") + F.col("_in")).drop("_recent", "_slot", "_start", "_in", "_before")


def replay(requests: DataFrame, rate: int = 60, period: float = 60, client: str = "client_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Decisions ``(client, ts, tie, allowed, remaining, retry_after)`` for a whole request log.

    Rows are ordered inside partitions and pass through batch by batch with one small bucket carried
    along; no client's log is held in memory.
    """
    runs = independent_runs(requests.select(client, ts, tie), period, client, ts).withColumn("_us", F.unix_micros(ts))
    ordered = runs.repartition(client, "_run").sortWithinPartitions(client, "_run", "_us", tie)
    ct, tt = requests.schema[client].dataType.simpleString(), requests.schema[tie].dataType.simpleString()

    def run(batches):
        import pandas as pd

        current, tokens, last = None, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            keys = list(zip(pdf[client].tolist(), pdf["_run"].tolist()))
            a, m, r, tokens, last = spend((pdf["_us"] / 1e6).tolist(), rate, period, tokens, last, keys, current)
            current = keys[-1]
            yield pd.DataFrame({client: pdf[client], "_us": pdf["_us"], tie: pdf[tie], "allowed": a, "remaining": m,
                                "retry_after": pd.array(r, dtype="Int64")})

    out = ordered.mapInPandas(run, f"`{client}` {ct}, _us bigint, `{tie}` {tt}, allowed boolean, remaining int, retry_after bigint")
    return out.select(client, F.timestamp_micros("_us").alias(ts), tie, "allowed", "remaining", "retry_after")


def limit_stream(requests: DataFrame, rate: int = 60, period: float = 60, client: str = "client_id", ts: str = "ts",
                 tie: str = "event_id", watermark: str = "10 minutes", idle_seconds: float = 3600, slot_seconds: float = 60) -> DataFrame:
    """The same decisions as a stream; a bucket not used for ``idle_seconds``, and long enough to be full again, is dropped.

    A request is decided once the watermark has passed its time slot, so requests may arrive in any order inside the watermark. Until then it waits in
    its client's state, in sorted parts of at most FRAME rows; one value lists the parts with their first and last time, and a client has one timer, for
    its next slot. So the state is touched some times a client and batch, not a slot. The bucket is two numbers. A client with more rows waiting
    than FRAME keeps its parts in bins of time, the narrower the more rows wait, so that few parts overlap and are in memory at once.
    """
    ct, tt = requests.schema[client].dataType.simpleString(), requests.schema[tie].dataType.simpleString()
    tied = order_key(tt)
    width, idle = int(slot_seconds * 1_000_000), int(max(idle_seconds, period) * 1_000_000)

    class Bucket(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.bucket = handle.getValueState("bucket", "tokens double, last double")
            self.waiting = handle.getValueState("waiting", "timer bigint, next bigint, no array<bigint>, first array<bigint>, last array<bigint>, n array<bigint>")
            self.parts = handle.getMapState("parts", "part bigint", "us array<bigint>, ids array<string>")

        def listed(self):
            """The timer set, the number of the next part, and the waiting parts as (first, last, number, rows)."""
            if not self.waiting.exists():
                return None, 0, []
            timer, number, no, first, last, n = self.waiting.get()
            return timer, number, list(zip(first, last, no, n))

        def keep(self, timer, number, parts) -> None:
            """Store the list of parts, with a timer for the end of the first slot unless one is due by then."""
            if not parts:
                if self.waiting.exists():
                    self.waiting.clear()
                return
            due = -(-(min(p[0] for p in parts) // width + 1) * width // 1000)
            if timer is None or due < timer:
                self.handle.registerTimer(due)
                timer = due
            first, last, no, n = (list(x) for x in zip(*parts))
            self.waiting.update((timer, number, no, first, last, n))

        def store(self, rows, number, parts) -> int:
            """Write sorted rows (us, id) as parts behind the listed ones; returns the number of the next part."""
            for at in range(0, len(rows), FRAME):
                us, ids = zip(*rows[at:at + FRAME])
                self.parts.updateValue((number,), (list(us), list(ids)))
                parts.append((us[0], us[-1], number, len(us)))
                number += 1
            return number

        def handleInputRows(self, key, rows, timerValues):
            timer, number, parts = self.listed()
            total = sum(p[3] for p in parts)
            for frame in rows:
                if frame.empty:
                    continue
                found = sorted(zip(frame["us"].tolist(), frame["id"].tolist()), key=lambda r: r[0])
                total += len(found)
                low, high = min([found[0][0], *(p[0] for p in parts)]), max([found[-1][0], *(p[1] for p in parts)])
                span = max(width, (high - low) * 8 * FRAME // total + 1) if total > FRAME else high - low + 1
                at = 0
                while at < len(found):
                    end, bin_ = at, (found[at][0] - low) // span
                    while end < len(found) and (found[end][0] - low) // span == bin_:
                        end += 1
                    number = self.store(found[at:end], number, parts)
                    at = end
            self.keep(timer, number, parts)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            passed = timerValues.getCurrentWatermarkInMs() * 1000
            line = passed // width * width  # requests before it are due
            _, number, parts = self.listed()
            tokens, last = self.bucket.get() if self.bucket.exists() else (None, None)
            due, rest, open_, decided = sorted(p for p in parts if p[0] < line), [p for p in parts if p[0] >= line], [], False
            for i, (_, _, no, _) in enumerate(due):
                open_ += zip(*self.parts.getValue((no,)))
                self.parts.removeKey((no,))
                until = min(line, due[i + 1][0]) if i + 1 < len(due) else line  # nothing before it comes in a later part
                open_.sort(key=lambda r: (r[0], tied(r[1])))
                cut = bisect_left(open_, until, key=lambda r: r[0])
                found, open_ = open_[:cut], open_[cut:]
                for at in range(0, len(found), FRAME):
                    ready = found[at:at + FRAME]
                    a, m, w, tokens, last = spend([r[0] / 1e6 for r in ready], rate, period, tokens, last)
                    decided = True
                    yield pd.DataFrame({"k": pd.Series([key[0]] * len(ready), dtype=object), "ts_us": [r[0] for r in ready], "id": pd.Series([r[1] for r in ready], dtype=object),
                                        "allowed": a, "remaining": m, "retry_after": pd.array(w, dtype="Int64")})
            if due:
                number = self.store(open_, number, rest)
                self.keep(None, number, rest)
            if last is None:
                return
            unused = int(last * 1_000_000) + idle
            if unused <= passed and not rest:
                self.bucket.clear()
            elif decided:
                self.bucket.update((float(tokens), float(last)))
                self.handle.registerTimer(max(unused, passed) // 1000 + 1)

        def close(self) -> None:
            pass

    keyed_state(requests.sparkSession)
    rows = keyed_rows(requests.withWatermark(ts, watermark), client, ts, tie)
    found = rows.groupBy("k").transformWithStateInPandas(
        Bucket(), "k string, ts_us bigint, id string, allowed boolean, remaining int, retry_after bigint", "append", "EventTime")
    return found.select(F.col("k").cast(ct).alias(client), "ts_us", F.col("id").cast(tt).alias(tie), "allowed", "remaining", "retry_after")
