"""Event-time alert streams: many events of one client within a trailing window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ostinato.streaming.state import FRAME, keyed_rows, keyed_state


#: Window lengths in a cell of time.
CELL = 4
#: As the line before which slots are judged: none is.
NOTHING = -(1 << 62)
#: Groups that a stream's clients and cells are dealt to; fixed, as a checkpoint belongs to one number of them.
GROUPS = 1024


def reached(group, us, threshold: int, width: int):
    """Which rows, sorted by group and time, have ``threshold`` rows of their group in ``(us - width, us]``; rows of the same instant count for each other."""
    import numpy as np

    if not len(us):
        return np.zeros(0, bool)
    ends = np.append((group[1:] != group[:-1]) | (us[1:] != us[:-1]), True)
    last = np.flatnonzero(ends)  # of each instant
    last = np.repeat(last, np.diff(last, prepend=-1))
    first = last - (max(threshold, 1) - 1)  # the row that must be inside the window still
    at = np.maximum(first, 0)
    return (first >= 0) & (group[at] == group) & (us[at] > us - width)


def alert_stream(
    events: DataFrame, threshold: int, window_seconds: float, client: str = "client_id", ts: str = "ts",
    event_id: str = "event_id", watermark: str = "10 minutes",
) -> DataFrame:
    """Stream of ``(client, ts_us, event_id)``: events at which the client's count in ``(ts - window, ts]``
    reaches the threshold.

    Time is cut into slots of the window's length, and CELL slots are a cell. An event belongs to its client and cell, one of a cell's last slot
    also to the client's next cell, as one that is only counted there. Clients and cells are dealt to GROUPS groups by hash: state and
    calls belong to a group, so their number does not grow with the clients, the slots or the events, and a busy client is in many groups.
    A group's events are appended as they come and judged together when the watermark has passed a slot and all its events are known. So the
    arrival order inside the watermark does not matter and the result is that of the batch form. When a slot is judged, its group's
    events of that slot and later ones are written once more; older ones go. Rows behind the watermark are dropped (and counted by Spark).
    """
    id_type = events.schema[client].dataType.simpleString()
    ev_type = events.schema[event_id].dataType.simpleString()
    width = int(window_seconds * 1_000_000)
    need = math.ceil(threshold)

    class Alerts(StatefulProcessor):
        def init(self, handle) -> None:
            import pyarrow as pa

            self.handle = handle
            self.schema = pa.schema([("k", pa.string()), ("id", pa.string()), ("us", pa.int64()), ("cell", pa.int64())])
            # rows: a record batch; judged: slots before it are done
            self.parts = handle.getListState("parts", "rows binary, judged bigint")

        def keep(self, rows, judged: int) -> None:
            for at in range(0, len(rows), FRAME):
                for part in rows.slice(at, FRAME).combine_chunks().to_batches():
                    self.parts.appendValue((part.serialize().to_pybytes(), judged))

        def wake(self, slot: int) -> None:
            """Set the timer for the end of a slot; the first slot that waits always has one."""
            self.handle.registerTimer(-(-(slot + 1) * width // 1000))

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pyarrow as pa

            first = []
            for frame in rows:
                if frame.empty:
                    continue
                self.keep(pa.Table.from_pandas(frame[self.schema.names], self.schema, preserve_index=False), NOTHING)
                first.append(np.maximum(frame["us"].to_numpy() // width, frame["cell"].to_numpy() * CELL).min())
            if first:
                self.wake(int(min(first)))
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import numpy as np
            import pandas as pd
            import pyarrow as pa

            line = timerValues.getCurrentWatermarkInMs() * 1000 // width  # slots before it are known
            found, judged = [], NOTHING
            for part, until in self.parts.get():
                found.append(pa.ipc.read_record_batch(pa.py_buffer(part), self.schema))
                judged = max(judged, until)
            if not found or judged >= line:
                return  # an earlier timer of this batch has done it
            rows = pa.Table.from_batches(found, self.schema)
            del found
            us, cell = rows["us"].to_numpy(), rows["cell"].to_numpy()
            slot = us // width
            self.parts.clear()
            # the next slot's windows reach into the last one that is known, if it is of the same cell
            wait = (slot >= line - 1) & (line < (cell + 1) * CELL)
            if wait.any():
                self.keep(rows.filter(pa.array(wait)), line)
                self.wake(int(np.maximum(np.maximum(slot, line), cell * CELL)[wait].min()))
            code = pd.factorize(rows["k"].to_pandas(), use_na_sentinel=False)[0]
            order = np.lexsort((us, cell, code))
            us, cell, slot, code = us[order], cell[order], slot[order], code[order]
            group = np.cumsum(np.append(False, (code[1:] != code[:-1]) | (cell[1:] != cell[:-1])))
            out = order[reached(group, us, need, width) & (slot // CELL == cell) & (slot >= judged) & (slot < line)]
            for at in range(0, len(out), FRAME):
                here = rows.take(pa.array(out[at:at + FRAME]))
                yield pd.DataFrame({"k": here["k"].to_pandas(), "ts_us": here["us"].to_numpy(), "id": here["id"].to_pandas()})

        def close(self) -> None:
            pass

    keyed_state(events.sparkSession)
    us = F.unix_micros(ts)
    slot = F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))
    cell = lambda s: F.call_function("div", s - F.pmod(s, F.lit(CELL)), F.lit(CELL))
    rows = keyed_rows(events.withWatermark(ts, watermark), client, ts, event_id, F.explode(F.sequence(cell(slot), cell(slot + 1))).alias("cell"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("k", "cell"), F.lit(GROUPS)))
    found = rows.groupBy("group").transformWithStateInPandas(Alerts(), "k string, ts_us bigint, id string", "append", "EventTime")
    return found.select(F.col("k").cast(id_type).alias(client), "ts_us", F.col("id").cast(ev_type).alias(event_id))


def repeated_violation_stream(violations: DataFrame, threshold: int = 5, window_minutes: float = 10, **kw) -> DataFrame:
    return alert_stream(violations, threshold, window_minutes * 60, **kw)


def brute_force_stream(failures: DataFrame, threshold: int = 10, window_minutes: float = 5, **kw) -> DataFrame:
    return alert_stream(failures, threshold, window_minutes * 60, **kw)


def hourly_summary_stream(events: DataFrame, violation: str = "rate_limit_violation", failure: str = "auth_failure",
                          kind: str = "type", ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Violations and failures per hour."""
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, "1 hour").alias("w")).agg(
        F.count_if(F.col(kind) == violation).alias("rate_limit_violations"), F.count_if(F.col(kind) == failure).alias("auth_failures"),
    ).select("w.start", "w.end", "rate_limit_violations", "auth_failures")
