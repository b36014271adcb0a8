"""Requests and alerts over time: a state machine of requests with polls, and alerts that need a run of breaching windows."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What each kind of event leads to; a poll asks and changes nothing.
STATES = {"request": "processing", "completed": "completed", "failed": "failed"}
NOT_STARTED = "not_started"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def poll_states(events: DataFrame, key: str = "key", time: str = "ts", kind: str = "kind", event: str = "event") -> DataFrame:
    """(key, event, ts, state): for each poll, the state that the last request or result before it (by time, then event id) led to."""
    told = F.coalesce(*(F.when(F.col(kind) == k, F.lit(s)) for k, s in STATES.items()))
    before = Window.partitionBy(key).orderBy(time, event).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("state", F.coalesce(F.last(told, ignorenulls=True).over(before), F.lit(NOT_STARTED)))
    return seen.where(F.col(kind) == "poll").select(F.col(key).alias("key"), F.col(event).alias("event"), F.col(time).alias("ts"), "state")


class RequestStates(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, then applies them in order of time and answers polls."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, us array<bigint>, event array<bigint>, kind array<string>")  # one value: every call to the store is a round trip

    def _get(self) -> tuple[str, list, list, list]:
        held = self.held.get()
        return (held[0], *map(list, held[1:])) if held else (NOT_STARTED, [], [], [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, us, event, kind = self._get()
        timer = us[0] if us else None  # there is one for the first row that waits
        for frame in rows:
            us += frame["us"].tolist()
            event += frame["event"].tolist()
            kind += frame["kind"].tolist()
        us, event, kind = map(list, zip(*sorted(zip(us, event, kind))))
        self.held.update((state, us, event, kind))
        if us[0] != timer:
            self.handle.registerTimer(us[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, us, event, kind = self._get()
        due = bisect.bisect_left(us, timerValues.getCurrentWatermarkInMs() * 1000)  # all that are due, whichever timer it is
        if not due:
            return iter(())
        out = []
        for row in zip(us[:due], event[:due], kind[:due]):
            if row[2] == "poll":
                out.append((key[0], row[1], row[0], state))
            state = STATES.get(row[2], state)
        self.held.update((state, us[due:], event[due:], kind[due:]))
        if due < len(us):
            self.handle.registerTimer(us[due] // 1000 + 1)
        return iter([_polls(out)] if out else ())

    def close(self) -> None:
        pass


def _polls(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "event", "us", "state"])


def stream_poll_states(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The same rows from a stream of (key long, event long, ts timestamp, kind string); a poll is answered when the watermark has passed it.

    Rows that come later than `delay` behind the newest are dropped by the watermark.
    """
    keyed = events.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay).groupBy("key")
    told = keyed.transformWithStateInPandas(RequestStates(), "key long, event long, us long, state string", "Append", "EventTime")
    return told.select("key", "event", F.timestamp_micros("us").alias("ts"), "state")


def sustained(windows: DataFrame, *, width: str, runs: int, above: float, keys: str = "key", start: str = "start", average: str = "average") -> DataFrame:
    """(key, at, event, since, windows): alerts over windowed averages, in batch.

    "firing" at the end of the `runs`-th window in a row whose average is above the limit, "recovered" at the end of the last breaching
    window before one that does not breach or is missing. A run that is still open has not recovered.
    """
    step = F.expr(f"interval {width}")
    by_key = Window.partitionBy(keys).orderBy(start)
    marked = windows.withColumn("_breach", F.col(average) > above)
    fresh = ~F.coalesce(F.lag("_breach").over(by_key) & (F.lag(start).over(by_key) + step == F.col(start)), F.lit(False))
    # a run starts where the window before does not breach or is missing; only breaching windows are in runs
    run = marked.withColumn("_run", F.sum(F.when(F.col("_breach") & fresh, 1).otherwise(0)).over(by_key)).withColumn("_next", F.lead(start).over(by_key)).where("_breach")
    islands = run.groupBy(keys, "_run").agg(F.min(start).alias("since"), F.max(start).alias("last"), F.count("*").alias("windows"), F.max_by("_next", start).alias("_next")).where(F.col("windows") >= runs)
    firing = F.struct((F.col("since") + F.expr(f"interval {width}") * runs).alias("at"), F.lit("firing").alias("event"), F.lit(runs).cast("long").alias("windows"))
    recovered = F.struct((F.col("last") + step).alias("at"), F.lit("recovered").alias("event"), F.col("windows"))
    told = F.when(F.col("_next").isNull(), F.array(firing)).otherwise(F.array(firing, recovered))
    return islands.select(F.col(keys).alias("key"), "since", F.inline(told)).select("key", "at", "event", "since", "windows")


class Sustained(StatefulProcessor):
    """The run of breaching windows of a key: its start, its last window and its length."""

    def __init__(self, width_us: int, runs: int, above: float):
        self.width, self.runs, self.above = width_us, runs, above

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "since long, last long, windows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("us")
        since, last, windows = self.run.get() if self.run.exists() else (0, 0, 0)
        out = []
        for start, average in zip(frame["us"].tolist(), frame["average"].tolist()):
            breach = average > self.above
            if windows and (not breach or start != last + self.width):
                if windows >= self.runs:
                    out.append((key[0], last + self.width, "recovered", since, windows))
                windows = 0
            if breach:
                since = since if windows else start
                last, windows = start, windows + 1
                if windows == self.runs:
                    out.append((key[0], start + self.width, "firing", since, windows))
        self.run.update((since, last, windows))
        yield pd.DataFrame(out, columns=["key", "at", "event", "since", "windows"])

    def close(self) -> None:
        pass


def stream_sustained(windows: DataFrame, *, width_us: int, runs: int, above: float) -> DataFrame:
    """The same rows from a stream of (key string, start timestamp, average double), in order of start for each key, as an aggregation in append mode gives it."""
    keyed = windows.select("key", F.unix_micros("start").alias("us"), "average").groupBy("key")
    told = keyed.transformWithStateInPandas(Sustained(width_us, runs, above), "key string, at long, event string, since long, windows long", "Append", "None")
    return told.select("key", F.timestamp_micros("at").alias("at"), "event", F.timestamp_micros("since").alias("since"), "windows")


def with_state_store(spark, start):
    """Start a query whose custom state needs RocksDB; the session's own setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        return start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
