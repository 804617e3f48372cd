"""The page state machine and the client's view as stateful streams, equal to their batch forms.

State is one small row a page. Where ``event_time`` names a timestamp column, it is bounded: the state of
a page goes when the watermark has passed its last event by ``idle`` milliseconds; without it all pages
stay. ``summaries`` is the plain windowed aggregate over the same stream. Keys may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds of event time after which a page without events is given up.
IDLE = 3_600_000
STATE = "at string, state string, attempts int, error string"
OUT = "state string, attempts int, error string"
VIEW_STATE = "attempts int, dets array<int>, text string, text_at string, truncated boolean, error string, error_at string"
VIEW = "attempts int, detections int, markdown string, truncated boolean, error string"


def _keyed(events: DataFrame, step, out: str, state: str, event_time: str | None, delay: str, idle: int) -> DataFrame:
    """step over the events of each page: step(key, batch, state) gives the new state and the row that it shows."""
    names = [x.split(" ")[0] for x in out.split(", ")]
    schema = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in ("session_id", "page_num")) + ", " + out
    if event_time:
        events = events.withWatermark(event_time, delay).withColumn("at_ms", F.unix_millis(event_time))

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, last = held.get if held.exists else None, 0
        for batch in batches:
            now = step(now, batch)
            last = max(last, int(batch["at_ms"].max())) if event_time else 0
        held.update(now)
        if event_time:
            held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame([(*key, *step.shown(now))], columns=["session_id", "page_num", *names])

    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return events.groupBy("session_id", "page_num").applyInPandasWithState(run, schema, state, "update", timeout)


def page_states(events: DataFrame, event_time: str | None = None, delay: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """Updates of page states from a stream of (session_id, page_num, at, event, truncated, warnings, message); at orders a page's events as text."""

    def step(held: tuple | None, batch: pd.DataFrame) -> tuple:
        at, now, attempts, error = held or ("", "pending", 0, None)
        for e in batch.itertuples():
            attempts += e.event == "page_start"
            if e.event in ("page_start", "page_done", "error", "cancelled") and e.at > at:
                flagged = bool(e.truncated) or (e.warnings or 0) > 0
                now = {"page_start": "processing", "error": "failed", "cancelled": "cancelled"}.get(e.event, "warning" if flagged else "done")
                at, error = e.at, e.message if e.event == "error" else None
        return at, now, int(attempts), error

    step.shown = lambda held: held[1:]
    return _keyed(events, step, OUT, STATE, event_time, delay, idle)


def reduced(events: DataFrame, event_time: str | None = None, delay: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """Updates of what a client shows of each page, from a stream of (session_id, page_num, at, attempt, event, det_index, text, truncated)."""

    def step(held: tuple | None, batch: pd.DataFrame) -> tuple:
        attempts, dets, text, text_at, truncated, error, error_at = held or (0, [], None, "", False, None, "")
        dets = set(dets)
        for e in batch.itertuples():
            if e.attempt > attempts:
                attempts, dets = int(e.attempt), set()
            truncated = truncated or bool(e.truncated)
            if e.event == "det_result" and e.attempt == attempts:
                dets.add(int(e.det_index))
            if e.event in ("token", "page_done") and e.at > text_at:
                text, text_at = e.text, e.at
            if e.event in ("error", "page_done") and e.at > error_at:
                error, error_at = e.text if e.event == "error" else None, e.at
        return attempts, sorted(dets), text, text_at, truncated, error, error_at

    step.shown = lambda held: (held[0], len(held[1]), held[2], held[4], held[5])
    return _keyed(events, step, VIEW, VIEW_STATE, event_time, delay, idle)


def newest(snapshots: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """One snapshot of each (keys, seq), whatever is sent twice within the watermark."""
    return snapshots.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*keys, "seq"])


def summaries(events: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by window and kind, with a watermark for late ones."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event").agg(F.count("*").alias("n"))
