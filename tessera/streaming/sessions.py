"""Sessions as a stream: the reducer of operators.runs with its state kept between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.runs import RUN_SCHEMA, Run, reduce_events, run_row

STATE = "revision long, answers string, consumed_ms long, running_since_ms long, finished boolean, accepted long, rejected long"


def _loaded(state: GroupState) -> Run:
    if not state.exists:
        return Run()
    revision, answers, consumed, since, finished, accepted, rejected = state.get
    return Run(revision, json.loads(answers), consumed, since, finished, accepted, rejected)


def stream_sessions(events: DataFrame, limit_ms: int | None = None, idle: str | None = None) -> DataFrame:
    """The current state of each session touched by a micro-batch (update mode).

    events: session_id, seq, kind, at_ms, question, answer.  Inside a batch events are taken by (at_ms, seq); batches are
    taken as they come, as the reducer decides on late input by the session's own clock and drops none unseen.

    idle (such as "2 days") bounds the state: a session is forgotten once the watermark, which trails the latest event by
    idle, passes its last event by as much again.  Events older than the watermark are then dropped, and a forgotten session
    would begin anew; without idle nothing is forgotten.
    """
    if idle is not None:
        events = events.withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", idle)
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run = _loaded(state)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "seq"])
        reduce_events(run, zip(rows.kind, rows.at_ms, rows.question, rows.answer, strict=True), limit_ms)
        state.update((run.revision, json.dumps(run.answers), run.consumed_ms, run.running_since_ms, run.finished, run.accepted, run.rejected))
        if wait is not None:
            state.setTimeoutTimestamp(max(int(rows.at_ms.max()), state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame([run_row(int(key[0]), run)])

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return events.groupBy("session_id").applyInPandasWithState(step, RUN_SCHEMA, STATE, "update", timeout)
