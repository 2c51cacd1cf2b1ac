"""The session machine as a stream: transformWithState with value, map and timer state.

Events of a session may come in any order.  They wait in a map until the watermark passes them and are then taken in the
order of (at_ms, seq), as a batch would.  Timers stand for the next waiting event and for the deadline of the running
clock, so a deadline fires when time passes it and needs no event.  Requests are remembered for a bounded time and a session idle for longer than
`idle` is forgotten with all its state, both by the time of events (Spark's own TTL knows only processing time).
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import astuple, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import machine as m

_FIELDS = {x.split()[0]: x for x in f"{m.EVENT}, {m.PLACE}".split(", ")}
_WAITING = [c for c in _FIELDS if c not in ("session_id", "at_ms", "seq")]
WAITING = ", ".join(_FIELDS[c] for c in _WAITING)


class _Stored(MutableMapping):
    """A map state as a dictionary of values of a kind."""

    def __init__(self, state, kind=tuple):
        self.state, self.kind = state, kind

    def __getitem__(self, key):
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        return self.kind(*self.state.getValue((key,))) if self.kind is not tuple else tuple(self.state.getValue((key,)))

    def __setitem__(self, key, value):
        self.state.updateValue((key,), astuple(value) if self.kind is not tuple else tuple(value) if isinstance(value, tuple) else (value,))

    def __delitem__(self, key):
        self.state.removeKey((key,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self):
        return sum(1 for _ in self.state.keys())


class _Event:
    def __init__(self, session_id, at_ms, seq, values):
        self.session_id, self.at_ms, self.seq = session_id, at_ms, seq
        self.__dict__.update(zip(_WAITING, values, strict=True))


def _value(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x


class SessionProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int | None, remember_ms: int | None):
        self.idle_ms, self.remember_ms = idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", m.HEAD)
        self.clocks = handle.getMapState("clocks", "id string", m.CLOCK)
        self.answers = handle.getMapState("answers", "question string", m.ANSWER)
        self.locks = handle.getMapState("locks", "id string", "locked boolean")
        self.requests = handle.getMapState("requests", "request string", m.REQUEST)
        self.waiting = handle.getMapState("waiting", "at_ms long, seq long", WAITING)

    def _session(self) -> m.Session:
        head = m.Head(*self.head.get()) if self.head.exists() else None
        if head is not None:
            head.open, head.submitted = list(head.open or []), list(head.submitted or [])
        return m.Session(head, _Stored(self.clocks, m.Clock), _Stored(self.answers), _Stored(self.locks), _Stored(self.requests), self.remember_ms)

    def _drain(self, session: int, watermark: int) -> list[tuple]:
        """Take the waiting events up to the watermark in their order, and set the timers for what comes next."""
        s, out = self._session(), []
        keys = sorted((k for k in self.waiting.keys()), key=lambda k: (k[0], k[1]))
        for key in keys:
            if key[0] > watermark:
                break
            out += m.step(session, s, _Event(session, key[0], key[1], self.waiting.getValue(key)))
            self.waiting.removeKey(key)
        out += m.advance(session, s, watermark)
        if self.remember_ms is not None:
            for request in [k for k, v in s.requests.items() if not m.remembered(s, v, watermark)]:
                del s.requests[request]
        left = [k for k in keys if k[0] > watermark]
        if s.head is not None:
            self.head.update(tuple(getattr(s.head, f.name) for f in fields(m.Head)))
        wanted = {k[0] for k in left[:1]} | {x for x in (m.deadline(s),) if x is not None}
        if s.head is not None and self.idle_ms is not None and not left:
            if s.head.last_ms + self.idle_ms <= watermark:
                self._forget()
                wanted = set()
            else:
                wanted.add(s.head.last_ms + self.idle_ms)
        set_already = set(self.handle.listTimers())
        for t in set_already - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - set_already:
            self.handle.registerTimer(t)
        return out

    def _forget(self) -> None:
        for state in (self.head, self.clocks, self.answers, self.locks, self.requests, self.waiting):
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for e in m.plain_events(batch):
                self.waiting.updateValue((e.at_ms, e.seq), tuple(_value(getattr(e, c)) for c in _WAITING))
        yield pd.DataFrame(self._drain(int(key[0]), timerValues.getCurrentWatermarkInMs()), columns=m.LOG_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._drain(int(key[0]), timerValues.getCurrentWatermarkInMs()), columns=m.LOG_COLUMNS)

    def close(self) -> None:
        pass


def stream_sessions(located: DataFrame, delay: str, idle: str | None = None, remember: str | None = None) -> DataFrame:
    """LOG rows of a stream of located events, each once the watermark, which trails the latest event by delay, passes it.

    The result is that of fold_sessions over the same events for all that the watermark has passed, whatever the order of
    arrival within delay.  An event that comes twice with its seq counts once; a request that comes again with another seq is
    replayed or a conflict, for as long as it is remembered (None: always).  Events older than
    the watermark are dropped by Spark.  Needs the RocksDB state store.
    """
    at = F.timestamp_millis("at_ms")
    ms = lambda x: None if x is None else int(pd.Timedelta(x).total_seconds() * 1000)
    rows = located.where(F.col("session_id").isNotNull() & F.col("at_ms").isNotNull()).withColumn("_at", at).withWatermark("_at", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(SessionProcessor(ms(idle), ms(remember)), m.LOG, "Append", "EventTime")
