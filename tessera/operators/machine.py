"""The session machine: positions, guarded moves, locks, clocks with deadlines, late answers, fencing, one step at a time.

`step` takes the state of one session and one located event.  A batch folds it over sorted events (`fold_sessions`); the
stream (`tessera.streaming.machine`) keeps the same state between micro-batches and lets timers fire its deadlines.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.runs import GRACE_MS, RECORDING_MS
from tessera.operators.sessions import PHASES

#: What an event says, and what the plan says about the question that it names.
EVENT = "session_id long, seq long, request string, kind string, at_ms long, captured_ms long, expected_revision long, question string, phase string, answer string, recording string, mode string"
PLACE = "question string, module string, task string, section string, task_index long, question_index long, scope string, duration_ms long, prepare_ms long, back string, review boolean, lock_on_advance boolean, next_module string, next_question string"
#: One row for each event and for each deadline that fired (seq null): the verdict and the state after it.
LOG = "session_id long, at_ms long, seq long, kind string, verdict string, revision long, module string, question string, phase string, clock string, used_ms long, finished boolean"
LOG_COLUMNS = [x.split()[0] for x in LOG.split(", ")]
HEAD = """mode string, module string, question string, task string, section string, scope string, task_index long, question_index long, duration_ms long, prepare_ms long, phase string,
    paused boolean, finished boolean, assisted boolean, revision long, active string, open array<string>, submitted array<string>, saving_until_ms long, last_ms long"""
CLOCK = "module string, question string, phase string, duration_ms long, consumed_ms long, started_ms long, running_since_ms long, deadline_ms long, expired_ms long, stopped_ms long, completed boolean"
ANSWER = "answer string, recording string, at_ms long"
REQUEST = "digest string, revision long, at_ms long"


@dataclass
class Head:
    """Where a session stands.  Of its clocks at most one runs: `active`; `open` are those begun and not completed."""

    mode: str
    module: str
    question: str
    task: str
    section: str
    scope: str = "none"
    task_index: int = 0
    question_index: int = 0
    duration_ms: int | None = None
    prepare_ms: int | None = None
    phase: str = "instructions"
    paused: bool = False
    finished: bool = False
    assisted: bool = False
    revision: int = 1
    active: str | None = None
    open: list[str] = field(default_factory=list)
    submitted: list[str] = field(default_factory=list)
    saving_until_ms: int | None = None
    last_ms: int = 0


@dataclass
class Clock:
    module: str
    question: str
    phase: str
    duration_ms: int | None
    consumed_ms: int = 0
    started_ms: int | None = None
    running_since_ms: int | None = None
    deadline_ms: int | None = None
    expired_ms: int | None = None
    stopped_ms: int | None = None
    completed: bool = False

    def used(self, at: int) -> int:
        running = 0 if self.running_since_ms is None else max(0, at - self.running_since_ms)
        used = self.consumed_ms + running
        return used if self.duration_ms is None else min(self.duration_ms, used)

    def up(self, at: int) -> bool:
        return self.duration_ms is not None and self.used(at) >= self.duration_ms

    def stop(self, at: int, completed: bool = False) -> None:
        running = self.running_since_ms is not None
        if running and self.up(at) and self.expired_ms is None:
            self.expired_ms = self.deadline_ms
        self.consumed_ms = self.used(at)
        self.running_since_ms = self.deadline_ms = None
        if running:
            self.stopped_ms = at
        self.completed = self.completed or completed


@dataclass
class Session:
    """All state of one session.  Stores are dictionaries in a batch and state variables in a stream."""

    head: Head | None
    clocks: MutableMapping[str, Clock]
    answers: MutableMapping[str, tuple]
    locks: MutableMapping[str, bool]
    requests: MutableMapping[str, tuple]
    #: How long a request is remembered, by the time of events; None: always.
    remember_ms: int | None = None


def empty_session(remember_ms: int | None = None) -> Session:
    return Session(None, {}, {}, {}, {}, remember_ms)


def remembered(s: Session, request: tuple, at: int) -> bool:
    return s.remember_ms is None or at - request[2] <= s.remember_ms


def _clock_id(phase: str, scope: str, module: str, task: str, question: str) -> str:
    return f"{phase}:{scope}:{module if scope == 'module' else task if scope == 'task' else question}"


def _locked(s: Session, e) -> bool:
    return e.module in s.head.submitted or f"t:{e.module}:{e.task_index}" in s.locks or f"q:{e.module}:{e.question_index}" in s.locks


def _answer(s: Session, e) -> str:
    """Verdict of an answer; input of the last second before a cutoff may arrive a second after it."""
    h, at = s.head, e.at_ms
    if _locked(s, e):
        return "locked"
    if e.module != h.module:
        return "other_module"
    clock = s.clocks.get(_clock_id("response", e.scope, e.module, e.task, e.question))
    spoken = e.section == "speaking"
    if (spoken or h.mode == "exam") and clock is not None and clock.started_ms is not None and clock.up(at):
        cutoff = clock.deadline_ms if clock.expired_ms is None else clock.expired_ms
        taken = e.captured_ms
        buffered = taken is not None and cutoff is not None and cutoff - GRACE_MS <= taken <= min(cutoff, at) and at <= cutoff + GRACE_MS
        saving = spoken and h.phase == "saving" and h.question == e.question and e.recording is not None and h.saving_until_ms is not None and at <= h.saving_until_ms
        if not buffered and not saving:
            return "too_late"
    before = s.answers.get(e.question)
    s.answers[e.question] = (before[0] if e.recording is not None and e.answer is None and before else e.answer, e.recording if e.recording is not None or not before else before[1], at)
    return "accepted"


def _move(s: Session, e) -> str:
    """Verdict of a move; an accepted one sets the position, locks what is left behind and opens the saving of recordings."""
    h, at, to = s.head, e.at_ms, e.phase
    spoken, same = e.section == "speaking", e.question_index == h.question_index
    if to not in PHASES:
        return "bad_phase"
    if e.module != h.module:
        return "submit_first"
    if to in ("saving", "recorded") and not spoken:
        return "not_spoken"
    if to == "saving" and (h.phase not in ("response", "saving") or not same):
        return "not_recording"
    if to == "recorded" and (s.answers.get(e.question) or (None, None))[1] is None:
        return "no_recording"
    if to == "response" and h.phase == "saving" and same:
        return "still_saving"
    again = to == "response" and h.phase == "recorded" and same
    if again and h.mode == "exam":
        return "no_second_take"
    if _locked(s, e):
        return "locked"
    if (e.back == "none" and e.question_index < h.question_index) or (e.back == "task" and e.task_index < h.task_index):
        return "no_way_back"
    if to == "review" and not e.review:
        return "no_review"
    clock = s.clocks.get(_clock_id("response", e.scope, e.module, e.task, e.question))
    begun = clock is not None and clock.started_ms is not None
    if to == "response" and spoken and begun and clock.up(at):
        return "time_used_up"
    if e.section in ("listening", "speaking") and begun and to in ("instructions", "directions", "stimulus", "prepare"):
        return "already_answering"
    if to == "saving" and h.phase != "saving":
        asked = at if e.captured_ms is None else e.captured_ms
        if not begun or asked > at + GRACE_MS or asked < clock.started_ms - GRACE_MS:
            return "not_this_phase"
        stopped = min(at, max(clock.started_ms, asked))
        if at > stopped + RECORDING_MS:
            return "save_window_over"
        h.saving_until_ms = stopped + RECORDING_MS
    elif to != "saving":
        h.saving_until_ms = None
    if e.section == "writing":
        for k in range(h.task_index, e.task_index):
            s.locks[f"t:{e.module}:{k}"] = True
    elif e.section in ("listening", "speaking") and e.lock_on_advance:
        for k in range(h.question_index, e.question_index):
            s.locks[f"q:{e.module}:{k}"] = True
    h.assisted = h.assisted or again
    h.question, h.task, h.section, h.scope, h.phase = e.question, e.task, e.section, e.scope, to
    h.task_index, h.question_index, h.duration_ms, h.prepare_ms = e.task_index, e.question_index, e.duration_ms, e.prepare_ms
    return "accepted"


def _submit(s: Session, e) -> str:
    h = s.head
    if e.module in h.submitted:
        return "sealed"
    if e.module != h.module:
        return "not_current"
    for name in h.open:
        clock = s.clocks[name]
        clock.stop(e.at_ms, True)
        s.clocks[name] = clock
    h.open, h.active = [], None
    h.submitted = [*h.submitted, h.module]
    h.scope, h.duration_ms, h.prepare_ms, h.saving_until_ms = "none", None, None, None
    if e.next_module is None:
        h.finished, h.paused, h.phase = True, True, "completed"
    else:
        h.module, h.question, h.task_index, h.question_index, h.phase, h.paused = e.next_module, e.next_question, 0, 0, "instructions", False
    return "accepted"


def _synchronize(s: Session, at: int) -> None:
    """Let exactly the clock of the present position run; complete those that were left."""
    h, due, cap = s.head, None, None
    if not h.finished:
        if h.phase == "prepare" and h.section == "speaking":
            due, cap = _clock_id("prepare", "question", h.module, h.task, h.question), h.prepare_ms
        else:
            name = _clock_id("response", h.scope, h.module, h.task, h.question)
            if h.phase == "response" or (h.scope in ("module", "task") and name in h.open):
                due, cap = name, h.duration_ms
    for name in [x for x in h.open if x != due]:
        clock = s.clocks[name]
        saving = h.section == "speaking" and clock.phase == "response" and clock.question == h.question and h.phase in ("saving", "recorded")
        clock.stop(at, not saving)
        s.clocks[name] = clock
        if not saving:
            h.open = [x for x in h.open if x != name]
    h.active = due
    if due is None:
        return
    clock = s.clocks.get(due) or Clock(h.module, h.question, due.split(":")[0], cap)
    if h.paused or clock.completed:
        if clock.running_since_ms is not None:
            clock.stop(at)
    elif clock.started_ms is not None and clock.up(at):
        clock.stop(at)
    elif clock.running_since_ms is None:
        clock.started_ms = at if clock.started_ms is None else clock.started_ms
        clock.running_since_ms, clock.stopped_ms = at, None
        clock.deadline_ms = None if clock.duration_ms is None else at + max(0, clock.duration_ms - clock.consumed_ms)
    s.clocks[due] = clock
    if clock.started_ms is not None and not clock.completed and due not in h.open:
        h.open = [*h.open, due]


def deadline(s: Session) -> int | None:
    """When the running clock is up."""
    if s.head is None or s.head.active is None:
        return None
    clock = s.clocks.get(s.head.active)
    return None if clock is None or clock.running_since_ms is None else clock.deadline_ms


def _row(session: int, s: Session, at: int, seq: int | None, kind: str, verdict: str) -> tuple:
    h = s.head
    if h is None:
        return (session, at, seq, kind, verdict, 0, None, None, None, None, None, False)
    clock = s.clocks.get(h.active) if h.active else None
    return (session, at, seq, kind, verdict, h.revision, h.module, h.question, h.phase, h.active, None if clock is None else clock.used(at), h.finished)


def advance(session: int, s: Session, until: int) -> list[tuple]:
    """Fire the deadline of the running clock if it lies at or before a moment."""
    at = deadline(s)
    if at is None or at > until:
        return []
    clock = s.clocks[s.head.active]
    clock.stop(at)
    s.clocks[s.head.active] = clock
    return [_row(session, s, at, None, "deadline", "expired")]


def step(session: int, s: Session, e) -> list[tuple]:
    """Log rows of one event: deadlines that lie before it, then its own verdict."""
    at = e.at_ms
    fired = advance(session, s, at)
    digest = "|".join("" if x is None else str(x) for x in (e.kind, e.question, e.phase, e.answer, e.recording))
    seen = s.requests.get(e.request) if e.request is not None else None
    h = s.head
    if seen is not None and remembered(s, seen, at):
        verdict = "replayed" if seen[0] == digest else "conflict"
    elif e.module is None:
        verdict = "unknown_question"
    elif h is None:
        verdict = "accepted" if e.kind == "start" else "no_session"
        if verdict == "accepted":
            s.head = Head(e.mode if e.mode in ("practice", "exam") else "practice", e.module, e.question, e.task, e.section, task_index=e.task_index, question_index=e.question_index, last_ms=at)
    elif e.kind == "start":
        verdict = "reused"
    elif h.finished:
        verdict = "finished"
    elif e.expected_revision is not None and e.expected_revision != h.revision:
        verdict = "stale"
    else:
        if e.kind == "answer":
            verdict = _answer(s, e)
        elif e.kind == "move":
            verdict = _move(s, e)
        elif e.kind == "submit":
            verdict = _submit(s, e)
        elif e.kind in ("pause", "resume"):
            verdict, h.paused = "accepted", e.kind == "pause"
        else:
            verdict = "unknown_kind"
        if verdict == "accepted":
            h.revision += 1
            h.last_ms = at
            _synchronize(s, at)
    if verdict == "accepted" and e.request is not None:
        s.requests[e.request] = (digest, s.head.revision, at)
    return [*fired, _row(session, s, at, e.seq, e.kind, verdict)]


_WHOLE = ("session_id", "seq", "at_ms", "captured_ms", "expected_revision", "task_index", "question_index", "duration_ms", "prepare_ms")


def plain_events(rows: pd.DataFrame) -> Iterator:
    """Rows as tuples with names, nulls as None and whole numbers as int."""
    columns = {}
    for name in rows.columns:
        values = rows[name]
        gone = values.isna()
        kept = values.where(~gone, 0).astype("int64").astype(object) if name in _WHOLE else values.astype(object)
        columns[name] = kept.where(~gone, None)
    return pd.DataFrame(columns, dtype=object).itertuples(index=False)


def located_events(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Events with what the plan (columns of PLACE) says of their question; those of unknown questions get nulls."""
    return events.join(plan, "question", "left")


def fold_sessions(located: DataFrame, until_ms: int | None = None, remember_ms: int | None = None) -> DataFrame:
    """LOG of all events of each session in the order of (at_ms, seq); until_ms fires deadlines up to then at the end.

    Rows of one session with equal at_ms and seq are copies of one event and count once.  Rows without a session or a time
    are left out.
    Sessions are folded one after another from sorted rows, so that a task holds the state of one session only.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state, last = None, empty_session(remember_ms), None
        for batch in batches:
            out: list[tuple] = []
            for e in plain_events(batch):
                if (e.session_id, e.at_ms, e.seq) == last:
                    continue
                last = (e.session_id, e.at_ms, e.seq)
                if e.session_id != session:
                    if session is not None and until_ms is not None:
                        out += advance(session, state, until_ms)
                    session, state = e.session_id, empty_session(remember_ms)
                out += step(session, state, e)
            yield pd.DataFrame(out, columns=LOG_COLUMNS)
        if session is not None and until_ms is not None:
            yield pd.DataFrame(advance(session, state, until_ms), columns=LOG_COLUMNS)

    rows = located.where(F.col("session_id").isNotNull() & F.col("at_ms").isNotNull())
    return rows.repartition("session_id").sortWithinPartitions("session_id", "at_ms", "seq").mapInPandas(fold, LOG)

