"""Practice runs: grading, attempt kinds, clocks, late input and the session reducer."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import answered, folded

OBJECTIVE = ("single_choice", "fill_blank", "sentence_order")
#: Grace for input captured before a cutoff, and for saving a recording.
GRACE_MS, RECORDING_MS = 1_000, 120_000
#: Default seconds by task kind, the interview cap, and the repeat ladder.
DEFAULT_SECONDS = {
    "complete_words": 720, "read_daily": 720, "read_academic": 720, "listen_response": 20, "listen_conversation": 20, "listen_announcement": 20,
    "listen_talk": 30, "build_sentence": 410, "write_email": 420, "academic_discussion": 600, "listen_repeat": 12, "interview": 45,
}
INTERVIEW_CAP = 45
REPEAT_SECONDS = (8, 8, 10, 10, 10, 12, 12)


def grade_answer(kind: Column, key: Column, submitted: Column) -> Column:
    """struct(status, correct, total) of a submitted list against the key list.

    Choices must be equal; blanks may equal any accepted answer after trimming, collapsing white space and lower-casing,
    punctuation kept; orders must be equal item by item.  No key or another kind is unscored; blank is unanswered, 0 of 1.
    """
    scored = kind.isin(*OBJECTIVE) & answered(key)
    first = F.element_at(submitted, 1)
    one = F.size(submitted) == 1
    right = (
        F.when(kind == "single_choice", one & (F.size(key) == 1) & (first == F.element_at(key, 1)))
        .when(kind == "fill_blank", one & F.exists(key, lambda k: folded(k) == folded(first)))
        .when(kind == "sentence_order", submitted == key)
    )
    status = F.when(~scored, "unscored").when(~answered(submitted), "unanswered").when(F.coalesce(right, F.lit(False)), "correct").otherwise("incorrect")
    total = F.when(status != "unscored", 1)
    correct = F.when(status == "correct", 1).when(status != "unscored", 0)
    return F.struct(status.alias("status"), correct.alias("correct"), total.alias("total"))


def normalized_answer(answer: Column) -> Column:
    """Null is an empty answer; lists of at most 100 items of at most 20 000 characters pass, others are null."""
    a = F.coalesce(answer, F.array(F.lit("")))
    return F.when((F.size(a) <= 100) & F.forall(a, lambda x: F.length(F.coalesce(x, F.lit(""))) <= 20_000), a)


def attempt_kind(question: list[str], order: list[str]) -> Column:
    """first for the earliest attempt at a question, retry for later ones."""
    return F.when(F.row_number().over(Window.partitionBy(*question).orderBy(*order)) == 1, "first").otherwise("retry")


def resolve_timing(kind: Column, custom: Column, standard: Column, source: Column, ordinal: Column) -> Column:
    """Seconds for a response: custom, else the user's standard, else the source's, else the default of the kind.

    Interviews never exceed their cap; repeat tasks use the ladder by ordinal (from 1) when nothing else is set.
    """
    default = F.lit(None).cast("int")
    for k, v in DEFAULT_SECONDS.items():
        default = F.when(kind == k, v).otherwise(default)
    ladder = F.get(F.array(*(F.lit(x) for x in REPEAT_SECONDS)), ordinal - 1)
    default = F.when(kind == "listen_repeat", F.coalesce(F.when(ordinal >= 1, ladder), default)).otherwise(default)
    valid = lambda c: F.when((c > 0) & (c <= 7200), c)
    seconds = F.coalesce(valid(custom), valid(standard), valid(source), default)
    return F.when(kind == "interview", F.least(seconds, F.lit(INTERVIEW_CAP))).otherwise(seconds)


def elapsed_at(consumed_ms: Column, running_since_ms: Column, at_ms: Column, duration_ms: Column) -> Column:
    """Time used on a clock at a moment: what was consumed plus what runs, never more than the duration."""
    running = F.when(running_since_ms.isNotNull(), F.greatest(F.lit(0), at_ms - running_since_ms)).otherwise(0)
    used = consumed_ms + running
    return F.when(duration_ms.isNull(), used).otherwise(F.least(used, duration_ms))


def accepts_input(captured_ms: Column, received_ms: Column, deadline_ms: Column, recording: Column) -> Column:
    """Two clocks decide on late input: when it was captured and when it arrived.

    Input that arrives by the deadline counts.  Later input counts only if it was captured within the last second before
    the deadline and arrived within a second after it; recordings may take longer to be saved.
    """
    on_time = received_ms <= deadline_ms
    last_moment = (captured_ms <= deadline_ms) & (captured_ms >= deadline_ms - GRACE_MS)
    grace = F.when(recording, RECORDING_MS).otherwise(GRACE_MS)
    return deadline_ms.isNull() | on_time | (last_moment & (received_ms <= deadline_ms + grace))


def response_intervals(events: DataFrame, key: list[str], at: str, order: list[str], active: Column) -> DataFrame:
    """Milliseconds of each key's active phases: from an active event to the next event of the key."""
    w = Window.partitionBy(*key).orderBy(*order)
    span = F.when(active, F.coalesce(F.lead(at).over(w) - F.col(at), F.lit(0))).otherwise(0)
    return events.withColumn("span_ms", span).groupBy(*key).agg(F.sum("span_ms").alias("active_ms"), F.count("*").alias("n_events"))


def session_view(sessions: DataFrame) -> DataFrame:
    """Adds elapsed and remaining whole seconds from consumed_ms, running_since_ms, at_ms and duration_ms."""
    used = elapsed_at(F.col("consumed_ms"), F.col("running_since_ms"), F.col("at_ms"), F.col("duration_ms"))
    left = F.greatest(F.lit(0), F.col("duration_ms") - used)
    return sessions.withColumn("elapsed_seconds", F.round(used / 1000).cast("long")).withColumn("remaining_seconds", F.ceil(left / 1000).cast("long"))


def replay_requests(events: DataFrame, request: list[str], digest: str, order: list[str]) -> DataFrame:
    """Idempotency: a request repeated with its digest is replayed, with another digest it is a conflict."""
    w = Window.partitionBy(*request).orderBy(*order)
    first = F.first(digest).over(w.rowsBetween(Window.unboundedPreceding, 0))
    verdict = F.when(F.row_number().over(w) == 1, "accepted").when(F.col(digest) == first, "replayed").otherwise("conflict")
    return events.withColumn("verdict", verdict)


@dataclass
class Run:
    """State of one session while its events are reduced."""

    revision: int = 0
    answers: dict[str, str] = field(default_factory=dict)
    consumed_ms: int = 0
    running_since_ms: int | None = None
    finished: bool = False
    accepted: int = 0
    rejected: int = 0

    def apply(self, kind: str, at_ms: int, question: str | None, answer: str | None, deadline_ms: int | None = None) -> bool:
        """One event; returns whether it was accepted.  Nothing is accepted after the commit."""
        late = deadline_ms is not None and self.consumed_ms + (at_ms - self.running_since_ms if self.running_since_ms is not None else 0) > deadline_ms
        if self.finished or (kind == "answer" and late):
            self.rejected += 1
            return False
        if kind == "answer" and question is not None:
            self.answers[question] = answer or ""
            if self.running_since_ms is None:
                self.running_since_ms = at_ms
        elif kind in ("pause", "commit"):
            if self.running_since_ms is not None:
                self.consumed_ms += max(0, at_ms - self.running_since_ms)
                self.running_since_ms = None
            self.finished = kind == "commit"
        elif kind == "resume" and self.running_since_ms is None:
            self.running_since_ms = at_ms
        self.revision += 1
        self.accepted += 1
        return True


RUN_SCHEMA = "session_id long, revision long, n_answers long, consumed_ms long, finished boolean, accepted long, rejected long"


def run_row(session_id: int, run: Run) -> dict:
    return {
        "session_id": session_id, "revision": run.revision, "n_answers": sum(bool(v.strip()) for v in run.answers.values()), "consumed_ms": run.consumed_ms,
        "finished": run.finished, "accepted": run.accepted, "rejected": run.rejected,
    }


def reduce_events(run: Run, rows: Iterable[tuple], limit_ms: int | None) -> Run:
    """rows: (kind, at_ms, question, answer) in order."""
    for kind, at_ms, question, answer in rows:
        run.apply(kind, int(at_ms), None if question is None else str(question), answer, limit_ms)
    return run


def reduce_sessions(events: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """Fold each session's ordered events (session_id, seq, kind, at_ms, question, answer) into its final state."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["at_ms", "seq"])
        run = reduce_events(Run(), zip(rows.kind, rows.at_ms, rows.question, rows.answer, strict=True), limit_ms)
        return pd.DataFrame([run_row(int(pdf.session_id.iloc[0]), run)])

    return events.groupBy("session_id").applyInPandas(fold, RUN_SCHEMA)


def commit_attempts(plan: DataFrame, answers: DataFrame, session: list[str]) -> DataFrame:
    """One graded attempt for every planned question, answered or not; duration is 0 as the module's clock counts.

    plan: session columns, question_id, type, key.  answers: session columns, question_id, submitted.
    """
    joined = plan.join(answers, [*session, "question_id"], "left")
    graded = joined.withColumn("objective", grade_answer(F.col("type"), F.col("key"), F.coalesce("submitted", F.array().cast("array<string>"))))
    return graded.select(*session, "question_id", F.col("objective.status").alias("status"), F.col("objective.correct").alias("correct"), F.col("objective.total").alias("total"), F.lit(0).alias("duration_seconds"))


def blank_edits(edits: Column, length: int) -> Column:
    """Fold an array of (at, letter) edits over `length` cells: the last edit of a cell wins, an empty letter clears it."""
    start = F.array_repeat(F.lit(""), length)
    put = lambda cells, e: F.transform(cells, lambda c, i: F.when(i == e["at"], e["letter"]).otherwise(c))
    return F.array_join(F.transform(F.aggregate(edits, start, put), lambda c: F.when(c == "", "_").otherwise(c)), "")
