"""Exam sessions as relations: creation, cursor moves, clocks over policy versions, recordings, audits, what a page shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.runs import GRACE_MS, RECORDING_MS, elapsed_at
from tessera.operators.verify import Rule, check_rules

#: Modes, phases of a cursor, and how many sessions a workspace holds.
MODES = ("practice", "exam")
PHASES = ("instructions", "directions", "stimulus", "prepare", "response", "saving", "recorded", "review")
MOST_SESSIONS = 1000
#: Fixed value: the policy of clocks that sessions are brought up to.
TIME_POLICY = 2


def _first(cases: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first code whose condition holds."""
    out = None
    for code, cond in cases:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out.otherwise(otherwise)


def create_sessions(requests: DataFrame, libraries: DataFrame, legacy: DataFrame, sessions: DataFrame) -> DataFrame:
    """What becomes of requests (request_id, library_id, mode, legacy_id): state, session and mode, with the plan's hash.

    libraries: library_id, content_hash; legacy: legacy_id, library_id, mode; sessions: session_id, legacy_id, finished.  A
    request that resumes a legacy run gets its unfinished session if there is one.  Of several requests for one legacy run
    the first creates it, and the others get that one.  New sessions freeze the library's content hash; those beyond what
    the workspace holds are refused.
    """
    lib = libraries.select("library_id", "content_hash")
    old = legacy.select("legacy_id", F.col("library_id").alias("_library"), F.col("mode").alias("_mode"))
    open_ = sessions.where("not finished and legacy_id is not null").groupBy("legacy_id").agg(F.min("session_id").alias("_session"))
    t = requests.join(lib, "library_id", "left").join(old, "legacy_id", "left").join(open_, "legacy_id", "left")
    mode = F.coalesce("mode", "_mode", F.lit("practice"))
    named = F.col("legacy_id").isNotNull()
    cases = [
        ("no_library", F.col("content_hash").isNull()), ("no_legacy", named & (F.col("_mode").isNull() | (F.col("_library") != F.col("library_id")))), ("reused", F.col("_session").isNotNull()),
        ("bad_mode", ~mode.isin(*MODES)), ("mode_changed", named & (mode != F.col("_mode"))),
    ]
    t = t.withColumn("state", _first(cases, "created")).withColumn("mode", mode)
    # The first request for a legacy run is counted, not ranked: requests without one, or for one run, are never brought together.
    first = t.where((F.col("state") == "created") & named).groupBy("legacy_id").agg(F.min("request_id").alias("_first"))
    t = t.join(first, "legacy_id", "left")
    t = t.withColumn("state", F.when((F.col("state") == "created") & named & (F.col("request_id") > F.col("_first")), "reused").otherwise(F.col("state")))
    # Only new sessions are numbered, in the order of requests, up to what the workspace holds.
    held = sessions.count()
    place = F.row_number().over(Window.orderBy("request_id")) + held
    new = t.where("state = 'created'").orderBy("request_id").limit(max(0, MOST_SESSIONS - held)).select("request_id", place.alias("place"))
    t = t.join(new, "request_id", "left")
    state = F.when((F.col("state") == "created") & F.col("place").isNull(), "full").otherwise(F.col("state"))
    return t.select("request_id", state.alias("state"), F.when(state == "reused", F.col("_session")).alias("session_id"), F.when(state == "created", F.col("mode")).alias("mode"), F.when(state == "created", F.col("content_hash")).alias("source_hash"))


def cursor_moves(moves: DataFrame) -> DataFrame:
    """Verdict of each move of a cursor, and what it locks.

    A move has where it comes from (module, task_index, question_index, phase) and where it goes (to_ and the same names),
    the section, the mode, the module's navigation (back: module, task or none; review, lock_on_advance), whether the goal
    is locked or holds a recording, and its response clock (started, elapsed_ms, duration_ms).  The first rule that a move
    breaks is its verdict; a move that breaks none is accepted, and going forward locks tasks in writing, and questions in
    listening and speaking where the module says so.
    """
    c = F.col
    spoken, same = c("section") == "speaking", c("to_question_index") == c("question_index")
    opening = c("to_phase").isin("instructions", "directions", "stimulus", "prepare")
    cases = [
        ("bad_phase", ~c("to_phase").isin(*PHASES)), ("submit_first", c("to_module") != c("module")), ("not_spoken", c("to_phase").isin("saving", "recorded") & ~spoken),
        ("not_recording", (c("to_phase") == "saving") & (~c("phase").isin("response", "saving") | ~same)), ("no_recording", (c("to_phase") == "recorded") & ~c("has_recording")),
        ("still_saving", (c("to_phase") == "response") & (c("phase") == "saving") & same), ("no_second_take", (c("to_phase") == "response") & (c("phase") == "recorded") & same & (c("mode") == "exam")),
        ("locked", c("locked")), ("no_way_back", ((c("back") == "none") & (c("to_question_index") < c("question_index"))) | ((c("back") == "task") & (c("to_task_index") < c("task_index")))),
        ("no_review", (c("to_phase") == "review") & ~c("review")), ("time_used_up", (c("to_phase") == "response") & spoken & c("started") & (c("elapsed_ms") >= c("duration_ms"))),
        ("already_answering", c("section").isin("listening", "speaking") & c("started") & opening),
    ]
    ok = c("verdict") == "accepted"
    tasks = F.when(ok & (c("section") == "writing"), F.greatest(F.lit(0), c("to_task_index") - c("task_index"))).otherwise(0)
    questions = F.when(ok & c("section").isin("listening", "speaking") & c("lock_on_advance"), F.greatest(F.lit(0), c("to_question_index") - c("question_index"))).otherwise(0)
    again = ok & (c("to_phase") == "response") & (c("phase") == "recorded") & same
    return moves.withColumn("verdict", _first(cases, "accepted")).withColumns({"locks_tasks": tasks, "locks_questions": questions, "assisted": again})


def upgrade_clocks(timers: DataFrame) -> DataFrame:
    """Clocks brought up to the present policy without granting time (applied_ms, running_since_ms, deadline_ms, expired_ms).

    timers: version, finished, closed, consumed_ms, running_since_ms, started_ms, old_duration_ms, duration_ms (what the
    plan says now) and at_ms.  Finished sessions, present versions and closed clocks stay as they are.  Time that ran beyond the old
    budget is history and isn't charged; a clock whose time is up gets the moment at which it was.
    """
    c = F.col
    move = (c("version") < TIME_POLICY) & ~c("finished") & ~c("closed")
    elapsed = elapsed_at(c("consumed_ms"), c("running_since_ms"), c("at_ms"), c("old_duration_ms"))
    cap = c("duration_ms")
    up = c("started_ms").isNotNull() & (elapsed >= cap)
    cutoff = F.when(c("running_since_ms").isNotNull() & (c("consumed_ms") < cap), c("running_since_ms") + cap - c("consumed_ms")).otherwise(F.least(c("at_ms"), c("started_ms") + cap))
    runs = move & ~up & c("running_since_ms").isNotNull()
    new = {
        "upgraded": move, "applied_ms": F.when(move, F.least(cap, elapsed)).otherwise(c("consumed_ms")), "deadline_ms": F.when(runs, c("at_ms") + cap - elapsed), "expired_ms": F.when(move & up, F.least(c("at_ms"), cutoff)),
        "running_since_ms": F.when(runs, c("at_ms")).when(~move, c("running_since_ms")), "version": F.when(move, TIME_POLICY).otherwise(c("version")),
    }
    return timers.withColumns(new)


def speaking_conflicts(sessions: DataFrame, timers: DataFrame) -> DataFrame:
    """Sessions on a spoken question for which only shared clocks ran: their time can't be told, so they are frozen.

    sessions: session_id, finished, section, task_kind, module_id, task_id, question_id; timers: session_id, module_id,
    task_id, question_id, scope, phase, started, closed.  A clock of the question itself settles it.
    """
    s = sessions.where((~F.col("finished")) & (F.col("section") == "speaking") & F.col("task_kind").isin("listen_repeat", "interview"))
    t = timers.where((F.col("phase") == "response") & F.col("started")).select("session_id", F.col("module_id").alias("_m"), F.col("task_id").alias("_t"), F.col("question_id").alias("_q"), "scope", "closed")
    own = (F.col("scope") == "question") & (F.col("_q") == F.col("question_id")) & (F.col("_m") == F.col("module_id"))
    shared = F.col("scope").isin("task", "module") & ~F.col("closed") & (F.col("_m") == F.col("module_id")) & ((F.col("scope") == "module") | (F.col("_t") == F.col("task_id")))
    out = s.join(t, "session_id").groupBy("session_id", "question_id").agg(F.coalesce(F.max(own), F.lit(False)).alias("_own"), F.count_if(shared).alias("shared_timers"))
    return out.where("not _own and shared_timers > 0").drop("_own")


def finalize_recordings(requests: DataFrame) -> DataFrame:
    """Saving of recordings (started_ms, captured_ms, at_ms): verdict, when they stopped and until when they may be saved.

    A stop is believed from a second before the start to a second after now, and clamped between start and now; saving is
    possible for two minutes after it.
    """
    c = F.col
    asked = F.coalesce(c("captured_ms"), c("at_ms"))
    stopped = F.least(c("at_ms"), F.greatest(c("started_ms"), asked))
    cases = [("not_started", c("started_ms").isNull()), ("not_this_phase", (asked > c("at_ms") + GRACE_MS) | (asked < c("started_ms") - GRACE_MS)), ("too_late", c("at_ms") > stopped + RECORDING_MS)]
    t = requests.withColumn("verdict", _first(cases, "accepted"))
    ok = c("verdict") == "accepted"
    return t.withColumns({"stopped_ms": F.when(ok, stopped), "expires_ms": F.when(ok, stopped + RECORDING_MS)})


#: Rules of restored sessions and of the record of their upgrade.
AUDIT = [
    Rule("unknown mode", "error", "mode in ('practice', 'exam')"), Rule("policy of the future", "error", f"version between 0 and {TIME_POLICY}"), Rule("first policy with an upgrade record", "error", "version > 0 or not has_upgrade"),
    Rule("upgrade to another version", "error", "not has_upgrade or (from_version < version and to_version = version)"), Rule("consumed beyond the budget", "error", "consumed_ms >= 0 and (duration_ms is null or consumed_ms <= duration_ms)"),
    Rule("observed time differs from the clock", "error", "not has_upgrade or observed_ms = consumed_ms + case when running_since_ms is null then 0 else greatest(0, upgraded_ms - running_since_ms) end"),
    Rule("applied time beyond the budget", "error", "not has_upgrade or applied_ms <= coalesce(least(observed_ms, duration_ms), observed_ms)"), Rule("submitted module without submission", "error", "status <> 'submitted' or submitted_ms is not null"),
    Rule("updated before the start", "error", "updated_ms >= started_ms"), Rule("no revision", "error", "revision >= 1"),
]


def audit_sessions(sessions: DataFrame) -> DataFrame:
    """Broken invariants of restored sessions, one row for each."""
    return check_rules(sessions, AUDIT, F.col("session_id"))


def page_context(runs: DataFrame, questions: DataFrame, requests: DataFrame) -> DataFrame:
    """What a helper may see of the page that each request names: questions with prompt, options, own answer.

    requests: request_id, session_id, revision, question_id, phase, panel; runs: session_id, mode, finished, revision,
    question_id, task_id, phase, all_questions; questions: session_id, task_id, question_id, prompt, options, saved, answer.
    A request that is not on the session's present page is refused, as is any before the end of an exam.  Key answers are
    shown only where the user has opened the panel of answers.
    """
    r = runs.select("session_id", "mode", "finished", F.col("revision").alias("_revision"), F.col("question_id").alias("_question"), "task_id", F.col("phase").alias("_phase"), "all_questions")
    t = requests.join(r, "session_id", "left")
    cases = [
        ("no_session", F.col("mode").isNull()), ("exam_running", (F.col("mode") == "exam") & ~F.col("finished")), ("page_changed", F.col("revision") != F.col("_revision")),
        ("question_changed", (F.col("question_id") != F.col("_question")) | (F.col("phase") != F.col("_phase"))),
    ]
    t = t.withColumn("verdict", _first(cases, "shown"))
    answering = (F.col("verdict") == "shown") & F.col("phase").isin("response", "saving", "recorded") & ~F.col("finished")
    q = questions.select("session_id", "task_id", F.col("question_id").alias("_id"), "prompt", "options", "saved", "answer")
    shown = t.where(answering).join(q, ["session_id", "task_id"]).where(F.col("all_questions") | (F.col("_id") == F.col("question_id")))
    shown = shown.select("request_id", F.col("_id").alias("shown_question"), "prompt", "options", "saved", F.when(F.col("panel") == "answers", F.col("answer")).alias("answer"))
    return t.select("request_id", "verdict").join(shown, "request_id", "left")
