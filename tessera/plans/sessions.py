"""Queries of the session machine over the events table, with SQL that takes the same steps by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import machine as m
from tessera.plans import carriers as c

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_HOUR = 3_600_000
#: The plan: four modules of five questions, two to a task.
_SECTIONS = ("reading", "listening", "writing", "speaking")
_SCOPES, _BACK = ("module", "question", "task", "question"), ("module", "none", "task", "none")
_HOURS = (72, 24, 48, 24)


def plan(spark: SparkSession) -> DataFrame:
    """The plan's 20 questions as PLACE."""
    n = F.col("id")
    k = F.floor(n / 5)
    of = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), (k + 1).cast("int"))
    task = F.floor(n % 5 / 2)
    following = F.when(k < 3, F.concat(F.lit("q"), 5 * (k + 1)))
    return spark.range(20).select(
        F.concat(F.lit("q"), n).alias("question"), F.concat(F.lit("m"), k).alias("module"), F.concat(F.lit("t"), k, F.lit("."), task).alias("task"), of(_SECTIONS).alias("section"), task.alias("task_index"),
        (n % 5).alias("question_index"), of(_SCOPES).alias("scope"), (of(_HOURS) * F.lit(_HOUR)).cast("long").alias("duration_ms"), F.when(k == 3, F.lit(6 * _HOUR).cast("long")).alias("prepare_ms"),
        of(_BACK).alias("back"), (k % 2 == 0).alias("review"), (k % 2 == 1).alias("lock_on_advance"), F.when(k < 3, F.concat(F.lit("m"), k + 1)).alias("next_module"), following.alias("next_question"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as those of one session: a start, then moves, answers, pauses and submissions along the plan."""
    e = c.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    e = e.withColumn("n", (F.row_number().over(Window.partitionBy("session_id").orderBy("at_ms", "seq")) - 1).cast("long"))
    n, k, i = F.col("n"), F.col("k"), F.col("seq")
    kind = F.when(n == 0, "start").when(n % 17 == 16, "submit").when(i % 10 < 4, "move").when(i % 10 < 8, "answer").when(i % 10 == 8, "pause").otherwise("resume")
    place = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(n % 17 / 3)) - F.when(k % 9 == 0, 1).otherwise(0))
    phase = F.element_at(F.array(*(F.lit(x) for x in ("prepare", "saving", "review", "recorded"))), F.least(k % 7 + 1, F.lit(4)).cast("int"))
    return e.select(
        "session_id", "seq", F.when(k % 6 == 0, F.concat(F.lit("x"), F.floor(n / 4))).alias("request"), kind.alias("kind"), "at_ms", F.when(k % 3 == 0, F.col("at_ms") - 20 * k).alias("captured_ms"),
        F.when(k % 11 == 0, n).alias("expected_revision"), F.concat(F.lit("q"), 5 * F.least(F.lit(3), F.floor(n / 17)) + place).alias("question"),
        F.when(kind == "move", F.when(k % 7 < 4, phase).otherwise("response")).alias("phase"), F.when(k % 5 != 0, F.char(65 + k % 4)).alias("answer"), F.when(k % 4 == 0, "rec").alias("recording"),
        F.when(F.col("session_id") % 2 == 0, "practice").otherwise("exam").alias("mode"),
    )


def _used(clock: str, at: str) -> str:
    """SQL: milliseconds used on a clock."""
    used = f"{clock}.consumed + coalesce(greatest(0, {at} - {clock}.since), 0)"
    return f"(case when {clock}.dur is null then {used} else least({clock}.dur, {used}) end)"


def _stopped(clock: str, at: str, completed: str) -> str:
    """SQL: a clock stopped at a moment."""
    ran_out = f"{clock}.since is not null and {clock}.dur is not null and {_used(clock, at)} >= {clock}.dur"
    return f"""{{'question': {clock}.question, 'phase': {clock}.phase, 'dur': {clock}.dur, 'consumed': {_used(clock, at)}, 'started': {clock}.started, 'since': null::bigint, 'deadline': null::bigint,
      'expired': case when {ran_out} then coalesce({clock}.expired, {clock}.deadline) else {clock}.expired end, 'completed': {clock}.completed or {completed}}}"""


_CLOCK = "struct(question varchar, phase varchar, dur bigint, consumed bigint, started bigint, since bigint, deadline bigint, expired bigint, completed boolean)"
_LOG = "at_ms, seq, kind, verdict, revision, module, question, phase, clock, used_ms, finished"


def _sql() -> str:
    due_clock = "coalesce(clocks2[due], {'question': question2, 'phase': split_part(due, ':', 1), 'dur': cap, 'consumed': 0, 'started': null, 'since': null, 'deadline': null, 'expired': null, 'completed': false})"
    return f"""
with recursive p as (
  select 'q' || n as question, 'm' || n // 5 as module, 't' || n // 5 || '.' || n % 5 // 2 as task, ([{", ".join(f"'{x}'" for x in _SECTIONS)}])[n // 5 + 1] as section, n % 5 // 2 as ti, n % 5 as qi,
    ([{", ".join(f"'{x}'" for x in _SCOPES)}])[n // 5 + 1] as scope, ([{", ".join(map(str, _HOURS))}])[n // 5 + 1]::bigint * {_HOUR} as dur, case when n // 5 = 3 then 6 * {_HOUR} end::bigint as prep,
    ([{", ".join(f"'{x}'" for x in _BACK)}])[n // 5 + 1] as back, n // 5 % 2 = 0 as review, n // 5 % 2 = 1 as locking, case when n < 15 then 'm' || (n // 5 + 1) end as next_module,
    case when n < 15 then 'q' || 5 * (n // 5 + 1) end as next_question from range(0, 20) t(n)),
o as (select user_id as session_id, event_id as seq, epoch_us(ts) // 1000 as at_ms, (props->>'$.k')::bigint as k, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) - 1 as n from events),
e as (
  select session_id, seq, at_ms, n, case when k % 6 = 0 then 'x' || n // 4 end as request, case when k % 3 = 0 then at_ms - 20 * k end as captured, case when k % 11 = 0 then n end as expected,
    case when n = 0 then 'start' when n % 17 = 16 then 'submit' when seq % 10 < 4 then 'move' when seq % 10 < 8 then 'answer' when seq % 10 = 8 then 'pause' else 'resume' end as kind,
    'q' || (5 * least(3, n // 17) + greatest(0, least(4, n % 17 // 3) - case when k % 9 = 0 then 1 else 0 end)) as question,
    case when k % 7 < 4 then (['prepare', 'saving', 'review', 'recorded'])[k % 7 + 1] else 'response' end as to_phase, case when k % 5 <> 0 then chr((65 + k % 4)::int) end as answer,
    case when k % 4 = 0 then 'rec' end as recording, case when session_id % 2 = 0 then 'practice' else 'exam' end as mode from o),
ev as (
  select e.*, p.module as e_module, p.task as e_task, p.section as e_section, p.ti as e_ti, p.qi as e_qi, p.scope as e_scope, p.dur as e_dur, p.prep as e_prep, back, review, locking, next_module, next_question,
    'response:' || p.scope || ':' || case p.scope when 'module' then p.module when 'task' then p.task else e.question end as e_clock,
    concat_ws('|', kind, e.question, case when kind = 'move' then to_phase else '' end, coalesce(answer, ''), coalesce(recording, '')) as digest from e join p using (question)),
run as (
  select distinct user_id as session_id, 0::bigint as n, false as begun, null::varchar as mode, null::varchar as module, null::varchar as question, null::varchar as task, null::varchar as section, null::varchar as scope,
    0::bigint as ti, 0::bigint as qi, null::bigint as dur, null::bigint as prep, null::varchar as phase, false as paused, false as finished, 0::bigint as revision, null::varchar as active, []::varchar[] as open,
    []::varchar[] as submitted, null::bigint as saving, map([]::varchar[], []::{_CLOCK}[]) as clocks, map([]::varchar[], []::varchar[]) as recordings, []::varchar[] as locks, map([]::varchar[], []::varchar[]) as requests,
    null::struct(at_ms bigint, revision bigint, module varchar, question varchar, phase varchar, clock varchar, used_ms bigint, finished boolean) as fired, null::bigint as seq, null::bigint as at_ms, null::varchar as kind,
    null::varchar as verdict, null::bigint as used_ms from events
  union all
  select session_id, n, begun, mode, module, question, task, section, scope, ti, qi, dur, prep, phase, paused, finished, revision, due as active, open, submitted, saving,
    case when due is null then clocks2 else map_concat(clocks2, map([due], [due_clock])) end as clocks, recordings, locks, requests, fired, seq, at_ms, kind, verdict,
    case when due is not null then {_used("due_clock", "at_ms")} end as used_ms
  from (
    select *, case when list_contains(open2, due) or due is null or due_clock.started is null or due_clock.completed then open2 else list_append(open2, due) end as open from (
    select *, case when due is null or not ok or due_was.completed and due_was.since is null then due_was
        when paused or due_was.completed or due_was.started is not null and due_was.dur is not null and {_used("due_was", "at_ms")} >= due_was.dur then
          case when due_was.since is null then due_was else {_stopped("due_was", "at_ms", "false")} end
        when due_was.since is null then {{'question': due_was.question, 'phase': due_was.phase, 'dur': due_was.dur, 'consumed': due_was.consumed, 'started': coalesce(due_was.started, at_ms), 'since': at_ms,
          'deadline': case when due_was.dur is not null then at_ms + greatest(0, due_was.dur - due_was.consumed) end, 'expired': due_was.expired, 'completed': due_was.completed}}
        else due_was end as due_clock from (
    select *, case when due is not null then {due_clock} end as due_was from (
    select *, list_filter(open1, lambda x: not list_contains(leaving, x) or kept and clocks1[x].phase = 'response' and clocks1[x].question = question2) as open2,
      case when len(leaving) = 0 then clocks1 else map_from_entries(list_transform(map_entries(clocks1), lambda z: case when list_contains(leaving, z.key) then
        {{'key': z.key, 'value': {_stopped("z.value", "at_ms", "(sealing or not (kept and z.value.phase = 'response' and z.value.question = question2))")}}} else z end)) end as clocks2 from (
    select *, case when ok then list_filter(open1, lambda x: due is null or x <> due) else []::varchar[] end as leaving, section = 'speaking' and phase in ('saving', 'recorded') as kept from (
    select *, question as question2, case when not ok then active when finished then null when phase = 'prepare' and section = 'speaking' then 'prepare:question:' || question
        when phase = 'response' or scope in ('module', 'task') and list_contains(open1, own) then own end as due, case when phase = 'prepare' then prep else dur end as cap from (
    select *, 'response:' || scope || ':' || case scope when 'module' then module when 'task' then task else question end as own from (
    select session_id, e_n as n, seq, at_ms, kind, verdict, ok, sealing, fired, clocks1, open as open1, active, begun or ok as begun, case when beginning then e_mode else mode end as mode,
      case when sealing then coalesce(next_module, module) when beginning then e_module else module end as module,
      case when sealing then coalesce(next_question, question) when beginning or moving then e_question else question end as question,
      case when beginning or moving then e_task else task end as task, case when beginning or moving then e_section else section end as section,
      case when beginning or sealing then 'none' when moving then e_scope else scope end as scope,
      case when sealing and next_module is not null then 0 when beginning or moving then e_ti else ti end as ti, case when sealing and next_module is not null then 0 when beginning or moving then e_qi else qi end as qi,
      case when beginning or sealing then null when moving then e_dur else dur end as dur, case when beginning or sealing then null when moving then e_prep else prep end as prep,
      case when beginning or sealing and next_module is not null then 'instructions' when sealing then 'completed' when moving then to_phase else phase end as phase,
      case when ok and kind in ('pause', 'resume') then kind = 'pause' when sealing then next_module is null else paused end as paused, finished or sealing and next_module is null as finished,
      case when beginning then 1 when ok then revision + 1 else revision end as revision,
      case when sealing then list_append(submitted, module) else submitted end as submitted,
      case when sealing then null when moving and to_phase = 'saving' and phase <> 'saving' then least(at_ms, greatest(t.started, coalesce(captured, at_ms))) + {m.RECORDING_MS}
        when moving and to_phase <> 'saving' then null else saving end as saving,
      case when ok and kind = 'answer' and recording is not null then map_concat(recordings, map([e_question], [recording])) else recordings end as recordings,
      case when moving and e_section = 'writing' then list_concat(locks, list_transform(range(ti, e_ti), lambda i: 't:' || e_module || ':' || i))
        when moving and e_section in ('listening', 'speaking') and locking then list_concat(locks, list_transform(range(qi, e_qi), lambda i: 'q:' || e_module || ':' || i)) else locks end as locks,
      case when ok and request is not null then map_concat(requests, map([request], [digest])) else requests end as requests from (
    select *, verdict = 'accepted' as ok, verdict = 'accepted' and kind = 'start' as beginning, verdict = 'accepted' and kind = 'move' as moving, verdict = 'accepted' and kind = 'submit' as sealing from (
    select *, case
        when requests[request] is not null then case when requests[request] = digest then 'replayed' else 'conflict' end
        when not begun then case when kind = 'start' then 'accepted' else 'no_session' end when kind = 'start' then 'reused' when finished then 'finished' when expected <> revision then 'stale'
        when kind in ('pause', 'resume') then 'accepted'
        when kind = 'submit' then case when list_contains(submitted, e_module) then 'sealed' when e_module <> module then 'not_current' else 'accepted' end
        when kind = 'answer' then case when locked then 'locked' when e_module <> module then 'other_module'
          when (e_section = 'speaking' or mode = 'exam') and t.started is not null and t_up and not coalesce(captured between cutoff - {m.GRACE_MS} and least(cutoff, at_ms) and at_ms <= cutoff + {m.GRACE_MS}, false)
            and not coalesce(e_section = 'speaking' and phase = 'saving' and question = e_question and recording is not null and at_ms <= saving, false) then 'too_late' else 'accepted' end
        when e_module <> module then 'submit_first' when to_phase in ('saving', 'recorded') and e_section <> 'speaking' then 'not_spoken'
        when to_phase = 'saving' and (phase not in ('response', 'saving') or e_qi <> qi) then 'not_recording' when to_phase = 'recorded' and recordings[e_question] is null then 'no_recording'
        when to_phase = 'response' and phase = 'saving' and e_qi = qi then 'still_saving' when to_phase = 'response' and phase = 'recorded' and e_qi = qi and mode = 'exam' then 'no_second_take'
        when locked then 'locked' when back = 'none' and e_qi < qi or back = 'task' and e_ti < ti then 'no_way_back' when to_phase = 'review' and not review then 'no_review'
        when to_phase = 'response' and e_section = 'speaking' and t.started is not null and t_up then 'time_used_up'
        when e_section in ('listening', 'speaking') and t.started is not null and to_phase = 'prepare' then 'already_answering'
        when to_phase = 'saving' and phase <> 'saving' then case when t.started is null or asked > at_ms + {m.GRACE_MS} or asked < t.started - {m.GRACE_MS} then 'not_this_phase'
          when at_ms > least(at_ms, greatest(t.started, asked)) + {m.RECORDING_MS} then 'save_window_over' else 'accepted' end
        else 'accepted' end as verdict from (
    select *, coalesce(t.dur is not null and {_used("t", "at_ms")} >= t.dur, false) as t_up, coalesce(t.expired, t.deadline) as cutoff, coalesce(captured, at_ms) as asked,
      list_contains(submitted, e_module) or list_contains(locks, 't:' || e_module || ':' || e_ti) or list_contains(locks, 'q:' || e_module || ':' || e_qi) as locked from (
    select *, clocks1[e_clock] as t from (
    select *, case when firing then map_concat(clocks, map([active], [{_stopped("a", "a.deadline", "false")}])) else clocks end as clocks1,
      case when firing then {{'at_ms': a.deadline, 'revision': revision, 'module': module, 'question': question, 'phase': phase, 'clock': active, 'used_ms': a.dur, 'finished': finished}} end as fired from (
    select *, coalesce(a.since is not null and a.deadline <= at_ms, false) as firing from (
    select r.* exclude (seq, at_ms, kind, verdict, used_ms, fired, n), r.clocks[r.active] as a, ev.seq, ev.at_ms, ev.kind, ev.n + 1 as e_n, ev.request, ev.captured, ev.expected, ev.question as e_question, ev.to_phase, ev.recording,
      ev.mode as e_mode, e_module, e_task, e_section, e_ti, e_qi, e_scope, e_dur, e_prep, back, review, locking, next_module, next_question, e_clock, digest
    from run r join ev on ev.session_id = r.session_id and ev.n = r.n)))))))))))))))),
last as (select session_id, arg_max_null(revision, n) as revision, arg_max_null(module, n) as module, arg_max_null(question, n) as question, arg_max_null(phase, n) as phase, arg_max_null(active, n) as active, arg_max_null(clocks[active], n) as a,
    arg_max_null(finished, n) as finished from run group by 1)
select session_id, {_LOG.replace("clock,", "active as clock,")} from (select * replace (case when begun then revision else 0 end as revision) from run where n > 0)
union all by name select session_id, fired.at_ms as at_ms, null::bigint as seq, 'deadline' as kind, 'expired' as verdict, fired.revision as revision, fired.module as module, fired.question as question, fired.phase as phase,
  fired.clock as clock, fired.used_ms as used_ms, fired.finished as finished from run where fired is not null
union all by name select session_id, a.deadline as at_ms, null as seq, 'deadline' as kind, 'expired' as verdict, revision, module, question, phase, active as clock, a.dur as used_ms, finished from last
  where a.since is not null and a.deadline <= (select max(epoch_us(ts) // 1000) from events)"""


@query(_sql())
def r2_session_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 with R3 to R8: verdicts and states of every user's session, deadlines that fire between events included."""
    events = session_events(spark, sf_dir)
    until = c.table(spark, sf_dir, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    return m.fold_sessions(m.located_events(events, plan(spark)), until)
