"""Queries of practice analytics and grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import word_count
from tessera.operators import analytics as a
from tessera.operators import runs as r
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


@query(f"with {c.ATTEMPTS} select user_id, attempt_id, row_number() over (partition by user_id order by created_at desc, seq) as place from attempts")
def a1_sorted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: every user's attempts, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("seq"))
    return c.attempts(spark, sf_dir).select("user_id", "attempt_id", F.row_number().over(w).alias("place"))


@query(f"with {c.ATTEMPTS} select user_id, count(total) as graded, round(100.0 * sum(correct) / count(total))::bigint as accuracy_pct from attempts group by user_id")
def a2_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: accuracy of each user."""
    return c.attempts(spark, sf_dir).groupBy("user_id").agg(F.count("total").alias("graded"), a.accuracy(F.col("correct"), F.col("total")).alias("accuracy_pct"))


FILTER = a.AttemptFilter(section="listening", kind="retry", assisted=False, date_from="2024-01-05", date_to="2024-01-20")
_FILTERED = "section = 'listening' and kind = 'retry' and not assisted and created_at::date between '2024-01-05' and '2024-01-20'"


@query(f"with {c.ATTEMPTS} select attempt_id, library_id, question_id, status from attempts where {_FILTERED}")
def a3_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: all conditions of the record filter."""
    return a.filter_attempts(c.attempts(spark, sf_dir), FILTER).select("attempt_id", "library_id", "question_id", "status")


@query(f"""with {c.ATTEMPTS} select library_id, question_id, attempt_id, status from (
  select *, row_number() over (partition by library_id, question_id order by created_at desc, seq) as n from attempts where {_FILTERED}) where n = 1""")
def a4_latest_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the latest of what the filter left."""
    return a.latest_per_question(a.filter_attempts(c.attempts(spark, sf_dir), FILTER)).select("library_id", "question_id", "attempt_id", "status")


@query(f"""with {c.ATTEMPTS} select library_id, question_id, attempt_id from (
  select *, row_number() over (partition by library_id, question_id order by created_at desc, seq) as n from attempts) where n = 1 and status = 'incorrect' and not reviewed""")
def a5_status_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the status filter comes after the latest of each question."""
    return a.filter_status(a.latest_per_question(c.attempts(spark, sf_dir)), "review").select("library_id", "question_id", "attempt_id")


@query(f"""with {c.ATTEMPTS}, {c.MODULES}, t as (
  select library_id, count(*) as attempts, count(total) as graded, coalesce(sum(correct), 0)::bigint as correct, round(100.0 * sum(correct) / count(total))::bigint as accuracy_pct,
    sum(case when session_id is null then duration_seconds else 0 end) as own, count_if(kind = 'retry')::bigint as retries from attempts group by 1),
m as (select library_id, sum(elapsed_seconds) as spent from (select distinct library_id, session_id from attempts where session_id is not null) join modules using (session_id) group by 1)
select library_id, attempts, graded, correct, accuracy_pct, round((own + coalesce(spent, 0)) / 60.0)::bigint as minutes, retries from t left join m using (library_id)""")
def a6_summary_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of every library."""
    return a.summary_tiles(c.attempts(spark, sf_dir), c.module_times(spark, sf_dir), ["library_id"])


@query(f"""with {c.ATTEMPTS}, s as (select unnest(['reading','listening','writing','speaking','none']) as section),
q as (select section, count(*) as questions from (select distinct section, library_id, question_id from attempts) group by 1),
t as (select section, count(*) as attempts, round(100.0 * sum(correct) / nullif(count(total), 0))::bigint as accuracy_pct from attempts where user_id % 2 = 0 group by 1)
select s.section, coalesce(questions, 0) as questions, coalesce(attempts, 0) as attempts, accuracy_pct,
  case when accuracy_pct is not null then 'accuracy' when coalesce(attempts, 0) > 0 then 'attempts' when coalesce(questions, 0) > 0 then 'untried' else 'empty' end as note
from s left join q using (section) left join t using (section)""")
def a7_section_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section, also one without questions."""
    rows = c.attempts(spark, sf_dir)
    sections = spark.sql("select explode(array('reading','listening','writing','speaking','none')) as section")
    return a.section_tiles(sections, rows.select("section", "library_id", "question_id").distinct(), rows.where("user_id % 2 = 0"))


@query(f"with {c.ATTEMPTS} select attempt_id, library_id, question_id from attempts where status = 'incorrect' and not reviewed order by created_at desc, seq limit 4")
def a8_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four newest wrong attempts to review (the limit is the feature)."""
    return a.review_queue(c.attempts(spark, sf_dir)).select("attempt_id", "library_id", "question_id")


@query(f"""with {c.MATERIALS}, b as (select case when status in ('analyzing','converting') then 'processing' when status in ('needs_information','draft_ready') then status
  when status in ('failed','interrupted') then 'unfinished' end as bucket from materials) select bucket, count(*) as n from b where bucket is not null group by 1""")
def a9_pending_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of pending materials."""
    return a.pending_materials(c.materials(spark, sf_dir))


@query(f"with {c.MATERIALS} select material_id, status from materials where status = 'ready' and contains(lower(title || ' ' || array_to_string(file_names, ' ')), 'example.com/en')")
def a10_material_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: case-folded search over titles and file names."""
    return a.search_materials(c.materials(spark, sf_dir), "Example.com/EN", "ready").select("material_id", "status")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = a.progress_rank(F.col("responses"), F.col("position"), F.col("marked"), F.col("locked"), F.col("submitted"))
    return c.sessions(spark, sf_dir).withColumn("rank", rank)


@query(f"with {c.SESSIONS} select session_id, rank from sessions")
def a11_progress_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume progress of every session."""
    return _ranked(spark, sf_dir).select("session_id", "rank")


@query(f"""with {c.SESSIONS} select library_id, session_id, rank, runs from (
  select *, row_number() over (partition by library_id order by rank desc, last_at desc, session_id desc) as n, count(*) over (partition by library_id) as runs from sessions where not finished) where n = 1""")
def a12_resume_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which unfinished session to resume in each scope."""
    return a.resume_groups(_ranked(spark, sf_dir), ["library_id"]).select("library_id", "session_id", "rank", "runs")


@query(f"""with {c.SESSIONS}, sets as (select unnest(range(20)) as set_id, unnest(range(20)) as turns)
select set_id, session_id, row_number() over (partition by set_id order by rank desc, last_at desc, session_id desc) as place from sessions join sets using (turns)""")
def a13_signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each set by signature (here the number of turns)."""
    sets = spark.range(20).select(F.col("id").alias("set_id"), F.col("id").alias("signature"))
    return a.signature_matches(_ranked(spark, sf_dir).withColumn("signature", F.col("turns")), sets)


@query(f"""with {c.SESSIONS}, p as (select session_id from (select *, row_number() over (partition by legacy_id order by finished, last_at desc, session_id) as n from sessions where legacy_id is not null) where n = 1)
select session_id, turns from sessions where finished and session_id not in (select session_id from p)""")
def a14_completed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished sessions that no projection stands for."""
    rows = c.sessions(spark, sf_dir)
    return a.completed_sources(rows, a.projections(rows)).select("session_id", "turns")


@query("select source, count(*) as total, count_if(n_chars >= 500)::bigint as answerable, count_if(n_chars < 500)::bigint as pending from documents group by 1")
def a15_candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each source, those of 500 characters or more being answerable."""
    return a.candidate_summary(c.table(spark, sf_dir, "documents").withColumn("answerable", F.col("n_chars") >= 500), ["source"])


@query("select o_custkey, count_if(o_orderstatus = 'F')::bigint as selected, count_if(o_orderstatus <> 'F')::bigint as pending, count(*) as total from orders group by 1")
def a16_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected, pending and total."""
    return a.completeness(c.table(spark, sf_dir, "orders").withColumn("selected", F.col("o_orderstatus") == "F"), ["o_custkey"])


@query(f"with {c.MATERIALS} select material_id, row_number() over (order by created desc, material_id) as place from materials")
def a17_material_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials, newest first; ranked through sorted ranges, so no task holds all rows."""
    rows = c.materials(spark, sf_dir).select("material_id", "created")
    # Few distinct times: places inside a time, plus the number of later ones.
    per = rows.groupBy("created").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("created")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("created").orderBy("material_id"))
    return rows.join(per.select("created", ahead.alias("ahead")), "created").select("material_id", (F.col("ahead") + inside).alias("place"))


@query(f"with {c.ATTEMPTS} select count(total) as graded, coalesce(sum(correct), 0)::bigint as correct from attempts where attempt_id % 3 = 0")
def a18_batch_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the attempts just finished."""
    rows = c.attempts(spark, sf_dir)
    return a.batch_result(rows, rows.where("attempt_id % 3 = 0").select("attempt_id"))


@query("select p_partkey, p_name from part order by p_name, p_partkey limit 50 offset 100")
def a19_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable slice (the limit is the feature)."""
    return a.page(c.table(spark, sf_dir, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 100, 50)


@query(f"with {c.ATTEMPTS} select attempt_id, status, correct, total from attempts")
def r9_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded answers."""
    return c.attempts(spark, sf_dir).select("attempt_id", "status", "correct", "total")


@query("""select doc_id, case when length(trim(coalesce(lang, ''))) = 0 then 'unscored' when doc_id % 4 = 3 then 'unanswered' when doc_id % 4 = 0 then 'correct' else 'incorrect' end as status from documents""")
def r9_grade_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in answers; case and spaces don't count, punctuation does."""
    d = c.table(spark, sf_dir, "documents").select("doc_id", "lang")
    given = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  "), F.upper("lang"), F.lit("\n"))).when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit("."))).when(F.col("doc_id") % 4 == 2, F.lit("x")).otherwise("  ")
    return d.select("doc_id", r.grade_answer(F.lit("fill_blank"), F.array("lang"), F.array(given))["status"].alias("status"))


@query("""select l_orderkey, case when list(l_suppkey % 3 order by l_linenumber, l_partkey) = list(l_partkey % 3 order by l_linenumber, l_partkey) then 'correct' else 'incorrect' end as status from lineitem group by 1""")
def r9_grade_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders must be equal item by item."""
    rows = c.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("rows"))
    pick = lambda name: F.transform("rows", lambda x: (x[name] % 3).cast("string"))
    return rows.select("l_orderkey", r.grade_answer(F.lit("sentence_order"), pick("l_partkey"), pick("l_suppkey"))["status"].alias("status"))


@query(f"with {c.ATTEMPTS} select library_id, kind, count(*) as n from attempts group by all")
def r11_first_or_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts and retries of each library."""
    return c.attempts(spark, sf_dir).groupBy("library_id", "kind").agg(F.count("*").alias("n"))


_KINDS = list(r.DEFAULT_SECONDS)


@query(f"""with t as (select o_orderkey, ({_KINDS!r})[o_orderkey % 12 + 1] as kind, case when o_orderkey % 5 = 0 then o_orderkey % 9000 end as custom, case when o_orderkey % 7 = 0 then 300 end as standard,
  case when o_orderkey % 3 = 0 then o_custkey % 100 end as source, o_orderkey % 9 as ord from orders),
s as (select *, coalesce(case when custom between 1 and 7200 then custom end, case when standard between 1 and 7200 then standard end, case when source between 1 and 7200 then source end,
  case kind when 'listen_repeat' then coalesce(([8,8,10,10,10,12,12])[nullif(ord, 0)], 12) {" ".join(f"when '{k}' then {v}" for k, v in r.DEFAULT_SECONDS.items() if k != "listen_repeat")} end) as v from t)
select o_orderkey, kind, case when kind = 'interview' then least(v, 45) else v end::bigint as seconds from s""")
def r6_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of a response by precedence."""
    o = c.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (key % 12 + 1).cast("int"))
    seconds = r.resolve_timing(F.col("kind"), F.when(key % 5 == 0, key % 9000), F.when(key % 7 == 0, F.lit(300)), F.when(key % 3 == 0, F.col("o_custkey") % 100), (key % 9).cast("int"))
    return o.withColumn("kind", kind).select("o_orderkey", "kind", seconds.cast("long").alias("seconds"))


@query("""with e as (select event_id, event_id % 2500 as late, event_id % 1700 as before, event_id % 11 = 0 as rec from events)
select event_id, coalesce(late <= 0 or (before <= 1000 and late <= case when rec then 120000 else 1000 end), true) as accepted from e""")
def r3_late_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input after a deadline, by capture and arrival times."""
    e = c.ordered_events(spark, sf_dir)
    key = F.col("event_id")
    ok = r.accepts_input(F.col("at_ms") - key % 1700, F.col("at_ms") + key % 2500, F.col("at_ms"), key % 11 == 0)
    return e.select("event_id", ok.alias("accepted"))


@query("""select event_id, least(event_id % 900 * 1000, (event_id % 50) * 1000 + case when event_id % 3 = 0 then 0 else greatest(0, (event_id % 700 - 20) * 1000) end)::bigint as used_ms from events""")
def r4_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time on a clock, capped."""
    k = F.col("event_id")
    used = r.elapsed_at(k % 50 * 1000, F.when(k % 3 != 0, F.lit(20_000)), k % 700 * 1000, k % 900 * 1000)
    return c.table(spark, sf_dir, "events").select("event_id", used.cast("long").alias("used_ms"))


@query("""with e as (select user_id, event_type, epoch_us(ts) // 1000 as ms, event_id from events), s as (select *, lead(ms) over (partition by user_id order by ms, event_id) as nxt from e)
select user_id, sum(case when event_type in ('view', 'click') then coalesce(nxt - ms, 0) else 0 end)::bigint as active_ms, count(*) as n_events from s group by 1""")
def r5_active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of the active phases of each user."""
    e = c.ordered_events(spark, sf_dir)
    return r.response_intervals(e, ["user_id"], "at_ms", ["at_ms", "event_id"], F.col("event_type").isin("view", "click"))


@query("""select event_id, round(u / 1000.0)::bigint as elapsed_seconds, ceil(greatest(0, 60000 - u) / 1000.0)::bigint as remaining_seconds
from (select event_id, least(60000, event_id * 7 % 50000 + greatest(0, event_id * 3 % 40000 - 1500)) as u from events)""")
def r12_session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds used and left."""
    k = F.col("event_id")
    e = c.table(spark, sf_dir, "events").select("event_id", (k * 7 % 50_000).alias("consumed_ms"), F.lit(1500).alias("running_since_ms"), (k * 3 % 40_000).alias("at_ms"), F.lit(60_000).alias("duration_ms"))
    return r.session_view(e).select("event_id", "elapsed_seconds", "remaining_seconds")


@query(f"with {c.MODULES} select split_part(session_id, '-', 1)::bigint as user_id, sum(elapsed_seconds)::bigint as elapsed_seconds from modules group by 1")
def r13_module_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over the clocks of a user's modules."""
    return c.module_times(spark, sf_dir).groupBy(F.split("session_id", "-")[0].cast("long").alias("user_id")).agg(F.sum("elapsed_seconds").alias("elapsed_seconds"))


@query("""with p as (select user_id, q as question_id from (select distinct user_id from events) cross join range(0, 20) t(q)),
a as (select user_id, k as question_id, arg_max(event_id, event_id) as e from (select *, (props->>'$.k')::bigint as k from events) where k < 20 group by 1, 2)
select user_id, question_id, case when e is null or e % 5 = 4 then 'unanswered' when e % 5 = question_id % 4 then 'correct' else 'incorrect' end as status,
  case when e % 5 = question_id % 4 then 1 else 0 end as correct, 1 as total, 0 as duration_seconds from p left join a using (user_id, question_id)""")
def r8_commit_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of all planned questions, answered or not."""
    e = c.table(spark, sf_dir, "events").withColumn("question_id", F.get_json_object("props", "$.k").cast("long"))
    plan = e.select("user_id").distinct().withColumn("question_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    plan = plan.withColumns({"type": F.lit("single_choice"), "key": F.array((F.col("question_id") % 4).cast("string"))})
    last = e.where("question_id < 20").groupBy("user_id", "question_id").agg(F.max("event_id").alias("e"))
    option = F.col("e") % 5
    answers = last.select("user_id", "question_id", F.array(F.when(option == 4, " ").otherwise(option.cast("string"))).alias("submitted"))
    return r.commit_attempts(plan, answers, ["user_id"])


@query("""with e as (select event_id, user_id, event_id // 3 % 200 as req, case when event_id % 4 = 0 then 'a' else 'b' end as d, epoch_ms(ts) as ms from events),
f as (select *, row_number() over w as n, first(d) over w as one from e window w as (partition by user_id, req order by ms, event_id))
select event_id, case when n = 1 then 'accepted' when d = one then 'replayed' else 'conflict' end as verdict from f""")
def g12_request_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated requests, by digest."""
    e = c.ordered_events(spark, sf_dir)
    e = e.withColumns({"req": F.floor(F.col("event_id") / 3) % 200, "d": F.when(F.col("event_id") % 4 == 0, "a").otherwise("b")})
    return r.replay_requests(e, ["user_id", "req"], "d", ["at_ms", "event_id"]).select("event_id", "verdict")


@query()
def r2_session_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: every user's events folded into a session state; no SQL, tested against the reducer and the stream."""
    e = c.ordered_events(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "answer").when(F.col("event_type") == "error", "pause").otherwise("resume")
    k = F.get_json_object("props", "$.k")
    return r.reduce_sessions(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), "at_ms", k.alias("question"), k.alias("answer")), 40 * 86_400_000)


@query("""with e as (select user_id, list({'p': event_id % 6, 'l': case when event_id % 9 = 0 then '' else chr((97 + event_id % 26)::int) end} order by event_id) as es from events group by 1),
x as (select user_id, i, coalesce(nullif(list_last(list_filter(es, lambda z: z['p'] = i))['l'], ''), '_') as c from e cross join range(0, 6) t(i))
select user_id, string_agg(c, '' order by i) as cells from x group by 1""")
def r18_blank_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell edits reduced in order."""
    e = c.table(spark, sf_dir, "events")
    k = F.col("event_id")
    edit = F.struct(k.alias("o"), (k % 6).alias("at"), F.when(k % 9 == 0, "").otherwise(F.char(97 + k % 26)).alias("letter"))
    return e.groupBy("user_id").agg(F.sort_array(F.collect_list(edit)).alias("es")).select("user_id", r.blank_edits(F.col("es"), 6).alias("cells"))


@query("select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::int as n from documents")
def h3_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: words by white space."""
    return c.table(spark, sf_dir, "documents").select("doc_id", word_count(F.coalesce("text", F.lit(""))).alias("n"))
