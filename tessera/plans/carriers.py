"""Driver tables read as the entities that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.runs import attempt_kind, grade_answer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: library is the event type, question the property k, key k % 4 (none where k % 10 is 0)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    option = F.col("event_id") % 5
    key = F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(F.array((k % 4).cast("string")))
    submitted = F.array(F.when(option == 4, "").otherwise(option.cast("string")))
    run = F.col("event_id") % 2 == 0
    out = e.select(
        F.col("event_id").alias("attempt_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("created_at"), "user_id", F.col("event_type").alias("library_id"),
        F.element_at(F.array(*(F.lit(x) for x in ("reading", "listening", "writing", "speaking"))), (k % 4 + 1).cast("int")).alias("section"), k.alias("question_id"),
        F.lit("single_choice").alias("type"), grade_answer(F.lit("single_choice"), key, submitted).alias("o"), (F.col("event_id") % 6 == 0).alias("reviewed"), (F.col("event_id") % 7 == 0).alias("assisted"),
        F.when(~run, k).alias("duration_seconds"), F.when(run, F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))).alias("session_id"), F.when(run, F.lit("m")).alias("module_id"),
    )
    out = out.withColumns({"status": F.col("o.status"), "correct": F.col("o.correct"), "total": F.col("o.total")}).drop("o")
    return out.withColumn("kind", attempt_kind(["library_id", "question_id"], ["created_at", "seq"]))


def module_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed seconds of each user-day, from its first to its last event."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    span = F.unix_seconds(F.max("at")) - F.unix_seconds(F.min("at"))
    return e.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id")).agg(span.alias("elapsed_seconds")).withColumn("module_id", F.lit("m"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions: answers are non-empty user turns, a session of four turns or more is finished."""
    c = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    out = c.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.count_if(user & (F.length("text") > 40)).alias("responses"), F.max("turn").alias("position"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("last_at")
    )
    return out.withColumns(
        {
            "marked": F.col("session_id") % 5 == 0, "locked": F.col("session_id") % 7 == 0, "submitted": F.col("turns") - 1, "finished": F.col("turns") >= 4,
            "library_id": F.col("session_id") % 11, "legacy_id": F.when(F.col("session_id") % 3 != 0, F.floor(F.col("session_id") / 3)),
        }
    )


STATUSES = ("received", "analyzing", "needs_information", "draft_ready", "converting", "ready", "imported", "failed", "cancelled", "interrupted")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as materials: the URL is the title, its path parts are file names."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    status = F.element_at(F.array(*(F.lit(s) for s in STATUSES)), (F.col("page_id") % 10 + 1).cast("int"))
    return p.select(F.col("page_id").alias("material_id"), F.col("url").alias("title"), F.filter(F.split(F.col("url"), "/"), lambda x: x != "").alias("file_names"), status.alias("status"), (F.col("page_id") * 37 % 1000).alias("created"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines: doc_id, line_no from 0, line, n (lines of the document)."""
    parts = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    return parts.select("doc_id", "lang", "source", F.size("ls").alias("n"), F.posexplode("ls").alias("line_no", "line"))


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with milliseconds and a previous-event gap for each user."""
    e = table(spark, sf_dir, "events").withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return e.withColumn("gap_ms", F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy("user_id").orderBy("at_ms", "event_id")))


#: SQL of the same views.
ATTEMPTS = """attempts as (
  select *, case when row_number() over (partition by library_id, question_id order by created_at, seq) = 1 then 'first' else 'retry' end as kind from (
    select event_id as attempt_id, event_id as seq, ts as created_at, user_id, event_type as library_id,
      (['reading','listening','writing','speaking'])[k % 4 + 1] as section, k as question_id, 'single_choice' as type,
      case when k % 10 = 0 then 'unscored' when event_id % 5 = 4 then 'unanswered' when event_id % 5 = k % 4 then 'correct' else 'incorrect' end as status,
      case when k % 10 = 0 then null when event_id % 5 = k % 4 then 1 else 0 end as correct, case when k % 10 = 0 then null else 1 end as total,
      event_id % 6 = 0 as reviewed, event_id % 7 = 0 as assisted, case when event_id % 2 = 1 then k end as duration_seconds,
      case when event_id % 2 = 0 then user_id || '-' || ts::date end as session_id
    from (select *, (props->>'$.k')::bigint as k from events)))"""
MODULES = "modules as (select user_id || '-' || ts::date as session_id, (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000)::bigint as elapsed_seconds from events group by 1)"
SESSIONS = """sessions as (
  select *, session_id % 5 = 0 as marked, session_id % 7 = 0 as locked, turns - 1 as submitted, turns >= 4 as finished, session_id % 11 as library_id,
    case when session_id % 3 <> 0 then session_id // 3 end as legacy_id,
    case when responses > 0 then 2 when position > 0 or session_id % 5 = 0 or session_id % 7 = 0 or turns > 1 then 1 else 0 end as rank
  from (select conv_id as session_id, count_if(role = 'user' and length(text) > 40)::bigint as responses, max(turn) as position, count(*) as turns, sum(length(text))::bigint as last_at from conversations group by 1))"""
MATERIALS = (
    "materials as (select page_id as material_id, url as title, list_filter(string_split(url, '/'), lambda x: x <> '') as file_names, (["
    + ",".join(f"'{s}'" for s in STATUSES)
    + "])[page_id % 10 + 1] as status, page_id * 37 % 1000 as created from pages)"
)
LINES = """lines as (
  select doc_id, lang, source, len(ls) as n, unnest(range(len(ls))) as line_no, unnest(ls) as line
  from (select doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) as ls from documents))"""
