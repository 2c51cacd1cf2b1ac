"""Practice analytics: filter, latest per question, status filter, aggregates, rankings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_attempts(attempts: DataFrame) -> DataFrame:
    """Newest first; equal times keep the order of entry."""
    return attempts.orderBy(F.desc("created_at"), F.asc("seq"))


def accuracy(correct: Column, total: Column) -> Column:
    """Whole percent of correct among graded attempts; unanswered counts as wrong, unscored is left out, null if none."""
    graded = total > 0
    return F.round(100 * F.sum(F.when(graded, correct)) / F.sum(F.when(graded, 1))).cast("long")


@dataclass(frozen=True)
class AttemptFilter:
    """Conditions of the practice record; None means any."""

    section: str | None = None
    type: str | None = None
    library: str | None = None
    kind: str | None = None
    assisted: bool | None = None
    date_from: str | None = None
    date_to: str | None = None
    timezone: str = "UTC"


def filter_attempts(attempts: DataFrame, wanted: AttemptFilter) -> DataFrame:
    """All conditions together; every kind but retry counts as first; dates are local and inclusive."""
    local = F.to_date(F.from_utc_timestamp("created_at", wanted.timezone))
    kind = F.when(F.col("kind") == "retry", "retry").otherwise("first")
    pairs = [
        (wanted.section, lambda v: F.col("section") == v), (wanted.type, lambda v: F.col("type") == v), (wanted.library, lambda v: F.col("library_id") == v),
        (wanted.kind, lambda v: kind == v), (wanted.assisted, lambda v: F.col("assisted") == F.lit(v)),
        (wanted.date_from, lambda v: local >= F.lit(v).cast("date")), (wanted.date_to, lambda v: local <= F.lit(v).cast("date")),
    ]
    for value, condition in pairs:
        if value is not None:
            attempts = attempts.where(condition(value))
    return attempts


def latest_per_question(attempts: DataFrame) -> DataFrame:
    """The newest attempt of each (library, question); of equal times the first entered."""
    w = Window.partitionBy("library_id", "question_id").orderBy(F.desc("created_at"), F.asc("seq"))
    return attempts.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def filter_status(attempts: DataFrame, status: str | None) -> DataFrame:
    """review: incorrect and not yet reviewed; otherwise the status itself."""
    if status is None:
        return attempts
    if status == "review":
        return attempts.where((F.col("status") == "incorrect") & ~F.col("reviewed"))
    return attempts.where(F.col("status") == status)


def summary_tiles(attempts: DataFrame, modules: DataFrame, by: list[str]) -> DataFrame:
    """attempts, graded, correct, accuracy_pct, minutes and retries for each `by`.

    Minutes add the durations of attempts outside runs to the elapsed time of the distinct (session, module) runs.
    modules: session_id, module_id, elapsed_seconds.
    """
    graded = F.col("total") > 0
    tiles = attempts.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        F.count_if(graded).alias("graded"),
        F.coalesce(F.sum(F.when(graded, F.col("correct"))), F.lit(0)).cast("long").alias("correct"),
        accuracy(F.col("correct"), F.col("total")).alias("accuracy_pct"),
        F.sum(F.when(F.col("session_id").isNull(), F.coalesce("duration_seconds", F.lit(0))).otherwise(0)).alias("_own"),
        F.count_if(F.col("kind") == "retry").alias("retries"),
    )
    runs = attempts.where("session_id is not null").select(*by, "session_id", "module_id").distinct().join(modules, ["session_id", "module_id"], "left")
    spent = runs.groupBy(*by).agg(F.sum(F.coalesce("elapsed_seconds", F.lit(0))).alias("_runs"))
    out = tiles.join(spent, by, "left")
    return out.select(*by, "attempts", "graded", "correct", "accuracy_pct", F.round((F.col("_own") + F.coalesce("_runs", F.lit(0))) / 60).cast("long").alias("minutes"), "retries")


def section_tiles(sections: DataFrame, questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every section once: its questions, attempts, accuracy, and which of them its note shows."""
    q = questions.groupBy("section").agg(F.count("*").alias("questions"))
    a = attempts.groupBy("section").agg(F.count("*").alias("attempts"), accuracy(F.col("correct"), F.col("total")).alias("accuracy_pct"))
    out = sections.join(q, "section", "left").join(a, "section", "left").fillna(0, ["questions", "attempts"])
    note = F.when(F.col("accuracy_pct").isNotNull(), "accuracy").when(F.col("attempts") > 0, "attempts").when(F.col("questions") > 0, "untried").otherwise("empty")
    return out.select("section", "questions", "attempts", "accuracy_pct", note.alias("note"))


def review_queue(attempts: DataFrame, limit: int = 4) -> DataFrame:
    """The newest wrong attempts that were not reviewed."""
    return sorted_attempts(filter_status(attempts, "review")).limit(limit)


#: Buckets of pending materials by status.
PENDING = {"processing": ("analyzing", "converting"), "needs_information": ("needs_information",), "draft_ready": ("draft_ready",), "unfinished": ("failed", "interrupted")}


def pending_materials(materials: DataFrame) -> DataFrame:
    """Buckets that hold any material."""
    bucket = F.lit(None).cast("string")
    for name, statuses in PENDING.items():
        bucket = F.when(F.col("status").isin(*statuses), name).otherwise(bucket)
    return materials.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def search_materials(materials: DataFrame, words: str, status: str | None = None) -> DataFrame:
    """Materials whose title or file names hold the words, case folded, of a status if one is given."""
    text = F.lower(F.concat_ws(" ", F.col("title"), F.array_join("file_names", " ")))
    found = materials.where(F.contains(text, F.lit(words.lower())))
    return found if status is None else found.where(F.col("status") == status)


def progress_rank(responses: Column, position: Column, marked: Column, locked: Column, submitted: Column) -> Column:
    """2 with any response, 1 if moved, marked, locked or submitted, else 0."""
    return F.when(responses > 0, 2).when((position > 0) | marked | locked | (submitted > 0), 1).otherwise(0)


def resume_groups(sessions: DataFrame, scope: list[str]) -> DataFrame:
    """Unfinished sessions by scope: the one to resume, with how many others there are.

    Higher progress goes first, then later activity, then the larger id.
    """
    w = Window.partitionBy(*scope).orderBy(F.desc("rank"), F.desc("last_at"), F.desc("session_id"))
    open_ = sessions.where(~F.col("finished")).withColumn("_at", F.row_number().over(w))
    return open_.withColumn("runs", F.count("*").over(Window.partitionBy(*scope))).where("_at = 1").drop("_at")


def projections(sessions: DataFrame) -> DataFrame:
    """For each legacy session the successor that stands for it: an unfinished one first, then the latest."""
    w = Window.partitionBy("legacy_id").orderBy(F.asc("finished"), F.desc("last_at"), F.asc("session_id"))
    return sessions.where("legacy_id is not null").withColumn("_at", F.row_number().over(w)).where("_at = 1").select("legacy_id", "session_id")


def signature_matches(sessions: DataFrame, sets: DataFrame) -> DataFrame:
    """Sessions whose question signature is that of a set, best first within each set."""
    w = Window.partitionBy("set_id").orderBy(F.desc("rank"), F.desc("last_at"), F.desc("session_id"))
    return sessions.join(sets, "signature").withColumn("place", F.row_number().over(w)).select("set_id", "session_id", "place")


def completed_sources(sessions: DataFrame, represented: DataFrame) -> DataFrame:
    """Finished sessions that nothing else stands for."""
    return sessions.where("finished").join(represented.select("session_id").distinct(), "session_id", "left_anti")


def candidate_summary(candidates: DataFrame, by: list[str]) -> DataFrame:
    return candidates.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("pending"))


def completeness(candidates: DataFrame, by: list[str]) -> DataFrame:
    return candidates.groupBy(*by).agg(F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("pending"), F.count("*").alias("total"))


def batch_result(attempts: DataFrame, finished: DataFrame) -> DataFrame:
    """Graded and correct counts of the attempts just finished."""
    done = attempts.join(finished, "attempt_id", "left_semi")
    return done.agg(F.count_if(F.col("total") > 0).alias("graded"), F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("correct"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A stable slice: offset up to 1000, limit from 1 to 100."""
    if not 0 <= offset <= 1000 or not 1 <= limit <= 100:
        raise ValueError("offset must be 0 to 1000 and limit 1 to 100")
    return rows.orderBy(*order).offset(offset).limit(limit)
