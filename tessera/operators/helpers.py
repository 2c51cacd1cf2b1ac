"""Smaller operators: answers as shown, histories, preferences, revisions, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def format_answer(frame: Column, ids: Column, options: Column) -> Column:
    """Option texts in the slots (two underscores or more) of a frame, left to right; unknown ids in brackets, surplus appended."""
    text_of = lambda i: F.coalesce(F.get(F.transform(F.filter(options, lambda o: o["id"] == i), lambda o: o["text"]), 0), F.concat(F.lit("["), i, F.lit("]")))
    texts = F.transform(ids, text_of)
    parts = F.split(frame, "_{2,}")
    slots = F.size(parts) - 1
    filled = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < slots, F.coalesce(F.get(texts, i), F.lit("__"))).otherwise(""))), "")
    surplus = F.when(F.size(texts) > slots, F.slice(texts, slots + 1, F.size(texts))).otherwise(F.array().cast("array<string>"))
    return F.concat(filled, F.when(F.size(surplus) > 0, F.concat(F.lit(" + "), F.array_join(surplus, " "))).otherwise(""))


def answer_status(slots: Column, wanted: Column, saved: Column) -> Column:
    filled = F.size(F.filter(slots, lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))))
    return F.when(saved, "saved").when(filled == 0, "unanswered").when(filled < wanted, "partial").otherwise("answered")


def scoped_history(messages: DataFrame, scope: list[str], order: list[str], sent: int = 12, kept: int = 24) -> DataFrame:
    """The last `kept` messages of each scope and which of them are sent along."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(*(F.desc(o) for o in order)))
    return messages.withColumn("_n", n).where(F.col("_n") <= kept).withColumn("sent", F.col("_n") <= sent).drop("_n")


def allowed_preferences(rows: DataFrame, tombstones: DataFrame, key: list[str], revision: str) -> DataFrame:
    """Confirmed, valid preferences whose revision is above that of any tombstone of their key."""
    dead = tombstones.groupBy(*key).agg(F.max(revision).alias("_dead"))
    out = rows.where("confirmed and valid").join(dead, key, "left")
    return out.where(F.col("_dead").isNull() | (F.col(revision) > F.col("_dead"))).drop("_dead")


def latest_revision(rows: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The row of the highest revision of each key; a retraction is such a row and removes nothing."""
    others = [c for c in rows.columns if c not in (*key, revision)]
    best = F.max(F.struct(revision, *others)).alias("_b")
    return rows.groupBy(*key).agg(best).select(*key, "_b.*")


def usage(dialect: Column, record: Column) -> Column:
    """Token usage by dialect of a JSON record."""
    get = lambda p: F.get_json_object(record, p).cast("long")
    first = dialect == "prompt"
    return F.struct(F.when(first, get("$.prompt_tokens")).otherwise(get("$.input_tokens")).alias("input"), F.when(first, get("$.completion_tokens")).otherwise(get("$.output_tokens")).alias("output"))


def retry_after(seconds: Column) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(0), F.coalesce(seconds, F.lit(0))))
