"""Job accounting: limits, estimates, budgets, the execution ledger and its merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a request in rising order; not_sent stands outside.
STATES = ("reserved", "in_flight", "outcome_unknown", "settled")


def state_rank(state: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, s in enumerate(STATES):
        out = F.when(state == s, k).otherwise(out)
    return out


def job_limits(jobs: DataFrame) -> DataFrame:
    """Requests, tokens and minutes allowed for a job of `blocks` blocks."""
    requests = F.least(F.lit(200), 2 * F.col("blocks") + 4)
    return jobs.withColumn("max_requests", requests).withColumn("max_input_tokens", requests * 12_000).withColumn("max_output_tokens", requests * 4_000)


def estimated_output(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Tokens that a reply needs: a token for four bytes of own text and a fifth more, and 80 for each question."""
    own = F.sum(F.when(~F.col("shared"), F.octet_length("text")).otherwise(0))
    return blocks.groupBy(*by).agg((F.ceil(own / 4 * 1.2) + 80 * F.sum("questions")).cast("long").alias("estimate"))


def execution_budget(requests: DataFrame, by: list[str]) -> DataFrame:
    """What a job was charged: usage where known, reservations where open or unknown, nothing where not sent."""
    known = F.col("used_input").isNotNull()
    sent = F.col("state") != "not_sent"
    charge = lambda used, reserved: F.sum(F.when(sent, F.when(known, F.col(used)).otherwise(F.col(reserved))).otherwise(0)).cast("long")
    return requests.groupBy(*by).agg(
        F.count_if(sent).alias("requests"), F.count_if(sent & ~known & (F.col("state") == "reserved")).alias("reserved"), F.count_if(sent & known).alias("known"),
        F.count_if(sent & ~known & (F.col("state") == "outcome_unknown")).alias("unknown"), charge("used_input", "reserved_input").alias("charged_input"), charge("used_output", "reserved_output").alias("charged_output"),
    )


def merge_ledger(records: DataFrame, key: list[str]) -> DataFrame:
    """Join of the records of each request in the ledger's lattice.

    The highest state wins; not_sent wins over open states, and excludes settlement and usage.  Digests, reservations and
    known usages must agree: a difference is a conflict, with every merged value null.  The latest acknowledgement stands.
    """
    no_send = F.max((F.col("state") == "not_sent").cast("int")) == 1
    rank = F.max(state_rank(F.col("state")))
    settled = F.max((F.col("state") == "settled").cast("int")) == 1
    # Two values differ where the least is not the greatest; distinct counts would repeat each record for each column.
    several = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    differs = several("request_digest") | several("reserved_input") | several("reserved_output")
    usage = several("used_input") | several("used_output")
    conflict = differs | usage | (no_send & (settled | (F.count("used_input") > 0)))
    state = F.when(no_send, "not_sent").otherwise(F.element_at(F.array(*(F.lit(s) for s in STATES)), rank + 1))
    agg = records.groupBy(*key).agg(conflict.alias("conflict"), state.alias("_state"), F.max("used_input").alias("_in"), F.max("used_output").alias("_out"), F.max("acknowledged_at").alias("_ack"))
    keep = lambda c: F.when(~F.col("conflict"), F.col(c))
    return agg.select(*key, "conflict", keep("_state").alias("state"), keep("_in").alias("used_input"), keep("_out").alias("used_output"), keep("_ack").alias("acknowledged_at"))


def synchronize(current: DataFrame, restored: DataFrame, key: list[str]) -> DataFrame:
    """Current records and those of a backup, merged; what was in flight in the backup has an unknown outcome now."""
    old = restored.withColumn("state", F.when(F.col("state") == "in_flight", "outcome_unknown").otherwise(F.col("state")))
    return merge_ledger(current.unionByName(old), key)


def unacknowledged(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Requests of unknown outcome that nobody has acknowledged."""
    return ledger.groupBy(*by).agg(F.count_if((F.col("state") == "outcome_unknown") & F.col("acknowledged_at").isNull()).alias("open"))


def acknowledge(ledger: DataFrame, at: int) -> DataFrame:
    open_ = (F.col("state") == "outcome_unknown") & F.col("acknowledged_at").isNull()
    return ledger.withColumn("acknowledged_at", F.when(open_, F.lit(at)).otherwise(F.col("acknowledged_at")))


def chunk_plan(blocks: DataFrame, doc: str, group: str) -> DataFrame:
    """One chunk per group with its own blocks, and the document's shared blocks repeated in each."""
    own = blocks.where(F.col(group).isNotNull()).groupBy(doc, group).agg(F.count("*").alias("own_blocks"), F.sum("chars").alias("own_chars"))
    shared = blocks.where(F.col(group).isNull()).groupBy(doc).agg(F.count("*").alias("shared_blocks"), F.sum("chars").alias("shared_chars"))
    return own.join(shared, doc, "left").fillna(0, ["shared_blocks", "shared_chars"])


def split_chunks(rows: DataFrame, chunk: list[str], order: list[str]) -> DataFrame:
    """Halve each chunk by question, the first half being the larger."""
    w = Window.partitionBy(*chunk).orderBy(*order)
    return rows.withColumn("half", F.ntile(2).over(w))


def failure_streaks(rows: DataFrame, by: list[str], order: list[str], failed: Column, length: int = 3) -> DataFrame:
    """Runs of at least `length` failures in a row."""
    w = Window.partitionBy(*by).orderBy(*order)
    t = rows.withColumn("_f", failed).withColumn("_i", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "_f").orderBy(*order)))
    return t.where("_f").groupBy(*by, "_i").agg(F.count("*").alias("length"), F.min(order[0]).alias("first_at")).where(F.col("length") >= length).drop("_i")


def first_settlement(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first known settlement of a request wins."""
    known = rows.where("used_input is not null")
    return known.groupBy(*by).agg(F.min_by("used_input", order).alias("used_input"), F.min_by("used_output", order).alias("used_output"), F.min(order).alias("settled_at"))


def snapshot_elapsed(elapsed: Column, last: Column, now: Column, deadline: Column) -> Column:
    return elapsed + F.greatest(F.lit(0), F.least(now, deadline) - last)


def chunk_tree_faults(chunks: DataFrame) -> DataFrame:
    """Chunks whose parent does not list them, and children that do not name their parent (chunk_id, parent_id, children)."""
    listed = chunks.select(F.col("chunk_id").alias("parent_id"), F.explode("children").alias("chunk_id"))
    named = chunks.where("parent_id is not null").select("parent_id", "chunk_id")
    a = named.join(listed, ["parent_id", "chunk_id"], "left_anti").withColumn("fault", F.lit("not listed"))
    b = listed.join(named, ["parent_id", "chunk_id"], "left_anti").withColumn("fault", F.lit("not named"))
    return a.unionByName(b)
