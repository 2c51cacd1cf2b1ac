"""Identity, lineage and graphs: content-addressed storage, closures, revisions, receipts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import digest


def store_by_hash(content: DataFrame, value: str) -> DataFrame:
    """One row per distinct content, named by its SHA-256."""
    return content.select(F.sha2(F.col(value), 256).alias("ref"), F.col(value)).dropDuplicates(["ref"])


def verify_hashes(stored: DataFrame, value: str) -> DataFrame:
    """Rows whose content no longer has its name."""
    return stored.where(F.sha2(F.col(value), 256) != F.col("ref"))


def commit_new(incoming: DataFrame, existing: DataFrame, ref: str) -> DataFrame:
    """Incoming rows with whether they were new or replay an existing row of the same hash (also within the batch)."""
    seen = existing.select(ref).distinct().withColumn("_seen", F.lit(True))
    first = F.row_number().over(Window.partitionBy(ref).orderBy("seq")) == 1
    out = incoming.join(seen, ref, "left").withColumn("_first", first)
    return out.withColumn("outcome", F.when(F.col("_seen").isNull() & F.col("_first"), "created").otherwise("existing")).drop("_seen", "_first")


def closure(roots: DataFrame, edges: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """(root, node, depth) of everything reachable from the roots, each node once at its smallest depth.

    A frontier loop: join, drop what is known, go on.  A diamond is walked once, and a cycle ends by itself.
    roots: root; edges: parent, child.  Needs a checkpoint folder.
    """
    found = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct().checkpoint()
    frontier, depth = found, 0
    while True:
        depth += 1
        step = frontier.select("root", F.col("node").alias("parent")).join(edges, "parent").select("root", F.col("child").alias("node")).distinct()
        frontier = step.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
        if depth % checkpoint_every == 0:
            found = found.checkpoint()


def shallow_closure(spark: SparkSession, roots: DataFrame, edges: DataFrame, most_levels: int = 64) -> DataFrame:
    """The same for graphs of few levels without shared paths to walk twice, as one recursive query; it ends at most_levels."""
    return spark.sql(
        f"""with recursive walk(root, node, depth) as (
             select root, root, 0 from {{roots}}
             union all select w.root, e.child, w.depth + 1 from walk w join {{edges}} e on e.parent = w.node where w.depth < {most_levels})
           select root, node, min(depth) as depth from walk group by root, node""",
        roots=roots,
        edges=edges,
    )


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: those that their own children reach."""
    reach = closure(edges.select(F.col("parent").alias("root")).distinct(), edges)
    back = reach.join(edges, (reach.root == edges.child) & (reach.node == edges.parent)).select(edges.parent.alias("node"))
    return back.distinct()


def missing_children(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Edges whose child does not exist."""
    return edges.join(artifacts.select(F.col("ref").alias("child")), "child", "left_anti").select("parent", "child")


def typed_edges(artifacts: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Edges by role from JSON values, only from the stated paths: role -> JSON path of a list or a single reference."""
    out = None
    for role, path in paths.items():
        found = F.get_json_object("value", path)
        refs = F.coalesce(F.from_json(found, "array<string>"), F.array(found))
        part = artifacts.select(F.col("ref").alias("parent"), F.explode(refs).alias("child"), F.lit(role).alias("role")).where("child is not null")
        out = part if out is None else out.unionByName(part)
    return out


def revision_faults(frames: DataFrame, key: list[str], revision: str) -> DataFrame:
    """Frames whose revision does not follow the one before by 0 or 1."""
    step = F.col(revision) - F.lag(revision).over(Window.partitionBy(*key).orderBy("seq"))
    return frames.withColumn("step", step).where("step is not null and step not in (0, 1)")


def dropped_members(frames: DataFrame, key: list[str], revision: str, member: str) -> DataFrame:
    """Members of a frame that the next frame no longer has."""
    last = frames.groupBy(*key).agg(F.max(revision).alias("_last"))
    nxt = frames.select(*key, (F.col(revision) - 1).alias(revision), member)
    return frames.join(last, key).where(F.col(revision) < F.col("_last")).drop("_last").join(nxt, [*key, revision, member], "left_anti")


def _appended(n_keys: int):
    """Adds to rows sorted by their first n_keys columns, then by order, whether each expects the revision that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, revision = None, 0
        for batch in batches:
            accepted = []
            for row in zip(*(c.to_pylist() for c in (*batch.columns[:n_keys], batch.column("expected"))), strict=True):
                if row[:-1] != now:
                    now, revision = row[:-1], 0
                accepted.append(row[-1] == revision)
                revision += accepted[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_())], [*batch.schema.names, "accepted"])

    return run


def conditional_append(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Optimistic concurrency: an event is accepted if it expects the current revision, which then grows by one.

    The events of a key pass one after the other in order; `expected` is what an event expects (from 0).  What is held is the
    key and its revision, however many events it has.
    """
    rows = events.select(*key, *order, "expected")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartition(*key).sortWithinPartitions(*key, *order)
    out = dealt.mapInArrow(_appended(len(key)), f"{names}, accepted boolean")
    last = out.groupBy(*key).agg(F.count_if("accepted").alias("final_revision"))
    return out.join(last, key)


def patch_latest(patches: DataFrame, key: list[str], field: str, order: list[str]) -> DataFrame:
    """The standing value of each field: a user's patch outranks any model's, later ones earlier ones; no-ops are left out."""
    rank = F.when(F.col("origin") == "user", 1).otherwise(0)
    best = F.max(F.struct(rank.alias("rank"), *order, "value", "origin")).alias("_best")
    return patches.where("value is not null").groupBy(*key, field).agg(best).select(*key, field, F.col("_best.value").alias("value"), F.col("_best.origin").alias("origin"))


def propagate_revisions(candidates: DataFrame, changed: DataFrame, on: str) -> DataFrame:
    """All candidates that depend on a changed node get the next revision and lose their checks."""
    hit = changed.select(on).distinct().withColumn("_hit", F.lit(True))
    out = candidates.join(hit, on, "left")
    touched = F.col("_hit").isNotNull()
    return out.withColumns({"revision": F.col("revision") + touched.cast("int"), "checked": F.col("checked") & ~touched}).drop("_hit")


def compile_subset(candidates: DataFrame, selection: DataFrame, by: list[str]) -> DataFrame:
    """Selected ready candidates by group in order, unverified answers emptied, with a selection key that ignores order."""
    chosen = candidates.join(selection.select("candidate_id").distinct(), "candidate_id", "left_semi").where("ready")
    answer = F.when(F.col("verified"), F.col("answer"))
    items = F.sort_array(F.collect_list(F.struct("ordinal", "candidate_id", answer.alias("answer"))))
    g = chosen.groupBy(*by).agg(items.alias("items"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x["candidate_id"].cast("string"))), ",")
    return g.select(*by, F.size("items").alias("n_items"), F.size(F.filter("items", lambda x: x["answer"].isNotNull())).alias("n_answers"), F.sha2(ids, 256).alias("selection_key"))


def source_revision(files: DataFrame, by: list[str], digits: int = 3) -> DataFrame:
    """Hash of a material's files and texts, however many, in two levels.

    A file belongs to the part that the first hex digits of its name's hash say; a part's hash is over its files in the
    order of names, the material's over its parts in order, so no row holds more than one part or 16 ** digits hashes.
    """
    part = F.substring(F.sha2(F.coalesce("name", F.lit("")), 256), 1, digits)
    hashed = files.select(*by, "name", part.alias("part"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    lines = F.sort_array(F.collect_list(F.struct("name", "text")))
    parts = hashed.groupBy(*by, "part").agg(F.sha2(F.array_join(F.transform(lines, lambda p: F.concat_ws(":", p["name"], p["text"])), "\n"), 256).alias("hash"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "hash"))), lambda p: F.concat_ws(":", p["part"], p["hash"])), "\n")
    return parts.groupBy(*by).agg(F.sha2(whole, 256).alias("source_revision"))


def receipts_match(receipts: DataFrame, compiled: DataFrame, on: list[str]) -> DataFrame:
    """Receipts whose recomputed selection key differs or is missing."""
    now = compiled.select(*on, F.col("selection_key").alias("_now"))
    return receipts.join(now, on, "left").where(~F.col("selection_key").eqNullSafe(F.col("_now"))).drop("_now")


def new_epoch(jobs: DataFrame, epoch: str) -> DataFrame:
    """A restored workspace: its own epoch, running jobs interrupted."""
    running = F.col("state").isin("running", "queued")
    return jobs.withColumns({"epoch": F.lit(epoch), "state": F.when(running, "interrupted").otherwise(F.col("state"))})


def block_id(*parts) -> "F.Column":
    return digest(*parts, length=20)
