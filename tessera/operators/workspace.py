"""Workspace: media probes, packages and backups, fences, tool requests and what their results change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import has_text

#: States of a decoder's report.
PROBE_STATES = ("notChecked", "playable", "failed", "partial")


def normalize_probe(rows: DataFrame) -> DataFrame:
    """A decoder's report (state, actual, container, missing, location, ranges) as evidence.

    Times that are negative or no number are null.  What is missing is as reported, else what the container promises beyond
    the actual length; where it is missing is known only of a partial file with valid ranges that says so.  An unknown
    state is a failure without figures.
    """
    known = F.col("state").isin(*PROBE_STATES)
    good = lambda c: F.when(known & (F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.col(c))
    partial = known & (F.col("state") == "partial")
    ranges = F.filter(F.coalesce("ranges", F.array().cast(rows.schema["ranges"].dataType)), lambda r: (r["start"] >= 0) & (r["end"] >= r["start"]))
    located = partial & (F.col("location") == "known") & (F.size(ranges) > 0)
    missing = F.coalesce(good("missing"), F.greatest(F.lit(0.0), good("container") - good("actual")))
    inferred = F.when(good("missing").isNotNull() | (good("container").isNotNull() & good("actual").isNotNull()), missing)
    none = F.slice(ranges, 1, 0)
    return rows.withColumns({
        "decode_state": F.when(known, F.col("state")).otherwise("failed"), "actual_seconds": good("actual"), "container_seconds": good("container"), "missing_seconds": inferred,
        "missing_location": F.when(F.coalesce(located, F.lit(False)), "known").when(F.coalesce(partial, F.lit(False)), "unknown").otherwise("notApplicable"), "missing_ranges": F.when(F.coalesce(located, F.lit(False)), ranges).otherwise(none),
    })


def decode_evidence(evidence: DataFrame, probes: DataFrame, key: list[str]) -> DataFrame:
    """Evidence with what the fixed pair of decoder and device saw: a source range of playable media, and the codec."""
    p = probes.where((F.col("engine") == "ffprobe+ffmpeg") & (F.col("device") == "cpu"))
    length = F.when(F.col("actual_seconds") > 0, F.col("actual_seconds"))
    p = p.select(*key, F.when(F.col("decode_state") == "playable", length).alias("range_end"), F.substring("codec", 1, 100).alias("codec"), F.lit(True).alias("_seen"))
    return evidence.join(p, key, "left").withColumn("decoded", F.coalesce("_seen", F.lit(False))).drop("_seen")


def structure_issues(packs: DataFrame, pack: str, schema: str, required: list[str]) -> DataFrame:
    """Issues of JSON packages held against a schema: not JSON, another version, a required field missing or of another type."""
    parsed = F.from_json(pack, schema, {"mode": "PERMISSIVE"})
    t = packs.withColumn("_p", parsed).withColumn("_version", F.get_json_object(pack, "$.schemaVersion"))
    present = lambda f: F.get_json_object(pack, f"$.{f}").isNotNull()
    found = [F.when(F.try_parse_json(pack).isNull(), "not JSON"), F.when(F.try_parse_json(pack).isNotNull() & ~F.coalesce(F.col("_version") == "2", F.lit(False)), "unknown version")]
    found += [F.when(F.try_parse_json(pack).isNotNull() & ~present(f), f"{f} missing") for f in required]
    found += [F.when(present(f) & F.col(f"_p.{f}").isNull(), f"{f} has another type") for f in required]
    out = t.withColumn("message", F.explode(F.array_compact(F.array(*found))))
    return out.select(*[c for c in packs.columns if c != pack], F.lit("error").alias("severity"), "message")


def backup_issues(attempts: DataFrame, sessions: DataFrame, libraries: DataFrame, history: DataFrame) -> DataFrame:
    """Broken invariants of a backup: names used twice, references to nothing, kinds and hashes that don't follow, revisions that fall.

    attempts: attempt_id, session_id, library_id, question_id, seq, kind; sessions: session_id, library_id; libraries:
    library_id, content, content_hash; history: candidate_id, seq, revision.
    """
    row = lambda df, message, path: df.select(F.lit(message).alias("message"), path.cast("string").alias("path"))
    twice = lambda df, key: row(df.groupBy(key).count().where("count > 1"), f"{key} used twice", F.col(key))
    lost = lambda df, key, path, other: row(df.where(F.col(key).isNotNull()).join(other.select(key).distinct(), key, "left_anti"), f"{key} not found", F.col(path))
    order = Window.partitionBy("library_id", "question_id").orderBy("seq", "attempt_id")
    kind = F.when(F.row_number().over(order) == 1, "first").otherwise("retry")
    step = F.col("revision") - F.lag("revision").over(Window.partitionBy("candidate_id").orderBy("seq"))
    parts = [
        twice(attempts, "attempt_id"), twice(sessions, "session_id"), lost(attempts, "session_id", "attempt_id", sessions), lost(sessions, "library_id", "session_id", libraries),
        row(attempts.withColumn("_kind", kind).where("kind <> _kind"), "kind does not follow", F.col("attempt_id")),
        row(libraries.where(F.sha2("content", 256) != F.col("content_hash")), "content has another hash", F.col("library_id")),
        row(history.withColumn("_step", step).where("_step < 0"), "revision falls", F.col("candidate_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fence(writes: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Verdict of writes (epoch, expected_revision): only those of the present epoch and revision of their key pass.

    current: key, now_epoch, now_revision, restoring.  A write without an epoch must be repeated with one; during a restore
    nothing is written.
    """
    t = writes.join(current, key, "left")
    e, r = F.col("epoch"), F.col("expected_revision")
    verdict = F.when(F.coalesce(e, F.lit("")) == "", "epoch_required").when(~e.eqNullSafe(F.col("now_epoch")), "stale_epoch").when(F.col("restoring"), "restoring").when(~r.eqNullSafe(F.col("now_revision")), "stale_revision").otherwise("accepted")
    return t.withColumn("verdict", verdict).drop("now_epoch", "now_revision", "restoring")


#: Caps of a tool's budget, tools that take no asset, and budgets that every request names.
BUDGET_CAPS = {"timeout_ms": 900_000, "max_output_bytes": 16 << 20, "max_input_bytes": 80 << 20, "max_duration_seconds": 7200, "max_pixels": 40 << 20}
WITHOUT_ASSETS = ("assets.list", "source.read", "candidates.validate", "draft.patch")
READ_LIMIT = 16_384


def tool_verdicts(requests: DataFrame, jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """Whether a tool request may run: the first rule that it breaks, or approved.

    requests: request_id, job_id, tool, generation, asset_ids, budget (map), read_from, read_to; jobs: job_id, state, tools,
    asset_ids, material_id, revision, allow_asr; assets: asset_id, material_id, revision, size.
    """
    j = jobs.select("job_id", F.col("state").alias("_state"), F.col("tools").alias("_tools"), F.col("asset_ids").alias("_assets"), F.col("material_id").alias("_material"), F.col("revision").alias("_revision"), "allow_asr")
    # A request's only asset; requests for several fail by their number.
    a = assets.select(F.col("asset_id").alias("_asset"), F.col("material_id").alias("_of"), F.col("revision").alias("_at"), "size")
    t = requests.withColumn("_asset", F.get("asset_ids", 0)).join(j, "job_id", "left").join(a, "_asset", "left")
    tool, n = F.col("tool"), F.size("asset_ids")
    bare = tool.isin(*WITHOUT_ASSETS)
    limit = F.lit(False)
    for name, cap in BUDGET_CAPS.items():
        v = F.col("budget")[name]
        limit = limit | (v.isNotNull() & ((v <= 0) | (v > cap))) | (v.isNull() & (F.lit(name != "max_pixels") | tool.startswith("document.")))
    other = F.exists(F.map_keys("budget"), lambda k: ~k.isin(*BUDGET_CAPS))
    wrong_ids = F.exists("asset_ids", lambda x: ~x.rlike("^[a-f0-9]{64}$"))
    cases = [
        ("invalid_request", F.col("generation") < 1), ("invalid_assets", wrong_ids | (bare & (n != 0)) | (~bare & (n != 1))), ("invalid_budget", limit | other), ("no_job", F.col("_state").isNull()),
        ("not_approved", ~F.col("_state").isin("running", "queued") | ~F.coalesce(F.array_contains("_tools", tool), F.lit(False))), ("asr_not_approved", (tool == "media.transcribe") & ~F.col("allow_asr")),
        ("asset_outside_scope", ~bare & (~F.coalesce(F.array_contains("_assets", F.col("_asset")), F.lit(False)) | ~F.coalesce((F.col("_of") == F.col("_material")) & (F.col("_at") == F.col("_revision")) & (F.col("size") <= F.col("budget")["max_input_bytes"]), F.lit(False)))),
        ("source_outside_scope", (tool == "source.read") & ((F.col("read_to") <= F.col("read_from")) | (F.col("read_to") - F.col("read_from") > READ_LIMIT))),
    ]
    out = None
    for code, cond in cases:
        cond = F.coalesce(cond, F.lit(True))
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return t.select("request_id", out.otherwise("approved").alias("verdict"))


def ingest_packs(questions: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts (ref, kind, parent) and candidates of packages (material_id, group_no, title, question_no, prompt, answer).

    Materials that have a set of candidates already are left alone, so reviewed fields are never replaced.  A group's
    artifact depends on its document's; candidates depend on their group's, and fields without text are missing.
    """
    new = questions.join(sets.select("material_id").distinct(), "material_id", "left_anti")
    groups = new.select("material_id", "group_no", "title").distinct()
    document = F.sha2(F.concat(F.lit("document:"), F.col("material_id").cast("string")), 256)
    group = F.sha2(F.concat_ws(":", F.lit("group"), document, F.col("group_no").cast("string"), F.coalesce("title", F.lit(""))), 256)
    artifacts = groups.select(group.alias("ref"), F.lit("group").alias("kind"), document.alias("parent")).unionByName(groups.select("material_id").distinct().select(document.alias("ref"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("parent")))
    state = lambda c: F.when(has_text(F.col(c)), "known").otherwise("missing")
    candidates = new.select("material_id", "group_no", "question_no", group.alias("group_ref"), state("prompt").alias("prompt_state"), state("answer").alias("answer_state"), F.lit(1).alias("revision"))
    return artifacts, candidates


def judge_proposals(proposals: DataFrame, questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Proposals of a model (source_id, task_kind, field, value, block_id, quote) held against their chunk.

    questions: source_id, task_kind, host_value, own_blocks; blocks: block_id, text, visibility.  A known kind stays, the
    quote must stand in its block, the block must be the question's own, a value that the host knows must be the same, and
    the quote must hold the whole value; prompts need visible blocks.  The first that fails is the verdict.
    """
    q = questions.select("source_id", F.col("task_kind").alias("_kind"), "host_value", "own_blocks")
    t = proposals.join(q, "source_id", "left").join(blocks.select("block_id", F.col("text").alias("_text"), "visibility"), "block_id", "left")
    cases = [
        ("no_question", F.col("_kind").isNull()), ("kind_changed", (F.col("_kind") != "unknown") & (F.col("task_kind") != F.col("_kind"))), ("quote_not_found", ~F.coalesce((F.col("quote") != "") & F.contains("_text", F.col("quote")), F.lit(False))),
        ("other_owner", ~F.array_contains("own_blocks", F.col("block_id"))), ("host_value_kept", has_text(F.col("host_value")) & ~F.col("value").eqNullSafe(F.col("host_value"))),
        ("not_covered", ~F.coalesce(has_text(F.col("value")) & F.contains("quote", F.col("value")), F.lit(False)) | ((F.col("field") == "prompt") & ~F.col("visibility").eqNullSafe(F.lit("source")))),
    ]
    out = None
    for code, cond in cases:
        cond = F.coalesce(cond, F.lit(True))
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return t.select("source_id", "field", out.otherwise("adopted").alias("verdict"))


#: What a reviewer confirms of a scanned page.
REVIEW_FLAGS = ("complete_question", "complete_dependencies", "readable", "answer_safe", "fields_confirmed", "critical_differences_resolved")


def ocr_candidates(proposals: DataFrame) -> DataFrame:
    """Candidates of scanned pages (prompt, options, passage, evidence_issues, review): states known only if all six flags are true.

    A proposal needs a prompt, a passage and two to ten options with different ids and texts.  An answer is never known.
    """
    reviewed = F.lit(True)
    for flag in REVIEW_FLAGS:
        reviewed = reviewed & F.coalesce(F.col("review")[flag], F.lit(False))
    n = F.size("options")
    ids = F.transform("options", lambda o: o["id"])
    whole = has_text(F.col("prompt")) & has_text(F.col("passage")) & (n >= 2) & (n <= 10) & (F.size(F.array_distinct(ids)) == n) & F.forall("options", lambda o: has_text(o["id"]) & has_text(o["text"]))
    state = F.when(reviewed, "known").otherwise("ambiguous")
    found = F.coalesce("evidence_issues", F.array().cast("array<string>"))
    open_ = F.when(reviewed, F.slice(found, 1, 0)).otherwise(F.concat(F.array(F.lit("ocr_complete_source_review_required")), found))
    t = proposals.withColumn("accepted", F.coalesce(whole, F.lit(False)))
    return t.withColumns({"prompt_state": F.when(F.col("accepted"), state), "answer_state": F.when(F.col("accepted"), "missing"), "visibility": F.when(F.col("accepted"), F.when(F.coalesce(F.col("review")["answer_safe"], F.lit(False)), "source").otherwise("reference")), "open_issues": F.when(F.col("accepted"), open_)}).drop("review", "options", "passage", "evidence_issues")


def apply_tool_results(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates (candidate_id, revision, evidence) after the completed results (candidate_id, expected_revision, seq, artifact).

    Results that expect another revision change nothing.  Evidence of the others is added in order, each artifact once, and
    the revision grows by one if any was new.
    """
    good = results.where("state = 'completed'").join(candidates.select("candidate_id", F.col("revision").alias("expected_revision")), ["candidate_id", "expected_revision"], "left_semi")
    added = good.groupBy("candidate_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "artifact"))), lambda r: r["artifact"]).alias("_new"))
    t = candidates.join(added, "candidate_id", "left")
    evidence = F.array_union("evidence", F.coalesce("_new", F.array().cast("array<string>")))
    grew = F.size(evidence) > F.size("evidence")
    return t.withColumns({"revision": F.col("revision") + grew.cast("int"), "evidence": evidence}).drop("_new")


def asset_page(assets: DataFrame, job: list[str], order: list[str], offset: Column, limit: int) -> DataFrame:
    """A page of each job's assets, with their number and where the next page begins (null at the end)."""
    w = Window.partitionBy(*job)
    t = assets.withColumn("_n", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count("*").over(w)).withColumn("_from", offset)
    t = t.where((F.col("_n") >= F.col("_from")) & (F.col("_n") < F.col("_from") + limit))
    return t.withColumn("next_offset", F.when(F.col("_from") + limit < F.col("total"), F.col("_from") + limit)).drop("_n", "_from")


def read_source(requests: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """The characters from start to end (exclusive) of a block; null where the block or the range isn't there."""
    t = requests.join(blocks, on, "left")
    fits = (F.col("end") <= F.length("text")) & (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    return t.withColumn("read", F.when(fits, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))).drop("text")


def ocr_proofs(evidence: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Evidence of pages (ref, job_id, chunk_id, page, state) that a completed chunk of a completed, present job vouches for.

    jobs: job_id, material_id, state, revision, now_revision; chunks: job_id, chunk_id, state, checkpoint.  Of several
    proofs of one piece of evidence the last job's stands.
    """
    j = jobs.where(F.col("state").isin("completed", "completed_with_issues") & (F.col("revision") == F.col("now_revision"))).select("job_id", "material_id")
    c = chunks.where((F.col("state") == "completed") & F.col("checkpoint").rlike("^[a-f0-9]{64}$")).select("job_id", "chunk_id", "checkpoint")
    e = evidence.where(F.col("ref").rlike("^[a-f0-9]{64}$") & F.col("page").between(1, 200) & F.col("state").isin("needs_review", "empty"))
    found = e.select("ref", "job_id", "chunk_id", "page", "state").join(c, ["job_id", "chunk_id"]).join(j, "job_id")
    best = F.max(F.struct("job_id", "chunk_id", "page", "state", "material_id", "checkpoint")).alias("_b")
    return found.groupBy("ref").agg(best).select("ref", "_b.*")


def backup_digest(tables: dict[str, DataFrame], parts: int = 4096) -> DataFrame:
    """(table, rows, digest) of every table of a backup, whatever the order of its rows: by hash parts, then over the parts."""
    out = None
    for name, df in tables.items():
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        t = df.select(row.alias("_row")).withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
        t = t.groupBy("_part").agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.sort_array(F.collect_list("_row")), ""), 256).alias("_hash"))
        whole = F.transform(F.sort_array(F.collect_list(F.struct("_part", "_hash"))), lambda p: p["_hash"])
        t = t.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(whole, ""), 256).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")
        out = t if out is None else out.unionByName(t)
    return out
