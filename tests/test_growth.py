"""What a job does on larger tables: the rows that its steps put out stay near those of its inputs."""

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import staging, text
from tessera.operators import evidence, extract, jobs, layout, lineage, match, projection, resolve, sessions, workbook
from tessera.plans import exam as exam_plans
from tessera.sources import intake


def most_rows(df):
    """The most rows that any step of the executed plan put out."""
    df.collect()

    def steps(node):
        name = node.getClass().getSimpleName()
        if name.startswith("AdaptiveSparkPlan"):
            yield from steps(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from steps(node.plan())
        else:
            yield node
            for i in range(node.children().size()):
                yield from steps(node.children().apply(i))

    found = [s.metrics().get("numOutputRows") for s in steps(df._jdf.queryExecution().executedPlan())]
    return max(m.get().value() for m in found if m.isDefined())


def _media(spark, n):
    targets = spark.range(n).select(F.concat(F.lit("t"), "id").alias("target_id"), F.lit("s").alias("scope"), F.lit(None).cast("string").alias("explicit_ref"), F.when(F.col("id") % 2 == 0, "clip").alias("hint"), F.when(F.col("id") % 5 != 0, (F.col("id") % 2).cast("int")).alias("number"))
    assets = spark.range(n).select(F.concat(F.lit("a"), "id").alias("asset_id"), F.lit("s").alias("scope"), F.lit("clip").alias("stem"), F.when(F.col("id") % 3 != 0, (F.col("id") % 2).cast("int")).alias("number"))
    return targets, assets


def test_media_of_large_scopes_make_no_product(spark):
    assert most_rows(resolve.media_mappings(*_media(spark, 600), ["scope"])) <= 2400


def test_media_in_order_of_large_scopes_make_no_product(spark):
    assert most_rows(resolve.media_mappings(*_media(spark, 600), ["scope"], pair_in_order=True)) <= 2400


def test_places_of_one_large_scope_are_dealt_over_tasks(spark, monkeypatch):
    rows = spark.range(900).select((F.col("id") * 7 % 900).alias("id"), F.when(F.col("id") % 50 == 0, "few").when(F.col("id") != 7, "many").alias("scope"))
    held = [r.n for r in staging.in_ranges(rows, "scope", "id", rows_per_task=60).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 900 and max(held) <= 300
    monkeypatch.setattr(staging.in_ranges, "__kwdefaults__", {"rows_per_task": 60})
    found = staging.placed(rows, ["scope"], ["id"])
    want = {}
    for scope in ("few", "many"):
        ids = sorted(r.id for r in rows.collect() if r.scope == scope)
        want |= {(scope, x): (k, len(ids)) for k, x in enumerate(ids, 1)}
    assert {(r.scope, r.id): (r._place, r._n) for r in found.collect()} == want and found.count() == 899
    assert not re.search(r"Window \[row_number", found._jdf.queryExecution().executedPlan().toString())


def test_keys_that_stand_several_times_count_distinct_values(spark):
    left = [(k, a, b) for k in range(6) for a, b in ((k % 3, 0), (k % 2, k % 2), (None, 1), (9, 9))[: 1 + k % 4]]
    right = [(a, b, f"v{v % 4}" if v else None) for v, (a, b) in enumerate([(0, 0), (0, 0), (1, 1), (1, 0), (2, 0), (0, 0), (1, 1), (2, 0), (None, 1)])]
    found = match.unique_match(spark.createDataFrame(left, "k int, a int, b int"), spark.createDataFrame(right, "a int, b int, v string"), ["a", "b"], "v", ["k"]).collect()
    expected = {}
    for k in range(6):
        met = {v for x, a, b in left if x == k and a is not None for c, d, v in right if (a, b) == (c, d) and v is not None}
        expected[k] = (len(met), "applied" if len(met) == 1 else "ambiguous" if met else "missing", min(met) if len(met) == 1 else None)
    assert {r.k: (r.n_matches, r.state, r.v) for r in found} == expected


def test_quotations_move_no_words_that_nothing_asks_for(spark):
    blocks = spark.range(200).select(F.lit(1).alias("doc"), F.col("id").alias("block_id"), F.col("id").alias("place"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("w"), F.col("id") * 50 + i)), " ").alias("text"))
    fields = spark.createDataFrame([(1, 1, "w120 w121 w122 w123 w124 w125"), (1, 2, "98 w9999"), (1, 3, "w7777"), (1, 4, " ".join(f"w{i}" for i in range(40, 310))), (1, 5, "w1 w2 w4")], "doc int, field int, text string")
    found = evidence.find_quotations(fields, blocks, ["doc"], ["field"])
    assert most_rows(found) <= 1000
    assert {(r.field, r.i0, tuple(r.block_ids)) for r in found.collect()} == {(1, 120, (2,)), (2, 9998, (199,)), (3, 7777, (155,)), (4, 40, tuple(range(7)))}


def test_workbook_lines_are_moved_once(spark):
    lines = spark.createDataFrame([(1, 1, 1, "Practice Test #1", None)], "doc int, page int, line_no int, text string, style string")
    for labels in (workbook.front_labels, workbook.answer_labels):
        plan = labels(workbook.workbook_lines(lines, ["doc"]), ["doc"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_ledger_records_are_not_repeated_for_each_column(spark):
    rows = [(i % 100, "d" if i % 100 else f"d{i % 3}", "settled" if i % 2 else "reserved", 1, 2, None if i % 3 else i % 100, 5 if i % 100 != 1 else i, i) for i in range(300)]
    records = spark.createDataFrame(rows, "request int, request_digest string, state string, reserved_input int, reserved_output int, used_input int, used_output int, acknowledged_at int")
    found = jobs.merge_ledger(records, ["request"])
    assert most_rows(found) <= 300
    assert sorted(r.request for r in found.collect() if r.conflict) == [0, 1]


def test_synchronized_records_are_not_repeated_for_each_column(spark):
    rows = [(i % 50, "d", "in_flight", 1, 2, i % 50, 5, i) for i in range(100)]
    records = spark.createDataFrame(rows, "request int, request_digest string, state string, reserved_input int, reserved_output int, used_input int, used_output int, acknowledged_at int")
    found = jobs.synchronize(records, records, ["request"])
    assert most_rows(found) <= 200
    assert {(r.conflict, r.state) for r in found.collect()} == {(False, "outcome_unknown")}


def test_requests_are_not_ranked_in_one_window(spark):
    requests = spark.createDataFrame([(i, 1, "practice", None if i % 3 else i % 2) for i in range(20)], "request_id long, library_id int, mode string, legacy_id int")
    libraries = spark.createDataFrame([(1, "h")], "library_id int, content_hash string")
    legacy = spark.createDataFrame([(0, 1, "practice"), (1, 1, "practice")], "legacy_id int, library_id int, mode string")
    held = spark.createDataFrame([(7, None, True)], "session_id long, legacy_id int, finished boolean")
    found = sessions.create_sessions(requests, libraries, legacy, held)
    assert {r.request_id for r in found.where("state = 'reused'").collect()} == {6, 9, 12, 15, 18}
    assert {r.request_id for r in found.where("state = 'created'").collect()} == {i for i in range(20) if i % 3 or i in (0, 3)}
    windows = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(state" not in windows


def test_missing_children_group_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("b", "d"), ("b", None)], "parent string, child string")
    refs = spark.createDataFrame([("b",), ("b",), ("d",), (None,)], "ref string")
    found = lineage.missing_children(edges, refs)
    assert sorted((r.parent, r.child or "") for r in found.collect()) == [("a", "c"), ("b", "")]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_projected_pages_are_moved_by_page_only(spark):
    heads = spark.createDataFrame([("a", n, n, "pdf", "", 600.0, 800.0, 0) for n in range(3)], "name string, page int, chunk int, kind string, text string, width double, height double, rotation int").withColumn("transform", F.lit(None).cast("array<double>"))
    rows = [("a", n, n, i, f"word {i}", 50.0 * i, 700.0 - 100 * (i % 2), 40.0, 10.0, i) for n in range(3) for i in range(4)]
    items = spark.createDataFrame(rows, "name string, page int, chunk int, item_index int, str string, x double, y double, width double, height double, line int").withColumn("axis", F.lit(None).cast("array<double>"))
    blocks = projection.project_layout(heads, items).blocks
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block_id" not in plan
    assert sorted((r.page, r.place, r.text) for r in blocks.collect()) == [(n, i, t) for n in range(3) for i, t in enumerate(("word 0", "word 2", "word 1", "word 3"))]


def test_texts_that_nfc_leaves_alone_go_around_python(spark):
    texts = ["plain", "“quoted” 中文 が", "e\u0301 x", "\u1112\u1161\u11ab", "\u212b", "a\u00a0 b", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r.i: r.text for r in rows.select("i", text.evidence_text(F.col("text")).alias("text")).collect()}
    assert found == {i: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()) for i, t in enumerate(texts)}
    plan = rows.select(text.evidence_text(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "nfc(CASE WHEN" in plan


def test_characters_that_nfc_leaves_alone_meet_no_other():
    ranges = [range(int(a, 16), int(b, 16) + 1) for a, b in re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", text.STABLE)]
    parts = [unicodedata.decomposition(chr(c)).split() for c in range(0x110000)]
    second = {int(p[1], 16) for p in parts if len(p) == 2 and not p[0].startswith("<")} | {*range(0x1161, 0x1176), *range(0x11A7, 0x11C3)}
    assert not [c for r in ranges for c in r if c in second or unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c)]


def test_packages_are_written_and_read_without_holding_their_entries(spark):
    entries = [(f"n{i:04}", b"x" * (i % 3)) for i in range(2500)]
    data = intake.zip_bytes(iter(entries))
    assert data == intake.zip_bytes(entries)
    rows = spark.createDataFrame([("p", n, bytearray(c)) for n, c in entries] + [("q", "é", bytearray(b"1"))], "pack string, name string, content binary")
    found = intake.package_archives(rows, "pack")
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    read = intake.read_archives(found.select(F.col("pack").alias("path"), F.col("zip").alias("content"))).collect()
    assert sorted((r.path, r.name, bytes(r.content)) for r in read) == [*(("p", n, c) for n, c in entries), ("q", "é", b"1")]


def test_records_are_read_by_columns():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("t", pa.string()), ("x", pa.float64())]))
    values = [[{"a": 1, "t": "u", "x": 0.5}], [], [{"a": None, "t": None, "x": None}, {"a": 2, "t": "", "x": 1.0}], [{"a": 3, "t": "w", "x": 2.0}]]
    assert list(layout.listed_records(pa.array(values, kind))) == values
    assert list(layout.listed_records(pa.array(values, kind).slice(1, 2))) == values[1:3]


def test_islands_of_many_rows_are_sorted_by_more_tasks(spark):
    """Tasks grow with the rows, and runs come from the one sort without groups held in memory."""
    rows = spark.range(3000).select((F.col("id") % 500).alias("k"), F.col("id").alias("at"), (F.col("id") % 7 < 3).cast("int").alias("kind"))
    by_kind = [F.col("at")], F.col("kind").isin(1)
    assert staging.dealt(rows, "k", rows_per_task=100).rdd.getNumPartitions() == 31
    heads = resolve.island_heads(staging.dealt(rows, "k"), ["k"], *by_kind)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 1
    expected = resolve.islands(rows, ["k"], *by_kind).groupBy("k", "island").agg(F.count("*").alias("size"), F.min("at").alias("at"))
    assert {(r.k, r.island, r.size, r["at"]) for r in heads.collect()} == {(r.k, r.island, r["size"], r["at"]) for r in expected.collect()}


def test_banks_of_many_orders_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(exam_plans, "ORDERS_PER_TASK", 50, raising=False)
    orders = spark.range(2000).selectExpr("id % 90 as o_custkey", "id as o_orderkey", "date'2020-01-01' as o_orderdate")
    monkeypatch.setattr(exam_plans.c, "table", lambda *_: orders)
    assert exam_plans._bank(spark, "").rdd.getNumPartitions() == 41


def test_worksheet_lines_are_classified_and_carried_once(spark):
    text = ["no question", "Section one", "1. First?", "and more", "(A) x", "B. y ", "", "2) Second?", "A) z", "Part two", "C. w", "1. Third?", "Answer key:", "1 B; 2 A", "note", "Task 3", "7. Last"]
    lines = spark.createDataFrame([(d, k, t) for d in (1, 2) for k, t in enumerate(text)], "doc int, line_no int, line string")
    questions, options, keys = extract.worksheet(lines, ["doc"], "line_no", "line")
    for found in (questions, options, keys):
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    asked = [(1, 2, 1, "1. First?\nand more", 2), (1, 7, 2, "2) Second?", 1), (9, 11, 1, "1. Third?", 1), (15, 16, 7, "7. Last", 1)]
    assert sorted(map(tuple, questions.select("doc", "group", "question", "number", "prompt", "n_lines").collect())) == [(d, *x) for d in (1, 2) for x in asked]
    assert sorted(map(tuple, options.collect())) == [(d, *x) for d in (1, 2) for x in [(2, "A", "x"), (2, "B", "y"), (7, "A", "z"), (7, "C", "w")]]
    assert sorted(map(tuple, keys.collect())) == [(d, 9, *x) for d in (1, 2) for x in [(1, "B"), (2, "A")]]


def test_workbooks_are_read_where_their_orders_lie(spark, tmp_path):
    """Orders are moved once, before they become lines; nothing is staged, and no line goes through Python."""
    from tessera.plans import workbooks

    spark.createDataFrame([(1, 1, "1-URGENT", "2020-01-01")], "o_custkey long, o_orderkey long, o_orderpriority string, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = workbooks._lines(spark, str(tmp_path))
    plan = workbook.read_workbook(lines, ["doc"]).questions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan and "SortMergeJoin" not in plan and "MapInPandas" not in plan
    labels = workbook.front_labels(workbook.workbook_lines(lines.withColumn("style", F.lit(None).cast("string")), ["doc"]), ["doc"])
    assert "Python" not in labels._jdf.queryExecution().executedPlan().toString()


def test_compatible_forms_without_python(spark):
    texts = ["plain", "１． ﬁ", "é x", "한", "Å½", "a b　c", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {r.i: r.t for r in rows.select("i", text.nfkc_text(F.col("text")).alias("t")).collect()} == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


def test_addressed_rows_are_put_together_where_they_lie(spark):
    """Of rows and fields that lie by document only one side is moved again, to meet the other."""
    rows = spark.createDataFrame([(1, 1, 7, 70, 0, "3.", [4]), (1, 1, 7, 71, 1, "B", [5])], "doc int, page int, row_id int, block_id int, place int, text string, lines array<int>").repartition(5, "doc")
    fields = spark.createDataFrame([("a", 1, 1, 5, "B"), ("b", 1, 2, 5, "B")], "field string, doc int, page int, line int, value string").repartition(5, "doc").hint("merge")
    found = evidence.addressed_answers(fields, rows, ["doc"], ["field"])
    assert {(r.field, r.state) for r in found.collect()} == {("a", "known"), ("b", "unmapped")}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 3
