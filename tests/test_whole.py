"""Queries that take every row: what the registered subsets leave out."""

import itertools

from tessera.operators.extract import tile_sentence
from tessera.plans.registry import QUERIES


def test_source_revision_sees_every_document(spark, tmp_path):
    def revisions(name, changed=None):
        rows = [(i, "new" if i == changed else f"text {i}", f"s{i % 2}") for i in range(40)]
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return dict(QUERIES["g4_source_revision"](spark, f"{tmp_path}/{name}").collect())

    before = revisions("before")
    assert revisions("same") == before
    for doc in (3, 20):
        after = revisions(f"changed{doc}", doc)
        assert {s for s in before if after[s] != before[s]} == {f"s{doc % 2}"}


def test_sorted_attempts_of_every_user(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 6:02d} 00:00:00", 7 + i % 3, "view", '{"k": %d}' % i) for i in range(18)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["a1_sorted_attempts"](spark, str(tmp_path)).collect()
    expected = set()
    for user in (7, 8, 9):
        own = sorted((r for r in rows if r[2] == user), key=lambda r: (-int(r[1][8:10]), r[0]))
        expected |= {(user, r[0], k) for k, r in enumerate(own, 1)}
    assert {tuple(r) for r in found} == expected and len(found) == 18


def test_scans_and_times_of_every_row(spark, tmp_path):
    texts = ["Ab 1" * 200, "cD 1" * 200, None, " \t", "page", ""]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"scan {i}") for i in range(1, 6)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scans = {r.doc_id: (r.text, r.scanned) for r in QUERIES["l17_scans"](spark, str(tmp_path)).collect()}
    assert scans == {1: (texts[0], False), 2: (texts[1], False), 3: ("scan 3", True), 4: ("scan 4", True), 5: ("page", False), 6: ("", False)}
    spark.createDataFrame([(0, 121), (8, 5), (1, 7201), (9, 30), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.o_orderkey: (r.scope, r.field, r.seconds) for r in QUERIES["x18_durations"](spark, str(tmp_path)).collect()}
    none = (None, None, None)
    assert found == {0: ("group", "prepare", None), 8: ("group", "prepare", 300), 1: ("question", "time", None), 9: ("question", "time", 30), 2: (None, "prepare", 90), 3: ("group", "time", 0), 4: (None, "time", None), 5: (None, "time", None), 6: none, 7: none}


def test_template_has_whole_turns(spark, tmp_path):
    rows = [(1, 0, "user", "a question of more than twenty characters"), (1, 1, "assistant", "an answer of more than twenty characters")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = QUERIES["x1_template"](spark, str(tmp_path)).collect()
    assert rows[0][3] in row.body and rows[1][3] in row.body


def test_tiling_takes_whole_texts(spark, tmp_path):
    texts = {1: "a b c d e f g h i j k", 2: "a b c d e f g h i a b c d e f g h i j", 3: "one two", 4: "a a a b c d a a a", 5: "x y x y x y", 6: None}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = dict(QUERIES["x13_tiling"](spark, str(tmp_path)).collect())
    assert found == {1: [1, 2, 0], 2: [1, 2, 0], 3: [0, 1], 4: found[4], 5: found[5], 6: None}
    for i in (4, 5):
        words, third = texts[i].split(), -(-len(texts[i].split()) // 3)
        parts = [words[k * third : (k + 1) * third] for k in (2, 0, 1)]
        orders = {tuple(map(tuple, (parts[k] for k in o))): list(o) for o in itertools.permutations(range(3)) if sum((parts[k] for k in o), []) == words}
        assert found[i] == tile_sentence(words, parts) and (found[i] is not None) == (len(orders) == 1)
