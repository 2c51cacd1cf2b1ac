"""Rules of layout, extraction, resolution and verification on small cases, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import exam, extract, layout, resolve, verify


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ([1, None, None, None, 5], [1, 2, 3, 4, 5]), ([None, 1], [None, 1]), ([None, None, 3], [None, 2, 3]), ([4, None, None], [4, 5, 6]), ([1, None, 5], [1, None, 5]), ([None, None], [None, None]),
        ([1, None, None, 9, None], [1, 2, None, 9, 10]), ([0, None], [0, 1]),
    ],
)
def test_numbers_of_labels(spark, given, expected):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(given)], "page int, pos int, number int")
    found = layout.repair_numbers(rows, ["page"], ["pos"], "number").orderBy("pos").collect()
    assert [r.number for r in found] == expected
    assert [r.restored for r in found] == [a is None and b is not None for a, b in zip(given, expected, strict=True)]


def test_lines_of_a_page(spark):
    line = "page int, line int, text string, x double, y double"
    rows = [(1, 0, "low", 0.0, 10.0), (1, 1, "top", 0.0, 100.0), (1, 2, "next", 0.0, 90.0), (1, 3, " ", 0.0, 50.0), (1, 4, "beside", 9.0, 90.0), (2, 0, "b", 0.0, None), (2, 1, "", 0.0, 3.0), (2, 2, "a", 0.0, 99.0)]
    rows += [(3, 0, "a", 0.0, 50.0), (3, 1, "b", 0.0, 49.5), (3, 2, "c", 0.0, 27.0)]
    found = layout.page_lines(spark.createDataFrame(rows, line), ["page"]).orderBy("page", "place").collect()
    show = lambda page: [(r.text, r.blank_before) for r in found if r.page == page]
    # Gaps 10, 0 and 80: above 1 are two, of which the upper is the leading.
    assert show(1) == [("top", False), ("next", False), ("beside", False), ("low", False)]
    assert show(2) == [("b", False), ("", False), ("a", False)]
    assert show(3) == [("a", False), ("b", False), ("c", False)]  # one gap of 22.5 is the leading itself
    two = [(1, 0, "a", 0.0, 100.0), (1, 1, "b", 0.0, 90.0), (1, 2, "c", 0.0, 80.0), (1, 3, "d", 0.0, 64.0)]
    assert [r.blank_before for r in layout.page_lines(spark.createDataFrame(two, line), ["page"]).orderBy("place").collect()] == [False, False, False, True]


def test_furniture_is_not_structure(spark):
    texts = {p: ["", f"Title {p}", "Question 3 What?", "body", f"own {p}", "", "(A) yes", f"page {p}", ""] for p in range(3)}
    rows = [("d", p, i, t) for p, ls in texts.items() for i, t in enumerate(ls)]
    found = layout.edge_furniture(spark.createDataFrame(rows, "doc string, page int, line int, text string"), ["doc"], "page", "line", "text").where("furniture").collect()
    assert {(r.page, r.text) for r in found} == {(p, t) for p in range(3) for t in (f"Title {p}", f"own {p}", f"page {p}")}


def test_margins(spark):
    texts = {1: ("Page 3", "Acme news"), 2: ("Page 4", "Acme news"), 3: ("Page 9", "Copyright 2020 A")}
    rows = [("d", p, 2 * p + k, t, 10.0 if k else 990.0, 1000.0, 500.0, 0.0) for p, ts in texts.items() for k, t in enumerate(ts)] + [("d", 4, 9, "Section 1", 10.0, 1000.0, 500.0, 0.0), ("d", 5, 10, "Copyright 2021 A", 10.0, 1000.0, 500.0, 0.0), ("d", 5, 11, "Page 9", 500.0, 1000.0, 500.0, 0.0)]
    found = layout.repeated_margins(spark.createDataFrame(rows, "doc string, page int, block int, text string, y double, height double, right double, baseline double"), ["doc"]).collect()
    assert {(r.page, r.pattern, r.role) for r in found} == {
        (1, "Page #", "footer"), (2, "Page #", "footer"), (3, "Page #", "body"), (1, "Acme news", "body"), (2, "Acme news", "body"), (3, "Copyright # A", "header"), (5, "Copyright # A", "header"),
    }


@pytest.mark.parametrize(
    ("gapped", "full", "passage", "missing"),
    [
        ("The ro was lo.", "The rope was long.", "The ro__ was lo__.", ["pe", "ng"]), ("THE ro", "The rope", None, None), ("Th ro", "The rope", "Th_ ro__", ["e", "pe"]), ("same text", "same text", None, None),
        ("a ro", "a rope here", None, None), ("don't ro-", "don't rope-", "don't ro__-", ["pe"]), ("RO it", "rope it", "RO__ it", ["pe"]), ("", "", None, None), ("xo it", "rope it", None, None),
    ],
)
def test_gaps_from_the_full_text(spark, gapped, full, passage, missing):
    (row,) = spark.createDataFrame([(gapped, full)], "a string, b string").select(extract.gap_words(F.col("a"), F.col("b")).alias("g")).collect()
    assert (row.g and (row.g.passage, row.g.missing)) == (passage and (passage, missing))


def test_missing_letters(spark):
    given = {"Ived": "lved", "SO": "so", "IN": None, "A": None, "bcd": "bcd", "a-I": "a-I", "": "", "3": "3"}
    found = spark.createDataFrame([(x,) for x in given], "a string").select("a", extract.missing_letters(F.col("a")).alias("b")).collect()
    assert {r.a: r.b for r in found} == given


def test_keys_look_back(spark):
    q = [("d", i, g, "single_choice", n) for i, g, n in ((1, 0, 1), (2, 0, 2), (3, 1, 1), (4, 3, 2), (5, 3, 2), (6, 5, 3))] + [("d", 7, 0, "sentence_order", 1)]
    k = [("d", i, b, "single_choice", n, s) for i, b, n, s in ((1, 2, 1, False), (2, 2, 2, False), (3, 4, 2, False), (4, 4, 1, True), (5, 6, 1, False), (6, 6, 3, False), (7, 6, 3, False))]
    found = resolve.keys_look_back(spark.createDataFrame(k, "doc string, key_id long, block int, type string, number int, scanned boolean"), spark.createDataFrame(q, "doc string, question_id long, group int, type string, number int"), ["doc"])
    got = {r.key_id: (r.state, r.question_id) for r in found.collect()}
    # Number 1 stands in two groups before the first block; number 2 twice in one group, so neither takes a key; a scanned key doesn't reach back.
    assert got == {1: ("ambiguous", None), 2: ("applied", 2), 3: ("missing", None), 4: ("missing", None), 5: ("ambiguous", None), 6: ("applied", 6), 7: ("missing", None)}


def test_answers_against_options(spark):
    q = [(1, 1, "single_choice", ["A", "B"], []), (2, 2, "single_choice", ["A", "B"], ["B."]), (3, 3, "sentence_order", ["a", "b"], ["b → a"]), (4, 4, "sentence_order", ["a", "b"], ["b b"]), (5, 5, "fill_blank", [], ["?", "cat"]), (6, 6, "fill_blank", [], ["cat", "dog"]),
         (7, 7, "interview", [], ["x"]), (8, 8, "single_choice", ["A"], []), (9, 8, "single_choice", ["A"], ["A"]), (10, 9, "single_choice", ["A"], [])]
    k = [(1, "C"), (2, "B."), (5, "not given"), (8, "A"), (9, "n/a")]
    found = resolve.resolve_keys(spark.createDataFrame([("s", *x) for x in q], "scope string, question_id int, number int, type string, options array<string>, local array<string>"), spark.createDataFrame([("s", *x) for x in k], "scope string, number int, answer string"), ["scope"], "number")
    assert {r.question_id: (r.state, r.answer) for r in found.collect()} == {
        1: ("unmatched", None), 2: ("applied", ["B"]), 3: ("applied", ["b", "a"]), 4: ("unmatched", None), 5: ("applied", ["cat"]), 6: ("conflict", None), 7: ("subjective", None), 8: ("missing", None), 9: ("applied", ["A"]), 10: ("missing", None),
    }


def test_fill_passages(spark):
    p = [(1, "m", "The ro__ was  lo _ _."), (2, "m", "no ga__"), (3, "n", "The ro__ was lo__.")]
    k = [("m", 10, "The ro{pe} was lo{n} .", 4, 5), ("m", 11, "no ga{ps}", 6, 6), ("m", 12, "no ga{ps}", 6, 6), ("n", 13, "The ro{pe} was lo{ng}.", 1, 3)]
    found = extract.fill_answers(spark.createDataFrame(p, "passage_id int, module string, text string"), spark.createDataFrame(k, "module string, key_id int, text string, first int, last int"), ["module"]).collect()
    assert {r.passage_id: (r.applied, r.key_id, r.answers) for r in found} == {1: (True, 10, ["pe", None]), 2: (False, None, None), 3: (False, None, None)}


def test_answer_evidence(spark):
    b = [("d", i, "f" if i < 9 else "g", t) for i, t in enumerate(["one?", "Answers: 1 B; 2) C, 3", "Reading: x", "two?", "three?", "Answer key: 12 A; 2. B", "answers: 2 D", "four?", "Answers: 4 D", "Answer key: 5 A", "five?"])]
    q = [("d", "q1", 1, "B", 0), ("d", "q2", 2, "B", 0), ("d", "q3", 2, "B", 3), ("d", "q4", 1, "A", 4), ("d", "q5", 4, "D", 7), ("d", "q6", 5, "A", 7)]
    found = verify.answer_evidence(spark.createDataFrame(q, "doc string, question_id string, number int, answer string, place int"), spark.createDataFrame(b, "doc string, place int, name string, text string"), ["doc"]).collect()
    assert {r.question_id: (r.n, r.state) for r in found} == {"q1": (1, "known"), "q2": (1, "conflict"), "q3": (2, "ambiguous"), "q5": (1, "known")}


def test_ocr_against_its_layer(spark):
    rows = [("", "x 1"), ("a  b", "a b "), ("a b", "a not b"), ("a_ 1", "a__ 1"), ("n 1", "n 2"), (None, "x"), ("EXCEPT a", "except a")]
    found = verify.compare_ocr(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    say = "text_ocr_disagreement"
    assert [r.issues for r in found] == [[], [], [say, "critical_negation_conflict"], [say, "blank_anchor_conflict"], [say, "number_conflict"], [], [say]]


def test_mutual_and_ranges(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 3), (3, 4), (5, 4), (6, 6)], "a int, b int")
    assert sorted(map(tuple, resolve.mutual_match(pairs, "a", "b").collect())) == [(1, 1), (6, 6)]
    left = spark.createDataFrame([(i, "p", i) for i in range(-30, 60)], "id int, page string, at int")
    ranges = spark.createDataFrame([("p", -25, -10, "a"), ("p", 0, 20, "b"), ("p", 20, 41, "c"), ("q", 0, 50, "d")], "page string, lo int, hi int, v string")
    found = {r.id: (r.state, r.v) for r in resolve.range_match(left, ranges, ["page"], "at", "lo", "hi", "v", ["id"], 7).collect()}
    for i in range(-30, 60):
        hit = [v for p, lo, hi, v in (("p", -25, -10, "a"), ("p", 0, 20, "b"), ("p", 20, 41, "c")) if lo <= i <= hi]
        assert found[i] == (("applied", hit[0]) if len(hit) == 1 else ("ambiguous" if hit else "missing", None))


def test_directives_may_be_indented_and_signs_stay(spark):
    lines = ["x", "  @Title : A  B ", "mail x@@y.z", "@@ home", " @@@deep", "@GROUP", "@question:what", "@1 no"]
    found = extract.parse_template(spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, i int, line string"), ["doc"], "i", "line").collect()
    assert {(r.at, r.directive, r.body) for r in found} == {(1, "title", "A  B\nmail x@@y.z\n@ home\n @@deep"), (5, "group", ""), (6, "question", "what\n@1 no")}


def test_headings_of_tasks_to_repeat_are_no_furniture(spark):
    rows = [("d", p, i, t) for p in range(4) for i, t in enumerate(["Task 3 Listen and Repeat", "Some Book 2020", f"text {'abcd'[p]}", "more"])]
    found = layout.edge_furniture(spark.createDataFrame(rows, "doc string, page int, line_no int, line string"), ["doc"], "page", "line_no", "line").where("furniture").collect()
    assert {r.line for r in found} == {"Some Book 2020", "more"}


def test_far_pieces_of_a_blank_stay_apart(spark):
    rows = [(["care", "___", "_", "on"], [True, True, False, True]), (["care", "___", "_", "on"], [True, True, True, None]), ([], []), (["3.B"], [None])]
    out = [r[0] for r in spark.createDataFrame(rows, "w array<string>, n array<boolean>").select(exam.repair_words(F.col("w"), F.col("n"))).collect()]
    assert out == [["care___", "_", "on"], ["care____", "on"], [""], ["3.", "B"]]


def test_repeated_numbers_of_a_group_take_no_key(spark):
    """Number 4 stands twice in group 3, so a key after it goes back to the single 4 of group 1."""
    keys = spark.createDataFrame([("d", "k", 5, "single_choice", 4, False)], "doc string, key_id string, block int, type string, number int, scanned boolean")
    questions = spark.createDataFrame([("d", "a", 1, "single_choice", 4), ("d", "b", 3, "single_choice", 4), ("d", "c", 3, "single_choice", 4), ("d", "e", 3, "single_choice", 5)], "doc string, question_id string, group int, type string, number int")
    (row,) = resolve.keys_look_back(keys, questions, ["doc"]).collect()
    assert (row.state, row.question_id) == ("applied", "a")


def test_boxes_of_proofread_words(spark):
    words = [(1, k, w, t, 50.0, 10.0 * w, 0.0, 10.0 * w + 8, 5.0 + k) for k in range(4) for w, t in enumerate(["ab", "c"])]
    fixed = [(1, 0, " ab  d "), (1, 1, "a b c"), (1, 2, " "), (1, 9, "no such line")]
    box = "page int, line int, word int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
    found = layout.proofread_words(spark.createDataFrame(words, box), spark.createDataFrame(fixed, "page int, line int, text string"), ["page"]).orderBy("line", "word").collect()
    unit = 18 / 5
    assert [(r.line, r.text, r.confidence, round(r.x0, 6), round(r.x1, 6)) for r in found] == [
        (0, "ab", 50.0, 0.0, 8.0), (0, "d", layout.PROOFREAD, 10.0, 18.0), *((1, t, layout.PROOFREAD, round(2 * i * unit, 6), round((2 * i + 1) * unit, 6)) for i, t in enumerate("abc")), (3, "ab", 50.0, 0.0, 8.0), (3, "c", 50.0, 10.0, 18.0),
    ]
    assert layout.proofread_words(spark.createDataFrame([], box), spark.createDataFrame(fixed, "page int, line int, text string"), ["page"]).collect() == []
