"""Exam documents, sessions and the workspace on small cases; queries without SQL against plain versions."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import exam, extract, lineage, packages, resolve, sentences, sessions, verify, workspace

LINE = "doc string, page int, line_no int, text string"


def lines(doc, pages):
    return [(doc, p, i, t) for p, text in enumerate(pages, 1) for i, t in enumerate(text.split("\n"))]


DOCUMENT = [
    "Reading Section, Module 1\nFill in the missing letters in the paragraph.\n1. The ro__ is lo__.\nRead an email.\n2. Why?\nBecause of\n(A) this\nand more\n(B) that",
    "Writing Section, Module 1\nBuild a Sentence\n1. What did she say?\n3. And then?",
    "Answer Key\nReading Section, Module 1\nQuestion Number Answer\n1. rope\nlong\n2 B\n7 A",
    "Answer Key\nWriting Section, Module 1\nlost\n1) she said so\n3 a\n3 b",
    "Answer Key\nno heading here",
]


def test_exam_document(spark):
    rows = lines("a", DOCUMENT) + lines("b", DOCUMENT[:2])
    found = exam.exam_document(spark.createDataFrame(rows, LINE), ["doc"]).collect()
    assert {(r.section, r.module, r.number, r.kind, r.prompt, tuple(o.text for o in r.options), r.state, r.answer) for r in found if r.doc == "a"} == {
        ("reading", 1, 1, "fill_blank", "The ro__ is lo__.", (), "applied", "rope\nlong"), ("reading", 1, 2, "single_choice", "Why?\nBecause of", ("this\nand more", "that"), "applied", "B"),
        ("writing", 1, 1, "sentence_order", "What did she say?", (), "applied", "she said so"), ("writing", 1, 3, "sentence_order", "And then?", (), "ambiguous", None),
    }
    assert {r.doc for r in found} == {"a"}
    keys, issues = exam.read_keys(spark.createDataFrame(rows, LINE), ["doc"])
    assert {(r.section, r.number) for r in keys.collect()} == {("reading", 1), ("reading", 2), ("reading", 7), ("writing", 1), ("writing", 3)}
    assert sorted((r.page, r.message) for r in issues.collect()) == [(4, "lines before the first row"), (5, "answer page without section or module")]


def test_insertion_offsets(spark):
    ask = "There are four locations where it may go. Where would the sentence best fit?\nNew one.\n"
    marked = "(A) First 😀 one.(B) Second  one.\n(C) Third.(D)"
    passage = "Title 😀\n\nFirst 😀 one. Second\none. Third. End."
    rows = [(1, ask + marked, passage), (2, ask + marked, passage + passage), (3, ask + "(A) First.(C) x", passage), (4, "Why?", passage), (5, ask + marked, None)]
    found = {r.i: r for r in exam.insertion_interaction(spark.createDataFrame(rows, "i int, prompt string, passage string")).collect()}
    assert [found[i].state for i in range(1, 6)] == ["insertion", "refused", "refused", None, "refused"]
    units = passage.encode("utf-16-le")
    assert [units[2 * p :].decode("utf-16-le")[:6] for p in found[1].positions] == ["First ", " Secon", " Third", " End."]
    assert found[1].sentence == "New one." and found[1].prompt.endswith("best fit?\n\nNew one.")


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("Question12: x", "Question 12: x"), ("3.B", "3. B"), ("3)cc", "3. cc"), ("3.6 words", "3. 6 words"), ("x 3.6 words", "x 3.6 words"), ("6words left", "6 words left"), ("(A)apple B.bee", "A. apple B.bee"), ("ab—–,", "ab---,"), ("— —", "-- --"),
        ("fr__therec_", "fr__ therec_"), ("care ___ _ on", "care____ on"), ("The ____ ____ fantastic.", "The ____ ____ fantastic."), ("rec_ __, then", "rec___, then"), ("_ __", "___"), ("plain text", "plain text"), ("word __", "word__"),
    ],
)
def test_repaired_words(spark, line, expected):
    (row,) = spark.createDataFrame([(line,)], "a string").select(F.array_join(exam.repair_words(F.split("a", " ", -1)), " ").alias("b")).collect()
    assert row.b == expected


def test_discussion_posts(spark):
    page = [("p1", 50.0, 100.0), ("p2", 51.0, 90.0), ("a1", 90.0, 80.0), ("a2", 90.0, 70.0), ("b1", 90.0, 50.0), ("b2", 92.0, 40.0)]
    crooked = [(t, x + (9 if t == "b2" else 0), y) for t, x, y in page]
    one = [(t, x, 100.0 - 10 * i) for i, (t, x, _) in enumerate(page)]
    rows = [(k, *r) for k, p in enumerate((page, crooked, one, page[2:])) for r in p]
    found = exam.discussion_posts(spark.createDataFrame(rows, "page int, text string, x double, y double"), ["page"]).collect()
    assert [(r.page, r.prompt, r.first_post, r.second_post) for r in found] == [(0, "p1\np2", "a1\na2", "b1\nb2")]


def best_covers(answer, fragments):
    """All covers by brute force: (cost, steps) of the best, steps as texts of fragments or words."""
    words, parts = answer.split(), [f.split() for f in fragments]
    out = []

    def walk(at, used, steps, cost):
        if at == len(words):
            out.append((cost, tuple(steps)))
            return
        walk(at + 1, used, [*steps, ("x", words[at].lower())], cost + 100)
        for i, p in enumerate(parts):
            if i not in used and all(j in used or fragments[j].lower() != fragments[i].lower() for j in range(i)) and [w.lower() for w in words[at : at + len(p)]] == [w.lower() for w in p]:
                walk(at + len(p), {*used, i}, [*steps, ("f", fragments[i].lower())], cost + sum(a != b for a, b in zip(words[at:], p, strict=False)))

    walk(0, frozenset(), [], 0)
    low = min(c for c, _ in out)
    return {s for c, s in out if c == low}


def test_covers_against_brute_force():
    r = random.Random(2)
    for _ in range(400):
        answer = " ".join(r.choice("abAc") for _ in range(r.randint(1, 7)))
        fragments = [" ".join(r.choice("abcB") for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 5))]
        best, found = best_covers(answer, fragments), sentences.cover_sentence(answer, fragments)
        (steps,) = best if len(best) == 1 else (None,)
        slots = [t for what, t in steps or () if what == "f"]
        if steps is None or len(slots) < 2:
            assert found is None, (answer, fragments)
        else:
            assert [fragments[i].lower() for i in found[1]] == slots and found[0].count("_____") == len(slots)


def test_blanks_dropped_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        wanted = [r.randint(1, 3) for _ in range(r.randint(0, 4))]
        lengths = [r.randint(1, 3) for _ in range(r.randint(0, 7))]
        extra = len(lengths) - len(wanted)
        ways = [(sum(lengths[i] != q for i, q in zip(kept, wanted, strict=True)), list(kept)) for kept in itertools.combinations(range(len(lengths)), len(wanted))] if extra >= 0 else []
        low = [k for c, k in ways if c == min(c for c, _ in ways)]
        assert extract.fewest_drops(lengths, wanted) == (low[0] if len(low) == 1 and 0 <= extra <= 3 else None)


def test_task_bank(spark):
    text = """Choose a Best Response
Question 1: Where?
(A) here
(B) there
Answer: A
2) When?
A. now
B. then
Build a Sentence
3. Why so?
Answers and Explanations
2 B
because
3. it is so
Passage 2: more
1. Who?
what is more
Answer key: 1 A, 3. c"""
    rows = [("d", i, t) for i, t in enumerate(text.split("\n"))]
    questions, keys = exam.task_bank(spark.createDataFrame(rows, "doc string, line_no int, text string"), ["doc"])
    assert [(r.group, r.number, r.kind, r.type, r.prompt, [tuple(o) for o in r.options], r.stated) for r in questions.orderBy("question_id").collect()] == [
        (1, 1, "listening", "single_choice", "Where?", [("A", "here"), ("B", "there")], ["A"]), (1, 2, "listening", "single_choice", "When?", [("A", "now"), ("B", "then")], []),
        (2, 3, "sentence_order", "sentence_order", "Why so?", [], []), (3, 1, "sentence_order", "sentence_order", "Who?\nwhat is more", [], []),
    ]
    assert {(r.block, r.number, r.type, r.answer) for r in keys.collect()} == {(3, 2, "single_choice", "B"), (3, 3, "sentence_order", "it is so"), (4, 1, "single_choice", "A"), (4, 3, "single_choice", "C")}
    taken = resolve.keys_look_back(keys.withColumn("scanned", F.lit(False)), questions, ["doc"]).collect()
    assert {(r.key_id.number, r.state, r.question_id) for r in taken} == {(2, "applied", 5), (3, "applied", 9), (1, "applied", 1), (3, "missing", None)}


def test_presentations(spark):
    email = "Write to him.\nYou will have 7 minutes to write.\nTo: A B\nSubject: Hi\nbody\nYour Response:\nx"
    read = "Read an email in a box.\nTo: me\nDate: now\nDear,\nyou"
    (row,) = spark.createDataFrame([(email, read)], "e string, r string").select(exam.email_presentation(F.col("e")).alias("e"), exam.reading_document(F.col("r"), F.lit(False)).alias("r"), exam.email_presentation(F.col("r")).alias("none")).collect()
    assert (row.e.to, row.e.subject, row.e.instructions, row.e.body) == ("A B", "Hi", "Write to him.\nYou will have 7 minutes to write.", "To: A B\nSubject: Hi\nbody")
    assert (row.r.kind, [tuple(x) for x in row.r.rows], row.r.title, row.r.body) == ("email", [("To", "me"), ("Date", "now")], "", "Dear,\nyou") and row.none is None


def test_conditional_append_of_a_long_history(spark):
    rows = [(k % 3, k, (k // 3) % 5) for k in range(3000)] + [(None, 1, 0), (None, 2, 1)]
    found = lineage.conditional_append(spark.createDataFrame(rows, "key int, seq int, expected int"), ["key"], ["seq"]).collect()
    for key in range(3):
        revision = 0
        for r in sorted((r for r in found if r.key == key), key=lambda r: r.seq):
            assert r.accepted == (r.expected == revision)
            revision += r.accepted
        assert {r.final_revision for r in found if r.key == key} == {revision}


def test_backup_digest(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "b int, a string")
    same, other = a.orderBy(F.desc("b")).repartition(7).select("a", "b"), a.withColumn("a", F.when(F.col("b") == 3, None).otherwise(F.col("a")))
    found = {r.table: (r.rows, r.digest) for r in workspace.backup_digest({"a": a, "same": same, "other": other, "none": a.where("false")}, 4).collect()}
    assert found["a"] == found["same"] != found["other"] and found["none"][0] == 0


def test_media_in_order(spark):
    t = [("t1", "s", None, None, None), ("t2", "s", None, None, None), ("t3", "s", None, None, 7), ("t4", "u", None, None, None), ("t5", "s", "a9", None, None)]
    a = [("a1", "s", "clip 10", None), ("a2", "s", "clip 9", None), ("a3", "s", "x", 7), ("a4", "u", "one", None), ("a5", "u", "two", None)]
    found = resolve.media_mappings(spark.createDataFrame(t, "target_id string, scope string, explicit_ref string, hint string, number int"), spark.createDataFrame(a, "asset_id string, scope string, stem string, number int"), ["scope"], pair_in_order=True).collect()
    assert {r.target_id: (r.asset_id, r.basis, r.state) for r in found} == {
        "t1": ("a2", "position", "applied"), "t2": ("a1", "position", "applied"), "t3": ("a3", "filename", "applied"), "t4": (None, "none", "proposed"), "t5": (None, "explicitRef", "proposed"),
    }


def compared(a, b, near):
    words = lambda t: re.findall(r"[^\W_]+(?:'[^\W\d_]+)?", (t or "").replace("’", "'").lower())
    chosen = lambda t, allowed, pattern: [w for w in words(t) if w in allowed or re.match(pattern, w)]
    runs = lambda t: [re.sub(r"[.!?,;:]+$", "", r.strip()).strip() for r in re.findall(r"[^A-Za-z]+", t or "") if re.search(r"\d", r)]
    if not (a or "").strip():
        return "notChecked"
    if not (b or "").strip():
        return "inconclusive"
    names = (set(re.findall(r"\b[A-Z][a-z]+\b", a)) | set(re.findall(r"\b[A-Z][a-z]+\b", b))) - set(verify.NO_NAMES)
    negated = chosen(a, verify.NEGATION, r"^\w+n't$") != chosen(b, verify.NEGATION, r"^\w+n't$")
    numbers = runs(a) != runs(b) or chosen(a, verify.NUMBER_WORDS, r"^\d+(\.\d+)?$") != chosen(b, verify.NUMBER_WORDS, r"^\d+(\.\d+)?$")
    if negated or numbers or any((n.lower() in words(a)) != (n.lower() in words(b)) for n in names):
        return "conflict"
    alike = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
    return "inconclusive" if words(a) != words(b) or any(alike(words(n), words(b)) >= 0.8 for n in near) else "matched"


def test_transcripts_against_references(spark):
    texts = ["The cat sat, on 3 mats.", "the cat sat on 3 mats", "the cat sat on 4 mats", "the cat didn't sit", "the cat sat", "Anna met Bob today", "anna met bob today", "anna met Rob today", "two cats", "too cats", "", None, "It is never late", "It is ever late", "one’s own", "one's own"]
    rows = [(i, j, a, b, [texts[0]] if (i + j) % 3 == 0 else []) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    found = verify.compare_texts(spark.createDataFrame(rows, "i int, j int, a string, b string, near array<string>"), "a", "b", "near").collect()
    assert {(r.i, r.j): r.state for r in found} == {(i, j): compared(a, b, near) for i, j, a, b, near in rows}


def test_capacity_of_sessions(spark, monkeypatch):
    monkeypatch.setattr(sessions, "MOST_SESSIONS", 3)
    requests = spark.createDataFrame([(i, 1, "exam", None) for i in range(4)], "request_id int, library_id int, mode string, legacy_id int")
    libraries, legacy = spark.createDataFrame([(1, "h")], "library_id int, content_hash string"), spark.createDataFrame([], "legacy_id int, library_id int, mode string")
    held = spark.createDataFrame([(9, None, False)], "session_id int, legacy_id int, finished boolean")
    assert [r.state for r in sessions.create_sessions(requests, libraries, legacy, held).orderBy("request_id").collect()] == ["created", "created", "full", "full"]


def test_rules_of_packages(spark):
    question = "pack string, path string, id string, type string, prompt string, options array<struct<id:string,text:string>>, answer array<string>, slots int, frame string, time_limit int, prepare int, interaction boolean"
    ab = [("A", "a"), ("B", "b")]
    rows = [
        ("p", "q1", "q1", "single_choice", "x", ab, ["B"], None, None, 60, 0, False), ("p", "q2", "q2", "sentence_order", "x", ab, ["B"], 1, "so __ it", None, None, False), ("p", "q3", "q3", "sentence_order", "x", ab, ["A", "B"], 3, "so __ it", None, None, False),
        ("p", "q4", "q4", "single_choice", "x", [], ["any"], None, None, None, None, True), ("p", "q5", "q1", "email", "x", [], None, None, None, 7200, None, False), ("p", "q6", "q6", "fill_blank", "x", [], [" "], None, None, None, 9000, False), ("r", "q7", "q1", "email", "x", [("A", "")], None, None, None, None, None, False),
    ]
    group = spark.createDataFrame([("p", "g1", "g1", "reading", "t", "x", 1), ("p", "g2", "g1", "reading", " ", "x" * 500_001, 0)], "pack string, path string, id string, section string, title string, passage string, n_questions int")
    pack = spark.createDataFrame([("p", 2, "é.1-a", "1", "t" * 301, None, 2, 1001), ("r", 1, "-x", "", "t", None, 101, 1)], "path string, schema_version int, id string, version string, title string, rights string, n_groups int, n_questions int")
    found = packages.package_issues(pack, group, spark.createDataFrame(rows, question)).collect()
    assert {(r.path, r.message) for r in found} == {
        ("q3", "slots differ from the frame"), ("q3", "more slots than options"), ("q3", "order does not fill the slots"), ("q5", "question id twice"), ("q6", "no standard answer"), ("q6", "preparation out of bounds"), ("q7", "option without id or text"),
        ("g2", "group id twice"), ("g2", "title empty"), ("g2", "passage too long"), ("g2", "group without questions"), ("p", "title too long"), ("p", "more than 1000 questions"), ("r", "id empty or with other characters"), ("r", "version empty"), ("r", "not 1 to 100 groups"),
    }
    times = {r.path: r.time_limit for r in packages.default_times(spark.createDataFrame(rows, question)).collect()}
    assert times == {"q1": 60, "q2": 60, "q3": 60, "q4": 60, "q5": 7200, "q6": 60, "q7": 420}
