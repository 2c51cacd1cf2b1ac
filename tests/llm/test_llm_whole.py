"""Results of the training-data operators that depend on more than one partition, passage, row or token."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, ngram_join, secret_scan, suffix_dedup
from tessera.llm import license_scan as lic
from tessera.llm.line_dedup import KEYS, LineIndex, _emit_keys, line_dedup
from tessera.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# 3 -------------------------------------------------------------------------------------------------------------------


def clusters(seed, n_clusters, size, n_alone, most):
    """Word sequences in clusters of edited copies, and others of their own; all share some words."""
    r = random.Random(seed)
    out = []
    for c in range(n_clusters):
        base = [f"c{c}w{k}" for k in range(r.randrange(30, 60))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randrange(most)):
                words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
            out.append(words)
    out += [[f"a{a}w{k}" for k in range(r.randrange(20, 60))] for a in range(n_alone)]
    return [" ".join([*(f"s{k}" for k in range(6)), *w]) for w in out]


def as_points(texts, label=None):
    sets = [shingle_set(t) for t in texts]
    m = len(texts)
    return sets, ngram_join.Points(np.array([len(x) for x in sets]), np.arange(m) if label is None else label, np.full(m, -1), np.full(m, True), [ngram_join._sketch(x) for x in sets])


@pytest.mark.parametrize("seed", range(4))
def test_cells_within_cells_lose_no_pair(seed):
    texts = clusters(seed, 20, 20, 10, 3)
    sets, points = as_points(texts)
    held = [set(x.tolist()) for x in sets]
    close = {(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])}
    depths = []
    a, b = ngram_join.close_pairs(points, 80, 8, depths)
    found = {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert close and close <= found and max(depths) > 1
    assert len(found) < len(texts) ** 2 / 10


def test_sketch_distance_is_a_metric_below_jaccard():
    sets, points = as_points(clusters(9, 3, 4, 6, 6) + ["x " * 3, "a b c d e f g"])
    every = np.arange(len(sets))
    d = points.distances(every, every)
    held = [set(x.tolist()) for x in sets]
    true = np.array([[1 - len(a & b) / len(a | b) for a in held] for b in held])
    assert (d <= true + 1e-12).all()
    assert (d[:, None, :] <= d[:, :, None] + d[None, :, :] + 1e-12).all()


@pytest.mark.parametrize(("task", "stuck"), [(12, 0.9), (40, 0.9), (12, 0.0)])
def test_large_regions_are_cut_by_spark(spark, monkeypatch, task, stuck):
    """One region of all points: levels of cells, stuck regions in blocks, hot regions and hubs dealt over tasks."""
    for name, value in (("LEAF", 4), ("BLOCK", 16), ("TASK_POINTS", task), ("STUCK", stuck), ("HOT_ROWS", 30)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", 30)
    texts = clusters(5, 8, 8, 6, 3)
    sets, _ = as_points(texts)
    cells = spark.createDataFrame([("k", i, len(x), i, -1, True, bytearray(ngram_join._sketch(x))) for i, x in enumerate(sets)], ngram_join.CELL)
    held = [set(x.tolist()) for x in sets]
    close = {(b, a) for a in range(len(texts)) for b in range(a) if 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])}
    assert close <= {(r.p, r.rep) for r in ngram_join.recursive_join(cells, 80).collect()}


def test_ngram_join_with_hot_regions(spark, monkeypatch):
    for name, value in (("LEAF", 4), ("BLOCK", 8), ("TASK_POINTS", 16), ("HOT_ROWS", 10), ("FREQUENT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    texts = clusters(6, 3, 14, 10, 7) + [None, "", "one two", "one two"]
    texts += texts[:2] * 8
    sets = [set(shingle_set(t).tolist()) for t in texts]
    name, changed = list(range(len(texts))), True
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: (len(sets[i]), name[i]) for i in range(len(texts))}


# 7 -------------------------------------------------------------------------------------------------------------------


def passages(rows, least):
    """(first_doc, kept words) of each document's words that lie in a passage of two documents."""
    where = collections.defaultdict(list)
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - least + 1):
            where[tuple(words[k : k + least])].append((i, k))
    covered, kept = collections.defaultdict(lambda: collections.defaultdict(set)), collections.defaultdict(set)
    for places in where.values():
        first = min(i for i, _ in places)
        if any(i != first for i, _ in places):
            for i, k in places:
                for j in range(k, k + least):
                    covered[i][j].add(first)
                    if i == first:
                        kept[i].add(j)
    return covered, kept


def spans_agree(spark, rows, least, seed):
    found = suffix_dedup.suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least, seed).collect()
    covered, kept = passages(rows, least)
    assert {i: sorted(j for x in found if x.doc_id == i for j in range(x.start_word, x.end_word)) for i in covered} == {i: sorted(c) for i, c in covered.items()}
    got = collections.defaultdict(set)
    for x in found:
        assert x.first_doc == min(f for j in range(x.start_word, x.end_word) for f in covered[x.doc_id][j])
        assert x.keep == bool(x.kept) and all(x.start_word <= p.start_word < p.end_word <= x.end_word for p in x.kept)
        got[x.doc_id] |= {j for p in x.kept for j in range(p.start_word, p.end_word)}
    assert {i: w for i, w in got.items() if w} == dict(kept)
    return {x.doc_id: x for x in found}


@pytest.mark.parametrize("partition_rows", [5, 17, 500_000])
def test_common_passage_over_many_partitions(spark, monkeypatch, partition_rows):
    monkeypatch.setattr(suffix_dedup, "PARTITION_ROWS", partition_rows)
    passage = " ".join(f"p{k}" for k in range(14))
    # Each document holds the passage twice, so that every partition of a run can see two documents.
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(i % 4)) + f" {passage} own{i} {passage}") for i in range(40)]
    found = spans_agree(spark, rows, 12, 5)
    assert [i for i, x in found.items() if x.keep] == [0]


def test_adjoining_passages(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(12)) for c in "xyz")
    found = spans_agree(spark, [(1, f"a {x} b"), (4, f"{x} {y} c {z}"), (9, f"d {y} e"), (10, f"{z} {x} {y} f")], 12, 5)
    assert found[4].keep and not found[9].keep and not found[10].keep


@pytest.mark.parametrize(("least", "seed"), [(6, 3), (8, 4), (5, 5)])
def test_agreement_of_sorted_suffixes(least, seed):
    """Every suffix of small texts, sorted and extended both ways: each passage's smallest document."""
    r = random.Random(least)
    reach = least - seed
    for _ in range(40):
        words = [[r.choice("abcd"[: r.randint(2, 4)]) for _ in range(r.randint(0, 40))] for _ in range(8)]
        places = [(d, p) for d, w in enumerate(words) for p in range(len(w) - seed + 1)]
        if not places:
            continue
        joined = lambda ws: b"".join(x.encode() + b" " for x in ws)
        after = pa.chunked_array([[joined(words[d][p : p + least]) for d, p in places]], pa.binary())
        before = pa.chunked_array([[joined(words[d][max(0, p - reach) : p]) for d, p in places]], pa.binary())
        back, ahead = np.array([min(p, reach) for _, p in places]), np.array([max(0, p - len(words[d]) + least) for d, p in places])
        first = suffix_dedup.common_passages(suffix_dedup._codes(after, least), suffix_dedup._codes(before, reach, True), np.array([d for d, _ in places]), back, ahead)
        where = collections.defaultdict(set)
        for d, w in enumerate(words):
            for k in range(len(w) - least + 1):
                where[tuple(w[k : k + least])].add(d)
        for i, (d, p) in enumerate(places):
            held = [where[tuple(words[d][p - k : p - k + least])] if ahead[i] <= k <= back[i] else set() for k in range(reach + 1)]
            assert first[i].tolist() == [min(h) if len(h) > 1 else -1 for h in held]


@pytest.mark.parametrize("partitions", ["1", "8", "211"])
def test_one_document_keeps_a_common_passage(spark, partitions):
    """However many partitions the equal suffixes of a passage lie in."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(i, f"own{i} a{i} {passage} b{i}") for i in range(1, 800)]
    found = suffix_dedup.suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(found) == 799 and {(x.start_word, x.end_word, x.first_doc) for x in found} == {(2, 52, 1)}
    assert [x.doc_id for x in found if x.keep] == [1]


# 8 -------------------------------------------------------------------------------------------------------------------


def test_runs_are_merged_and_opened_again(spark, tmp_path):
    """Batches in any order, over several levels and two openings, count as one table; common keys are dealt over tasks."""
    folder = f"file://{tmp_path}/index"
    rows = [(doc, f"line number {k} of twenty and more") for doc in range(60) for k in range(12) if (doc * k) % 7 < 3]
    held = collections.defaultdict(set)
    for doc, line in rows:
        held[line].add(doc)
    frame = spark.createDataFrame(rows, "doc_id long, line string").select("doc_id", F.xxhash64("line").alias("h1"), F.hash("line").cast("long").alias("h2"))
    index = LineIndex(spark, folder, 4, fanout=2)
    parts = [(20, 40), (0, 5), (5, 20), (50, 60), (40, 50)]
    for k, (low, high) in enumerate(parts):
        if k == 3:
            index = LineIndex.open(spark, folder, fanout=2)
            assert index.version == 3 and [len(x) for x in index.levels] == [1, 1]
        index.add(frame.where(f"doc_id >= {low} and doc_id < {high}"))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    names = {r.h1: r.line for r in spark.createDataFrame([(x,) for x in held], "line string").select("line", F.xxhash64("line").alias("h1")).collect()}
    assert {names[r.h1]: r.max_doc for r in index.repeated().collect()} == {x: max(d) for x, d in held.items() if len(d) >= 3}


def test_runs_are_not_moved(spark, tmp_path):
    index = LineIndex(spark, f"file://{tmp_path}/index", int(spark.conf.get("spark.sql.shuffle.partitions")), fanout=9)
    for k in range(2):
        index.add(spark.range(5).selectExpr(f"id + {10 * k} as doc_id", "id as h1", "id as h2"))
    join = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = index.repeated()._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", join)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_later_documents_join_the_index(spark, tmp_path):
    line = "a line that many documents hold"
    docs = lambda ids: spark.createDataFrame([(i, f"own {i}\n{line}") for i in ids], "doc_id long, text string")
    assert sum(r.n_dropped for r in line_dedup(docs(range(2)), batches=1).collect()) == 0
    index = LineIndex(spark, f"file://{tmp_path}/lines", 4)
    keys = docs(range(2)).mapInArrow(_emit_keys(20), KEYS)
    index.add(keys)
    got = {r.doc_id: r.n_dropped for r in line_dedup(docs([2, 3]), batches=1, index_dir=f"file://{tmp_path}/lines").collect()}
    assert got == {2: 1, 3: 0}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    big = spark.createDataFrame([(i, None if i % 11 == 0 else 0 if i % 3 else i % 50) for i in range(400)], "i int, k int")
    small = spark.createDataFrame([(k, k * 2) for k in range(0, 50, 2)], "k int, v int")
    rows = lambda df: sorted(map(tuple, df.select("i", "k", "v").collect()), key=str)
    assert rows(common.skew_join(big, small, ["k"], how)) == rows(big.join(small, "k", how))


# 9 -------------------------------------------------------------------------------------------------------------------

LONG = " OR ".join(["MIT"] * 150 + ["(GPL-2.0-only AND BSD-3-Clause)"])


@pytest.mark.parametrize(
    ("after", "expression", "labels", "permissive"),
    [
        ("Apache-2.0 -->", "Apache-2.0", "apache", 0.95), ("Apache-2.0-->", "Apache-2.0", "apache", 0.95), ("MIT</b> or later", "MIT", "mit", 1.0),
        ("MIT. This file is free.", "MIT", "mit", 1.0), ("MIT This file and others", "MIT", "mit", 1.0), ('"MIT OR GPL-2.0+", "x"', 'MIT OR GPL-2.0+', "gpl,mit", 1.0),
        ("(MIT OR GPL-3.0). See LICENSE", "(MIT OR GPL-3.0)", "gpl,mit", 1.0), ("MIT (see LICENSE)", "MIT", "mit", 1.0), ("(MIT) AND 'ISC' */", "(MIT) AND 'ISC'", "isc,mit", 1.0),
        (LONG, LONG, "bsd,gpl,mit", 1.0), (LONG + " and", None, "", None), ("MIT OR\nApache-2.0", None, "", None), ("-->", None, "", None), ("(MIT prose", None, "", None),
    ],
)
def test_expression_after_a_tag(after, expression, labels, permissive):
    found = lic.scan_text(f"<!-- SPDX-License-Identifier: {after}")
    assert (found[5], found[7], found[8]) == (labels, [expression] if expression else [], permissive)


def test_two_tags_on_a_line():
    assert lic.scan_text("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC")[7] == ["MIT", "ISC"]


# 10 ------------------------------------------------------------------------------------------------------------------

SAMPLES = {
    "assign": [f"{w}=abcdefghijklmnop" for k in ("password", "passwd", "secret", "token", "api_key", "apikey") for w in (k, k.upper())],
    "access": ["AKIA" + "A1" * 8], "hex": ["0123456789abcdef"], "github": [f"gh{c}_" + "a1" * 18 for c in "pousr"], "slack": [f"xox{c}-" + "a1" * 5 for c in "abprs"],
    "google": ["AIza" + "a" * 35], "stripe": [f"{c}k_live_" + "a1" * 8 for c in "sr"], "jwt": [".".join(["eyJ" + "a" * 10, "eyJ" + "b" * 10, "c" * 10])],
    "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----"],
}


@pytest.mark.parametrize("rule", [*secret_scan.BASE_RULES, *secret_scan.MORE_RULES], ids=lambda r: r.kind)
def test_matches_meet_a_clause(rule):
    clauses = secret_scan.trigram_query(rule)
    for text in SAMPLES[rule.kind]:
        hit = re.search(rule.pattern, text)[0]
        assert not clauses or any(c <= secret_scan.trigrams(hit) for c in clauses), text


PATTERNS = [
    r"(abc|x+)(def){2}", r"a.*bcde", r"(?:abc)*xyz", r"(abcd)+e?", r"[ab]cde|fghi", r"(?i:Ab[cC]d)-?ef", r"abc(def|ghi)?jkl", r"\bfoo_bar\b|qux{3,5}", r"(a|b)(c|d)(e|f)(g|h)\d+",
    r"x[0-9a-f]{2}yz\.w", "[^a]bcd", r"(?:one|two)[ _](three|four)\s*=", r"ab\dcd", "", r"a?b?c?d",
]


def sample(r, items):
    """A string that the parse tree of a pattern matches."""
    from re import _constants as k

    out = ""
    for kind, value in items:
        if kind is k.LITERAL:
            out += chr(value)
        elif kind is k.ANY:
            out += r.choice("zq9")
        elif kind is k.NOT_LITERAL:
            out += r.choice([c for c in "zqab" if ord(c) != value])
        elif kind is k.IN:
            what, v = r.choice([x for x in value if x[0] is not k.NEGATE])
            out += r.choice("zq") if value[0][0] is k.NEGATE else chr(v) if what is k.LITERAL else chr(r.randint(*v)) if what is k.RANGE else {k.CATEGORY_DIGIT: "7", k.CATEGORY_SPACE: " "}[v]
        elif kind in (k.MAX_REPEAT, k.MIN_REPEAT):
            out += "".join(sample(r, value[2]) for _ in range(r.randint(value[0], min(value[1], value[0] + 2))))
        elif kind is k.SUBPATTERN:
            out += sample(r, value[3])
        elif kind is k.BRANCH:
            out += sample(r, r.choice(value[1]))
        else:
            assert kind is k.AT
    return out


@pytest.mark.parametrize("pattern", [*PATTERNS, *(r.pattern for r in [*secret_scan.BASE_RULES, *secret_scan.MORE_RULES])])
def test_every_match_holds_its_query(pattern):
    from re import _parser

    r = random.Random(1)
    clauses = secret_scan.trigram_query(secret_scan.Rule("x", pattern, 0))
    for _ in range(300):
        text = sample(r, list(_parser.parse(pattern)))
        assert re.search(pattern, text), text
        assert not clauses or any(c <= secret_scan.trigrams(text) for c in clauses), text


def test_queries_are_not_empty():
    ask = lambda p: secret_scan.trigram_query(secret_scan.Rule("x", p, 0))
    assert ask(r"(abc|x+)(def){2}") == [frozenset({"def", "efd", "fde"})]
    assert {frozenset({"abc", "bcd"}), frozenset({"xyz"})} == set(ask(r"abcd|xyz+"))
    assert ask("a.*b") == [] and ask("(") == [] and ask("(?:abc)*") == []


def test_secrets_over_blocks(spark, monkeypatch):
    """Posting lists of several blocks, candidates joined both ways, ids null or repeated, very many matches in one text."""
    monkeypatch.setattr(secret_scan, "BLOCK_BITS", 2)
    many = " ".join(f"token={'a' * (11 + k % 3)}{k}" for k in range(2000))
    rows = [(k if k % 5 else None, f"{'é' * k} secret: {'Q' * (8 + k % 9)} ghp_{'x1' * 18}" if k % 3 else "secre t tok en") for k in range(60)] + [(7, "token=abcdefghijklmnop")] * 3 + [(8, many), (9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    rule = {r.kind: r for r in (*secret_scan.BASE_RULES, *secret_scan.MORE_RULES)}
    exp = collections.Counter()
    for i, t in rows:
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, x) in enumerate(rule.items()) for m in re.finditer(x.pattern, t or "", re.ASCII) if len(m[x.group]) >= x.at_least)
        exp[(i, tuple(spans))] += 1
    for most in (400_000, 0):
        monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", most)
        assert collections.Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in secret_scan.secret_spans(d).collect()) == exp


# pipeline ------------------------------------------------------------------------------------------------------------


@pytest.fixture
def pipeline_docs(spark, tmp_path):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(20 + i % 7))
    rows = [(i, text(i)) for i in range(30)] + [(3, text(3))] * 4 + [(5, None)] * 3 + [(None, text(100)), (None, text(101)), (None, text(2)), (None, None), (None, None)]
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def test_pipeline_rows(spark, pipeline_docs, tmp_path):
    import corpus_pipeline as p

    count = lambda df: collections.Counter((r.doc_id, r.text or "") for r in df.collect())
    n = count(pipeline_docs)
    # Without labels all scores are 0.5, and all rows are good.
    assert count(p.keep_good(spark, pipeline_docs, str(tmp_path))) == n
    assert count(p.drop_lines(spark, pipeline_docs, str(tmp_path))) == n
    once = p.drop_near_copies(spark, pipeline_docs, str(tmp_path))
    assert count(once) == collections.Counter({k: 2 if k == (None, "") else 1 for k in n if k[0] is not None or k[1] not in {t for i, t in n if i is not None and t}})


def test_mix_takes_its_target(spark, pipeline_docs, tmp_path):
    import corpus_pipeline as p

    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    mixed = p.mix(spark, pipeline_docs, str(tmp_path))
    assert words(mixed) == pytest.approx(1.5 * words(pipeline_docs), abs=2)
    assert {r.text for r in mixed.where("doc_id is null").collect()} - {None}
