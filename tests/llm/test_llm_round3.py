"""Periodic runs, tokenizer alignment and chat formatting against brute-force versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, queries
from tessera.llm import periodic_runs as runs
from tessera.llm import token_alignment as align

SCHEMA = "doc_id long, text string"


def odd_columns(df):
    """Columns with names that the operators use inside; they do no harm."""
    return df.withColumns({c: F.lit("x") for c in ("block", "k", "runs", "w", "h", "count", "piece", "spread")})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 ------------------------------------------------------------------------------------------------------------------


def brute_runs(w, least=6, exponent=4):
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(text):
    return [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]


def periodic_texts(seed, n):
    r = random.Random(seed)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "b a a a a a a b", "ab " * 9, "a b " * 4, "a b " * 3 + "a", "x y " * 8, "é\x0bß\r" * 7, "A a " * 8]
    for _ in range(n):
        letters, m = r.choice(["ab", "abc", "abcdefghij", "é ßüö"]), r.randint(1, 120)
        w = [r.choice(letters.replace(" ", "")) for _ in range(m)]
        if r.random() < 0.6:
            a = r.randrange(m)
            p = 1 + (m - a) // r.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(m)]
        out.append(r.choice([" ", "\n", "  "]).join(w))
    # Runs inside runs, runs that meet, and a long text of many.
    out += ["c " + ("a a a a a a a b " * 5), "a b " * 6 + "b c " * 6, "q " + ("x y z " * 3000) + "r", " ".join(f"w{i % 700} v" for i in range(4000)), "z " * 20_000]
    return out + out[3:8]


def test_main_lorentz_finds_every_run():
    r = random.Random(7)
    for _ in range(400):
        docs = [w for text in r.sample(periodic_texts(r.randrange(10**6), 4)[:17], 5) for w in [[x.encode() for x in words(text)]]]
        for w, found in zip(docs, runs.runs_of_documents(docs), strict=True):
            assert found == brute_runs(w)


def test_collisions_of_hashes_change_nothing(monkeypatch):
    """With hashes that all collide, every square is a candidate and every k-gram is repeated."""
    docs = [[x.encode() for x in words(text)][:150] for text in periodic_texts(3, 30)]
    want = [brute_runs(w) for w in docs]
    monkeypatch.setattr(runs, "_mixed", lambda x: (x.astype("uint64") * 0).astype("uint64"))
    assert runs.runs_of_documents(docs) == want


def test_segments_hold_repeated_grams_only():
    docs = [b"a b c d e f g h i j k l m".split(), b"p a b c d e q a b c d e r".split()]
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for x in docs for w in x])
    doc = np.repeat([0, 1], [len(x) for x in docs])
    assert runs.surviving_segments(ids, doc, 5) == [(14, 19), (20, 25)]  # a-e of the first document is no repetition
    assert runs.least_overlap() == 5 and runs.least_overlap(8, 4) == 6
    with pytest.raises(ValueError):
        runs.least_overlap(6, 3)


def test_periodic_runs(spark):
    rows = [(i, t) for i, t in enumerate(periodic_texts(11, 60))] + [(None, "a a a a a a"), (-3, "a a a a a a"), (-3, "a a a a a a")]
    docs = odd_columns(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    found = runs.periodic_runs(docs)
    got = collections.Counter((x.doc_id, x.n_words, tuple(tuple(r) for r in x.runs), x.collapsed) for x in found.collect())
    want = collections.Counter()
    for doc, text in rows:
        r = brute_runs(words(text))
        want[(doc, len(words(text)), tuple(r), brute_collapsed(words(text), r))] += 1
    assert got == want
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    top = {x.doc_id: x.top for x in found.select("doc_id", runs.highest_exponent(F.col("runs")).alias("top")).collect()}
    for doc, text in rows[: len(rows) - 3]:
        r = brute_runs(words(text))
        assert (top[doc] and tuple(top[doc])) == (min(r, key=lambda x: (-x[1] / x[2], x[0], x[2])) if r else None)


def test_planted_runs(spark):
    rows = [(i, t) for i, t in enumerate(periodic_texts(5, 150))] + [(None, "a  b")]
    got = {x.doc_id: x.text for x in runs.with_planted_runs(odd_columns(spark.createDataFrame(rows, SCHEMA))).collect()}
    for doc, text in rows:
        h, w = zlib.crc32(str(doc).encode()), words(text)
        if doc is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        assert got[doc] == text


# 12 ------------------------------------------------------------------------------------------------------------------


def paths():
    return queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES)


def odd_texts(seed, n):
    r = random.Random(seed)
    parts = ["a", "b", "'s", "'ll", "the", "é", "日本", "\n", " ", "  ", "\t", "23", ".", "!?", "<s>", "</s>", "<|endoftext|>", " ", "▁", "　", "\x1c", "\x85", "​", "﻿", "😀", "\r\n", "\x00", "́", "ß", "word", "᠎", " ", " ", "ﬁ", "-"]
    return ["", "a", " a", "\na", "a\n", "\n", " ", "  ", None] + ["".join(r.choice(parts) + r.choice([" ", "\n", ""]) for _ in range(r.randint(1, 14))) for _ in range(n)]


def whole_alignment(text):
    """Tokens of the whole text by both tokenizers, with their byte ranges; None where a text has no tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    a_path, b_path = paths()
    if "tools" not in whole_alignment.__dict__:
        tokenizer = Tokenizer.from_file(a_path)
        tokenizer.encode_special_tokens = True
        whole_alignment.tools = tokenizer, sentencepiece.SentencePieceProcessor(model_file=b_path), {v: k for k, v in tokenizer.get_vocab().items()}
    tokenizer, model, name = whole_alignment.tools
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    data_a = [(i, bytes(byte_of[c] for c in name[i])) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    data_b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
    joined = (" " + text).encode()
    if b"".join(x for _, x in data_a) != joined or b"".join(x for _, x in data_b) != joined:
        return None
    out = []
    for tokens in (data_a, data_b):
        at, placed = 0, []
        for i, x in tokens:
            placed.append((at, at + len(x), i))
            at += len(x)
        out.append(placed)
    return out


def brute_alignment(texts):
    known, counts, rows = [whole_alignment(t) for t in texts], collections.Counter(), []
    links = [[(x[2], y[2]) for x in k[0] for y in k[1] if x[0] < y[1] and y[0] < x[1]] if k else [] for k in known]
    for x in links:
        counts.update(x)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for k, x in zip(known, links, strict=True):
        if not k:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({y[1] for y in k[0]} & {y[1] for y in k[1]})
        groups = [[[str(y[2]) for y in side if low < y[1] <= high] for side in k] for low, high in zip([0, *ends], ends, strict=False)]
        text = ";".join(",".join(a) + "|" + ",".join(b) for a, b in groups)
        rows.append((len(k[0]), len(k[1]), len(groups), len(x), sum(counts[y] == best[y[1]] for y in x), sum(counts[y] for y in x), text))
    return rows


def test_components_are_smallest_groups():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 30)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 30))]
        want = list(range(n))
        for _ in range(n):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        u, v = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
        assert align.components(n, u, v).tolist() == want


def test_cuts_are_aligned_as_whole_texts_are():
    aligner = align._Aligner(*paths())
    texts = odd_texts(2, 1500)
    found = aligner.codes(texts)
    sizes = np.concatenate(aligner.sizes)
    for text, codes in zip(texts, found, strict=True):
        whole = whole_alignment(text)
        assert (codes is None) == (whole is None), repr(text)
        if whole:
            assert sizes[codes, :2].sum(axis=0).tolist() == [len(whole[0]), len(whole[1])], repr(text)


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(align, "CACHE_ENTRIES", 50)
    texts = odd_texts(9, 150) + ["the word is a word " * 40] * 3 + ["x" * 20_000, "tiontion. Thation " * 300]
    ids = [None, *range(1, len(texts) - 2), 5, 5]  # a row without an id, and one id three times
    docs = odd_columns(spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)).repartition(3)
    got = align.align_tokenizers(docs, *paths(), block_chars=400)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = collections.Counter((i, *row) for i, row in zip(ids, brute_alignment(texts), strict=True))
    assert collections.Counter((x.doc_id, *(x[c] for c in names)) for x in got.collect()) == want
    assert align.align_tokenizers(docs.limit(0), *paths()).collect() == []


def test_alignment_shuffles_no_text(spark):
    docs = spark.createDataFrame([(1, "a b")], SCHEMA)
    plan = align.align_tokenizers(docs, *paths())._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


# 13 ------------------------------------------------------------------------------------------------------------------


def brute_chat(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: t[:3])
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), sha(learned))
    return out


def chats(seed):
    r = random.Random(seed)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\", "<\\s>", "[\\\\INST]", "[", "<", "é", "😀", " ", "\n", "[ROLE]", "[:]", "x", "[/SYS]", "s>", "INST]"]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, "user", None), (None, None, "assistant", "last")]
    for conv in range(60):
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn, r.choice(["system", "user", "assistant", "assistant", "tool", None, "a[:]b", "<s>"]), r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 12)))])))
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(900)]  # one conversation of most rows
    return rows + [(7, 3, "user", "again"), (7, 3, "user", "again")]


CHATS = "conv_id long, turn long, role string, text string"


def test_control_strings_are_escaped_reversibly():
    import pyarrow as pa

    r, t = random.Random(1), chat_format.CHAT
    bits = [*t.marks, "\\", "[", "<", "s>", "INST]", "/", "é", "\n", "]"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 8))) for _ in range(5000)]
    for text, inner in zip(texts, t.escape(pa.array(texts)).to_pylist(), strict=True):
        assert not any(m in inner for m in t.marks) and t.unescape(inner) == text
        # Not across the edge of a mark either.
        assert list(t.turns("<s>" + inner + "</s>[INST]" + inner + "[/INST]")) == [("assistant", text), ("user", text)]
    with pytest.raises(ValueError):
        chat_format.Template(other=("[[", "[:]", "[/ROLE]"))


def test_assembly_places_every_byte():
    import pyarrow as pa

    r = random.Random(2)
    columns = [pa.array(["".join(r.choice(["é", "a", "", "😀"]) for _ in range(r.randint(0, 5))) for _ in range(50)]) for _ in range(3)]
    ends = np.array([1, 5, 6, 20, 50])
    want = ["".join(c[i].as_py() for i in range(a, b) for c in columns) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert chat_format.assemble(columns, ends).to_pylist() == want
    shifted = [c.slice(7) for c in columns]
    assert chat_format.assemble(shifted, np.array([43])).to_pylist() == ["".join(c[i].as_py() for i in range(43) for c in shifted)]


def test_chat_format(spark):
    rows = chats(3)
    given = odd_columns(spark.createDataFrame(rows, CHATS)).repartition(5)
    pieces = chat_format.format_chat(given)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = pieces.collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # The conversation with most rows lies in several tasks.
    assert len({x.piece >> 40 for x in found if x.conv_id == 99}) > 1
    got = {x.conv_id: x for x in chat_format.read_back(pieces).collect()}
    want = brute_chat(rows)
    assert {c: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for c, x in got.items()} == want
    assert sum(len(x.formatted) for x in found) == sum(x.formatted_chars for x in got.values())
    for x in found:
        for low, high in x.loss:
            assert x.formatted[:low].endswith("<s>") and x.formatted[high:].startswith("</s>")
    assert chat_format.read_back(chat_format.format_chat(given.limit(0))).collect() == []


def test_pieces_are_bounded(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chat_format, "PIECE_ROWS", 10)
    monkeypatch.setattr(chat_format, "PIECE_BYTES", 100)
    turns = [(1, "user" if k % 2 else "assistant", "x" * (k % 40)) for k in range(95)] + [(2, "user", "y")]
    rows = pa.table({"conv_id": [t[0] for t in turns], "role": [t[1] for t in turns], "text": [t[2] for t in turns]})
    out = chat_format.format_rows(rows, chat_format.CHAT, 5).to_pylist()
    assert [x["piece"] for x in out] == list(range(5, 5 + len(out))) and max(x["n_turns"] for x in out) <= 10
    assert sum(x["n_turns"] for x in out) == 96 and out[-1]["conv_id"] == 2
    assert [t for x in out for t in chat_format.CHAT.turns(x["formatted"])] == [(r, t) for _, r, t in turns]


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_token_alignment", "op13_chat_format"])
def test_queries(spark, name):
    """The registered queries on the smallest tables, against brute force."""
    sf_dir = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf_dir).collect()
    if name == "op13_chat_format":
        rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        said = "</s>[INST] ok [/INST]"
        want = brute_chat([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
        assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == want
        return
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs)
    if name == "op11_periodic_runs":
        for x in got:
            h, w = zlib.crc32(str(x.doc_id).encode()), words(docs[x.doc_id])
            if h % 10 == 0 and w:
                g, n = h // 10, len(w)
                a = g % n
                w = [w[i] if i < a else w[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
            r = brute_runs(w)
            assert x.n_runs == len(r) and x.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in r)) and x.collapsed_sha256 == sha(brute_collapsed(w, r))
            top = min(r, key=lambda y: (-y[1] / y[2], y[0], y[2])) if r else (None, None, None)
            assert (x.start, x.length, x.period) == top and x.exponent_milli == (1000 * top[1] // top[2] if r else None)
    else:
        ids = sorted(docs)
        few = [i for i in ids if len(docs[i] or "") < 4000]
        known = {x.doc_id: x for x in got}
        if len(few) == len(ids):
            want = dict(zip(ids, brute_alignment([docs[i] for i in ids]), strict=True))
        else:  # whole counts need whole texts; links of long ones are found by walking along both sides
            want = walked({i: docs[i] for i in ids})
        for i in ids:
            row = known[i]
            assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256) == (*want[i][:6], want[i][6] and sha(want[i][6]))


def walked(docs):
    counts, links, heads = collections.Counter(), {}, {}
    for i, text in docs.items():
        sides, links[i], groups = whole_alignment(text), [], []
        if sides:
            a, b = sides
            x = y = 0
            one: list[list[str]] = [[], []]
            while x < len(a):
                links[i].append((a[x][2], b[y][2]))
                end_a, end_b = a[x][1], b[y][1]
                if end_a <= end_b:
                    one[0].append(str(a[x][2]))
                    x += 1
                if end_b <= end_a:
                    one[1].append(str(b[y][2]))
                    y += 1
                if end_a == end_b:
                    groups.append(",".join(one[0]) + "|" + ",".join(one[1]))
                    one = [[], []]
        counts.update(links[i])
        heads[i] = (len(sides[0]), len(sides[1]), len(groups), ";".join(groups)) if sides else (0, 0, 0, "")
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return {i: (*h[:3], len(links[i]), sum(counts[p] == best[p[1]] for p in links[i]), sum(counts[p] for p in links[i]), h[3]) for i, h in heads.items()}


# 3 -------------------------------------------------------------------------------------------------------------------


def test_sets_meet_their_pivots_either_way(spark, monkeypatch):
    """Near copies, and an id that stands twice with one text: the same groups whether pairs are broadcast or shuffled."""
    from tessera.llm import ngram_join

    r = random.Random(8)
    base = [[f"w{r.randrange(400)}" for _ in range(150)] for _ in range(6)]
    rows = []
    for k, text in enumerate(base):
        for j in range(8):
            edited = list(text)
            for i in r.sample(range(150), j % 4):
                edited[i] = f"e{r.randrange(9)}"
            rows.append((100 * k + j, " ".join(edited)))
    rows += [rows[3]] * 5
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = collections.Counter(map(tuple, ngram_join.ngram_jaccard_join(docs).collect()))
    monkeypatch.setattr(ngram_join, "FEW_ROLES", -1)
    assert collections.Counter(map(tuple, ngram_join.ngram_jaccard_join(docs).collect())) == want

    def shingles(t):
        w = t.split(" ")
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[d]] == label[d] for d in label):
            break
    assert {d: c for d, _, c in want} == label and sum(want.values()) == len(rows)
