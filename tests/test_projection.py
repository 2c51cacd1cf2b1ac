"""Projection of pages: evidence, ids, columns, tables, margins; blocks against a plain version on random pages."""

import hashlib
import json
import math
import random

import pytest

from tessera.operators import projection as pr

PAGE = "name string, page int, chunk int, kind string, text string, width double, height double, transform array<double>, rotation int"
ITEM = "name string, page int, chunk int, item_index int, str string, x double, y double, width double, height double, line int, axis array<double>"


def item(text, x, y, width=130.0, height=12.0, line=None, axis=None):
    return (text, float(x), float(y), float(width), float(height), line, axis)


def project(spark, pages, parts=3):
    """pages: (name, page, items, options); items None: the page has text only."""
    heads, rows = [], []
    for chunk, (name, number, items, options) in enumerate(pages):
        o = {"kind": "pdf", "text": "", "width": 600.0, "height": 800.0, "transform": None, "rotation": 0} | options
        heads.append((name, number, chunk, *o.values()))
        rows += [(name, number, chunk, i, *x) for i, x in enumerate(items or [])]
    found = pr.project_layout(spark.createDataFrame(heads, PAGE).repartition(parts), spark.createDataFrame(rows, ITEM).repartition(parts))
    blocks = [r.asDict(True) for r in found.blocks.collect()]
    return blocks, [r.asDict(True) for r in found.ambiguities.collect()], found


def read(blocks, chunk=0):
    return [b["text"] for b in sorted((b for b in blocks if b["chunk"] == chunk and b["place"] is not None), key=lambda b: b["place"])]


def test_columns_and_margins(spark):
    pages = [("a", n, [item(f"Original workbook {n}", 180, 20), item("Right first", 330, 650), item("Right second", 330, 620), item("Left first, of some length", 40, 650), item("Do NOT erase this prompt.", 40, 620)], {}) for n in (1, 2)]
    pages[1][2][0] = item("Original workbook 2", 180, 20)
    blocks, doubts, _ = project(spark, pages)
    for chunk in (0, 1):
        assert read(blocks, chunk) == ["Left first, of some length", "Do NOT erase this prompt.", "Right first", "Right second"]
    footers = [b for b in blocks if b["role"] == "footer"]
    assert len(footers) == 2 and all(b["place"] is None and b["region"] == "footer" for b in footers) and footers[0]["raw_items"] == [0]
    assert {b["region"] for b in blocks if b["role"] == "body"} == {"band-0-column-1", "band-0-column-2"}
    assert not doubts


def test_repetition_alone_drops_nothing(spark):
    blocks, doubts, _ = project(spark, [("a", n, [item("Which door is NOT open?", 40, 775), item("Do not open the red door.", 40, 20)], {}) for n in (1, 2)])
    assert sum(b["place"] is not None for b in blocks) == 4 and [d["code"] for d in doubts] == ["repeated_margin"] * 4
    assert {i for d in doubts for i in d["block_ids"]} == {b["block_id"] for b in blocks}


def test_bands_between_spanning_lines(spark):
    items = [
        item("A heading that spans the whole page", 20, 700, 560), item("left prose before the line", 30, 650, 200), item("right prose before", 330, 650, 200), item("left again, some more", 30, 630, 200), item("right again", 330, 630, 200),
        item("Another line over both columns", 20, 600, 560), item("left below, quite long", 30, 550, 200), item("right below", 330, 550, 200), item("touching the line", 30, 598, 100),
    ]
    blocks, doubts, _ = project(spark, [("a", 1, items, {})])
    # The last run is on the second line's row, so that line stands alone no more and the page is one band after the heading.
    assert read(blocks)[0] == "A heading that spans the whole page"
    two, found, _ = project(spark, [("a", 1, items[:-1], {})])
    assert read(two) == ["A heading that spans the whole page", "left prose before the line", "left again, some more", "right prose before", "right again", "Another line over both columns", "left below, quite long", "right below"]
    # Below are only two blocks, side by side: read as they stand, and said to be doubtful.
    assert [d["code"] for d in found] == ["unresolved_regions"] and len(found[0]["block_ids"]) == 2


def test_tables_keep_their_rows(spark):
    rows = [("Type of Task", "Description"), ("Read a text of some length", "You read"), ("Write a text of some length", "You write"), ("Speak for some time, please", "You speak")]
    items = [item(t, 40 + 300 * c, 700 - 30 * r, 150) for c in (0, 1) for r, row in enumerate(rows) for t in [row[c]]]
    blocks, doubts, found = project(spark, [("a", 1, items, {})])
    assert read(blocks) == [t for row in rows for t in row] and not doubts
    lines = sorted((r.line_no, r.text) for r in pr.projected_lines(found.blocks).collect())
    assert [t for _, t in lines] == [" ".join(row) for row in rows]
    # Without its heads the same page is two columns.
    plain, _, _ = project(spark, [("a", 1, [x for x in items if x[0] not in rows[0]], {})])
    assert read(plain) == [r[0] for r in rows[1:]] + [r[1] for r in rows[1:]]


def test_rows_that_begin_with_a_number_go_on(spark):
    items = [item("1.", 40, 700, 10), item("B", 200, 700, 10), item("To:", 40, 650, 20), item("Ann", 300, 650, 30), item("word", 40, 600, 30), item("far", 300, 600, 30), item("near", 100, 550, 30), item("by", 140, 550, 20)]
    blocks, doubts, found = project(spark, [("a", 1, items, {})])
    assert [r.text for r in pr.projected_lines(found.blocks).orderBy("line_no").collect()] == ["1. B", "To: Ann", "word", "far", "near by"]
    assert sorted(d["code"] for d in doubts) == ["unresolved_regions"] * 2  # the mail row and the last


def test_rotation_ligatures_and_evidence(spark):
    turned = [0.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    blocks, doubts, _ = project(spark, [("a", 1, [item("oﬃce", 30, 700), item("ne _", 30, 670), item("_ the door", 30, 650)], {"transform": turned, "rotation": 90})])
    first = next(b for b in blocks if b["text"] == "oﬃce")
    assert (first["x0"], first["y0"], first["x1"], first["y1"]) == (700.0, 30.0, 712.0, 160.0) and first["raw_items"] == [0]
    assert [d["code"] for d in doubts] == ["rotated_page"] and len(blocks) == 3


def test_pages_without_positions(spark):
    pages = [("a", None, None, {"kind": "docx", "text": "one\r\n\n two \nTranscript: three", "height": None, "width": None}), ("b", 1, [item("x", 1, 1), ("y", None, 1.0, 1.0, 1.0, None, None)], {"text": "from text"}), ("c", 1, None, {"text": None})]
    blocks, doubts, _ = project(spark, pages)
    assert read(blocks, 0) == ["one", " two ", "Transcript: three"] and [b["raw_lines"] for b in sorted((b for b in blocks if b["chunk"] == 0), key=lambda b: b["place"])] == [[1], [3], [4]]
    assert {b["method"] for b in blocks} == {"docx-semantic", "source-text"} and read(blocks, 1) == ["from text"] and not doubts
    assert {b["text"]: b["visibility"] for b in blocks if b["chunk"] == 0} == {"one": "source", " two ": "source", "Transcript: three": "reference"}


def test_reference_pages(spark):
    blocks, _, _ = project(spark, [("a", 1, [item("Answer Key", 40, 700), item("1. B", 40, 600)], {}), ("a", 2, [item("1. B", 40, 600)], {})])
    assert {(b["chunk"], b["text"], b["visibility"]) for b in blocks} == {(0, "Answer Key", "reference"), (0, "1. B", "reference"), (1, "1. B", "source")}


def plain_blocks(name, page, chunk, items, height):
    """Blocks of a page as sets of runs with their text and id, one run after another."""
    rows = []
    boxes = []
    for i, (text, x, y, w, h, line, axis) in enumerate(items):
        a = axis or [1, 0, 0, 1]
        sx, sy = math.hypot(a[0], a[1]) or 1, math.hypot(a[2], a[3]) or 1
        corners = [(x + u * a[0] / sx * w + v * a[2] / sy * h, height - (y + u * a[1] / sx * w + v * a[3] / sy * h)) for u in (0, 1) for v in (0, 1)]
        box = (min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners))
        boxes.append((i, text, box, height - y, line))
        vertical = abs(-a[1]) > abs(a[0])
        row = None if vertical else next((r for r in rows if not r[0] and abs(r[1][0][3] - (height - y)) <= 3), None)
        if row is None:
            rows.append((vertical, [boxes[-1]]))
        else:
            row[1].append(boxes[-1])
    out = []
    for _, runs in rows:
        part = []
        for r in sorted(runs, key=lambda r: (r[2][0], r[0])):
            if part and r[2][0] - part[-1][2][2] > max(24, 2 * (r[2][3] - r[2][1])):
                out.append(part)
                part = []
            part.append(r)
        out.append(part)
    found = set()
    for part in out:
        text, before = "", None
        for r in part:
            gap = math.inf if before is None else r[2][0] - before[2][2]
            touching = text[-1:].isalpha() and r[1][:1].isalpha() and -0.5 <= gap <= 0.5
            if text and r[1] and not text[-1].isspace() and not r[1][0].isspace() and not touching:
                text += " "
            text, before = text + r[1], r
        lines = list(dict.fromkeys(r[4] for r in part if r[4] is not None))
        made = ",".join([json.dumps([name]), str(page), str(chunk), json.dumps([r[0] for r in part], separators=(",", ":")), json.dumps(lines, separators=(",", ":"))])
        found.add(("block-" + hashlib.sha256(made.encode()).hexdigest()[:20], text, tuple(r[0] for r in part), tuple(lines)))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_random_pages(spark, seed):
    r = random.Random(seed)
    pages = []
    for n in range(8):
        items = [
            item(r.choice(["a", "word", "two words", "é", "1", " x", "y "]), r.choice([10, 20.5, 60, 61, 100, 300]), r.choice([100, 101, 103, 105, 300, 302.5]), r.choice([10, 40, 39.8]), r.choice([2, 12]), r.choice([None, 1, 2]), r.choice([None, None, [2.0, 0.0, 0.0, 2.0], [0.0, 1.0, -1.0, 0.0], [0.6, 0.8, -0.8, 0.6]]))
            for _ in range(r.randrange(1, 14))
        ]
        pages.append(("doc", n, items, {}))
    blocks, _, _ = project(spark, pages)
    got = {(b["block_id"], b["text"], tuple(b["raw_items"]), tuple(b["raw_lines"])) for b in blocks}
    assert got == set().union(*(plain_blocks("doc", n, n, items, 800.0) for n, (_, _, items, _) in enumerate(pages)))
    # Each run is in exactly one block, and ids don't hang on partitions.
    runs = sorted((b["chunk"], i) for b in blocks for i in b["raw_items"])
    assert runs == sorted((n, i) for n, p in enumerate(pages) for i in range(len(p[2])))
    again, _, _ = project(spark, pages, parts=1)
    assert {b["block_id"]: (b["place"], b["region"], b["row_id"]) for b in again} == {b["block_id"]: (b["place"], b["region"], b["row_id"]) for b in blocks}


def test_order_of_random_pages():
    """All blocks once; bands from top to bottom; columns whole; in a band without columns no block before one on a row above."""
    r = random.Random(9)
    for _ in range(500):
        blocks = [
            {"block_id": str(i), "text": r.choice(["a line of prose here", "1.", "Answer", "x"]), "x0": (x := r.choice([20.0, 300.0, 310.0, 180.0])), "x1": x + r.choice([40.0, 120.0, 500.0]), "y0": (y := 20.0 * r.randrange(12)), "y1": y + 10, "baseline": y + r.choice([0.0, 2.0]), "source_place": i}
            for i in range(r.randrange(1, 14))
        ]
        found, flags = pr.order_page(blocks, 600.0)
        by = {b["block_id"]: b for b in blocks}
        assert sorted(i for i, *_ in found) == sorted(by)
        bands = {}
        for i, region, row in found:
            bands.setdefault(region, []).append(by[i])
            assert abs(by[row]["baseline"] - by[i]["baseline"]) <= 6
        for region, held in bands.items():
            if region.endswith("column-1"):
                right = bands[region[:-1] + "2"]
                assert len(held) >= 2 and len(right) >= 2 and min(b["x0"] for b in right) - max(b["x1"] for b in held) > 27
            assert all(b["baseline"] - a["baseline"] >= -3 for a, b in zip(held, held[1:], strict=False))
        assert all(len(ids) >= 2 and code in ("unresolved_regions", "overlapping_regions") for code, ids in flags)


def test_nothing(spark):
    blocks, doubts, found = project(spark, [])
    assert blocks == [] and doubts == [] and pr.projected_lines(found.blocks).collect() == []
