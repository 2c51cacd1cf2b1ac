"""Projection of documents: positioned runs to blocks in reading order, with the raw runs that each block stands for.

A block's id is the hash of what it is made of (document, page, its runs' numbers and lines), so it depends on neither the
order of rows nor their partitions, and every run is in exactly one block.  Boxes, rows and segments are columns and
windows over pages; the order of a page's regions is a small fold over its blocks (`order_page`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.staging import checkpointed
from tessera.operators.layout import repeated_margins, row_numbers

#: Baselines that are one row; the least gutter, and how many heights it may also be.
NEAR, GUTTER, HEIGHTS = 3.0, 24.0, 2
#: What marks references, heads a table, heads a column of numbers, opens a header row.
REFERENCE = r"(?i)(?:^|\n)\s*(?:(?:Answer(?:\s+Key|s)?|Explanation|Rationale|Transcript|Hidden\s+Reference|Sample\s+(?:Answer|Response))\s*(?::|$)|(?:答案|参考答案|解析|参考转录)\s*[:：]?)"
REFERENCE_PAGE = r"(?i)^(?:Answer\s+Key|Transcript|参考答案|答案|转录)$"
TABLE = ("type of task", "description")
_NUMBER = re.compile(r"\d+[.)]?")
_COLUMN_HEAD = re.compile(r"(?:\d+[.)]?|Question|Number|Answer)", re.I)
_MAIL_HEAD = re.compile(r"(?:To|From|Date|Subject|Cc|Bcc):", re.I)

ORDER = "ordered array<struct<place: int, region: string, row_id: string>>"
FLAG = "flags array<struct<code: string, block_ids: array<string>>>"


def run_boxes(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items (name, page, chunk, item_index, str, x, y, width, height, line, axis) with x0, y0, x1, y1, baseline, vertical.

    axis is the run's own transform, of which only the direction counts; pages: name, page, chunk, transform, height.  A page
    without a transform is turned upside down.
    """
    t = items.join(pages.select("name", "page", "chunk", F.coalesce("transform", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0), F.coalesce("height", F.lit(0.0)))).alias("_m")), ["name", "page", "chunk"])
    axis = F.coalesce("axis", F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 1.0))))
    a = [axis[k] for k in range(4)]
    m = [F.col("_m")[k] for k in range(6)]
    unit = lambda u, v: F.coalesce(F.nullif(F.sqrt(u * u + v * v), F.lit(0.0)), F.lit(1.0))
    sx, sy = unit(a[0], a[1]), unit(a[2], a[3])
    right, up = (a[0] / sx * F.col("width"), a[1] / sx * F.col("width")), (a[2] / sy * F.col("height"), a[3] / sy * F.col("height"))
    corners = [(F.col("x") + i * right[0] + j * up[0], F.col("y") + i * right[1] + j * up[1]) for i in (0, 1) for j in (0, 1)]
    xs, ys = [m[0] * x + m[2] * y + m[4] for x, y in corners], [m[1] * x + m[3] * y + m[5] for x, y in corners]
    along = (m[0] * a[0] + m[2] * a[1], m[1] * a[0] + m[3] * a[1])
    return t.withColumns({"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys), "baseline": m[1] * F.col("x") + m[3] * F.col("y") + m[5], "vertical": F.abs(along[1]) > F.abs(along[0])}).drop("_m")


def _block_id(indexes: Column, lines: Column) -> Column:
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))
    made = F.concat_ws(",", F.to_json(F.array("name")), F.when(F.col("page") >= 0, F.col("page").cast("string")).otherwise("null"), F.col("chunk").cast("string"), listed(indexes), listed(lines))
    return F.concat(F.lit("block-"), F.substring(F.sha2(made, 256), 1, 20))


def blocks_of_runs(boxes: DataFrame) -> DataFrame:
    """Blocks of positioned pages: runs of one row, in order from left to right, cut where a gutter parts them.

    A row takes all runs whose baseline is within NEAR of its first run; vertical runs are rows of their own.  A gutter is
    wider than max(GUTTER, HEIGHTS times the height of the run after it).
    """
    page = ["name", "page", "chunk"]
    # A page's runs are gathered once, and all that follows stays where they lie.
    runs = F.sort_array(F.collect_list(F.struct("item_index", "str", "line", "x0", "y0", "x1", "y1", "baseline", "vertical")))
    t = boxes.groupBy(*page).agg(runs.alias("runs")).withColumn("rows", row_numbers(F.col("runs"), "baseline", NEAR, lambda r: F.when(r["vertical"], -1 - r["item_index"])))
    t = t.select(*page, F.explode(F.arrays_zip("runs", "rows")).alias("_z")).select(*page, "_z.runs.*", F.col("_z.rows").alias("row"))
    w = Window.partitionBy(*page, "row").orderBy("x0", "item_index")
    gap = F.col("x0") - F.lag("x1").over(w)
    wide = F.coalesce(gap > F.greatest(F.lit(GUTTER), HEIGHTS * (F.col("y1") - F.col("y0"))), F.lit(False))
    t = t.withColumns({"_gap": gap, "_cut": wide.cast("int")}).withColumn("cell", F.sum("_cut").over(w)).withColumn("_place", F.row_number().over(w))
    runs = F.sort_array(F.collect_list(F.struct("_place", "str", "_gap", "item_index", "line", "baseline")))
    b = t.groupBy(*page, "row", "cell").agg(runs.alias("_r"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))

    def joined(text: Column, r: Column) -> Column:
        touching = text.rlike(r"\p{L}$") & r["str"].rlike(r"^\p{L}") & r["_gap"].between(-0.5, 0.5)
        apart = (text != "") & (r["str"] != "") & ~text.rlike(r"\s$") & ~r["str"].rlike(r"^\s") & ~F.coalesce(touching, F.lit(False))
        return F.concat(text, F.when(apart, " ").otherwise(""), r["str"])

    of = lambda name: F.transform("_r", lambda r: r[name])
    # Runs of another segment are no neighbours.
    first = F.transform("_r", lambda r, i: F.struct(r["str"].alias("str"), F.when(i > 0, r["_gap"]).alias("_gap")))
    b = b.withColumns({"text": F.aggregate(first, F.lit(""), joined), "raw_items": of("item_index"), "raw_lines": F.array_distinct(F.array_compact(of("line"))), "baseline": F.get(of("baseline"), F.lit(0))})
    return b.select(*page, _block_id(F.col("raw_items"), F.col("raw_lines")).alias("block_id"), "text", "x0", "y0", "x1", "y1", "baseline", "raw_items", "raw_lines", F.array_min("raw_items").alias("source_place"), F.lit("text-layer").alias("method"))


def blocks_of_text(pages: DataFrame) -> DataFrame:
    """Blocks of pages without positions: the lines of their text that are not blank."""
    none = lambda kind: F.lit(None).cast(kind)
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n", -1)
    t = pages.select("name", "page", "chunk", "kind", F.posexplode(lines).alias("i", "text")).where(F.col("text").rlike(r"(?U)\S"))
    raw = F.array((F.col("i") + 1).cast("int"))
    empty = F.array().cast("array<int>")
    method = F.when(F.col("kind") == "docx", "docx-semantic").otherwise("source-text")
    return t.select("name", "page", "chunk", _block_id(empty, raw).alias("block_id"), "text", *(none("double").alias(c) for c in ("x0", "y0", "x1", "y1", "baseline")), empty.alias("raw_items"), raw.alias("raw_lines"), F.col("i").alias("source_place"), method.alias("method"))


def _by_row(blocks: list[dict]) -> list[dict]:
    """Blocks from top to bottom and, of those whose baselines are one row with the block above, from left to right."""
    rows: list[list[dict]] = []
    for b in sorted(blocks, key=lambda b: (b["baseline"], b["x0"], b["source_place"])):
        if rows and b["baseline"] - rows[-1][0]["baseline"] <= NEAR:
            rows[-1].append(b)
        else:
            rows.append([b])
    return [b for row in rows for b in sorted(row, key=lambda b: (b["x0"], b["source_place"]))]


def _columns(blocks: list[dict], width: float) -> list[list[dict]] | None:
    """Left and right side of the widest gutter: two blocks or more on each, and prose, not only numbers, on the left."""
    by_x, edge, best, found = sorted(blocks, key=lambda b: (b["x0"], b["source_place"])), float("-inf"), max(GUTTER, 0.045 * width), None
    prose = only_numbers = None
    for i, b in enumerate(by_x):
        if 2 <= i <= len(by_x) - 2 and b["x0"] - edge > best and prose and not only_numbers:
            best, found = b["x0"] - edge, i
        edge = max(edge, b["x1"])
        text = b["text"].strip()
        prose = bool(prose) or len(text) > 15
        only_numbers = (only_numbers is None or only_numbers) and bool(_COLUMN_HEAD.fullmatch(text))
    return None if found is None else [by_x[:found], by_x[found:]]


def order_page(blocks: list[dict], width: float | None) -> tuple[list[tuple[str, str, str]], list[tuple[str, list[str]]]]:
    """(block_id, region, row_id) of a page's blocks in reading order, and (code, block_ids) of what is doubtful.

    A block that takes more than 60 % of the width and stands alone on its baseline spans the page and ends a band.  A band
    with a table keeps its rows; any other is split at its widest gutter, or read by rows where it has none.
    """
    width = width or max((b["x1"] for b in blocks), default=0.0)
    near = lambda a, b: abs(a["baseline"] - b["baseline"]) <= NEAR
    lines = sorted(b["baseline"] for b in blocks)
    alone = lambda b: sum(1 for x in lines if abs(x - b["baseline"]) <= NEAR) == 1
    spans = _by_row([b for b in blocks if b["x1"] - b["x0"] > 0.6 * width and alone(b)])
    head = next((b for b in blocks if b["text"].strip().lower() == TABLE[0] and any(o["text"].strip().lower() == TABLE[1] and near(o, b) for o in blocks)), None)
    table: set[str] = set()
    if head:
        end = next((s["baseline"] for s in spans if s["baseline"] > head["baseline"]), float("inf"))
        table = {b["block_id"] for b in blocks if head["baseline"] - NEAR <= b["baseline"] < end}
    out: list[tuple[dict, str]] = []
    flags: list[tuple[str, list[str]]] = []
    wide = {s["block_id"] for s in spans}
    rest, band = [b for b in blocks if b["block_id"] not in wide], 0

    def put(held: list[dict]) -> None:
        nonlocal band
        name, band = f"band-{band}", band + 1
        tabular = any(b["block_id"] in table for b in held)
        sides = None if tabular else _columns(held, width)
        if sides:
            out.extend((b, f"{name}-column-{k}") for k, side in enumerate(sides, 1) for b in _by_row(side))
            return
        rows = _by_row(held)
        out.extend((b, name) for b in rows)
        for a, b in zip(rows, rows[1:], strict=False):
            keyed = re.fullmatch("(?i)Question|Number", a["text"].strip()) and re.fullmatch("(?i)Answer", b["text"].strip())
            if not tabular and near(a, b) and b["x0"] - a["x1"] > max(GUTTER, HEIGHTS * (b["y1"] - b["y0"])) and not _NUMBER.fullmatch(a["text"].strip()) and not keyed:
                flags.append(("unresolved_regions", [a["block_id"], b["block_id"]]))

    for s in spans:
        put([b for b in rest if b["baseline"] < s["baseline"] - NEAR])
        rest = [b for b in rest if b["baseline"] >= s["baseline"] - NEAR]
        out.append((s, f"spanning-{band}"))
        band += 1
        over = [b["block_id"] for b in rest if near(b, s)]
        if over:
            flags.append(("overlapping_regions", [s["block_id"], *over]))
    put(rest)
    return _in_rows(out, table), flags


def _in_rows(ordered: list[tuple[dict, str]], table: set[str]) -> list[tuple[str, str, str]]:
    """Blocks in order with the first block of their row: neighbours of one region and baseline, unless a gutter parts them.

    Rows that begin with a number or a mail header, and rows of a table, go on over gutters.
    """
    out: list[tuple[str, str, str]] = []
    first = before = None
    for b, region in ordered:
        gap = b["x0"] - before[0]["x1"] if before else 0.0
        on = before is not None and region == before[1] and abs(b["baseline"] - before[0]["baseline"]) <= NEAR and gap >= -1
        head = first["text"].strip() if first else ""
        over = on and (gap <= max(GUTTER, HEIGHTS * (b["y1"] - b["y0"])) or _NUMBER.fullmatch(head) or first["block_id"] in table or _MAIL_HEAD.fullmatch(head))
        first = first if over else b
        before = (b, region)
        out.append((b["block_id"], region, first["block_id"]))
    return out


def _order_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each page's blocks what their order is, as an array of equal length; blocks of margins have none."""
    flag = pa.list_(pa.struct([("code", pa.string()), ("block_ids", pa.list_(pa.string()))]))
    names = ("block_id", "text", "x0", "y0", "x1", "y1", "baseline", "source_place")
    for batch in batches:
        held = batch.column("blocks")
        flat, offsets = held.flatten(), held.offsets.to_numpy() - held.offsets[0].as_py()
        boxed, body = flat.field("x0").is_valid().to_numpy(zero_copy_only=False), (c == "body" for c in flat.field("role").to_numpy(zero_copy_only=False))
        rows = [dict(zip(names, r, strict=True)) if b else None for b, *r in zip(body, *(flat.field(n).to_numpy(zero_copy_only=False).tolist() for n in names), strict=True)]
        order: list[tuple] = []
        flags = []
        for at, end, width in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("width").to_pylist(), strict=True):
            blocks = sorted((b for b in rows[at:end] if b), key=lambda b: b["source_place"])
            if boxed[at:end].all():
                found, doubts = order_page(blocks, width)
            else:
                found, doubts = [(b["block_id"], "body", b["block_id"]) for b in blocks], []
            places = {b: (i, r, row) for i, (b, r, row) in enumerate(found)}
            order.extend(places[b["block_id"]] if b else (None, None, None) for b in rows[at:end])
            flags.append([{"code": c, "block_ids": ids} for c, ids in doubts])
        columns = zip(*order, strict=True) if order else [[]] * 3
        ordered = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()), strict=True)], ["place", "region", "row_id"])
        ordered = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ordered)
        yield pa.RecordBatch.from_arrays([*batch.columns, ordered, pa.array(flags, flag)], [*batch.schema.names, "ordered", "flags"])


class Projection(NamedTuple):
    blocks: DataFrame
    ambiguities: DataFrame


def project_layout(pages: DataFrame, items: DataFrame) -> Projection:
    """Blocks of documents in reading order, with their evidence, and what is doubtful.

    pages: name, page, chunk, kind, text, width, height, transform, rotation; items: name, page, chunk, item_index, str, x, y,
    width, height, line, axis.  A page is positioned if all its items have a place and a size; of others the text's lines are
    the blocks.  blocks: block_id, text, box, baseline, role (body, header, footer), region, place (null in margins), row_id,
    visibility, raw_items, raw_lines, method.  ambiguities: code, name, page, block_ids.
    """
    page = ["name", "page", "chunk"]
    # Documents without pages have one that is below zero, so that equal keys join.
    pages, items = (t.withColumn("page", F.coalesce("page", F.lit(-1))) for t in (pages, items))
    finite = lambda c: F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))), F.lit(False))
    placed = finite("x") & finite("y") & finite("width") & finite("height")
    whole = items.groupBy(*page).agg(F.min(placed).alias("positioned")).where("positioned").select(*page)
    boxes = run_boxes(items.withColumn("_placed", F.min(placed).over(Window.partitionBy(*page))).where("_placed").drop("_placed"), pages)
    fields = ["block_id", "text", "x0", "y0", "x1", "y1", "baseline", "raw_items", "raw_lines", "source_place", "method"]
    size = pages.select(*page, F.col("width").cast("double").alias("width"), F.col("height").alias("_height"))
    by_page = lambda blocks: blocks.groupBy(*page).agg(F.collect_list(F.struct(*fields)).alias("blocks")).join(size, page)
    # A row holds a page from here to the end, so that blocks are moved neither to their roles nor to their places.
    positioned = checkpointed(by_page(blocks_of_runs(boxes)))
    sized = positioned.where("_height > 0").select("name", "page", F.col("_height").alias("height"), F.inline("blocks")).where("x0 is not null")
    margin = sized.select("name", "page", F.col("block_id").alias("block"), "text", F.col("y0").alias("y"), "height", F.col("x1").alias("right"), "baseline")
    margins = checkpointed(repeated_margins(margin, ["name"]).select("name", "page", F.col("block").alias("block_id"), "role", "doubt"))
    sure = margins.where("doubt is null").groupBy("name", "page").agg(F.map_from_entries(F.collect_set(F.struct("block_id", "role"))).alias("_roles"))
    role = lambda b: F.coalesce(F.col("_roles")[b["block_id"]], F.lit("body"))
    texts = by_page(blocks_of_text(pages.join(whole, page, "left_anti"))).withColumn("_roles", F.lit(None).cast("map<string, string>"))
    t = positioned.join(sure, ["name", "page"], "left").unionByName(texts)
    t = t.select(*page, "width", F.transform("blocks", lambda b: b.withField("role", role(b))).alias("blocks"))
    t = t.mapInArrow(_order_pages, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema) + f", {ORDER}, {FLAG}")
    key = F.exists("blocks", lambda b: (b["role"] == "body") & F.trim(b["text"]).rlike(REFERENCE_PAGE))
    found = t.select("name", "page", F.explode("flags").alias("f")).select("name", "page", "f.code", "f.block_ids")
    t = t.select(*page, key.alias("_key"), F.explode(F.arrays_zip("blocks", "ordered")).alias("_z")).select(*page, "_key", "_z.blocks.*", "_z.ordered.*")
    t = t.withColumn("region", F.coalesce("region", "role")).withColumn("visibility", F.when(F.col("_key") | F.col("text").rlike(REFERENCE), "reference").otherwise("source")).drop("_key")
    found = found.unionByName(margins.where("doubt is not null").select("name", "page", F.col("doubt").alias("code"), F.array("block_id").alias("block_ids")))
    named = lambda t: t.withColumn("page", F.when(F.col("page") >= 0, F.col("page")))
    turned = pages.join(whole, page, "left_semi").where("rotation <> 0").select("name", "page", F.lit("rotated_page").alias("code"), F.array().cast("array<string>").alias("block_ids"))
    return Projection(named(t), named(found.unionByName(turned)))


def projected_lines(blocks: DataFrame) -> DataFrame:
    """Lines of pages as they are read: name, page, chunk, line_no, text, block_ids, raw_line, x; one for each row of blocks."""
    page = ["name", "page", "chunk"]
    parts = F.sort_array(F.collect_list(F.struct("place", "text", "block_id", "raw_lines", "x0")))
    rows = blocks.where("place is not null").groupBy(*page, "row_id").agg(parts.alias("_p"), F.min("place").alias("_place"))
    text = F.array_join(F.transform("_p", lambda p: p["text"]), " ")
    rows = rows.select(*page, "_place", F.posexplode(F.split(text, "\n", -1)).alias("_k", "text"), F.transform("_p", lambda p: p["block_id"]).alias("block_ids"), F.get(F.get("_p", F.lit(0))["raw_lines"], F.lit(0)).alias("raw_line"), F.round(F.get("_p", F.lit(0))["x0"]).cast("int").alias("x"))
    number = F.row_number().over(Window.partitionBy(*page).orderBy("_place", "_k")) - 1
    return rows.select(*page, number.alias("line_no"), "text", "block_ids", "raw_line", "x")
