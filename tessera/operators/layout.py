"""Layout: positioned text to lines, regions and reading order; furniture; repairs of recognised text."""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapsed, digits_masked, has_text
from tessera.operators.exam import bank_kind


def assemble_lines(items: DataFrame, page: list[str]) -> DataFrame:
    """Runs in item order (item_index, str, x, y, width, has_eol) to lines.

    A new line starts where y moves by more than 3 or the run before ended its line; runs are parted by a space unless two
    letters touch within half a unit.
    """
    w = Window.partitionBy(*page).orderBy("item_index")
    before = lambda c: F.lag(c).over(w)
    new = before("y").isNull() | (F.abs(F.col("y") - before("y")) > 3) | F.coalesce(before("has_eol"), F.lit(False))
    touching = (F.abs(F.col("x") - (before("x") + before("width"))) <= 0.5) & before("str").rlike(r"\p{L}$") & F.col("str").rlike(r"^\p{L}")
    glue = F.when(new | F.coalesce(touching, F.lit(False)), "").otherwise(" ")
    flagged = items.withColumn("_new", new.cast("int")).withColumn("_glue", glue).withColumn("line", F.sum("_new").over(w) - 1)
    parts = F.sort_array(F.collect_list(F.struct("item_index", "_glue", "str")))
    lines = flagged.groupBy(*page, "line").agg(parts.alias("_p"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.first("y").alias("y"))
    return lines.select(*page, "line", F.array_join(F.transform("_p", lambda p: F.concat(p["_glue"], p["str"])), "").alias("text"), "x0", "x1")


def bounds(transform: Column, width: Column, height: Column) -> Column:
    """Bounding box of a rectangle under an affine transform [a, b, c, d, e, f]."""
    xs, ys = [], []
    for u, v in ((F.lit(0.0), F.lit(0.0)), (width, F.lit(0.0)), (F.lit(0.0), height), (width, height)):
        xs.append(transform[0] * u + transform[2] * v + transform[4])
        ys.append(transform[1] * u + transform[3] * v + transform[5])
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def row_numbers(blocks: Column, baseline: str, near: float, own: Callable[[Column], Column] | None = None) -> Column:
    """Row of each block of an array: it joins the first row whose baseline (its first block's) is within `near`.

    own: a number for blocks that are rows of their own, null for others.
    """
    start = F.struct(F.array().cast("array<double>").alias("base"), F.array().cast("array<int>").alias("rows"))

    def place(state: Column, block: Column) -> Column:
        apart = own(block) if own else F.lit(None).cast("int")
        met = F.array_position(F.transform(state["base"], lambda b: F.abs(b - block[baseline]) <= near), F.lit(True)).cast("int")
        base = F.when(apart.isNotNull() | (met > 0), state["base"]).otherwise(F.array_append(state["base"], block[baseline]))
        row = F.coalesce(apart, F.when(met > 0, met - 1).otherwise(F.size(state["base"]))).cast("int")
        return F.struct(base.alias("base"), F.array_append(state["rows"], row).alias("rows"))

    return F.aggregate(blocks, start, place, lambda state: state["rows"])


def cluster_rows(blocks: DataFrame, near: float = 3.0) -> DataFrame:
    """Greedy rows of a page: a block joins the first row whose baseline (its first block's) is within `near` (column row).

    A fold over the blocks of one page; pages are small, and many of them share a task.
    """
    page = blocks.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("block", "x0", "y0", "x1", "y1", "text"))).alias("blocks"))
    placed = page.withColumn("rows", row_numbers(F.col("blocks"), "y1", near))
    out = placed.select("doc", "page", F.explode(F.arrays_zip("blocks", "rows")).alias("z"))
    return out.select("doc", "page", "z.blocks.block", F.col("z.rows").alias("row"), *(f"z.blocks.{c}" for c in ("x0", "y0", "x1", "y1", "text")))


def split_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cut rows where the gap between neighbours exceeds max(24, twice the height) (column cell)."""
    w = Window.partitionBy(*by, "row").orderBy("x0")
    gap = F.col("x0") - F.lag("x1").over(w)
    wide = gap > F.greatest(F.lit(24.0), 2 * (F.col("y1") - F.col("y0")))
    return rows.withColumn("_cut", F.coalesce(wide, F.lit(False)).cast("int")).withColumn("cell", F.sum("_cut").over(w)).drop("_cut")


ORDERED = "doc long, page int, block int, place int, band int, col int, flag string"


def _gutter(held: list[dict], width: float) -> float | None:
    """Left edge of the widest gutter that parts a band: two blocks on each side, none across, real prose on the left."""
    lefts, rights = sorted(b["x0"] for b in held), sorted(b["x1"] for b in held)
    prose = min((b["x1"] for b in held if len(b["text"] or "") > 15), default=None)
    best, found = max(24.0, 0.045 * width), None
    for x in dict.fromkeys(rights):
        n_left, first_right = bisect_right(rights, x), bisect_right(lefts, x)
        if n_left == first_right and n_left >= 2 and len(held) - n_left >= 2 and prose is not None and prose <= x and lefts[first_right] - x > best:
            best, found = lefts[first_right] - x, x
    return found


def _overlapping(held: list[dict]) -> bool:
    return any(a["x0"] < b["x1"] and b["x0"] < a["x1"] and a["y0"] < b["y1"] and b["y0"] < a["y1"] for i, a in enumerate(held) for b in held[:i])


def _ordered_page(blocks: list[dict]) -> list[tuple]:
    """(block, place, band, col, flag) of one page's blocks."""
    blocks = sorted(blocks, key=lambda b: (b["y0"], b["x0"], b["block"]))
    width, lines = blocks[0]["width"], sorted(b["y1"] for b in blocks)
    bands: list[tuple[list[dict], bool]] = []
    for b in blocks:
        alone = bisect_right(lines, b["y1"] + 3) - bisect_left(lines, b["y1"] - 3) == 1
        if alone and b["x1"] - b["x0"] > 0.6 * width:
            bands.append(([b], True))
        elif bands and not bands[-1][1]:
            bands[-1][0].append(b)
        else:
            bands.append(([b], False))
    out: list[tuple] = []
    for band, (held, spans) in enumerate(bands):
        gutter = None if spans else _gutter(held, width)
        flag = "overlapping_regions" if not spans and gutter is None and len(held) > 3 and _overlapping(held) else None
        columns = [held] if gutter is None else [[b for b in held if b["x1"] <= gutter], [b for b in held if b["x0"] > gutter]]
        for col, side in enumerate(columns):
            out += [(b["block"], len(out) + k, band, col, flag) for k, b in enumerate(side)]
    return out


def listed_records(held: pa.ListArray) -> Iterator[list[dict]]:
    """The lists of records of an array, read column by column, which takes a fraction of what to_pylist takes."""
    flat, offsets = held.flatten(), (held.offsets.to_numpy() - held.offsets[0].as_py()).tolist()
    names = [f.name for f in flat.type]
    plain = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
    rows = [dict(zip(names, r, strict=True)) for r in zip(*(plain(flat.field(n)) for n in names), strict=True)]
    return (rows[at:end] for at, end in itertools.pairwise(offsets))


def _ordered_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ORDERED.split(", ")]
    types = [pa.int64(), *[pa.int32()] * 5, pa.string()]
    for batch in batches:
        docs, pages, held = batch.columns
        rows = [(doc, page, *r) for doc, page, blocks in zip(docs.to_pylist(), pages.to_pylist(), listed_records(held), strict=True) for r in _ordered_page(blocks)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Place of each block of a page, by bands between spanning blocks and, inside a band, columns at the widest gutter.

    A block is spanning if it takes more than 60 % of the page and stands alone on its baseline.  A band is split where
    the gutter exceeds max(24, 4.5 % of the width) with two blocks on each side and real prose on the left.  One row
    holds the blocks of one page; a batch holds many pages.
    """
    page = blocks.groupBy("doc", "page").agg(F.collect_list(F.struct("block", "x0", "y0", "x1", "y1", "text", "width")).alias("blocks"))
    return page.mapInArrow(_ordered_pages, ORDERED)


#: Margin texts that are headings, page labels, titles and imprints.
MARGIN_HEADING = r"(?i)Section|Module|Question|Read |Listen |Fill in"
PAGE_LABEL = r"(?i)^(?:\d+|Page\s+\d+)$"
TITLE_LABEL = r"(?i)^(?:(?:Original|Practice|Sample|Mock)\s+(?:Workbook|Test)|(?:TOEFL\s+iBT[®™]?\s+)?(?:Teacher Resources\s*[–—-]\s*)?(?:Practice|Sample|Mock)\s+Test)\s+#?\d+(?:\s+\d+)?$"
IMPRINT = r"(?i)^(?:Copyright\s*(?:©\s*)?|©\s*)\d{4}\b.{0,180}$"


def repeated_margins(blocks: DataFrame, doc: list[str], role_top: float = 0.07, role_bottom: float = 0.91, near: int = 12, baseline: float = 3.0) -> DataFrame:
    """Blocks (page, block, text, y, height, right, baseline) that repeat in the margins, with their role or the doubt about it.

    Texts of a header or footer are alike if they are equal once digits are masked; headings don't count.  Of those that
    two pages hold, page labels and titles count as margin only if their number follows the page number on two pages at
    one right edge (a title also if such a bare counter stands on its line), and imprints always.  Others are kept as body,
    as ambiguous: repetition alone is no permission to drop prose.
    """
    role = F.when(F.col("y") < F.col("height") * role_top, "header").when(F.col("y") > F.col("height") * role_bottom, "footer")
    t = blocks.withColumn("margin", role).where("margin is not null").where(~F.col("text").rlike(MARGIN_HEADING))
    t = t.withColumn("pattern", digits_masked(collapsed(F.col("text")))).withColumn("_text", F.trim("text"))
    group = [*doc, "margin", "pattern"]
    often = t.groupBy(*group).agg(F.count_distinct("page").alias("_pages")).where("_pages >= 2")
    t = t.join(often, group)
    number = F.regexp_extract("text", r"(\d{1,9})\s*$", 1).try_cast("long")
    t = t.withColumn("_offset", number - F.col("page"))
    along = Window.partitionBy(*group, "_offset").orderBy("right").rangeBetween(-near, near)
    tracks = F.col("_offset").isNotNull() & (F.min("page").over(along) != F.max("page").over(along))
    t = t.withColumn("_tracks", tracks)
    counters = t.where(F.col("_tracks") & F.col("_text").rlike(r"^\d+$")).select(*doc, "page", F.col("baseline").alias("_line")).distinct()
    titles = t.where(F.col("_text").rlike(TITLE_LABEL)).select(*doc, "page", "block", "baseline").join(counters, [*doc, "page"])
    beside = titles.where(F.abs(F.col("_line") - F.col("baseline")) <= baseline).select(*doc, "page", "block", F.lit(True).alias("_beside")).distinct()
    t = t.join(beside, [*doc, "page", "block"], "left")
    title = F.col("_text").rlike(TITLE_LABEL) & (F.col("_tracks") | F.coalesce("_beside", F.lit(False)))
    label = (F.col("_text").rlike(PAGE_LABEL) & F.col("_tracks")) | title | F.col("_text").rlike(IMPRINT)
    return t.select(*doc, "page", "block", "pattern", F.when(label, F.col("margin")).otherwise("body").alias("role"), F.when(~label, "repeated_margin").alias("doubt"))


def joined_rows(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Neighbours on one baseline and in one region as one line, unless a gutter of 24 parts them."""
    w = Window.partitionBy(*by, "row").orderBy("x0", "text")
    cut = F.coalesce(F.col("x0") - F.lag("x1").over(w) > 24, F.lit(False)).cast("int")
    t = blocks.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(w))
    return t.groupBy(*by, "row", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def reference_visibility(lines: DataFrame, page: list[str], text: str, marker: str = r"(?i)^\s*(answer key|transcript|answers?)\s*:?\s*$") -> DataFrame:
    """Adds visibility: reference on a page whose heading is a marker, else visible."""
    flag = F.max(F.col(text).rlike(marker)).over(Window.partitionBy(*page))
    return lines.withColumn("visibility", F.when(flag, "reference").otherwise("visible"))


#: Lines with a structure of their own, which never are page furniture.
STRUCTURAL = (
    r"^\(?[A-F][.)]\s+\S", r"(?i)^(?:(?:Question|Item|Example|Prompt)\s+\d{1,3}\b|\d{1,3}[.)]\s+\S)", r"(?i)^(?:Passage|Recording|Text|Set|Conversation|Lecture|Talk|Announcement)\s+\d{1,3}\s*[:.—–-]",
    r"(?i)^(?:Play|Listen to|Hear) (?:this|the) (?:recording|audio)\b",
)


def edge_furniture(lines: DataFrame, doc: list[str], page: str, line: str, text: str, pages: int = 3, longest: int = 90) -> DataFrame:
    """Furniture among the first two and last three non-blank lines of a page: what stands so on `pages` pages, digits masked.

    Lines of more than `longest` characters and structural lines, headings of tasks to repeat among them, are none.  Blank lines are no edges.
    """
    t = lines.withColumn("_text", F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))
    filled = F.when(F.col("_text") != "", F.col(line))
    up, down = (Window.partitionBy(*doc, page).orderBy(x) for x in (F.asc_nulls_last("_at"), F.desc_nulls_last("_at")))
    edge = F.col("_at").isNotNull() & ((F.row_number().over(up) <= 2) | (F.row_number().over(down) <= 3))
    structural = F.coalesce(bank_kind(F.col("_text")) == "listen_repeat", F.lit(False))
    for pattern in STRUCTURAL:
        structural = structural | F.col("_text").rlike(pattern)
    t = t.withColumn("_at", filled).withColumn("_edge", edge).withColumn("_mask", digits_masked(F.col("_text")))
    counted = t.where(F.col("_edge") & (F.length("_text") <= longest) & ~structural)
    often = counted.groupBy(*doc, "_mask").agg(F.count_distinct(page).alias("_n")).where(F.col("_n") >= pages).select(*doc, "_mask", F.lit(True).alias("_often"))
    out = t.join(often, [*doc, "_mask"], "left")
    return out.withColumn("furniture", F.col("_edge") & F.coalesce("_often", F.lit(False))).drop("_edge", "_mask", "_often", "_at", "_text")


def last_line_footers(lines: DataFrame, page: list[str], line: str, text: str, pattern: str) -> DataFrame:
    """Empties the last non-blank line of a page where it matches a footer pattern."""
    last = F.max(F.when(F.length(F.trim(text)) > 0, F.col(line))).over(Window.partitionBy(*page))
    hit = (F.col(line) == last) & F.col(text).rlike(pattern)
    return lines.withColumn("footer", F.coalesce(hit, F.lit(False))).withColumn(text, F.when(hit, "").otherwise(F.col(text)))


def group_words(words: DataFrame, page: list[str]) -> DataFrame:
    """Recognised words (line, x0, y0, y1, text) to lines: by their line id, else by the middle's twelfth; x order."""
    group = F.coalesce(F.col("line").cast("long"), F.round((F.col("y0") + F.col("y1")) / 2 / 12).cast("long"))
    t = words.withColumn("group", group).groupBy(*page, "group")
    return t.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("text"), F.min("y0").alias("y0"))


def repair_line(text: Column) -> Column:
    """Spacing of labels and options, long dashes as blanks, blanks torn apart joined again."""
    out = F.regexp_replace(text, r"^\s*\(\s*([A-D])\s*\)\s*", "($1) ")
    out = F.regexp_replace(out, r"^\s*(\d{1,3})\s*[.)]\s*(?=\S)", "$1. ")
    out = F.regexp_replace(out, r"[—–-]{3,}", "____")
    return F.regexp_replace(out, r"_{2,}(?:\s+_{2,})+", "____")


def repair_numbers(labels: DataFrame, by: list[str], order: list[str], number: str) -> DataFrame:
    """Missing numbers of labels in order: the one before the next label's, else the one after the label before.

    A restored number serves the next label; one below 1, or that doesn't follow the label before, is not restored.  In a
    run of missing numbers all but the last therefore count on from the last known one, and the last must meet both ends.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    behind = w.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(w)
    t = labels.withColumn("_place", place)
    known, at = F.last(number, ignorenulls=True).over(behind), F.last(F.when(F.col(number).isNotNull(), F.col("_place")), ignorenulls=True).over(behind)
    counted, after = known + (F.col("_place") - at), F.lead(number).over(w) - 1
    fixed = F.when(after.isNull(), counted).when(counted.isNull() | (counted == after), after)
    fixed = F.when(F.col(number).isNull() & (fixed >= 1), fixed)
    return t.withColumn("_fixed", fixed).withColumn("restored", F.col("_fixed").isNotNull()).withColumn(number, F.coalesce(number, "_fixed")).drop("_fixed", "_place")


def option_context(lines: DataFrame, by: list[str], order: str, explicit: Column, frame: int = 3, least: int = 2) -> DataFrame:
    """Whether a line has `least` explicit options within `frame` lines around it, itself left out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-frame, frame)
    return lines.withColumn("option_like", F.sum(explicit.cast("int")).over(w) - explicit.cast("int") >= least)


def repair_key_rows(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Key rows (number, letter, confidence): a number is fixed where both neighbours agree; unsafe letters are withheld."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, after = F.lag("number").over(w), F.lead("number").over(w)
    fixed = F.when((before + 2 == after) & (F.col("number") != before + 1), before + 1)
    unsafe = (F.col("confidence") < 50) | ~F.col("letter").rlike("^[A-D]$")
    return rows.withColumn("_n", F.coalesce(fixed, F.col("number"))).withColumn("repaired", fixed.isNotNull()).withColumn("letter", F.when(unsafe, "[?]").otherwise(F.col("letter"))).drop("number").withColumnRenamed("_n", "number")


def scale_words(words: DataFrame, ratio: Column) -> DataFrame:
    """Pixels to points, and whether a word is below 60 confidence."""
    return words.withColumns({c: F.col(c) * ratio for c in ("x0", "y0", "x1", "y1")}).withColumn("low_confidence", F.col("confidence") < 60)


def apply_scans(chunks: DataFrame, scans: DataFrame, on: list[str]) -> DataFrame:
    """Pages without text take the scan's."""
    out = chunks.join(scans.withColumnRenamed("text", "_scan"), on, "left")
    blank = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    return out.withColumn("scanned", blank & F.col("_scan").isNotNull()).withColumn("text", F.when(blank, F.coalesce("_scan", "text")).otherwise(F.col("text"))).drop("_scan")


def apply_proofread(lines: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    """Corrected lines: with as many tokens as before the boxes stay, else they are dealt in proportion to lengths."""
    out = lines.join(corrections.withColumnRenamed("text", "_new"), key, "left")
    old_n, new_n = F.size(F.split("text", r"\s+")), F.size(F.split("_new", r"\s+"))
    boxes = F.when(F.col("_new").isNull(), "kept").when(old_n == new_n, "same").otherwise("proportional")
    return out.withColumn("boxes", boxes).withColumn("text", F.coalesce("_new", "text")).drop("_new")


#: Fixed value: the confidence of a word that proofreading has changed.
PROOFREAD = 95


def proofread_words(words: DataFrame, corrections: DataFrame, page: list[str], confidence: float = PROOFREAD) -> DataFrame:
    """Words of recognised lines after proofreading: page, line, word, text, confidence, x0, y0, x1, y1.

    words: page, line, word (from 0, in order), text, confidence, box; corrections: page, line, text.  With as many tokens as
    words each keeps its box, and its confidence where its text is as it was.  Else the line's box is dealt over the tokens by
    their lengths in UTF-16 units with one unit between them, a token's place being the length of those before it.  Lines
    without a correction stay; those corrected to nothing go.
    """
    own = F.sort_array(F.collect_list(F.struct("word", "text", "confidence", "x0", "y0", "x1", "y1")))
    box = {c: (F.min if c.endswith("0") else F.max)(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")}
    t = words.groupBy(*page, "line").agg(own.alias("_own"), *box.values())
    t = t.join(corrections.select(*page, "line", F.coalesce("text", F.lit("")).alias("_new")), [*page, "line"], "left")
    told = F.coalesce("_new", F.array_join(F.transform("_own", lambda w: w["text"]), " "))
    t = t.withColumn("_tokens", F.filter(F.split(collapsed(told), " "), lambda x: x != ""))
    units = lambda x: F.length(F.encode(x, "UTF-16BE")) / 2
    whole = F.array_join("_tokens", " ")
    unit = (F.col("_x1") - F.col("_x0")) / F.greatest(F.lit(1.0), units(whole))
    before = lambda i: F.when(i == 0, 0.0).otherwise(units(F.array_join(F.slice("_tokens", 1, i), " ")) + 1)

    def kept(x: Column, i: Column) -> Column:
        w = F.get("_own", i)
        sure = F.when(w["text"] == x, w["confidence"]).otherwise(F.lit(confidence))
        return F.struct(i.alias("word"), x.alias("text"), sure.cast("double").alias("confidence"), *(w[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))

    def dealt(x: Column, i: Column) -> Column:
        start = F.col("_x0") + before(i) * unit
        return F.struct(i.alias("word"), x.alias("text"), F.lit(confidence).cast("double").alias("confidence"), start.cast("double").alias("x0"), F.col("_y0").cast("double").alias("y0"), (start + units(x) * unit).cast("double").alias("x1"), F.col("_y1").cast("double").alias("y1"))

    new = F.when(F.size("_tokens") == F.size("_own"), F.transform("_tokens", kept)).otherwise(F.transform("_tokens", dealt))
    return t.select(*page, "line", F.explode(new).alias("_w")).select(*page, "line", "_w.*")


def page_lines(lines: DataFrame, page: list[str]) -> DataFrame:
    """Lines (text, x, y, line) of a page from the top, with a blank before a gap of more than 1.55 times the leading.

    The leading is the upper median of gaps above 1, or 14 where there is none.  Lines without text fall away.  A page
    with a line of text that has no y is left alone: all its lines in their order, no blanks.
    """
    whole = Window.partitionBy(*page)
    filled = has_text(F.col("text"))
    placed = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf"))
    t = lines.withColumn("_filled", filled)
    t = t.withColumn("_moved", F.coalesce(F.min(F.when(F.col("_filled"), placed)).over(whole), F.lit(False))).where(~F.col("_moved") | F.col("_filled"))
    order = [F.when(F.col("_moved"), -F.col("y")), F.when(F.col("_moved"), F.col("x")), F.col("line")]
    w = Window.partitionBy(*page).orderBy(*order)
    t = t.withColumn("place", F.row_number().over(w)).withColumn("_gap", F.when(F.col("_moved"), F.lag("y").over(w) - F.col("y")))
    wide = F.sort_array(F.collect_list(F.when(F.col("_gap") > 1, F.col("_gap"))).over(whole))
    leading = F.coalesce(F.get(wide, F.floor(F.size(wide) / 2).cast("int")), F.lit(14.0))
    return t.withColumn("blank_before", F.coalesce(F.col("_gap") > 1.55 * leading, F.lit(False))).drop("_gap", "_moved", "_filled")


def name_to_post(names: DataFrame, posts: DataFrame, page: list[str]) -> DataFrame:
    """The one post of a page whose range of y holds a name."""
    from tessera.operators.resolve import range_match

    return range_match(names, posts, page, "y", "y_low", "y_high", "post", [*page, "name"], 100.0)
