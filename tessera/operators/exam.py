"""Exam documents: lines of pages to keys and questions; presentations of tasks; repairs of recognised lines.

Lines have a document, a page, a place in it (line_no) and a text.  Everything is classify, carry forward, fold.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.extract import carry_forward, fold_text
from tessera.operators.match import unique_match

#: Headings, cues and rows of modular exam documents.
SECTION = r"(?i)^(Reading|Listening|Writing|Speaking)\s+Section(?:\s*,\s*Module\s+(\d+))?$"
KEY_HEADING = r"(?i)^Answer Key$"
KEY_LABEL = r"(?i)^(?:Answer Key|Question(?:\s+Number)?(?:\s+Answer)?|Number(?:\s+Answer)?|Answer)$"
KEY_ROW = r"(?s)^(\d+)[.)]?\s+(.+)$"
NUMBERED = r"^(\d+)\.\s+(.+)$"
OPTION = r"^\(([A-Z])\)\s*(.*)$"
FILL = r"(?i)^Fill in the missing letters in the paragraph\.?$"
CUE = r"(?i)^(?:Read (?:a|an) .+|Listen to (?:a|an) .+)\.?$"
TASKS = {"build a sentence": "sentence_order", "write an email": "email", "write for an academic discussion": "discussion", "listen and repeat": "listen_repeat", "take an interview": "interview"}


def _part(text: str | Column, pattern: str, group: int) -> Column:
    """The group of a match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def read_keys(lines: DataFrame, doc: list[str]) -> tuple[DataFrame, DataFrame]:
    """Answers (section, module, number, answer) of answer key pages, and issues of those that can't be placed.

    A page with a line `Answer Key` belongs to its first section heading; reading and listening need a module too.  A row
    begins with a number; other lines go on with the row before; lines before the first row are an issue.
    """
    page = [*doc, "page"]
    whole = Window.partitionBy(*page)
    t = lines.withColumns({"text": F.trim("text")})
    t = t.withColumn("_key", F.max(F.col("text").rlike(KEY_HEADING)).over(whole)).where("_key")
    head = F.when(F.col("text").rlike(SECTION), F.struct("line_no", F.lower(_part("text", SECTION, 1)).alias("section"), _part("text", SECTION, 2).cast("int").alias("module")))
    t = t.withColumn("_head", F.min(head).over(whole))
    section, module = F.col("_head.section"), F.col("_head.module")
    placed = section.isNotNull() & (module.isNotNull() | ~section.isin("reading", "listening"))
    lost = t.where(~F.coalesce(placed, F.lit(False))).groupBy(*page).agg(F.lit("answer page without section or module").alias("message"))
    rows = t.where(placed).where((F.col("text") != "") & ~F.col("text").rlike(SECTION) & ~F.col("text").rlike(KEY_LABEL))
    rows = rows.select(*page, "line_no", "text", section.alias("section"), module.alias("module"))
    is_row = F.col("text").rlike(KEY_ROW)
    rows = carry_forward(rows, page, ["line_no"], {"_row": F.when(is_row, F.col("line_no")), "number": F.when(is_row, _part("text", KEY_ROW, 1).cast("int"))})
    loose = rows.where("_row is null").groupBy(*page).agg(F.lit("lines before the first row").alias("message"))
    value = F.when(F.col("line_no") == F.col("_row"), _part("text", KEY_ROW, 2)).otherwise(F.col("text"))
    keys = fold_text(rows.where("_row is not null").withColumn("value", value), [*page, "section", "module", "_row", "number"], "line_no", "value")
    return keys.select(*doc, "section", "module", "number", F.col("body").alias("answer")), lost.unionByName(loose)


def exam_document(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Questions of modular exam documents: section, module, kind, number, prompt, options, state and answer.

    A document is one if it has two sections, two headings with a module, two task labels and an answer key.  Answer pages
    are left to read_keys; a question begins at a numbered line under a section, its options are lettered lines, and text
    goes on with what stood before.  Answers come from the one key of (section, module, number).
    """
    t = lines.withColumn("text", F.trim("text"))
    text = F.lower("text")
    task = F.when(F.col("text").rlike(FILL), "fill_blank").when(F.col("text").rlike(CUE), "choice")
    for label, kind in TASKS.items():
        task = task.when(text == label, kind)
    is_section, module = F.col("text").rlike(SECTION), _part("text", SECTION, 2)
    section = F.when(is_section, F.lower(_part("text", SECTION, 1)))
    known = t.groupBy(*doc).agg(F.count_distinct(section).alias("s"), F.count(module).alias("m"), F.count(task).alias("t"), F.max(F.col("text").rlike(KEY_HEADING)).alias("k"))
    t = t.join(known.where("s >= 2 and m >= 2 and t >= 2 and k").select(*doc), doc, "left_semi")
    keys, _ = read_keys(t, doc)
    answers = Window.partitionBy(*doc, "page")
    body = t.withColumn("_key", F.max(F.col("text").rlike(KEY_HEADING)).over(answers)).where("not _key and text <> ''")
    place = F.struct("page", "line_no")
    starts = F.col("text").rlike(NUMBERED)
    body = carry_forward(body, doc, ["page", "line_no"], {
        "_head": F.when(is_section, F.struct(section.alias("section"), module.cast("int").alias("module"), place.alias("at"))), "_task": F.when(task.isNotNull() | is_section, F.struct(task.alias("kind"), place.alias("at"))),
    })
    body = carry_forward(body.where("_head is not null"), doc, ["page", "line_no"], {"_question": F.when(is_section | task.isNotNull(), F.struct(F.lit(None).cast("struct<page:int,line_no:int>").alias("at"), F.lit(None).cast("int").alias("number"))).when(starts, F.struct(place.cast("struct<page:int,line_no:int>").alias("at"), _part("text", NUMBERED, 1).cast("int").alias("number")))})
    body = body.where("_question.at is not null")
    is_option = F.col("text").rlike(OPTION)
    body = carry_forward(body, [*doc, "_question"], ["page", "line_no"], {"_option": F.when(is_option, _part("text", OPTION, 1))})
    value = F.when(starts, _part("text", NUMBERED, 2)).when(is_option, F.regexp_extract("text", OPTION, 2)).otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("page", "line_no", value.alias("value"))))
    folded = body.groupBy(*doc, "_head", "_task", "_question", "_option").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    option = F.when(F.col("_option").isNotNull(), F.struct(F.col("_option").alias("id"), F.trim("value").alias("text")))
    q = folded.groupBy(*doc, "_head", "_task", "_question").agg(F.max(F.when(F.col("_option").isNull(), F.col("value"))).alias("prompt"), F.sort_array(F.collect_list(option)).alias("options"))
    kind = F.when(F.col("_task.kind") == "choice", F.when(F.size("options") > 0, "single_choice").otherwise("unsupported")).otherwise(F.coalesce("_task.kind", F.when(F.size("options") > 0, "single_choice").otherwise("unsupported")))
    q = q.select(*doc, F.col("_head.section").alias("section"), F.coalesce("_head.module", F.lit(0)).alias("module"), F.col("_question.at").alias("at"), F.col("_question.number").alias("number"), kind.alias("kind"), "prompt", "options")
    found = unique_match(q, keys.withColumn("module", F.coalesce("module", F.lit(0))), [*doc, "section", "module", "number"], "answer", [*doc, "at"])
    return q.join(found.select(*doc, "at", "state", "answer"), [*doc, "at"]).drop("at")


#: Rows of objective answer sections.
KEY_MODULE = r"(?i)^Module\s+(\d+)$"
KEY_TASK = r"(?i)^(Listen and Choose|Conversation|Announcement|(?:Listen to an )?Academic(?: Talk)?)\s*#\s*(\d+)(\s+Transcript)?$"
KEY_RANGE = r"^(\d+)\s*[-–]\s*(\d+)$"
KEY_CHOICE = r"^(\d+)\s*\.\s*([A-D])(?:\s*,\s*(.*))?$"


def objective_keys(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Entries of answer sections (lines with a section): kind choice, fill or transcript, with the lines below as their body.

    Module headings and task headings end an entry.  A choice is `3. B, label`; a range of numbers in reading opens a fill
    passage; a task heading with `Transcript` opens that task's transcript.  Lines before the first module are left out.
    """
    c = F.col("text")
    is_module, is_task = c.rlike(KEY_MODULE), c.rlike(KEY_TASK)
    fill, choice = c.rlike(KEY_RANGE) & (F.col("section") == "reading"), c.rlike(KEY_CHOICE)
    script = is_task & (_part("text", KEY_TASK, 3).isNotNull())
    name = F.concat(F.regexp_replace(F.lower(_part("text", KEY_TASK, 1)), "^listen to an ", ""), F.lit("#"), _part("text", KEY_TASK, 2))
    by = [*doc, "section"]
    t = carry_forward(lines, by, ["line_no"], {"module": F.when(is_module, _part("text", KEY_MODULE, 1).cast("int"))})
    t = carry_forward(t, by, ["line_no"], {"_task": F.when(is_module, F.struct(F.lit(None).cast("string").alias("name"))).when(is_task, F.struct(name.alias("name")))}).where("module is not null")
    entry = F.struct(
        F.col("line_no").alias("at"), F.when(choice, "choice").when(fill, "fill").when(script, "transcript").alias("kind"), F.when(choice, _part("text", KEY_CHOICE, 1)).when(fill, _part("text", KEY_RANGE, 1)).cast("int").alias("first"),
        F.when(fill, _part("text", KEY_RANGE, 2)).cast("int").alias("last"), F.when(choice, _part("text", KEY_CHOICE, 2)).alias("answer"), F.when(choice, _part("text", KEY_CHOICE, 3)).alias("label"),
    )
    t = carry_forward(t, by, ["line_no"], {"_entry": F.when(is_module | is_task | fill | choice, entry)}).where("_entry.kind is not null")
    parts = F.sort_array(F.collect_list(F.when(F.col("line_no") > F.col("_entry.at"), F.struct("line_no", "text"))))
    out = t.groupBy(*by, "module", F.col("_task.name").alias("task"), "_entry").agg(F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("body"))
    return out.select(*by, "module", "task", *(F.col(f"_entry.{n}").alias(n) for n in ("kind", "first", "last", "answer", "label")), "body")


#: Parts of a question that asks where a sentence fits.
INSERTION = r"(?is)^(.*?sentence best fit\?)\s+(.+?)\s+(\(A\).+)$"


def insertion_places(passage: str | None, marked: str | None) -> list[int] | None:
    """UTF-16 offsets in a passage of the marks (A) to (D) of a paragraph that stands in it exactly once; None otherwise.

    White space of any kind and length counts as one space.  Words are found once; their places in the flat text are running
    sums of their lengths, so a place there is looked up among them.
    """
    parts = re.split(r"\(([ABCD])\)", marked or "")
    if not passage or parts[1::2] != list("ABCD"):
        return None
    spans = [m.span() for m in re.finditer(r"\S+", passage)]
    flat = " ".join(passage[a:b] for a, b in spans)
    starts = list(accumulate((b - a + 1 for a, b in spans), initial=0))[:-1]
    texts = parts[0::2]
    target = " ".join("".join(texts).split())
    found = [m.start() for m in re.finditer(f"(?={re.escape(target)})", flat)]
    if not target or len(found) != 1:
        return None
    out = []
    for k in range(4):
        place = found[0] + len(" ".join("".join(texts[: k + 1]).split()))
        word = bisect_right(starts, place) - 1
        at = min(spans[word][0] + place - starts[word], spans[word][1])
        out.append(len(passage[:at].encode("utf-16-le")) // 2)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _insertions(passages: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([insertion_places(p, m) for p, m in zip(passages, marks, strict=True)], dtype=object)


def insertion_interaction(questions: DataFrame) -> DataFrame:
    """Questions (prompt, passage) that ask where a sentence fits: prompt without the paragraph, sentence, positions, state.

    The paragraph's four marks become UTF-16 offsets in the passage, where it must stand exactly once; state is insertion,
    refused where a part or its one place is missing, and null for other questions.
    """
    asks = F.col("prompt").rlike(r"(?is)four locations.+sentence best fit\?")
    parts = questions.withColumn("_is", asks).withColumn("_marked", F.when(asks, _part("prompt", INSERTION, 3)))
    parts = parts.withColumn("positions", _insertions("passage", "_marked"))
    found = F.col("positions").isNotNull()
    sentence = F.trim(_part("prompt", INSERTION, 2))
    state = F.when(~F.col("_is"), F.lit(None)).when(found, "insertion").otherwise("refused")
    prompt = F.when(found, F.concat(_part("prompt", INSERTION, 1), F.lit("\n\n"), sentence)).otherwise(F.col("prompt"))
    return parts.withColumns({"state": state, "sentence": F.when(found, sentence), "shown": prompt}).drop("_is", "_marked", "prompt").withColumnRenamed("shown", "prompt")


def reading_document(passage: Column, academic: Column) -> Column:
    """struct(kind, rows, title, body) of a reading passage; null where it is blank.

    A first line `Read a ...` names the kind and goes.  An email's header lines become rows; otherwise a first line of up
    to 180 characters that ends no sentence is the title.
    """
    lines = F.split(passage, "\n", -1)
    cued = F.get(lines, 0).rlike(r"(?i)^Read (?:a|an)\b")
    cue = F.when(cued, F.get(lines, 0)).otherwise("")
    rest = F.when(cued, F.slice(lines, 2, F.size(lines))).otherwise(lines)
    kind = F.when(academic, "academic").when(cue.rlike("(?i)email"), "email").when(cue.rlike("(?i)social media"), "social_post").when(cue.rlike("(?i)notice"), "notice").otherwise("plain")
    field = r"(?i)^(To|From|Date|Subject):\s*(.*)$"
    # Header lines end at the first line that is none.
    n = F.aggregate(rest, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda a, x: F.struct((a["on"] & x.rlike(field)).alias("on"), (a["n"] + (a["on"] & x.rlike(field)).cast("int")).alias("n")), lambda a: a["n"])
    n = F.when(kind == "email", n).otherwise(0)
    rows = F.transform(F.slice(rest, 1, n), lambda x: F.struct(F.regexp_extract(x, field, 1).alias("name"), F.regexp_extract(x, field, 2).alias("value")))
    after = F.slice(rest, n + 1, F.size(rest))
    first = F.coalesce(F.get(after, 0), F.lit(""))
    titled = (n == 0) & (first != "") & (F.length(first) <= 180) & ~first.rlike("[.!?]$")
    body = F.trim(F.array_join(F.when(titled, F.slice(after, 2, F.size(after))).otherwise(after), "\n"))
    found = F.struct(kind.alias("kind"), rows.alias("rows"), F.when(titled, first).otherwise("").alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    return F.when(F.coalesce(passage.rlike(r"\S"), F.lit(False)), found)


def email_presentation(prompt: Column) -> Column:
    """struct(to, subject, instructions, body) of an email task; null without a recipient or a subject."""
    to, subject = (_part(prompt, rf"(?im)^{name}:[ \t]*(\S.*)$", 1) for name in ("To", "Subject"))
    before = F.regexp_replace(F.get(F.split(prompt, r"(?im)^Your Response:[ \t]*$"), 0), r"^\s+|\s+$", "")
    head = r"(?is)^((?:.*?\n)?You will have\s+\d+\s+minutes?\s+to\s+write[^\n]*)(?:\n(.*))?$"
    timed = before.rlike(head)
    body = F.regexp_replace(F.when(timed, F.regexp_extract(before, head, 2)).otherwise(before), r"^\s+|\s+$", "")
    return F.when(to.isNotNull() & subject.isNotNull(), F.struct(to.alias("to"), subject.alias("subject"), F.when(timed, F.regexp_extract(before, head, 1)).otherwise("").alias("instructions"), body.alias("body")))


def document_timing(kind: Column, text: Column) -> Column:
    """struct(scope, duration_seconds, prepare_seconds, basis): what the printed text of a task says of its time."""
    minutes = _part(text, r"(?i)You will have\s+(\d{1,6})\s+minutes?\s+to\s+write", 1).cast("int")
    none = F.lit(None).cast("int")
    written, spoken = kind.isin("write_email", "academic_discussion"), kind.isin("listen_repeat", "interview")
    zero = spoken & text.rlike(r"(?i)No time for preparation will be provided\.")
    seconds = F.when(written & (minutes > 0), minutes * 60)
    scope = F.when(written | (kind == "build_sentence"), "task").when(spoken, "question").otherwise("inherit_module")
    basis = F.when(seconds.isNotNull() | zero, "document").otherwise("unknown")
    return F.struct(scope.alias("scope"), F.when(seconds <= 7200, seconds).alias("duration_seconds"), F.when(zero, 0).otherwise(none).alias("prepare_seconds"), basis.alias("basis"))


def instruction_prefix(kind: Column, passage: Column, prompt: Column) -> Column:
    """The printed instruction of a task: first line of its prompt, its whole passage, or a cue that opens the passage."""
    first = lambda c: F.get(F.split(F.coalesce(c, F.lit("")), "\n", -1), 0)
    cue = F.when(first(passage).rlike(r"(?i)^(?:Read (?:a|an)|Listen to (?:a|an)|Choose the best response)\b"), first(passage)).otherwise("")
    return F.when(kind.isin("complete_words", "write_email", "academic_discussion"), first(prompt)).when(kind.isin("build_sentence", "listen_repeat", "interview"), F.coalesce(passage, F.lit(""))).otherwise(cue)


#: Words that a scan glues together, where they count (any, first of a line, first before `words`), and their two parts.
GLUED = (
    (r"(?i)^(Questions?|Passage|Item|Set|Part|Module|Task|Section)(\d{1,3}(?:[-–]\d{1,3})?[.:]?)$", "any", ""), (r"^(\d{1,3})[.)]([A-Ea-e08]|Cc|cc)$", "any", "."), (r"^(\d{1,3}\.)(\d{1,2})$", "counted", ""),
    (r"(?i)^(\d{1,2})(words?)$", "any", ""), (r"^\(?([A-E])[.)]([A-Za-z'\"‘“].*)$", "first", "."),
)
#: A blank written with long dashes; a blank by itself; where a blank ends and where it goes on.
DASHED = r"^(?=.*[A-Za-z]|[-—–]+$)[A-Za-z]*[-_]*[—–][-—–_]*[,.;:!?]?$"
SLOT, ENDS, GOES_ON = r"^_{3,}[,.;:!?]?$", r"(?<=_|_[,.;:!?])(?=[A-Za-z])", r"(?<=[A-Za-z_]) (?=_+[,.;:!?]?(?:[ \x01]|$))"


def repair_words(words: Column, near: Column | None = None) -> Column:
    """Words of a recognised line: glued labels, keys, counts and first options parted, dashes made blanks, blanks joined.

    Long dashes in a blank stand for two hyphens, short ones for one; a blank ends where letters go on; a piece of a blank
    belongs to the blank or word before it, unless the line is a frame of separate slots.  near: for each word, whether its
    box stands close to that of the word before; pieces of blanks that are far apart stay words of their own.
    """
    first_count = F.coalesce(F.get(words, 1).rlike("(?i)^words?$"), F.lit(False))

    def parted(w: Column, i: Column) -> Column:
        """The word with a space between its parts."""
        out = w
        for pattern, where, mark in reversed(GLUED):
            counts = w.rlike(pattern) & {"any": F.lit(True), "first": i == 0, "counted": (i == 0) & first_count}[where]
            out = F.when(counts, F.regexp_replace(w, pattern, f"$1{mark} $2")).otherwise(out)
        blank = F.when(w.rlike(DASHED), F.replace(F.replace(w, F.lit("—"), F.lit("--")), F.lit("–"), F.lit("-"))).otherwise(out)
        return F.regexp_replace(F.when(out == w, blank).otherwise(out), ENDS, " ")

    # Words that are far from the one before are set off by another character than a space.
    pieces = F.transform(words, parted)
    count = F.size(F.split(F.array_join(pieces, " "), " "))
    slots = F.size(F.filter(F.split(F.array_join(pieces, " "), " "), lambda w: w.rlike(SLOT)))
    line = F.array_join(pieces, " ") if near is None else F.array_join(F.transform(pieces, lambda w, i: F.concat(F.when(i == 0, "").when(F.coalesce(F.get(near, i), F.lit(False)), " ").otherwise("\x01"), w)), "")
    joined = F.when((slots >= 2) & (slots >= 0.4 * count), line).otherwise(F.regexp_replace(line, GOES_ON, ""))
    return F.split(joined, "[ \x01]", -1)


def ocr_runs(words: DataFrame, line: list[str], scale: Column, height: Column) -> DataFrame:
    """Runs of recognised words in points: a line is cut where the gap exceeds max(24 points, twice the word's height).

    Words (x0, y0, x1, y1 in pixels from the top, text, confidence) become runs with x and y (from the bottom), width,
    height, the lowest confidence and the words below 60.
    """
    w = Window.partitionBy(*line).orderBy("x0", "x1", "text")
    gap = F.col("x0") - F.lag("x1").over(w)
    wide = F.coalesce(gap > F.greatest(24 * scale, 2 * (F.col("y1") - F.col("y0"))), F.lit(False))
    t = words.withColumn("_wide", wide.cast("int")).withColumn("run", F.sum("_wide").over(w))
    unsure = F.count_if((F.col("confidence") < 60) & F.col("text").rlike("[A-Za-z0-9]"))
    parts = F.sort_array(F.collect_list(F.struct("x0", "x1", "text")))
    out = t.groupBy(*line, "run", scale.alias("_scale"), height.alias("_height")).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("_x0"), F.max("x1").alias("_x1"), F.min("y0").alias("_y0"), F.max("y1").alias("_y1"), F.min(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), unsure.alias("low_confidence")
    )
    s = F.col("_scale")
    return out.select(*line, "run", "text", (F.col("_x0") / s).alias("x"), (F.col("_height") - F.col("_y1") / s).alias("y"), ((F.col("_x1") - F.col("_x0")) / s).alias("width"), ((F.col("_y1") - F.col("_y0")) / s).alias("height"), "confidence", "low_confidence")


def discussion_posts(lines: DataFrame, page: list[str], most_leading: float = 35.0) -> DataFrame:
    """Prompt and two posts of a discussion page: lines (x, y, text) from the top, indented by 24 where the posts begin.

    The prompt stands at one left edge and the posts at another (within 3).  The posts part where the gap exceeds 1.55
    times the upper median of gaps.  Pages of any other form give no row: nothing is guessed.
    """
    down = Window.partitionBy(*page).orderBy(F.desc("y"), "x")
    whole = Window.partitionBy(*page)
    t = lines.withColumn("_n", F.row_number().over(down)).withColumn("_left", F.min(F.struct("_n", "x")).over(whole)["x"])
    t = t.withColumn("_start", F.min(F.when(F.col("x") - F.col("_left") >= 24, F.col("_n"))).over(whole)).where("_start is not null")
    t = t.withColumn("_post", F.col("_n") >= F.col("_start")).withColumn("_edge", F.first("x").over(Window.partitionBy(*page, "_post").orderBy("_n")))
    t = t.withColumn("_straight", F.min(F.abs(F.col("x") - F.col("_edge")) <= 3).over(whole))
    gap = F.when(F.col("_post"), F.lag("y").over(Window.partitionBy(*page, "_post").orderBy("_n")) - F.col("y"))
    t = t.withColumn("_gap", gap).withColumn("_gaps", F.sort_array(F.collect_list(F.when(F.col("_gap") > 0, F.col("_gap"))).over(whole)))
    t = t.withColumn("_leading", F.get("_gaps", F.floor(F.size("_gaps") / 2).cast("int")))
    new = (F.col("_gap") > 1.55 * F.col("_leading")).cast("int")
    t = t.withColumn("_k", F.when(F.col("_post"), 1 + F.sum(F.coalesce(new, F.lit(0))).over(Window.partitionBy(*page, "_post").orderBy("_n"))).otherwise(0))
    t = t.where(F.col("_straight") & (F.col("_leading") <= most_leading) & (F.col("_start") > 1))
    parts = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_k") == k, F.struct("_n", "text")))), lambda p: p["text"]), "\n")
    out = t.groupBy(*page).agg(F.max("_k").alias("posts"), F.count("*").alias("lines"), parts(0).alias("prompt"), parts(1).alias("first_post"), parts(2).alias("second_post"))
    return out.where("posts = 2 and lines >= 5").drop("posts", "lines")


def source_marks(chunks: DataFrame) -> DataFrame:
    """Adds location (file, page, paragraph) and the marked text of chunks."""
    shown = F.concat_ws("; ", F.col("name"), F.concat(F.lit("page "), "page"), F.concat(F.lit("paragraph "), "paragraph"))
    return chunks.withColumns({"location": shown, "marked": F.concat(F.lit("[source: "), shown, F.lit("]\n"), F.coalesce("text", F.lit("")))})


def mark_scanned(questions: DataFrame, scanned: DataFrame) -> DataFrame:
    """Questions (name, page) on a scanned page say so."""
    hit = scanned.select("name", "page").distinct().withColumn("_scan", F.lit(True))
    return questions.join(hit, ["name", "page"], "left").withColumn("scanned", F.coalesce("_scan", F.lit(False))).drop("_scan")


#: Kinds of tasks by the letters of their headings, in order of precedence.
BANK_KINDS = {
    "listen_repeat": ("listenandrepeat", "listenrepeat"), "interview": ("takeaninterview", "interviewprompt", "interviewquestion"), "sentence_order": ("buildasentence",), "discussion": ("academicdiscussion",),
    "email": ("writeanemail", "emailprompt"), "complete_words": ("completethewords", "fillinthemissingletters"), "listening": ("chooseabestresponse", "chooseresponse"), "reading": ("readindailylife", "readanacademicpassage"),
}
SECTION_WORDS = ("listening", "reading", "speaking", "writing")
BANK_OPTION = r"^\(?([A-F])[.)]\s+(\S.*)$"
BANK_ITEM = r"(?i)^(?:(?:Question|Item|Example|Prompt)\s+(\d{1,3})\b\s*[.:)]?\s*(.*)|(\d{1,3})[.)]\s+(\S.*))$"
BANK_ANCHOR = r"(?i)^(?:Passage|Recording|Text|Set|Conversation|Lecture|Talk|Announcement)\s+\d{1,3}\s*[:.—–-]\s*(.*)$"
BANK_INLINE = r"(?i)^(?:Correct\s+|Right\s+)?Answers?\s*[:：]\s*\(?([A-F])\)?[.)]?$"
BANK_TABLE = r"(?i)^(?:Answer key|Answers)\s*[:：]\s*((?:\d{1,3}\s*[.):-]?\s*[A-F]\b[\s,;]*)+)$"
BANK_KEY_HEADING = r"^(?:answerkey|answersandexplanations|answers)"
BANK_KEY_ROW = r"^(\d{1,3})\s*[.):]?\s+(\S.*)$"


def bank_kind(text: Column) -> Column:
    """The kind of task that a heading names, by its letters alone; section words count in short headings and as `section` or `part` only."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    short = (F.size(F.split(F.trim(text), r"\s+")) <= 4) | text.rlike(r"(?i)\b(?:section|part)\b")
    out = F.lit(None).cast("string")
    for word in reversed(SECTION_WORDS):
        out = F.when(short & letters.startswith(word), word).otherwise(out)
    for kind, keys in reversed(BANK_KINDS.items()):
        held = F.lit(False)
        for k in keys:
            held = held | F.contains(letters, F.lit(k))
        out = F.when(held, kind).otherwise(out)
    return out


def task_bank(lines: DataFrame, doc: list[str]) -> tuple[DataFrame, DataFrame]:
    """Questions and keys of banks of single tasks, by the features of their lines (line_no counts through a document).

    A heading sets the kind of task; an anchor (`Passage 2: ...`) opens a group, as does a heading.  Items are numbered
    lines, with lettered options below; `Answer: B` below an item is its own answer.  An answer key heading turns lines
    into keys up to the next anchor or heading of a task; a key stands in the block of the groups before it.  One-line
    tables of keys count anywhere.  questions: group, number, kind, type, prompt, options, stated; keys: key_id, block,
    type, number, answer.
    """
    c, order = F.col("text"), ["line_no"]
    t = lines.withColumn("text", F.trim("text")).where("text <> ''")
    item, option, anchor, inline = c.rlike(BANK_ITEM), c.rlike(BANK_OPTION), c.rlike(BANK_ANCHOR), c.rlike(BANK_INLINE)
    heading = c.rlike(r"^[A-Z0-9]") & (F.size(F.split("text", r"\s+")) <= 14) & ~c.rlike(r"[.?!:,;]$") & ~option & ~item & (~c.rlike(r"^[^:：]{1,30}[:：]\s*\S") | c.rlike(r"(?i)^(?:Task|Section|Part)\s*\d+\s*[:：]"))
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    table = c.rlike(BANK_TABLE)
    keys_begin = letters.rlike(BANK_KEY_HEADING) & (heading | c.rlike(r"(?i)^answers?\s*[:：]?$")) & ~table
    kind = F.when(heading & ~keys_begin & ~anchor, bank_kind(c))
    t = t.withColumns({"_table": table, "_keys": keys_begin, "_kind": kind, "_anchor": anchor})
    opens = F.col("_anchor") | F.col("_kind").isNotNull()
    t = carry_forward(t, doc, order, {"kind": F.col("_kind"), "_mode": F.when(F.col("_keys"), True).when(opens, False)})
    w = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("group", F.sum(opens.cast("int")).over(w)).withColumn("_mode", F.coalesce("_mode", F.lit(False)) & ~F.col("_keys"))
    # Keys: rows of a key, with the lines below as their explanation, and tables.
    number = lambda pattern, k=1: F.regexp_extract("text", pattern, k).try_cast("int")
    listed = t.where(F.col("_mode") & c.rlike(BANK_KEY_ROW) & ~F.col("_table")).select(*doc, "line_no", "group", number(BANK_KEY_ROW).alias("number"), F.regexp_extract("text", BANK_KEY_ROW, 2).alias("answer"))
    pairs = F.arrays_zip(*(F.regexp_extract_all(F.regexp_extract("text", BANK_TABLE, 1), F.lit(r"(?i)(\d{1,3})\s*[.):-]?\s*([A-F])\b"), F.lit(k)).alias(n) for k, n in ((1, "n"), (2, "a"))))
    tabled = t.where("_table").select(*doc, "line_no", "group", F.explode(pairs).alias("_p")).select(*doc, "line_no", "group", F.col("_p.n").cast("int").alias("number"), F.upper("_p.a").alias("answer"))
    letter = F.regexp_extract("answer", r"^\(?([A-F])\)?[.)]?$", 1)
    keys = listed.unionByName(tabled).select(*doc, F.struct("line_no", "number").alias("key_id"), (F.col("group") + 1).alias("block"), F.when(letter != "", "single_choice").otherwise("sentence_order").alias("type"), "number", F.when(letter != "", letter).otherwise(F.col("answer")).alias("answer"))
    # Items, outside keys.
    body = t.where(~F.col("_mode") & ~F.col("_keys") & ~F.col("_table") & ~opens)
    head = F.when(item, F.struct("line_no", F.coalesce(number(BANK_ITEM, 1), number(BANK_ITEM, 3)).alias("number")))
    body = carry_forward(body, [*doc, "group"], order, {"_item": head}).where("_item is not null")
    first = F.trim(F.concat(F.coalesce(F.regexp_extract("text", BANK_ITEM, 2), F.lit("")), F.regexp_extract("text", BANK_ITEM, 4)))
    value = F.when(F.col("line_no") == F.col("_item.line_no"), first).otherwise(F.col("text"))
    plain = ~inline & ((F.col("line_no") == F.col("_item.line_no")) | ~option)
    parts = F.sort_array(F.collect_list(F.when(plain & (value != ""), F.struct("line_no", value.alias("value")))))
    options = F.sort_array(F.collect_list(F.when(option & (F.col("line_no") > F.col("_item.line_no")), F.struct("line_no", F.regexp_extract("text", BANK_OPTION, 1).alias("id"), F.regexp_extract("text", BANK_OPTION, 2).alias("text")))))
    stated = F.array_sort(F.collect_set(F.when(inline, F.upper(F.regexp_extract("text", BANK_INLINE, 1)))))
    q = body.groupBy(*doc, "group", "kind", "_item").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("prompt"), F.transform(options, lambda o: F.struct(o["id"].alias("id"), o["text"].alias("text"))).alias("options"), stated.alias("stated"))
    kind_of = F.when(F.size("options") >= 2, "single_choice").when(F.col("kind") == "sentence_order", "sentence_order").otherwise("open")
    return q.select(*doc, F.col("_item.line_no").alias("question_id"), "group", F.col("_item.number").alias("number"), "kind", kind_of.alias("type"), "prompt", "options", "stated"), keys
