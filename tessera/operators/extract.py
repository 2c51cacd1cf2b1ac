"""Extraction: classify lines, carry the scope forward, fold lines into questions, keys and blanks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.staging import written


def classify(lines: DataFrame, text: str, classes: dict[str, str], default: str = "text") -> DataFrame:
    """Adds class: the first whose pattern fits a line."""
    out = F.lit(default)
    for name, pattern in reversed(classes.items()):
        out = F.when(F.col(text).rlike(pattern), name).otherwise(out)
    return lines.withColumn("class", out)


def carry_forward(lines: DataFrame, by: list[str], order: list[str], scopes: dict[str, Column]) -> DataFrame:
    """Adds one column per scope: its last value that is not null, up to and with the line."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({name: F.last(value, ignorenulls=True).over(w) for name, value in scopes.items()})


def fold_text(lines: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Lines of each scope joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return lines.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias("body"), F.count("*").alias("n_lines"))


#: Classes of worksheet lines.
WORKSHEET = {
    "key_heading": r"(?i)^\s*(answer key|answers?|key)\s*:?\s*$", "key": r"^\s*\d{1,3}\s*[.):\-]?\s*[A-D]\s*(;\s*\d{1,3}\s*[.):\-]?\s*[A-D]\s*)*$", "question": r"^\s*\d{1,3}\s*[.)]\s+\S",
    "option": r"^\s*\(?[A-D][.)]\s+\S", "heading": r"(?i)^\s*(section|part|module|task|questions?)\b.{0,60}$", "directive": r"^@[a-z]+", "blank": r"^\s*$",
}


def worksheet(lines: DataFrame, doc: list[str], order: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, options and keys of worksheet lines: numbers are local to a heading's group."""
    c = classify(lines, text, WORKSHEET)
    number = F.regexp_extract(text, r"^\s*(\d{1,3})", 1).cast("int")
    c = carry_forward(c, doc, [order], {
        "group": F.when(F.col("class") == "heading", F.col(order)), "in_key": F.when(F.col("class") == "key_heading", True).when(F.col("class") == "heading", False), "question": F.when(F.col("class") == "question", F.col(order)),
        "number": F.when(F.col("class") == "question", number),
    })
    in_key, asked = F.coalesce("in_key", F.lit(False)), F.col("question").isNotNull()
    held = F.when(in_key, F.col("class") == "key").otherwise(asked & F.col("class").isin("question", "text", "option"))
    # Lines are classified and carried once: the lines of a question or of a key, a row each, are written and give all three tables.
    lines_of = F.sort_array(F.collect_list(F.struct(order, text, "class"))).alias("_lines")
    units = written(c.where(held).groupBy(*doc, "group", "question", "number", in_key.alias("in_key")).agg(lines_of))
    at = F.col("_l").getField(text)
    body = F.transform(F.filter("_lines", lambda l: l["class"] != "option"), lambda l: l[text])
    inside = units.where("not in_key")
    questions = inside.where(F.size(body) > 0).select(*doc, "group", "question", "number", F.array_join(body, "\n").alias("prompt"), F.size(body).cast("long").alias("n_lines"))
    options = inside.select(*doc, "question", F.explode(F.filter("_lines", lambda l: l["class"] == "option")).alias("_l"))
    options = options.select(*doc, "question", F.regexp_extract(at, r"^\s*\(?([A-D])", 1).alias("label"), F.trim(F.regexp_replace(at, r"^\s*\(?[A-D][.)]\s+", "")).alias("option"))
    keys = key_table(units.where("in_key").select(*doc, "group", F.explode("_lines").alias("_l")).select(*doc, "group", at.alias(text)), [*doc, "group"], text)
    return questions, options, keys


def key_table(lines: DataFrame, by: list[str], text: str) -> DataFrame:
    """`1 B; 2 C` to rows; a line with any part that is no key is refused whole."""
    parts = F.transform(F.split(F.col(text), ";"), lambda p: F.trim(p))
    pattern = r"^(\d{1,3})\s*[.):\-]?\s*([A-D])$"
    t = lines.withColumn("_parts", parts).where(F.forall("_parts", lambda p: p.rlike(pattern)))
    return t.select(*by, F.explode("_parts").alias("_p")).select(*by, F.regexp_extract("_p", pattern, 1).cast("int").alias("number"), F.regexp_extract("_p", pattern, 2).alias("answer"))


def parse_template(lines: DataFrame, doc: list[str], order: str, text: str) -> DataFrame:
    """`@directive: value` lines: each directive with the text up to the next one.

    Directives may be indented, in any case, with or without a colon.  A line that begins with `@@` is text that begins with
    one @; elsewhere signs stay as they are.
    """
    form = r"(?is)^\s*@([a-z]+)\b\s*:?\s*(.*?)\s*$"
    is_one = F.col(text).rlike(form)
    c = carry_forward(lines, doc, [order], {"at": F.when(is_one, F.col(order)), "directive": F.when(is_one, F.lower(F.regexp_extract(text, form, 1)))})
    value = F.when(is_one, F.regexp_extract(text, form, 2)).otherwise(F.regexp_replace(text, r"^(\s*)@@", "$1@"))
    return fold_text(c.where("at is not null").withColumn("value", value), [*doc, "at", "directive"], order, "value")


def arbitrate(results: DataFrame, by: list[str]) -> DataFrame:
    """The parser that wins a document: the most questions less errors, a worksheet on ties (priority)."""
    best = F.max(F.struct((F.col("questions") - F.col("errors")).alias("score"), "priority", "parser")).alias("_b")
    return results.groupBy(*by).agg(best).select(*by, F.col("_b.parser").alias("parser"), F.col("_b.score").alias("score"))


#: Labels of times and the form of a duration.
TIME_LABEL = r"(?i)^\s*(?:(Group|Question)\s+)?(Preparation\s+time|Prep\s+time|Response\s+time|Answer\s+time|Time\s+limit)\s*:\s*(.*)$"
DURATION = r"(?i)^(\d+(?:\.\d+)?)\s*(seconds?|secs?|s|minutes?|mins?|m)\.?$"


def durations(text: Column) -> Column:
    """A text that is one duration, with a unit, as whole seconds from 0 to 7200; null otherwise."""
    n, unit = F.regexp_extract(text, DURATION, 1), F.lower(F.regexp_extract(text, DURATION, 2))
    seconds = F.when(n != "", n.cast("double") * F.when(unit.startswith("m"), 60).otherwise(1))
    return F.when((seconds == F.floor(seconds)) & (seconds <= 7200), seconds.cast("int"))


def labelled_times(text: Column) -> Column:
    """What a line `Response time: 45 seconds` sets: scope (group, question or null), field, seconds; null if it's no such line."""
    label = F.lower(F.regexp_extract(text, TIME_LABEL, 2))
    scope, value = F.lower(F.regexp_extract(text, TIME_LABEL, 1)), F.trim(F.regexp_extract(text, TIME_LABEL, 3))
    field = F.when(label.startswith("prep"), "prepare").otherwise("time")
    return F.when(label != "", F.struct(F.nullif(scope, F.lit("")).alias("scope"), field.alias("field"), durations(value).alias("seconds")))


def source_groups(lines: DataFrame, doc: list[str], order: str, text: str, heading: str, key_heading: str) -> DataFrame:
    """Groups by headings; from a key heading on, to the end of the document, lines are reference."""
    w = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("group", F.sum(F.col(text).rlike(heading).cast("int")).over(w)).withColumn("reference", F.max(F.col(text).rlike(key_heading)).over(w))


def header_fields(text: Column, names: tuple[str, ...] = ("to", "from", "subject", "date")) -> Column:
    """Values of `Name: value` lines."""
    return F.struct(*(F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^{n}:[ \t]*(.+)$", 1)), F.lit("")).alias(n) for n in names))


BLANKS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("prefix_start", T.IntegerType()), T.StructField("missing", T.IntegerType())]))
_BLANK = re.compile(r"(?<![^\W_])([^\W\d_]*)(_(?:[ ]?_)*)(?![^\W_])")


@F.pandas_udf(BLANKS)
def inline_blanks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Gaps of underscores with the letters before them, as code point offsets (end exclusive)."""
    for s in texts:
        yield s.map(lambda t: [] if t is None else [{"start": m.start(2), "end": m.end(2), "prefix_start": m.start(1), "missing": m[2].count("_")} for m in _BLANK.finditer(t)])


def fewest_drops(lengths: list[int], wanted: list[int], most: int = 3) -> list[int] | None:
    """Which gaps to keep so that their lengths differ from the wanted ones at the fewest places; None on a tie.

    A dynamic programme over (gap, question): each gap is kept or dropped, in order.
    """
    extra = len(lengths) - len(wanted)
    if extra == 0:
        return list(range(len(lengths)))
    if not 1 <= extra <= most:
        return None
    best: dict[tuple[int, int], tuple[int, int, list[int]]] = {(0, 0): (0, 1, [])}
    for i in range(len(lengths)):
        for q in range(max(0, i - extra), min(i, len(wanted)) + 1):
            if (i, q) not in best:
                continue
            cost, ways, kept = best[i, q]
            steps = [((i + 1, q), cost, kept)]
            if q < len(wanted):
                steps.append(((i + 1, q + 1), cost + (lengths[i] != wanted[q]), [*kept, i]))
            for to, c, k in steps:
                old = best.get(to)
                if old is None or c < old[0]:
                    best[to] = (c, ways, k)
                elif c == old[0]:
                    best[to] = (c, old[1] + ways, old[2])
    found = best.get((len(lengths), len(wanted)))
    return found[2] if found and found[1] == 1 else None


def tile_sentence(answer: list[str], fragments: list[list[str]]) -> list[int] | None:
    """The one order of fragments whose words make up the answer; None if there is none or more than one."""
    found: list[list[int]] = []

    def walk(at: int, used: tuple[int, ...]) -> None:
        if len(found) > 1:
            return
        if at == len(answer):
            if len(used) == len(fragments):
                found.append(list(used))
            return
        tried = set()
        for k, f in enumerate(fragments):
            if k not in used and f and tuple(f) not in tried and answer[at : at + len(f)] == f:
                tried.add(tuple(f))
                walk(at + len(f), (*used, k))

    walk(0, ())
    return found[0] if len(found) == 1 else None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def tiling(answers: pd.Series, fragments: pd.Series) -> pd.Series:
    """tile_sentence over words, case folded."""
    fold = lambda x: str(x).lower().split()
    return pd.Series([None if a is None or f is None else tile_sentence(fold(a), [fold(x) for x in f]) for a, f in zip(answers, fragments, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def aligned_blanks(lengths: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else fewest_drops([int(x) for x in a], [int(x) for x in b]) for a, b in zip(lengths, wanted, strict=True)])


#: Fixed value: words of letters, or single marks.
TOKEN = r"[A-Za-z]+(?:['’][A-Za-z]+)*|\S"


def gap_words(gapped: Column, full: Column) -> Column:
    """Gaps restored from the full text: passage (with one underscore for each missing letter) and missing.

    Word by word, what differs must be letters that begin the full word, in either case.  Null where anything else
    differs, or nothing does.
    """
    a, b = F.regexp_extract_all(gapped, F.lit(TOKEN), F.lit(0)), F.regexp_extract_all(full, F.lit(TOKEN), F.lit(0))
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"), F.slice(F.split(gapped, TOKEN, -1), 1, F.size(a)).alias("before"))
    letters = lambda x: x.rlike("^[A-Za-z]+$")
    begins = lambda z: letters(z["a"]) & letters(z["b"]) & (F.length(z["a"]) < F.length(z["b"])) & F.startswith(F.lower(z["b"]), F.lower(z["a"]))
    fits = (F.size(a) == F.size(b)) & F.forall(pairs, lambda z: (z["a"] == z["b"]) | begins(z))
    rest = lambda z: F.substring(z["b"], F.length(z["a"]) + 1, F.length(z["b"]))
    missing = F.transform(F.filter(pairs, lambda z: z["a"] != z["b"]), rest)
    shown = F.array_join(F.transform(pairs, lambda z: F.concat(z["before"], z["a"], F.repeat(F.lit("_"), F.length(z["b"]) - F.length(z["a"])))), "")
    passage = F.concat(shown, F.element_at(F.split(gapped, TOKEN, -1), -1))
    return F.when(fits & (F.size(missing) > 0), F.struct(passage.alias("passage"), missing.alias("missing")))


#: Gaps of a passage, and of its key, where the letters stand in braces.
GAP = r"([A-Za-z]+)((?:\s*_)+)"
MARKED_GAP = r"([A-Za-z]+)\{([A-Za-z]+)\}"


def gap_skeleton(text: Column, gap: str) -> Column:
    """A passage with each gap as a mark, in the form in which passages and keys are compared."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, gap, "$1◊"), r"(?U)\s+", " "))
    return F.regexp_replace(flat, r"\s+([,.;:!?])", "$1")


def fill_answers(passages: DataFrame, keys: DataFrame, scope: list[str]) -> DataFrame:
    """Letters of the gaps of passages (passage_id, text) from the one key (key_id, text, first, last) with the same skeleton.

    The key's range of numbers must count as many gaps as both texts have; else nothing is applied.  A gap whose prefix or
    number of letters differs stays open: its answer is null.
    """
    p = passages.withColumn("_s", gap_skeleton(F.col("text"), GAP))
    k = keys.select(*scope, "key_id", "first", F.col("last").alias("_last"), F.col("text").alias("_key"), gap_skeleton(F.col("text"), MARKED_GAP).alias("_s"))
    n = F.count("*").over(Window.partitionBy(*scope, "_s"))
    k = k.withColumn("_n", n).where("_n = 1")
    out = p.join(k, [*scope, "_s"], "left")
    every = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.arrays_zip(every("text", GAP, 1).alias("prefix"), F.transform(every("text", GAP, 2), lambda x: F.length(F.regexp_replace(x, "[^_]", ""))).alias("letters"))
    marks = F.arrays_zip(every("_key", MARKED_GAP, 1).alias("prefix"), every("_key", MARKED_GAP, 2).alias("answer"))
    whole = F.coalesce((F.col("first") > 0) & (F.col("_last") - F.col("first") + 1 == F.size(gaps)) & (F.size(marks) == F.size(gaps)), F.lit(False))
    same = lambda z: (z["g"]["prefix"] == z["m"]["prefix"]) & (z["g"]["letters"] == F.length(z["m"]["answer"]))
    answers = F.transform(F.arrays_zip(gaps.alias("g"), marks.alias("m")), lambda z: F.when(same(z), z["m"]["answer"]))
    return out.select("passage_id", F.size(gaps).alias("gaps"), whole.alias("applied"), F.when(whole, F.col("key_id")).alias("key_id"), F.when(whole, answers).alias("answers"))


def insertion_points(passage: Column, paragraph: Column) -> Column:
    """The place of a paragraph that stands exactly once in a passage, from 1; else null."""
    first = F.locate(paragraph, passage) if isinstance(paragraph, str) else F.position(paragraph, passage)
    again = F.position(paragraph, passage, first + 1)
    return F.when((F.length(paragraph) > 0) & (first > 0) & (again == 0), first)


def missing_letters(answer: Column) -> Column:
    """Letters to fill in, as recognised: a capital I among small letters is an l, capitals are small; unsure ones are null.

    What isn't all letters stays.  Capitals with an I, and a lone capital, may stand for something else.
    """
    letters, small = answer.rlike("^[A-Za-z]+$"), answer.rlike("[a-z]")
    unsure = F.contains(answer, F.lit("I")) | (F.length(answer) == 1)
    return F.when(~letters, answer).when(small, F.translate(answer, "I", "l")).when(~unsure, F.lower(answer))
