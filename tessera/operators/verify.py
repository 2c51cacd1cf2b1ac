"""Predicates and verification: rule tables, evidence, text comparison, readiness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapsed, jaccard, tokens

#: Words of negation and of numbers.
NEGATION = ("no", "not", "never", "neither", "nor", "without", "cannot")
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
)
#: Fixed value: capitalised words that are no names.
NO_NAMES = ("The", "This", "That", "There", "I", "We", "It", "He", "She", "They", "A", "An")


@dataclass(frozen=True)
class Rule:
    """One row of a rules table: `holds` is SQL; rows where it is not true break the rule."""

    rule_id: str
    severity: str
    holds: str


def check_rules(rows: DataFrame, rules: list[Rule], path: Column) -> DataFrame:
    """An issue for each broken rule of each row, in one pass over the rows."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(r.holds), F.lit(False)), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.rule_id).alias("message"))) for r in rules)))
    return rows.select(path.cast("string").alias("path"), F.explode(found).alias("_i")).select("_i.severity", "_i.message", "path")


def duplicates(rows: DataFrame, by: list[str], message: str) -> DataFrame:
    """An issue for each key that occurs more than once."""
    again = rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1")
    return again.select(F.lit("error").alias("severity"), F.lit(message).alias("message"), F.concat_ws("/", *by).alias("path"))


def pack_defaults(questions: DataFrame, defaults: dict[str, int], column: str) -> DataFrame:
    """Fill missing times by section."""
    value = F.lit(None).cast("int")
    for section, seconds in defaults.items():
        value = F.when(F.col("section") == section, seconds).otherwise(value)
    return questions.withColumn(column, F.coalesce(F.col(column), value))


def capabilities(candidates: DataFrame, blocking: dict[str, dict[str, str]]) -> DataFrame:
    """Adds for each capability whether it is open, and the codes that block it (code -> SQL condition)."""
    out = candidates
    for name, codes in blocking.items():
        blocked = F.array_compact(F.array(*(F.when(F.coalesce(F.expr(cond), F.lit(True)), F.lit(code)) for code, cond in codes.items())))
        out = out.withColumn(f"{name}_blocked", blocked).withColumn(name, F.size(f"{name}_blocked") == 0)
    return out


def field_evidence(fields: DataFrame, blocks: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """How many blocks of the same document hold a field's text: one is known, more are ambiguous, none is missing.

    The containment test runs within documents only; blocks of one document are its lines or paragraphs.
    """
    held = F.contains("block_text", F.col("field_text")) & (F.length("field_text") > 0)
    joined = fields.join(blocks, on, "left")
    out = joined.groupBy(*key).agg(F.count_if(held).alias("n_blocks"), F.min(F.when(held, F.col("block_id"))).alias("_first"))
    state = F.when(F.col("n_blocks") == 1, "known").when(F.col("n_blocks") > 1, "ambiguous").otherwise("missing")
    return out.select(*key, "n_blocks", state.alias("state"), F.when(F.col("n_blocks") == 1, F.col("_first")).alias("block_id"))


def fidelity(proposals: DataFrame, sources: DataFrame, on: list[str]) -> DataFrame:
    """Proposals whose text stands verbatim in their source."""
    return proposals.join(sources, on, "left").withColumn("verbatim", F.coalesce(F.contains("source_text", F.col("proposal")), F.lit(False))).drop("source_text")


def clear_unverified(rows: DataFrame, text: str, source: str) -> DataFrame:
    """A text that its source does not hold is emptied and counted as cleared."""
    held = F.coalesce(F.contains(F.col(source), F.col(text)), F.lit(False))
    return rows.withColumn("cleared", ~held & F.col(text).isNotNull()).withColumn(text, F.when(held, F.col(text)))


def media_issues(references: DataFrame, files: DataFrame) -> DataFrame:
    """A referenced file that is absent is an error, a file that nothing refers to a warning (column path)."""
    absent = references.select("path").distinct().join(files.select("path"), "path", "left_anti")
    idle = files.select("path").distinct().join(references.select("path"), "path", "left_anti")
    row = lambda df, severity, message: df.select(F.lit(severity).alias("severity"), F.lit(message).alias("message"), "path")
    return row(absent, "error", "media not found").unionByName(row(idle, "warning", "media not used"))


def numeric_runs(text: Column) -> Column:
    """Runs without letters that hold a digit, trimmed of closing punctuation: signs and separators stay as evidence."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"[^\p{L}]+"), F.lit(0)), lambda x: x.rlike(r"\p{N}"))
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"[.!?,;:]+$", ""), r"(?U)\s+", " ")
    return F.transform(runs, lambda x: F.rtrim(tidy(x)))


def _chosen(words: Column, allowed: tuple[str, ...], pattern: str) -> Column:
    return F.array_join(F.filter(words, lambda x: x.isin(*allowed) | x.rlike(pattern)), " ")


def names_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*(F.lit(x) for x in NO_NAMES)))


def compare_texts(rows: DataFrame, reference: str, transcript: str, adjacent: str | None = None, engine_issues: str | None = None) -> DataFrame:
    """Adds state and doubts of a transcript against its reference.

    No reference is notChecked.  Differences of negation, numbers or names are a conflict; equal words match; anything
    else is inconclusive, as is a transcript that resembles a neighbour (Jaccard 0.8) or any doubt of the engine.
    """
    a, b = F.col(reference), F.col(transcript)
    ta, tb = tokens(a), tokens(b)
    same = F.array_join(ta, " ") == F.array_join(tb, " ")
    contains_name = lambda words, name: F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lower(name))
    suspects = F.array_union(names_in(a), names_in(b))
    negation = _chosen(ta, NEGATION, r"^\w+n't$") != _chosen(tb, NEGATION, r"^\w+n't$")
    number = (F.to_json(numeric_runs(a)) != F.to_json(numeric_runs(b))) | (_chosen(ta, NUMBER_WORDS, r"^\d+(\.\d+)?$") != _chosen(tb, NUMBER_WORDS, r"^\d+(\.\d+)?$"))
    name = F.exists(suspects, lambda x: contains_name(ta, x) != contains_name(tb, x))
    near = F.lit(False) if adjacent is None else F.exists(F.coalesce(F.col(adjacent), F.array().cast("array<string>")), lambda x: jaccard(tokens(x), tb) >= 0.8)
    engine = F.lit(False) if engine_issues is None else F.size(F.coalesce(F.col(engine_issues), F.array().cast("array<string>"))) > 0
    conflict = negation | number | name
    blank = ~F.coalesce(b.rlike(r"(?U)\S"), F.lit(False))
    state = F.when(~F.coalesce(a.rlike(r"(?U)\S"), F.lit(False)), "notChecked").when(engine | blank, "inconclusive").when(conflict, "conflict").when(near | ~same, "inconclusive").otherwise("matched")
    codes = [("negation_difference", negation), ("number_difference", number), ("name_difference", name), ("text_difference", ~same & ~conflict), ("similar_adjacent_candidate", near)]
    doubts = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in codes)))
    return rows.withColumn("state", state).withColumn("doubts", F.when(F.col("state") == "notChecked", F.array().cast("array<string>")).otherwise(doubts))


#: Fixed value: words of negation and exception in a question.
OCR_NEGATION = r"(?i)\b(?:not|no|never|except|without)\b"


def compare_ocr(rows: DataFrame, layer: str, ocr: str) -> DataFrame:
    """Disagreements of a text layer with its OCR: text, words of negation, number of underscores, digits.

    An empty layer has nothing to disagree with; neither do texts that differ in white space only.
    """
    a, b = F.coalesce(layer, F.lit("")), F.coalesce(ocr, F.lit(""))
    every = lambda x, pattern: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.lower), "|")
    underscores = lambda x: F.length(F.regexp_replace(x, "[^_]", ""))
    differ = (collapsed(a) != "") & (collapsed(a) != collapsed(b))
    codes = [
        ("text_ocr_disagreement", F.lit(True)), ("critical_negation_conflict", every(a, OCR_NEGATION) != every(b, OCR_NEGATION)),
        ("blank_anchor_conflict", underscores(a) != underscores(b)), ("number_conflict", every(a, r"\d+") != every(b, r"\d+")),
    ]
    found = F.array_compact(F.array(*(F.when(differ & cond, F.lit(code)) for code, cond in codes)))
    return rows.withColumn("issues", found)


def reliable_region(text: Column, hidden: Column) -> Column:
    """A visible region of 16 characters or more with two letters and no control or replacement characters."""
    return ~hidden & (F.length(text) >= 16) & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F�]") & text.rlike(r"(?s)\p{L}.*\p{L}")


def flatten_ocr(trees: DataFrame, tree: str, width: Column, height: Column) -> DataFrame:
    """Words of nested blocks -> paragraphs -> lines -> words that lie inside the page, with a flag for low confidence."""
    out = trees.select("*", F.posexplode(tree).alias("block", "_b"))
    out = out.select("*", F.posexplode("_b.paragraphs").alias("paragraph", "_p")).select("*", F.posexplode("_p.lines").alias("line", "_l")).select("*", F.posexplode("_l.words").alias("word", "_w"))
    inside = (F.col("_w.x0") >= 0) & (F.col("_w.y0") >= 0) & (F.col("_w.x1") <= width) & (F.col("_w.y1") <= height)
    out = out.where(inside)
    return out.select(*[c for c in trees.columns if c != tree], "block", "paragraph", "line", "word", F.col("_w.text").alias("text"), F.col("_w.confidence").alias("confidence"), (F.col("_w.confidence") < 85).alias("low_confidence"))


def decoded_scope(seconds_from: Column, seconds_to: Column, rate: int = 16_000) -> Column:
    return F.struct(F.floor(seconds_from * rate).alias("first"), F.floor(seconds_to * rate).alias("last"))


def effective_checks(checks: DataFrame, current: DataFrame, key: list[str], bound: list[str]) -> DataFrame:
    """A check counts only while every revision and hash that it was bound to is still current."""
    now = current.select(*key, *(F.col(b).alias(f"_now_{b}") for b in bound))
    out = checks.join(now, key, "left")
    stale = F.array_compact(F.array(*(F.when(~F.col(b).eqNullSafe(F.col(f"_now_{b}")), F.lit(b)) for b in bound)))
    out = out.withColumn("stale", stale).withColumn("effective", F.when(F.size("stale") == 0, F.col("state")).otherwise("notChecked"))
    return out.drop(*(f"_now_{b}" for b in bound))


def clean_feedback(rows: DataFrame) -> DataFrame:
    """Corrections whose quote stands in the answer and that claim no score and nothing about sound (answer, corrections)."""
    claims = r"(?i)\b\d+(\.\d+)?\s*(/|out of)\s*\d+|\bscore\b|\bpronunciation\b|\bintonation\b|\baccent\b"
    ok = F.filter("corrections", lambda x: F.contains(F.col("answer"), x["quote"]) & ~x["note"].rlike(claims))
    return rows.withColumn("kept", ok).withColumn("removed", F.size("corrections") - F.size("kept")).drop("corrections")


#: Headings that end the reach of a key row, a key row, and an entry of it.
SECTION_HEADING = r"(?i)^\s*(Reading|Listening|Speaking|Writing)\s*[:：]"
KEY_ROW = r"(?i)^(?:Answer key|Answers?)\s*:\s*(.+)$"
KEY_ENTRY = r"(?:^|[;,\s])(\d+)\s*[.):]?\s*([A-Za-z])(?=$|[;,\s])"


def answer_evidence(questions: DataFrame, blocks: DataFrame, doc: list[str]) -> DataFrame:
    """What the key rows after a question's prompt say of its answer (questions: question_id, number, answer, place).

    Blocks (place, name, text) are those of a document in reading order.  A question reaches from its prompt to the next
    heading or the end of the source.  One entry of its number that is its answer makes it known, another answer is a
    conflict, several entries are ambiguous; questions without an entry are not returned.
    """
    w = Window.partitionBy(*doc).orderBy("place")
    new = F.col("text").rlike(SECTION_HEADING) | (F.lag("name").over(w) != F.col("name"))
    b = blocks.withColumn("_reach", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w))
    key = F.regexp_extract("text", KEY_ROW, 1)
    entries = F.arrays_zip(*(F.regexp_extract_all(key, F.lit(KEY_ENTRY), F.lit(k)).alias(n) for k, n in ((1, "n"), (2, "value"))))
    found = b.where(key != "").select(*doc, "_reach", F.col("place").alias("_at"), F.explode(entries).alias("_e"))
    found = found.select(*doc, "_reach", "_at", F.col("_e.n").alias("_number"), F.col("_e.value").alias("_value"))
    q = questions.join(b.select(*doc, "place", "_reach"), [*doc, "place"]).withColumn("_number", F.col("number").cast("string"))
    hits = q.join(found, [*doc, "_reach", "_number"]).where("_at >= place")
    out = hits.groupBy(*doc, "question_id", "answer").agg(F.count("*").alias("n"), F.first("_value").alias("_value"))
    state = F.when(F.col("n") > 1, "ambiguous").when(F.col("_value") == F.col("answer"), "known").otherwise("conflict")
    return out.select(*doc, "question_id", "n", state.alias("state"))


def status_rollup(issues: DataFrame, by: list[str]) -> DataFrame:
    """The worst severity of each material."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    out = issues.groupBy(*by).agg(F.max(rank).alias("_r"), F.count("*").alias("n_issues"))
    return out.select(*by, "n_issues", F.when(F.col("_r") == 2, "blocked").when(F.col("_r") == 1, "needs_review").otherwise("ready").alias("status"))
