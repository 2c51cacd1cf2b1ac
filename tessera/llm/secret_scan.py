"""Secret scan through a trigram inverted index, in DataFrame functions only.

The Boolean trigram query of each rule is derived from its pattern.  The index maps the trigrams of these queries to
posting lists: for each block of BLOCK_ROWS rows the rows that hold the trigram.  A rule's candidates come from
intersecting and uniting posting lists as its query says, block by block; only candidates meet its regular expression.
Rules without a mandatory trigram scan all texts.  Rows are known by a number of their own, so that null and repeated ids
need no rule of their own.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.trigram_query import disjunctive, pattern_query, trigrams  # noqa: F401

#: Rows of a block, as a power of two.
BLOCK_BITS = 12
#: Up to this many candidates (some 30 MB) are broadcast to the texts; more are joined by a shuffle of candidates and texts.
BROADCAST_ROWS = 400_000
#: Matches whose places are summed in one go.
CHUNK = 256
SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """pattern is a Java regular expression in the syntax that Python shares; group is measured against at_least."""

    kind: str
    pattern: str
    at_least: int
    group: int = 0


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # a maximal run, so the bound may stand in the pattern
)
#: Rules that this scan adds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 36),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 26),
)


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Clauses of the rule's query in disjunctive form; empty where no trigram is mandatory."""
    return disjunctive(pattern_query(rule.pattern))


def build_index(rows: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(block, trigram, rows): posting lists of the wanted trigrams over rows (row, text), at most 2 ** BLOCK_BITS long each."""
    low = rows.select("row", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(wanted))))
    postings = low.select("row", F.explode(held).alias("trigram"))
    return postings.groupBy(F.shiftright("row", BLOCK_BITS).alias("block"), "trigram").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def _rows_of(clauses: list[frozenset[str]], lists: Column) -> Column:
    """The rows of a block that meet one of the clauses, from its posting lists."""
    none = F.array().cast("array<bigint>")
    found = [functools.reduce(F.array_intersect, [F.coalesce(lists[t], none) for t in sorted(clause)]) for clause in clauses]
    return functools.reduce(F.array_union, found)


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(row, kinds): of which rules a row can hold a match, by intersecting posting lists block by block."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))  # the queries' trigrams at most

    def named(kind: str) -> Column:
        return F.transform(_rows_of(queries[kind], F.col("lists")), lambda r: F.struct(r.alias("row"), F.lit(kind).alias("kind")))

    return blocks.select(F.explode(F.concat(*map(named, queries))).alias("found")).groupBy("found.row").agg(F.collect_set("found.kind").alias("kinds"))


def _spans(rule: Rule, order: int, found: Column) -> Column:
    """Array of (start, ord, end, kind) of the rule's matches `found` in column text, in code points."""
    measured = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.split("text", rule.pattern, -1)
    zipped = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("gap"), found.alias("hit"), measured.alias("part"))
    steps = F.transform(zipped, lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"), F.length(z["part"]).alias("part")))
    # Places are sums over all matches before; each chunk of matches starts from the sum of the chunks before it.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda k: F.slice(steps, k * CHUNK + 1, CHUNK))
    long = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, z: a + z["gap"] + z["hit"]))
    starts = F.aggregate(long, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + z["gap"]
        end = start + z["hit"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(z["part"] >= rule.at_least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def placed(c: Column, k: Column) -> Column:
        return F.aggregate(c, F.struct(F.get(starts, k).alias("at"), F.array().cast(SPANS).alias("spans")), step)["spans"]

    return F.flatten(F.transform(chunks, placed))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (start, ord, end, kind) sorted by start, then by the order of rules; one row per row of docs.

    Matches of a rule are leftmost and do not overlap; those whose measured group is shorter than the rule's bound are
    dropped.  Null text is empty.  Repeated rows and rows without a doc_id are scanned like others.  Other columns are not
    read; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r))}
    none = F.array().cast("array<string>")
    if queries:
        kinds = staged(candidates(build_index(rows, frozenset().union(*(c for q in queries.values() for c in q))), queries))
        tried = rows.join(F.broadcast(kinds) if kinds.count() <= BROADCAST_ROWS else kinds, "row", "left").withColumn("kinds", F.coalesce("kinds", none))
    else:
        tried = rows.withColumn("kinds", none)

    def matches(rule: Rule) -> Column:
        found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        return F.when(F.array_contains("kinds", rule.kind), found).otherwise(none) if rule.kind in queries else found

    hits = tried.select("doc_id", "text", *(matches(r).alias(f"found_{k}") for k, r in enumerate(rules)))
    spans = [F.when(F.size(f"found_{k}") > 0, _spans(r, k, F.col(f"found_{k}"))).otherwise(F.array().cast(SPANS)) for k, r in enumerate(rules)]
    return hits.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
