"""Quality by weak supervision, in DataFrame functions only.

Rules look at statistics of a text and vote for keeping, against it, or abstain.  A label model with one class variable
(good or bad) and, for each rule, its chances of each vote given the class is fitted by expectation-maximisation over the
counts of vote patterns; there are at most 3 ** rules patterns, however many documents.  The verdict is the posterior
chance that a document is good.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, checkpointed, words_of

WINDOW = 5


def _repeat_words(words: str) -> Column:
    """Words in WINDOW-word windows that occur twice or more in the array column `windows` of (w, i), sorted by w."""
    hit = F.filter(
        "windows",
        lambda x, j: ((j > 0) & (F.element_at("windows", F.greatest(j, F.lit(1)))["w"] == x["w"]))
        | ((j < F.size("windows") - 1) & (F.element_at("windows", F.least(j + 2, F.size("windows")))["w"] == x["w"])),
    )
    return F.sort_array(F.transform(hit, lambda x: x["i"]))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per row of docs.  Null text counts as empty.

    Windows are compared as texts, so no two different windows are taken for one.
    """
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("words", words_of(F.col("text")))
    blank = "".join(SPACES)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(blank))) > 0)
    t = t.select(
        "doc_id", "text", "words", lines.alias("lines"),
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0))), lambda i: F.array_join(F.slice("words", i + 1, WINDOW), " ")).alias("grams"),
    )
    t = t.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.floor((F.length("text") - F.length(F.replace("text", F.lit("!!"), F.lit("")))) / 2).alias("n_shouts"),
        (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("long").alias("n_stops"),
        (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).cast("long").alias("n_bars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.when((F.size("words") > WINDOW) & (F.size(F.array_distinct("grams")) < F.size("grams")), F.col("grams")).alias("grams"),
    )
    t = t.withColumn("windows", F.sort_array(F.transform("grams", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    t = t.withColumn("starts", _repeat_words("windows"))
    gaps = F.transform("starts", lambda x, j: F.when(j < F.size("starts") - 1, F.least(F.lit(WINDOW), F.element_at("starts", F.least(j + 2, F.size("starts"))) - x)).otherwise(WINDOW))
    t = t.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    return t.drop("grams", "windows", "starts")


@dataclass(frozen=True)
class VoteRule:
    """bad and good are SQL conditions on the statistics; neither: the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    VoteRule("length", "n_words < 10", "false"),
    VoteRule("symbols", "n_symbols * 100 > word_chars * 5", "false"),
    VoteRule("marked_words", "n_symbols * 2 > n_words", "false"),
    VoteRule("bars", "n_bars * 10 > n_words", "false"),
    VoteRule("capitals", "n_upper * 100 > word_chars * 40", "false"),
    VoteRule("shouting", "n_shouts * 10 > n_words", "false"),
    VoteRule("repeats", "n_repeat_words * 100 > n_words * 20", "false"),
    VoteRule("dup_lines", "n_dup_lines * 100 > n_lines * 30", "false"),
    VoteRule("word_length", "word_chars < n_words * 2 or word_chars > n_words * 14", "false"),
    VoteRule("sentences", "n_words > 100 and n_stops * 400 < n_words", "n_stops * 40 >= n_words"),
    VoteRule("variety", "n_words > 50 and n_distinct * 100 < n_words * 15", "n_words > 50 and n_distinct * 100 > n_words * 30"),
)


def votes(rules: tuple[VoteRule, ...] = RULES) -> list[Column]:
    """Each rule's vote: 1 for, 0 against, -1 abstains (also where a statistic is null)."""
    return [F.when(F.expr(r.bad), 0).when(F.expr(r.good), 1).otherwise(-1).cast("int").alias(f"v_{r.name}") for r in rules]


@dataclass(frozen=True)
class LabelModel:
    """prior: chance of good; chances[k][c][v]: chance that rule k votes v (-1, 0, 1) given class c (0 bad, 1 good)."""

    prior: float
    chances: list[list[dict[int, float]]]

    def log_odds(self, k: int, v: int) -> float:
        return math.log(self.chances[k][1][v]) - math.log(self.chances[k][0][v])


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.8) -> LabelModel:
    """Expectation-maximisation over (votes, count).

    Starts from rules that seldom vote, and then mostly rightly: bad documents come in several kinds, and each kind trips
    a few rules only.  A rule's votes never become evidence for the opposite class, so the classes keep their meaning.
    Pseudo-counts keep all chances above 0; no patterns give the starting model.
    """
    n = len(patterns[0][0]) if patterns else 0
    chances = [[{-1: 0.6, 0: 0.3, 1: 0.1}, {-1: 0.79, 0: 0.01, 1: 0.2}] for _ in range(n)]
    for _ in range(rounds):
        mass = [1.0, 1.0 / (1 - prior) * prior]
        sums = [[{-1: 0.5, 0: 0.4, 1: 0.1}, {-1: 0.5, 0: 0.1, 1: 0.4}] for _ in range(n)]
        for vote, count in patterns:
            logs = [math.log(1 - prior), math.log(prior)]
            for k, v in enumerate(vote):
                for c in (0, 1):
                    logs[c] += math.log(chances[k][c][v])
            good = 1 / (1 + math.exp(max(-700, min(700, logs[0] - logs[1]))))
            for c, share in ((0, 1 - good), (1, good)):
                mass[c] += count * share
                for k, v in enumerate(vote):
                    sums[k][c][v] += count * share
        prior = min(0.995, max(0.005, mass[1] / sum(mass)))
        for k in range(n):
            chances[k] = [{v: x / sum(sums[k][c].values()) for v, x in sums[k][c].items()} for c in (0, 1)]
            for v, wrong in ((0, 1), (1, 0)):
                least = min(chances[k][0][v], chances[k][1][v])
                if chances[k][wrong][v] > chances[k][1 - wrong][v]:
                    chances[k][wrong][v] = chances[k][1 - wrong][v] = least
    return LabelModel(prior, chances)


def posterior(model: LabelModel, rules: tuple[VoteRule, ...] = RULES) -> Column:
    """Chance that a document is good, from its vote columns."""
    total = F.lit(math.log(model.prior) - math.log(1 - model.prior))
    for k, r in enumerate(rules[: len(model.chances)]):
        v = F.col(f"v_{r.name}")
        total = total + F.when(v == 1, model.log_odds(k, 1)).when(v == 0, model.log_odds(k, 0)).otherwise(model.log_odds(k, -1))
    return 1 / (1 + F.exp(-total))


def quality_rules(docs: DataFrame, rules: tuple[VoteRule, ...] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, votes, posterior and verdict `good` of every row of docs.

    One scan of the texts: the statistics are checkpointed, then grouped by votes for the model and read again for the
    verdicts.  Repeated rows count as often as they come; other columns are not read; an empty table gives an empty one.
    """
    stats = checkpointed(statistics(docs, id_col, text_col).select("*", *votes(rules)))
    names = [f"v_{r.name}" for r in rules]
    # Patterns of votes: 3 ** len(rules) rows at most.
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in stats.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    model = fit_label_model(patterns)
    return stats.withColumn("p_good", posterior(model, rules)).withColumn("good", F.col("p_good") >= threshold)
