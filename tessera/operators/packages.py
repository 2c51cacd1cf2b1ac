"""Rules of practice packages and of the exam settings that they may carry, as tables of rules over flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.verify import Rule, check_rules

_ID = r"'^[\\p{L}\\p{N}][\\p{L}\\p{N}_.:-]{0,127}$'"


def _named(column: str) -> list[Rule]:
    return [Rule(f"{column} empty or with other characters", "error", f"trim({column}) rlike {_ID}")]


def _text(column: str, most: int, required: bool = False) -> list[Rule]:
    rules = [Rule(f"{column} too long", "error", f"length(coalesce({column}, '')) <= {most}")]
    return [Rule(f"{column} empty", "error", rf"coalesce({column}, '') rlike '\\S'"), *rules] if required else rules


#: Packages: schema_version, id, version, title, rights, n_groups, n_questions.
PACK_RULES = [
    Rule("unknown schema version", "error", "schema_version in (1, 2)"), *_named("id"), *_text("version", 80, True), *_text("title", 300, True), *_text("rights", 10_000),
    Rule("not 1 to 100 groups", "error", "n_groups between 1 and 100"), Rule("more than 1000 questions", "error", "n_questions <= 1000"),
]
#: Groups: id, section, title, passage, n_questions.
GROUP_RULES = [
    *_named("id"), Rule("unknown section", "error", "section in ('reading', 'listening', 'speaking', 'writing')"), *_text("title", 300, True), *_text("passage", 500_000), Rule("group without questions", "error", "n_questions > 0"),
]
_OPTIONS = "transform(options, o -> o.id)"
_ANSWERED = r"exists(coalesce(answer, array()), a -> a rlike '\\S')"
_PLAIN = "not interaction"
#: Questions: id, type, prompt, options (id, text), answer (list), slots, frame, time_limit, prepare, interaction.
QUESTION_RULES = [
    *_named("id"), Rule("unknown type", "error", "type in ('single_choice', 'fill_blank', 'sentence_order', 'email', 'discussion', 'interview', 'listen_repeat')"), *_text("prompt", 100_000, True),
    Rule("more than 30 options", "error", "size(options) <= 30"), Rule("option id twice", "error", f"size(array_distinct({_OPTIONS})) = size(options)"), Rule("option without id or text", "error", rf"forall(options, o -> trim(o.id) rlike {_ID} and o.text rlike '\\S')"),
    Rule("fewer than two options", "error", f"type not in ('single_choice', 'sentence_order') or not ({_PLAIN}) or size(options) >= 2"),
    Rule("slots differ from the frame", "error", "type <> 'sentence_order' or (slots is null and frame is null) or (slots between 1 and 30 and size(regexp_extract_all(coalesce(frame, ''), '_{2,}', 0)) = slots)"),
    Rule("more slots than options", "error", "type <> 'sentence_order' or slots is null or slots <= size(options)"), Rule("no standard answer", "warning", f"type not in ('single_choice', 'fill_blank', 'sentence_order') or {_ANSWERED}"),
    Rule("answer is no option", "error", f"type <> 'single_choice' or not {_ANSWERED} or not ({_PLAIN}) or (size(answer) = 1 and array_contains({_OPTIONS}, answer[0]))"),
    Rule("order does not fill the slots", "error", f"type <> 'sentence_order' or not {_ANSWERED} or (size(answer) = coalesce(slots, size(options)) and size(array_distinct(answer)) = size(answer) and forall(answer, a -> array_contains({_OPTIONS}, a)))"),
    Rule("no sentence to repeat", "warning", f"type <> 'listen_repeat' or {_ANSWERED}"), Rule("several sentences to repeat", "error", "type <> 'listen_repeat' or size(coalesce(answer, array())) <= 1"),
    Rule("time out of bounds", "error", "time_limit is null or time_limit between 0 and 7200"), Rule("preparation out of bounds", "error", "prepare is null or prepare between 0 and 7200"),
]
#: Seconds for a question of each type that names none.
DEFAULT_TIME = {"single_choice": 60, "fill_blank": 60, "sentence_order": 60, "email": 420, "discussion": 600, "interview": 45, "listen_repeat": 15}

_BASES = "('document', 'user', 'preset', 'unknown')"
#: Timings: scope, duration, prepare, basis, may_inherit.
TIMING_RULES = [
    Rule("unknown scope", "error", "scope in ('module', 'task', 'question', 'none') or (may_inherit and scope = 'inherit_module')"), Rule("inherited timing with seconds", "error", "scope <> 'inherit_module' or (duration is null and prepare is null)"),
    Rule("duration out of bounds", "error", "duration is null or duration between 1 and 7200"), Rule("preparation out of bounds", "error", "prepare is null or prepare between 0 and 7200"), Rule("unknown basis", "error", f"basis in {_BASES}"),
    Rule("untimed with a duration", "error", "scope <> 'none' or duration is null"), Rule("seconds of unknown origin", "error", "scope = 'inherit_module' or basis <> 'unknown' or (duration is null and prepare is null)"),
]
_STEPS = "('module', 'task', 'none')"
#: Navigations: back, review, lock_on_advance.
NAVIGATION_RULES = [Rule("unknown way back", "error", f"back in {_STEPS}"), Rule("unknown review", "error", f"review in {_STEPS}"), Rule("lock_on_advance missing", "error", "lock_on_advance is not null")]
#: Directions: id, text, audio, basis, verified.
DIRECTION_RULES = [
    *_named("id"), *_text("text", 100_000), Rule("neither text nor audio", "error", r"coalesce(text, '') rlike '\\S' or audio is not null"), Rule("unknown basis", "error", "basis in ('document', 'filename', 'user')"),
    Rule("verified by its file name", "error", "basis <> 'filename' or not verified"),
]


def twice(rows: DataFrame, by: list[str], path: str, message: str) -> DataFrame:
    """An issue for each row whose key an earlier row has."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(path))
    return rows.withColumn("_n", n).where("_n > 1").select(F.lit("error").alias("severity"), F.lit(message).alias("message"), F.col(path).cast("string").alias("path"))


def package_issues(packs: DataFrame, groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Issues of packages: each table against its rules, and ids that a package uses twice (path names the row, pack its package)."""
    parts = [
        check_rules(packs, PACK_RULES, F.col("path")), check_rules(groups, GROUP_RULES, F.col("path")), check_rules(questions, QUESTION_RULES, F.col("path")),
        twice(groups, ["pack", "id"], "path", "group id twice"), twice(questions, ["pack", "id"], "path", "question id twice"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def default_times(questions: DataFrame) -> DataFrame:
    """Questions with the seconds of their type where they name none or name them out of bounds."""
    default = F.lit(60)
    for kind, seconds in DEFAULT_TIME.items():
        default = F.when(F.col("type") == kind, seconds).otherwise(default)
    return questions.withColumn("time_limit", F.coalesce(F.when(F.col("time_limit").between(0, 7200), F.col("time_limit")), default))


def setting_issues(timings: DataFrame, navigations: DataFrame, directions: DataFrame) -> DataFrame:
    """Issues of exam settings: where time is counted, how one may move, what is said before a task."""
    return check_rules(timings, TIMING_RULES, F.col("path")).unionByName(check_rules(navigations, NAVIGATION_RULES, F.col("path"))).unionByName(check_rules(directions, DIRECTION_RULES, F.col("path")))
