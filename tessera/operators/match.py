"""UniqueMatch: exactly one match is applied, several are ambiguous, none is missing - never a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_match(left: DataFrame, right: DataFrame, on: list[str], value: str, key: list[str], condition=None) -> DataFrame:
    """For each key of left, the one distinct value of right that meets it.

    Adds n_matches, state (applied, ambiguous, missing) and `value`, null unless applied.  on: equal columns; condition: a
    further condition on the joined row (ranges).  Values are counted distinct, so repeated evidence is no ambiguity.
    """
    r = right.select(*on, *[c for c in right.columns if c not in on])
    if condition is None:
        out = _by_groups(left, r, on, value, key)
    else:
        hit = F.when(F.col(value).isNotNull() & F.coalesce(condition, F.lit(False)), F.col(value))
        out = left.join(r, on, "left").groupBy(*key).agg(F.count_distinct(hit).alias("n_matches"), F.min(hit).alias("_one"))
    n = F.col("n_matches")
    state = F.when(n == 1, "applied").when(n > 1, "ambiguous").otherwise("missing")
    return out.select(*key, "n_matches", state.alias("state"), F.when(n == 1, F.col("_one")).alias(value))


def _by_groups(left: DataFrame, right: DataFrame, on: list[str], value: str, key: list[str]) -> DataFrame:
    """key, n_matches and _one without a product: values are counted once for each `on`, and a key looks its count up.

    Only a key that stands in left with several `on` meets the values themselves, since they may be the same ones.
    """
    rest = [c for c in on if c not in key]
    asked = left.groupBy(*key).agg(F.collect_set(F.struct(*on)).alias("_on"))
    spread = lambda which: asked.where(which).select(*key, F.explode("_on").alias("_o")).select(*key, *[F.col(f"_o.{c}").alias(c) for c in rest])
    groups = right.groupBy(*on).agg(F.count_distinct(value).alias("n_matches"), F.min(value).alias("_one"))
    single = spread(F.size("_on") == 1).join(groups, on, "left").select(*key, F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), "_one")
    values = right.select(*on, F.col(value).alias("_value")).distinct()
    several = spread(F.size("_on") > 1).join(values, on, "left").groupBy(*key).agg(F.count_distinct("_value").alias("n_matches"), F.min("_value").alias("_one"))
    return single.unionByName(several)


def issues_of(matched: DataFrame, key: list[str]) -> DataFrame:
    """One issue row per key that was not applied: none is a warning, several are an error."""
    path = F.concat_ws("/", *(F.col(k).cast("string") for k in key))
    severity = F.when(F.col("state") == "ambiguous", "error").otherwise("warning")
    return matched.where("state <> 'applied'").select(severity.alias("severity"), F.concat(F.lit("match "), F.col("state")).alias("message"), path.alias("path"))


def orphans(right: DataFrame, left: DataFrame, on: list[str]) -> DataFrame:
    """Rows of right that nothing of left asks for."""
    return right.join(left.select(*on).distinct(), on, "left_anti")
