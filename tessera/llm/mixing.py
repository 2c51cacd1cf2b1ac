"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a target number of words.  Among all rates between 0 and `most` copies that meet the targets, the ones
nearest to one copy each (in entropy) are exponentially tilted: rate = most / (1 + (most - 1) exp(-tilt * size)), with
one tilt for each source.  The tilts solve the convex dual; every Newton step sums words and slopes over the documents'
sizes in one distributed pass.  Rates are rounded into whole copies by running sums in the order of size, so that the
errors cancel; what is left over is put on a single document of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, checkpointed, skew_join, staged, tasks_for, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Rates and sums are whole numbers of millionths and thousandths, so that their sums don't depend on order.
UNIT, GRAIN = 1_000_000, 1000
#: Salts deal the rows of one size of a source over tasks; their number grows with the table.
LEAST_SALTS, ROWS_PER_SALT, STEPS = 64, 1_000_000, 60


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), salts: int = LEAST_SALTS) -> DataFrame:
    """doc_id, source, size (words of the whole text; 0 for null), a key that is not null, and a salt."""
    s = F.col(source_col)
    key = F.when(s.isNull(), "n").otherwise(F.concat(F.lit("s"), s))
    return docs.select(
        F.col(id_col).alias("doc_id"), s.alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), key.alias("key"), F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("salt"), *carry
    )


def targets(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, words and target of each source, from (key, source, size, n).

    The share is dealt by weight; sources that reach `most` times their words stop there and the rest is dealt again.
    That is a common water level: the largest, over all prefixes in the order of words by weight, of what is left by the
    weight that is left.
    """
    sums = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("words"))
    # One row for each source from here on, not for each document.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((place - 1) % len(weights) + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("cap", most * F.col("words"))
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = share * F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    rows = rows.withColumn("level", left / weight_left)
    return rows.select("key", "words", F.least("cap", F.col("weight") * F.max("level").over(everything)).alias("target"))


def _rate(tilt: Column, z: Column, most: float) -> Column:
    return most / (1 + (most - 1) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * z))))


def tilts(cells: DataFrame, aims: DataFrame, most: float = MOST) -> DataFrame:
    """key and tilt, by Newton steps from tilt 0 (one copy each).

    The words as a function of the tilt bend towards the root on either side of it, so plain steps never overshoot.
    Sources that aim at `most` times their words get a tilt that gives that rate to every size.  cells and aims are
    checkpointed; the state of the steps keeps its number of partitions, and is broadcast for up to FEW_ROWS sources.
    """
    tasks, few = tasks_for(n := aims.count()), n <= FEW_ROWS
    mean = cells.where("size > 0").groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    rows = cells.join(mean, "key").withColumn("z", F.col("size") / F.col("mean")).select("key", "size", "n", "z")
    rows = checkpointed(rows.coalesce(tasks_for(cells.count())))
    full = F.col("target") >= most * F.col("words") * (1 - 1e-9)
    state = checkpointed(aims.where("words > 0").select("key", "target", F.when(full, 1e9).otherwise(0.0).alias("tilt"), full.alias("done")).coalesce(tasks))
    for _ in range(STEPS):
        r = _rate(F.col("tilt"), F.col("z"), most)
        words = F.sum(F.round(F.col("n") * F.col("size") * r * GRAIN).cast("long")) / GRAIN
        slope = F.sum(F.round(F.col("n") * F.col("size") * F.col("z") * r * (1 - r / most) * GRAIN).cast("long")) / GRAIN
        moving = state.where("not done")
        step = rows.join(F.broadcast(moving) if few else moving, "key").groupBy("key", "target", "tilt").agg(words.alias("words"), slope.alias("slope"))
        gap = F.col("target") - F.col("words")
        near = F.abs(gap) <= F.greatest(F.lit(0.5), F.col("target") * 1e-6)
        moved = step.select("key", "target", (F.col("tilt") + F.when(near | (F.col("slope") <= 0), 0.0).otherwise(gap / F.col("slope"))).alias("tilt"), (near | (F.col("slope") <= 0)).alias("done"))
        state = checkpointed(state.where("done").unionByName(moved).coalesce(tasks))
        if state.where("not done").isEmpty():
            break
    return state.select("key", "tilt").join(mean, "key")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken and the carried columns of every row of docs.

    taken is copies * size but for one document of each source, on which the difference to the target is put as far as it
    fits between 0 and `most` copies.  Null text has size 0 and is taken 0 times its words; a null source is a source of
    its own, last in order.  Repeated rows are told apart only by their place among rows of one size, so a rerun gives
    equal rows.  Other columns are not read; an empty table gives an empty table.
    """
    salts = max(LEAST_SALTS, docs.count() // ROWS_PER_SALT)
    rows = staged(sized(docs, id_col, text_col, source_col, carry, salts))
    salted = checkpointed(rows.groupBy("key", "size", "salt").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    cells = checkpointed(salted.groupBy("key", "size").agg(F.first("source").alias("source"), F.sum("n").alias("n")))
    aims = checkpointed(targets(cells, weights, share, most))
    rated = cells.join(tilts(cells, aims, most), "key", "left").withColumn("rate", F.coalesce(_rate(F.col("tilt"), F.col("size") / F.col("mean"), most), F.lit(1.0)))
    rated = rated.select("key", "size", "n", F.round(F.col("rate") * UNIT).cast("long").alias("units"))
    up_to = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.select("key", "size", "units", F.coalesce(F.sum(F.col("n") * F.col("units")).over(up_to), F.lit(0)).alias("start"))
    before = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.select("key", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(rated, ["key", "size"])
    k = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("doc_id", *carry)) + F.col("before")
    placed = rows.join(starts, ["key", "size", "salt"]).withColumn("k", k)
    total = lambda upto: F.floor((F.col("start") + F.col("units") * upto + F.lit(UNIT // 2)) / F.lit(UNIT))
    placed = staged(placed.withColumn("copies", (total(F.col("k")) - total(F.col("k") - 1)).cast("int")).select("doc_id", "source", "key", "size", "k", (F.col("units") / UNIT).alias("rate"), "copies", *carry))
    taken = F.col("copies") * F.col("size")
    ceiling = F.floor(F.lit(most) * F.col("size"))
    ends = placed.groupBy("key").agg(
        F.sum(taken).alias("taken_all"), F.max(F.struct((ceiling - taken).alias("room"), "size", "k")).alias("up"), F.max(F.struct(taken.alias("room"), "size", "k")).alias("down")
    )
    gap = F.round(F.col("target")).cast("long") - F.col("taken_all")
    pick = F.when(gap > 0, F.col("up")).otherwise(F.col("down"))
    ends = ends.join(aims, "key").select(
        "key", F.col("words").alias("source_size"), "target", pick["size"].alias("at_size"), pick["k"].alias("at_k"), F.when(gap > 0, F.least(gap, pick["room"])).otherwise(-F.least(-gap, pick["room"])).alias("extra")
    )
    here = (F.col("size") == F.col("at_size")) & (F.col("k") == F.col("at_k"))
    return skew_join(placed, checkpointed(ends), ["key"], narrow=True).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (taken + F.when(here, F.col("extra")).otherwise(F.lit(0))).cast("long").alias("taken"), *carry
    )
