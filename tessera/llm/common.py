"""Helpers that several of the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The separators of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


#: A key is hot from HOT_ROWS rows on; of more than HOT_KEYS such keys those with most rows are.
HOT_ROWS, HOT_KEYS, SALTS = 256, 1 << 14, 64
#: Rows of a table of few numbers that is broadcast at most, and the tasks that a counted small table is read by.
FEW_ROWS, LEAST_TASKS, ROWS_PER_TASK = 1 << 17, 8, 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where it is unset on a local master."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there and every executor can read it."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, for small tables of loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def hot_keys(rows: DataFrame, on: list[str]) -> list[Row]:
    """The keys that most rows hold, above HOT_ROWS: at most HOT_KEYS of them, so others hold less than 1 / HOT_KEYS of all rows."""
    counts = rows.groupBy(*on).count().where(F.col("count") > HOT_ROWS).dropna(subset=on)
    return counts.orderBy(F.desc("count")).limit(HOT_KEYS).select(*on).collect()


def tasks_for(rows: int) -> int:
    """Partitions of a table of so many short rows.  What loops read again and again should not keep those of a large shuffle."""
    return max(LEAST_TASKS, rows // ROWS_PER_TASK + 1)


def skew_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", hot: list[Row] | None = None, narrow: bool = False) -> DataFrame:
    """big.join(small, on, how) for how inner or left, where the rows of one key of big don't meet in one task.

    Rows of hot keys are dealt over SALTS and meet a copy of small's rows of their key in each; all others are joined as
    they are.  small should hold one row for each key, and big be staged, since it is read more than once.  What is
    broadcast are the hot keys, HOT_KEYS at most; hot takes them where they are known already.  narrow: small, staged and
    of a few short columns, is counted and broadcast instead while it has at most FEW_ROWS rows.
    """
    if narrow and small.count() <= FEW_ROWS:
        return big.join(F.broadcast(small), on, how)
    hot = hot_keys(big, on) if hot is None else hot
    if not hot:
        return big.join(small, on, how)
    few = F.broadcast(big.sparkSession.createDataFrame(hot, StructType([big.schema[c] for c in on])))
    dealt = big.join(few, on, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    copied = small.join(few, on, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt").unionByName(big.join(few, on, "left_anti").join(small, on, how))


def words_of(text: Column) -> Column:
    """The array of words, runs of characters other than SPACES; empty for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")
