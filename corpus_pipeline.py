"""A pipeline over documents: quality classifier, line deduplication, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Rows are told apart by a key that a stage gives them, never by doc_id.  Rows without a doc_id go through all stages like
others.  Rows that share a doc_id stay as many as they are up to the near-copy stage, which keeps one of them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, staged
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.packing import best_fit_packing
from tessera.llm.quality_classifier import quality_classifier
from tessera.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _scanned(docs: DataFrame) -> bool:
    """Whether docs are rows of files as they lie there, perhaps filtered: reading them again gives the same rows in the same order."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `row`, a number of each row that nulls and repeated rows have too.

    Numbers go by partition and place, so texts of files need no copy to keep them; any other docs are staged.
    """
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row"))
    return rows if _scanned(docs) else staged(rows)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts as good, those without a doc_id too."""
    rows = keyed(docs)
    good = quality_classifier(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row",)).where("predicted = 1").select("row")
    return rows.join(good, "row", "left_semi").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a later document holds too; n_chars follows.  Rows without a doc_id stay whole."""
    kept = line_dedup(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; nulls come last.

    Texts without words are copies of nothing, so of them one row stays for each doc_id, and all rows without one.
    """
    rows = keyed(docs)
    found = staged(ngram_jaccard_join(rows, id_col="row").select(F.col("doc_id").alias("row"), "n_shingles", "component_id"))
    named = found.join(rows.select("row", "doc_id", F.xxhash64("text").alias("h")), "row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "row")
    kept = named.where("n_shingles > 0").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    bare = named.where("n_shingles = 0")
    kept = kept.unionByName(bare.where("doc_id is null").select("row"))
    kept = kept.unionByName(bare.where("doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("row")).select("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each of its copies; the last copy of a document that is taken in part is cut after its words.

    Each row, repeated or without a doc_id, has its own number of copies.
    """
    docs = keyed(docs)
    taken = staged(mix_sources(docs, carry=("row",)).select("row", "size", "taken"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1)
    parts = taken.withColumn("whole", whole).withColumn("rest", F.when(F.col("size") > 0, F.col("taken") - F.col("whole") * F.col("size")).otherwise(0))
    copies = F.concat(F.array_repeat("size", F.col("whole").cast("int")), F.when(F.col("rest") > 0, F.array("rest")).otherwise(F.array().cast("array<bigint>")))
    rows = parts.select("row", "size", F.explode(copies).alias("words"))
    blank = SPACES.replace(" ", r"\x20")
    # Cut at every end of a word: each part is one word with the white space before it.
    parts = F.split("text", rf"(?<=[^{blank}])(?=[{blank}])")
    head = F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), "")
    out = docs.join(rows, "row").withColumn("text", F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return best_fit_packing(docs, tokenizer_path())


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_copies), ("mix_sources", mix), ("best_fit_packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
