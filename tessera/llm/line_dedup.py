"""Line deduplication over levelled sorted runs of line hashes.

An index holds, for each line key, a number of documents seen with it and the largest doc_id.  Its runs are tables
bucketed and sorted by key, so that runs are joined with each other, and a batch with the runs, without moving or hashing
a run again.  Each batch is merge-anti-joined with the runs: keys that a run already holds in enough documents and with a
larger doc_id are settled and are not added again.  What is left becomes a new run of level 0.  When a level has `fanout`
runs they are merged into one run of the next level.  A manifest in the index's folder lists the runs, so that later
sessions can add batches.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, shared_dir, skew_join, staged

_STRIP = SPACES.encode()
KEYS = "doc_id long, h1 long, h2 long"
RUN = "h1 bigint, h2 bigint, n_docs bigint, max_doc bigint"
MANIFEST = "version long, level int, place int, path string, buckets int"
_CATALOG = "spark_catalog.default"
KEPT = "doc_id long, n_lines long, n_dropped long, kept string"


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """For each line, its 16-byte key hash, or None where the key is shorter than min_chars code points."""
    out: list[bytes | None] = []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):  # bytes.lower() changes A-Z only
        key = line.strip(_STRIP)
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def _halves(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def _emit_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                docs, first, second = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if doc is not None and text:
                        for key in set(line_keys(text, min_chars)) - {None}:
                            a, b = _halves(key)
                            docs.append(doc)
                            first.append(a)
                            second.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, first, second)], ["doc_id", "h1", "h2"])

    return run


class LineIndex:
    """Levelled runs of (h1, h2, n_docs, max_doc), each a table of `buckets` sorted buckets, and their manifest in folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, min_docs: int = 3, fanout: int = 3) -> None:
        self.spark, self.folder, self.buckets, self.min_docs, self.fanout = spark, folder, buckets, min_docs, fanout
        self.version = 0
        self.levels: list[list[tuple[str, DataFrame]]] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, min_docs: int = 3, fanout: int = 3) -> LineIndex:
        """The index that an earlier session left in folder, as of the last version of its manifest."""
        listed = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
        rows = listed.where(F.col("version") == listed.agg(F.max("version")).first()[0]).orderBy("level", "place").collect()  # one row for each run
        index = cls(spark, folder, rows[0].buckets, min_docs, fanout)
        index.version = rows[0].version
        index.levels = [[] for _ in range(rows[-1].level + 1)]
        for row in rows:
            name = f"{_CATALOG}.tessera_run_{uuid.uuid4().hex}"
            spark.sql(f"create table {name} ({RUN}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {index.buckets} buckets location '{row.path}'")
            index.levels[row.level].append((row.path, index._taken(name)))
        return index

    def _taken(self, name: str) -> DataFrame:
        """The table of that name, which leaves the catalog; its files stay."""
        run = self.spark.table(name)
        self.spark.sql(f"drop table {name}")
        return run

    def _written(self, run: DataFrame) -> tuple[str, DataFrame]:
        name = f"tessera_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        run.write.option("path", path).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(f"{_CATALOG}.{name}")
        return path, self._taken(f"{_CATALOG}.{name}")

    @staticmethod
    def _merged(one: DataFrame, other: DataFrame) -> DataFrame:
        # A union of bucketed tables would lose their order; a full join of two sorted runs is a merge.
        other = other.select("h1", "h2", F.col("n_docs").alias("more"), F.col("max_doc").alias("other_max"))
        count = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
        return one.join(other, ["h1", "h2"], "full").select("h1", "h2", count.alias("n_docs"), F.greatest("max_doc", "other_max").alias("max_doc"))

    def runs(self) -> list[tuple[str, DataFrame]]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch of distinct (doc_id, h1, h2); all rows of a doc_id must be in one batch."""
        batch = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        for _, run in self.runs():
            settled = run.where(F.col("n_docs") >= self.min_docs).select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("max_doc").alias("settled"))
            batch = batch.join(settled, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("settled") >= F.col("max_doc")), "left_anti")
        self._put(0, self._written(batch))
        self.version += 1
        rows = [(self.version, level, place, path, self.buckets) for level, runs in enumerate(self.levels) for place, (path, _) in enumerate(runs)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _put(self, level: int, run: tuple[str, DataFrame]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, functools.reduce(lambda a, b: self._written(self._merged(a[1], b[1])), runs))

    def repeated(self) -> DataFrame:
        """(h1, h2, max_doc) of the keys held by at least min_docs documents."""
        *first, last = self.runs()
        out = last[1]
        if first:
            out = self._merged(functools.reduce(lambda a, b: self._written(self._merged(a[1], b[1])), first)[1], out)
        return out.where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "max_doc")


def _drop_lines(min_chars: int, carried: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc, text, drops in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    text = text or ""
                    lines = text.split("\n")
                    kept, n = text, 0
                    if drops:
                        gone = {(d["h1"], d["h2"]) for d in drops}
                        stay = [x for x, key in zip(lines, line_keys(text, min_chars), strict=True) if key is None or _halves(key) not in gone]
                        kept, n = "\n".join(stay), len(lines) - len(stay)
                    rows.append((doc, len(lines), n, kept))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                others = [part.column(k) for k in range(3, 3 + carried)]
                names = ["doc_id", "n_lines", "n_dropped", "kept", *part.schema.names[3 : 3 + carried]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *others], names)

    return run


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), index_dir: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, the kept text and the carried columns of every row of docs.

    A key is a line stripped of SPACES with A-Z lower-cased.  Keys of min_chars code points or more that min_docs
    documents hold lose all their lines except in the largest doc_id that holds them.  Null or empty text is one empty
    line.  Rows that share a doc_id count as one document and are treated alike; rows without a doc_id hold no key and
    stay whole.  Other columns are not read.

    index_dir names the folder of an index that an earlier call has left (see LineIndex): its documents count too, and
    docs, which must be new to it, are added.  By default a new index is begun in the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    keys = staged(docs.select("doc_id", "text").mapInArrow(_emit_keys(min_chars), KEYS).dropDuplicates(["doc_id", "h1", "h2"]))
    if index_dir is None:
        index = LineIndex(spark, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), min_docs, fanout)
    else:
        index = LineIndex.open(spark, index_dir, min_docs, fanout)
    cuts = [c for c in docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)] if batches > 1 else []
    edges = sorted({int(c) for c in cuts}, reverse=True)
    for low, high in zip([*edges, None], [None, *edges], strict=True):
        part = keys
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        index.add(part)
    drops = skew_join(keys, staged(index.repeated()), ["h1", "h2"]).where(F.col("doc_id") < F.col("max_doc"))
    per_doc = drops.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))  # one document's lines at most
    schema = ", ".join([KEPT, *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)])
    return docs.join(per_doc, "doc_id", "left").select("doc_id", "text", "drops", *carry).mapInArrow(_drop_lines(min_chars, len(carry)), schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
