"""Repeated passages by a sparse suffix array.

1. Suffixes are kept at minimiser positions only: among the SEED-word seeds of every passage of `least` words, the one
   with the smallest hash.  Equal passages pick equal seeds, so each passage that occurs twice has a kept suffix in both
   places.  Suffixes whose seed occurs in one document only are sorted out by the seed's hash.
2. The others carry the words around them: `least` words from their position on, and the words before it that a passage
   can reach back to.  In each partition the suffixes are sorted by their words, neighbours are compared word by word, and
   the lengths of their common prefixes tell for every length which suffixes agree that far to the right.  The same is
   done with the words before them, backwards, for the left.  A passage is extended as far as both sides agree: two
   suffixes hold the same passage of `least` words if they agree r words to the right and least - r to the left.
3. All suffixes of one seed are in one partition, unless they are more than GROUP_ROWS or lie across the partitions of step
   1; the passages around such common seeds are sorted by range over all partitions, by the passage's hash.

Range sorting also splits the rows of one very common seed or passage.  Where a run of equal rows may go on in the next
partition, its two ends are looked at together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.shingles import window_hashes, word_bounds, word_hashes

LEAST, SEED = 50, 25
#: Rows of a sorted partition of (hash, document, place); it is held in memory while neighbours are compared.
PARTITION_ROWS = 500_000
#: Suffixes with words of a partition (some 50 MB), and of one seed in it.
SUFFIX_ROWS, GROUP_ROWS = 50_000, 1_000
RUN = "doc_id long, low int, high int, first long"


def minimisers(words: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes, and for each passage of `least` words the position of its smallest seed (the first of equal ones)."""
    seeds = window_hashes(words, seed)
    span = least - seed + 1
    if len(seeds) < span:
        return seeds, np.zeros(0, dtype=np.int64)
    owner = np.empty(len(seeds) - span + 1, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(seeds, span)
    for at in range(0, len(view), 65536):
        part = view[at : at + 65536]
        owner[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    return seeds, owner


def _suffixes(least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                docs, keys, places = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seeds, owner = minimisers(word_hashes(text, lower=False), least, seed)
                    if len(owner) and doc is not None:
                        kept = np.unique(owner)
                        docs.append(np.full(len(kept), doc))
                        keys.append(seeds[kept].view(np.int64))
                        places.append(kept)
                if docs:
                    yield _batch([("key", keys, np.int64), ("doc_id", docs, np.int64), ("pos", places, np.int32)])

    return run


def _batch(columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(t)) for _, v, t in columns], [n for n, _, _ in columns])


def _around(least: int, seed: int):
    """Candidate suffixes with their words, and the passages around common seeds (columns doc_id, text, found).

    A suffix owns the passages that chose it as their minimiser: those from `back` words before it up to `ahead` words
    before it.  Passages of common seeds have a hash as key instead of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[] for _ in range(8)]
                for doc, text, found in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    bounds = word_bounds(data)
                    words = word_hashes(text, lower=False)
                    seeds, owner = minimisers(words, least, seed)
                    kept, begin = np.unique(owner, return_index=True)
                    end = np.append(begin[1:], len(owner)) - 1
                    common = {(x["pos"], x["key"]): x["common"] for x in found}
                    for pos, low, high in zip(kept.tolist(), begin.tolist(), end.tolist(), strict=True):
                        key = int(seeds[pos].view(np.int64))
                        if (pos, key) not in common:
                            continue
                        if common[pos, key]:
                            keys = window_hashes(words[low : high + least], least).view(np.int64).tolist()
                            rows = [(doc, p, k, True, None, None, 0, 0) for p, k in zip(range(low, high + 1), keys, strict=True)]
                        else:
                            before, after = (_words(data, bounds, *x) for x in ((max(0, pos - (least - seed)), pos), (pos, pos + least)))
                            rows = [(doc, pos, key, False, before, after, pos - low, pos - high)]
                        for column, values in zip(out, zip(*rows, strict=True), strict=True):
                            column += values
                types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in AROUND.split(", ")])

    return run


AROUND = "doc_id long, pos int, key long, common boolean, before binary, after binary, back int, ahead int"


def _words(data: bytes, bounds: tuple[np.ndarray, np.ndarray], low: int, high: int) -> bytes:
    """Words low to high of a text, each with one space behind it."""
    return b"".join(data[s:e] + b" " for s, e in zip(bounds[0][low:high].tolist(), bounds[1][low:high].tolist(), strict=True))


def _codes(column: pa.ChunkedArray, width: int, backwards: bool = False) -> np.ndarray:
    """A number for each different word, one row of `width` for each row; places without a word have numbers of their own."""
    lists = pc.split_pattern(column.combine_chunks(), b" ")
    sizes = lists.value_lengths().to_numpy() - 1  # behind the last space is nothing
    codes = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    place = np.arange(width)[None, :]
    at = starts[:, None] + (sizes[:, None] - 1 - place if backwards else place)
    out = -1 - np.arange(len(sizes) * width).reshape(len(sizes), width)
    inside = place < sizes[:, None]
    out[inside] = codes[at[inside]]
    return out


def agreement(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows sorted by their words, and how many first words each row shares with the row before it there."""
    order = np.lexsort(codes.T[::-1]) if codes.shape[1] else np.arange(len(codes))
    ranked = codes[order]
    shared = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        shared[1:] = np.cumprod(ranked[1:] == ranked[:-1], axis=1).sum(axis=1)
    return order, shared


def common_passages(right: np.ndarray, left: np.ndarray, doc: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """first[i, k]: the smallest document that holds the passage k words before suffix i, or -1 where it's in one document.

    right holds the words from each suffix on, left those before it, backwards; only passages between back and ahead are
    looked at, which are the same for all suffixes that hold the passage.
    """
    n, least, reach = len(doc), right.shape[1], left.shape[1]
    first = np.full((n, reach + 1), -1, dtype=np.int64)
    (by_right, right_shared), (by_left, left_shared) = agreement(right), agreement(left)
    right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for k in range(reach + 1):
        some = np.flatnonzero((ahead <= k) & (k <= back))
        if not len(some):
            continue
        right_class[by_right] = np.cumsum(right_shared < least - k)
        left_class[by_left] = np.cumsum(left_shared < k)
        both = right_class[some] * (n + 1) + left_class[some]
        order = np.lexsort((doc[some], both))
        ranked, docs = both[order], doc[some][order]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        ends = np.append(starts[1:], len(order)) - 1
        low = np.where(docs[starts] != docs[ends], docs[starts], -1)
        first[some[order], k] = np.repeat(low, ends - starts + 1)
    return first


def _extended(least: int, seed: int):
    """Runs of repeated passages (doc_id, low, high, first) of the suffixes of whole seeds in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        doc, pos, back, ahead = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "pos", "back", "ahead"))
        first = common_passages(_codes(table.column("after"), least), _codes(table.column("before"), least - seed, True), doc, back, ahead)
        # Passages in a row with the same first document are one run; from the left, they begin at pos - reach.
        first = first[:, ::-1]
        edge = np.full((len(doc), 1), -1)
        begins = (first >= 0) & (first != np.hstack([edge, first[:, :-1]]))
        ends = (first >= 0) & (first != np.hstack([first[:, 1:], edge]))
        (row, low), (_, high) = np.nonzero(begins), np.nonzero(ends)
        reach = least - seed
        out = [doc[row], (pos[row] - reach + low).astype(np.int32), (pos[row] - reach + high).astype(np.int32), first[row, low]]
        for at in range(0, len(row), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536]) for x in out], [x.split()[0] for x in RUN.split(", ")])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition (key, doc_id, pos) whose run of equal keys holds two documents.

    first is the smallest document of the run, and common whether it is at an end of the partition or longer than
    GROUP_ROWS.  The runs at either end may go on in other partitions: edge tells them from the rest, all their rows are
    given, and first is null.
    """
    held = list(batches)
    if not held or not sum(b.num_rows for b in held):
        return
    key, doc, pos = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lengths = np.diff(np.append(starts, len(key)))
    low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    edge = np.zeros(len(starts), dtype=bool)
    edge[[0, -1]] = True
    kept = np.repeat((low != high) | edge, lengths)
    out = [key[kept], doc[kept], pos[kept], np.repeat(low, lengths)[kept], np.repeat(edge, lengths)[kept], np.repeat(edge | (lengths > GROUP_ROWS), lengths)[kept]]
    for at in range(0, len(out[0]), 65536):
        k, d, p, f, e, c = (x[at : at + 65536] for x in out)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d), pa.array(p), pa.array(f, mask=e), pa.array(e), pa.array(c)], ["key", "doc_id", "pos", "first", "edge", "common"])


def sorted_neighbours(rows: DataFrame) -> DataFrame:
    """(key, doc_id, pos, first, common) of the rows whose key occurs in two documents; rows must be staged."""
    n = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PARTITION_ROWS + 1)
    ordered = rows.select("key", "doc_id", "pos").repartitionByRange(parts, "key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos")
    found = staged(ordered.mapInArrow(_neighbours, "key long, doc_id long, pos int, first long, edge boolean, common boolean"))
    # Two runs for each partition at most, each counted as one row before the exchange.
    ends = found.where("edge").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    known = found.join(F.broadcast(ends.select("key", "low")), "key", "left")
    return known.select("key", "doc_id", "pos", F.coalesce("first", "low").alias("first"), "common").where("first is not null")


def suffix_array_dedup(docs: DataFrame, least: int = LEAST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal spans of words, at least `least` long, made of passages that also occur in another document.

    One row per span: doc_id, start_word, end_word (exclusive), n_words, first_doc (the smallest document seen with one of
    its passages), kept (the parts of the span, as start_word and end_word, whose passages have doc_id itself as their
    smallest document) and keep (whether there are any).  Each passage stays whole in the kept parts of its smallest
    document; the other words of spans can go.  Words are runs of characters other than white space, as they
    stand.  Null, empty and shorter texts have no span; repetition inside one document alone is none; rows without a
    doc_id take no part; rows that share a doc_id count as one document.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    suffixes = staged(docs.mapInArrow(_suffixes(least, seed), "key long, doc_id long, pos int"))
    places = sorted_neighbours(suffixes).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "key", "common")).alias("found"))  # one document's suffixes
    around = staged(docs.join(places, "doc_id").select("doc_id", "text", "found").mapInArrow(_around(least, seed), AROUND))
    rare = around.where("not common")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rare.count() // SUFFIX_ROWS + 1)
    runs = rare.repartition(parts, "key").select("doc_id", "pos", "before", "after", "back", "ahead").mapInArrow(_extended(least, seed), RUN)
    spread = sorted_neighbours(around.where("common").select("key", "doc_id", "pos"))
    runs = runs.unionByName(spread.select("doc_id", F.col("pos").alias("low"), F.col("pos").alias("high"), "first"))
    w = Window.partitionBy("doc_id").orderBy("low", "high", "first")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("first") == F.col("doc_id")
    new = F.coalesce(F.col("low") > F.max("high").over(ahead) + least, F.lit(True))
    new_own = F.coalesce(own & (F.col("low") > F.max(F.when(own, F.col("high"))).over(ahead) + least), own)
    runs = runs.withColumns({"new": new, "new_own": new_own, "own_low": F.when(own, F.col("low")), "own_high": F.when(own, F.col("high"))})
    runs = runs.withColumns({"span": F.sum(F.col("new").cast("int")).over(w), "part": F.sum(F.col("new_own").cast("int")).over(w)})
    parts = runs.groupBy("doc_id", "span", "part").agg(*(f(c).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.min, "first"), (F.min, "own_low"), (F.max, "own_high"))))
    part = F.struct(F.col("own_low").cast("long").alias("start_word"), (F.col("own_high") + least).cast("long").alias("end_word"))
    spans = parts.groupBy("doc_id", "span").agg(
        F.min("low").cast("long").alias("start_word"), (F.max("high") + least).cast("long").alias("end_word"), F.min("first").alias("first_doc"),
        F.sort_array(F.collect_list(F.when(F.col("own_low").isNotNull(), part))).alias("kept"),
    )
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc", (F.size("kept") > 0).alias("keep"), "kept")
