"""Periodic runs of words within documents: repeated k-gram masking, then Main-Lorentz on what is left.

A run is a stretch of words with smallest period q and at least max(least, exponent * q) words that no neighbouring word
extends.  Its words from the first to the q-th last come again q words later, so all k-grams in it occur twice in the
document, k being the fewest words that such a stretch shares with its own shift.  k-grams that occur once therefore cut
a document into segments that no run crosses.  Most documents have no segment at all.

Segments are searched by divide and conquer: a run that crosses the middle of a block has a square that begins or ends
there.  All blocks of one size, and all their periods, are looked at in one step, by prefix hashes; each square found is
then extended by comparing words, so that a collision of hashes costs time and changes no result.

A document is the work of one task and nothing is shuffled.  Memory is a few arrays of the length of a few hundred
documents, or of one long one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import words_of

LEAST, EXPONENT = 6, 4
#: Words of documents that are searched together, and rows taken from a batch at once.
GROUP_WORDS, GROUP_ROWS = 200_000, 512
RUN = "struct<start: bigint, length: bigint, period: bigint>"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def least_overlap(least: int = LEAST, exponent: int = EXPONENT) -> int:
    """The fewest words that a run and its shift by one period share, over all periods.

    The search needs exponent >= 4: of a run with four periods two lie on one side of any place in it.
    """
    if exponent < 4 or least < 3:
        raise ValueError("exponent must be at least 4, least at least 3")
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scattered 64-bit numbers for small ones."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 .. n - 1, modulo 2^64."""
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def surviving_segments(ids: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int]]:
    """[from, to) of the stretches whose k-grams all occur twice or more in their document.

    ids are words, doc is the document of each (rising).  A collision can only make a segment longer.
    """
    n = len(ids) - k + 1
    if n < 2:
        return []
    scattered, gram = _mixed(ids), np.zeros(n, dtype=np.uint64)
    for i in range(k):
        gram = gram * np.uint64(_BASE) + scattered[i : i + n]
    gram ^= _mixed(doc[:n])
    inside = doc[:n] == doc[k - 1 :]
    order = np.argsort(gram, kind="stable")
    order = order[inside[order]]
    sorted_grams = gram[order]
    same = sorted_grams[1:] == sorted_grams[:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([False], twice, [False])).astype(np.int8)))
    found = []
    for low, high in edges.reshape(-1, 2).tolist():
        found.append((low, high + k - 1))
    return found


def _reach(x: np.ndarray, at: int, p: int, step: int) -> int:
    """How many of the positions at, at + step, ... have the word that comes p later."""
    n, size = 0, 32
    limit = len(x) - p - at if step > 0 else at + 1
    while n < limit:
        size = min(size, limit - n)
        low = at + n if step > 0 else at - n - size + 1
        differ = np.flatnonzero(x[low : low + size] != x[low + p : low + p + size])
        if differ.size:
            return n + int(differ[0] if step > 0 else size - 1 - differ[-1])
        n, size = n + size, size * 4
    return n


def main_lorentz(x: np.ndarray, longest: int, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of x; longest: no run has more words than this.

    Blocks are taken from the largest size down, so that a long run is known before the small blocks inside it.
    """
    n = len(x)
    if n < least:
        return []
    size = 1 << (n - 1).bit_length()
    padded = np.concatenate([x, -2 - np.arange(size - n + 1)])  # words of their own, equal to nothing
    power = _powers(size + 1)
    # at[i]: hash of the first i words; of two equal stretches, p words apart, the later hash is the earlier times power[p].
    at = np.zeros(size + 1, dtype=np.uint64)
    at[1:] = np.cumsum(_mixed(padded[:size]) * power[:size], dtype=np.uint64)
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)  # period -> (start, end), sorted

    def covering(p: int, low: int, high: int) -> tuple[int, int] | None:
        """The known run of period p that holds [low, high); two runs of one period share less than p words."""
        runs = known.get(p)
        if runs:
            k = bisect_right(runs, (low, len(padded))) - 1
            if k >= 0 and runs[k][1] >= high:
                return runs[k]
        return None

    def note(p: int, start: int, end: int) -> None:
        runs = known[p]
        k = bisect_right(runs, (start, end))
        if not k or runs[k - 1] != (start, end):
            runs.insert(k, (start, end))

    while size >= least:
        most = min(size, longest) // exponent
        if most:
            blocks = np.lib.stride_tricks.as_strided(at, (-(-n // size), size + 1), (size * at.itemsize, at.itemsize))
            half, p = size // 2, np.arange(1, most + 1)
            middle = blocks[:, half : half + 1]
            raised = power[p]
            right = (blocks[:, half + p] - middle) * raised == blocks[:, half + 2 * p] - blocks[:, half + p]
            left = (blocks[:, half - p] - blocks[:, half - 2 * p]) * raised == middle - blocks[:, half - p]
            for squares, shift in ((right, 0), (left, 1)):
                rows, periods = np.nonzero(squares)
                if not rows.size:
                    continue
                cuts = np.flatnonzero(np.diff(rows, prepend=-1))
                for low, high in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                    m = int(rows[low]) * size + half
                    left_over = periods[low:high] + 1
                    while left_over.size:
                        q, left_over = int(left_over[0]), left_over[1:]
                        first = m - 2 * q * shift  # where the square begins
                        stretch = covering(q, first, first + 2 * q)
                        if stretch is None:
                            ahead = _reach(padded, first, q, 1)
                            if ahead < q:  # hashes collided
                                continue
                            start, end = stretch = first - (_reach(padded, first - 1, q, -1) if first else 0), first + ahead + q
                            if end - start >= max(least, exponent * q):
                                note(q, start, end)
                        # A square inside this stretch whose period is a multiple of q has no smallest period.
                        inside = (m - 2 * left_over >= stretch[0]) if shift else (m + 2 * left_over <= stretch[1])
                        left_over = left_over[~(inside & (left_over % q == 0))]
        size //= 2
    smallest: dict[tuple[int, int], int] = {}
    for q in sorted(known):
        for start, end in known[q]:
            smallest.setdefault((start, end - start), q)
    return sorted((start, length, q) for (start, length), q in smallest.items())


def runs_of_documents(words: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each document, (start, length, period) of its runs by start, then period."""
    k = least_overlap(least, exponent)
    number: dict[bytes, int] = {}
    for x in words:
        number.update(dict.fromkeys(x))
    for i, w in enumerate(number):
        number[w] = i
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((number[w] for x in words for w in x), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(words)), lengths)
    first = np.cumsum(lengths) - lengths
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    segments = surviving_segments(ids, doc, k)
    if not segments:
        return out
    # Segments stand behind each other, parted by words that equal nothing.
    parts, begins, at = [], [], 0
    for i, (low, high) in enumerate(segments):
        parts += [ids[low:high], np.array([len(number) + i])]
        begins.append(at)
        at += high - low + 1
    for start, length, period in main_lorentz(np.concatenate(parts), max(high - low for low, high in segments), least, exponent):
        s = bisect_right(begins, start) - 1
        place = segments[s][0] + start - begins[s]
        d = int(doc[place])
        out[d].append((place - int(first[d]), length, period))
    return [sorted(set(x), key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _search(least: int, exponent: int, schema: pa.Schema):
    def table(kept: list[tuple], found: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
        columns = list(zip(*[key for key, _ in kept], strict=True))
        runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in found], schema.field("runs").type)
        texts = pa.array([collapsed(w, r) for (_, w), r in zip(kept, found, strict=True)], pa.binary())
        counts = pa.array([len(w) for _, w in kept], pa.int64())
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)]
        return pa.RecordBatch.from_arrays([*arrays, counts, runs, texts], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                *keys, texts = (c.to_pylist() for c in part.columns)
                kept, n = [], 0
                for i, text in enumerate(texts):
                    words = (text or b"").split()  # of bytes: at U+0009 to U+000D and spaces only
                    kept.append((tuple(c[i] for c in keys), words))
                    n += len(words)
                    if n >= GROUP_WORDS:
                        yield table(kept, runs_of_documents([w for _, w in kept], least, exponent))
                        kept, n = [], 0
                if kept:
                    yield table(kept, runs_of_documents([w for _, w in kept], least, exponent))

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, runs (by start, then period) and collapsed, the text without repetitions.

    Words are stretches of characters other than U+0020 and U+0009 to U+000D.  Null and blank texts have no words: no runs,
    an empty collapsed text.  Repeated rows and rows without an id each get their row; an empty table gives an empty table.
    Only id_col and text_col are read, so other columns of any name do no harm.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary()),
        ]
    )
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = given.mapInArrow(_search(least, exponent, schema), f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def highest_exponent(runs: Column) -> Column:
    """Of runs by start, then period, the first of those with greatest length / period; null where there are none."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col of docs, a tenth of the texts made periodic from some word on, by the crc32 of their id.

    For h = crc32(id in decimals), h % 10 = 0, g = h div 10 and n > 0 words, each word i >= a becomes word a + (i - a) % p
    with a = g % n and p = 1 + (n - a) div (3 + g % 8).  Words are then parted by one space.  Rows without an id stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(id_col, text_col, h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col(text_col)))).withColumn("g", F.floor(F.col("h") / 10))
    n = F.size("w").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select(id_col, F.when(F.col("a").isNotNull(), F.concat_ws(" ", again)).otherwise(F.col(text_col)).alias(text_col))
