"""Best-fit packing of token sequences by a plan over the histogram of lengths.

The planner never sees a document.  It works through the counts of the lengths, longest first, and puts all pieces of
one length at once into the ranges of sequences whose free room fits tightest.  Its output is a list of slots: "pieces
of this length with ranks from .. to .. take sequences from .. on, at this offset".  The list depends on the number of
distinct lengths (2048 at most), not on the number of documents.  Documents then take their slots by a join on
(length, rank), ranks being dealt in salted groups so that a frequent length is never one task.
"""

from __future__ import annotations

import ctypes
import importlib.util
import json
import os
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

CAPACITY = 2048
#: Groups into which the pieces of one length are dealt for ranking.
SALTS = 256
#: Pieces of text that a partition keeps encoded (about 90 MB), those that stay in its worker after it, and the longest that is kept.
CACHE_ENTRIES, KEPT_ENTRIES, CACHE_LENGTH = 500_000, 150_000, 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, rank_from long, rank_to long, per_sequence long, first_sequence long, first_offset long"

_tokenizers: dict = {}
_mergers: dict = {}
_specials: dict = {}
_encoded: dict = {}


def _tokenizer(path: str):
    """One tokenizer for each Python worker, single-threaded."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Fixed value: how byte-level tokenizers split a text before merging.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _merger(path: str):
    """A function from a cut to its ids: the tokenizer's own vocabulary merged by tiktoken, which is four times as fast.

    Only for plain byte-level BPE whose ids follow the order of merges; otherwise, or without tiktoken, None.
    """
    if path not in _mergers:
        _mergers[path] = None
        spec = json.loads(_tokenizer(path).to_str())
        pre, model, vocab = spec.get("pre_tokenizer") or {}, spec["model"], spec["model"]["vocab"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges")
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        rising = all(vocab[a] < vocab[b] for a, b in zip(merged, merged[1:], strict=False))
        if plain and rising and importlib.util.find_spec("tiktoken"):
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [b for b in range(256) if b not in shown]
            byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}
            special = {t["content"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
            _mergers[path] = tiktoken.Encoding("cuts", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _specials[path] = tuple(special)
    return _mergers[path]


def _to_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Marks the first cut of a text, which has no space before it.
_FIRST = "\x01"


def _cuts(text: str) -> list[str] | None:
    """The text cut before every space and line feed, spaces left out; None where cuts could share a token.

    Single spaces and single line feeds between other characters must be the only white space.
    """
    if not text or text[0].isspace() or text[-1].isspace() or _FIRST in text:
        return None
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return None
    found = text.replace("\n", " \n").split(" ")
    if len(found) != len(text.split()):  # other white space inside a cut
        return None
    found[0] = _FIRST + found[0]
    return found


def _as_text(cut: str) -> str:
    return cut if cut[0] == "\n" else cut[1:] if cut[0] == _FIRST else " " + cut


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers.

    The pre-tokenizer always starts a new token at a space before a word and at a lone line feed.  A text with no other
    white space is therefore cut there, and each distinct cut is encoded once per worker; other texts go to the
    tokenizer whole.
    """
    tokenizer, cache = _tokenizer(path), _encoded.setdefault(path, {})
    merge = _merger(path)
    special = _specials.get(path, ())
    cuts = [None if any(t in text for t in special) else _cuts(text) for text in texts]
    distinct: set[str] = set()
    for found in cuts:
        if found:
            distinct.update(found)
    missing = [x for x in distinct if x not in cache]
    if merge:
        for x in missing:
            cache[x] = _to_bytes(merge(_as_text(x)))
    for at in range(0, 0 if merge else len(missing), 4096):
        part = missing[at : at + 4096]
        for x, e in zip(part, tokenizer.encode_batch_fast([_as_text(x) for x in part], add_special_tokens=False), strict=True):
            cache[x] = _to_bytes(e.ids)
    out = [
        _to_bytes(tokenizer.encode(text, add_special_tokens=False).ids) if found is None else b"".join(map(cache.__getitem__, found))
        for text, found in zip(texts, cuts, strict=True)
    ]
    for x in missing:
        if len(x) > CACHE_LENGTH:
            del cache[x]
    if len(cache) > CACHE_ENTRIES:
        release(path)
    return out


def release(path: str) -> None:
    """Give back what was encoded, but for the first pieces, which are mostly frequent ones: a worker lives on after its partition and does other stages' work."""
    cache = _encoded.get(path, {})
    if len(cache) > KEPT_ENTRIES:
        _encoded[path] = dict(islice(cache.items(), KEPT_ENTRIES))
        cache.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # else freed memory stays with the process
        if trim:
            trim(0)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of capacity at the end, the rest first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(path: str, end_id: int, capacity: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]
                rows: list[tuple] = []
                for doc, data in zip(ids, encode_texts(texts, path), strict=True):
                    data += end
                    for k, (start, length) in enumerate(cut_points(len(data) // 4, capacity)):
                        rows.append((doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        release(path)

    return run


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document's token ids, end_id included.  Null text counts as empty: one piece, end_id alone."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, rank_from, rank_to, per_sequence, first_sequence, first_offset) for counts[length] pieces.

    Sequences with equal free room are kept as ranges of numbers.  Lengths are taken from the longest; each fills the
    tightest ranges first, as many pieces to a sequence as fit, then opens new sequences.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> (first sequence, sequences)
    rooms: list[int] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not ranges[room]:
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    rooms.pop(at)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                slots.append((length, rank, rank + left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
            elif full < n:
                put(room, first + full, n - full)
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (columns of PIECES).

    Repeated rows each get a place of their own.  An empty table gives an empty table.  Rows of equal length are told
    apart by (doc_id, piece, ids_crc32), so a rerun gives the same places up to the exchange of equal rows.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    cells = staged(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan_best_fit(counts, capacity), SLOTS)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    # The plan has a few rows for each of at most `capacity` lengths, whatever the number of documents.
    s = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    placed = ranked.join(s, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    k = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(k / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + k % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack docs.  Only id_col and text_col are read, so other columns of any name do no harm.

    Tokens are computed once and staged; the histogram, the ranks and the join read the small staged table.
    """
    return pack(staged(pieces_of(docs, tokenizer_path, end_id, capacity, id_col, text_col)), capacity)
