"""Alignment of two tokenizers' tokens over the same bytes, with counts of aligned pairs over all documents.

Token A and token B of a text are linked where their byte ranges overlap.  Links make a bipartite graph; its connected
components, found by union-find, are the smallest groups of A and B tokens that cover the same bytes.

Both tokenizers start a new token at a single space or line feed between two other characters, so texts are cut there
and each distinct cut is aligned once for each Python worker.  A block of documents (bounded in characters) is kept as
one dictionary of its distinct cuts and, for each document, the numbers of its cuts.  Pairs are counted within blocks
first, then over all blocks.  The counts come back to a block by a join on its distinct pairs, so neither links nor
texts are shuffled, and nothing is broadcast.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.packing import _merger, _tokenizer

#: Characters of a block's documents, at least; rows of one batch that are cut at once.
BLOCK_CHARS, ROWS = 8_000_000, 256
#: Distinct cuts that one Python worker keeps aligned, and the longest that it keeps.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 64

#: Characters beside which a space or line feed is white space to neither regular expressions nor tokenizers.
_PLAIN = "!-~\u00a1-\u167f\u3001-\ud7ff"
_SAFE = re.compile(f"(?<=[{_PLAIN}])(?=[ \n][{_PLAIN}])")
_ODD = re.compile(f"[^{_PLAIN} \n]|[ \n](?![{_PLAIN}])")
_CUT = re.compile("[ \n][^ \n]+")

BLOCKS = "block long, doc_id long, codes binary, sizes binary, link_pairs binary, link_starts binary, pairs array<struct<a: int, b: int, n: bigint>>"
_BLOCKS = pa.schema(
    [
        ("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("sizes", pa.binary()), ("link_pairs", pa.binary()), ("link_starts", pa.binary()),
        ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))),
    ]
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0 .. n - 1 and edges u - v: union-find, all edges at once."""
    root = np.arange(n)
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def cuts_of(text: str) -> list[str]:
    """A space and text, cut where both tokenizers start a new token."""
    whole = " " + text
    return _SAFE.split(whole) if _ODD.search(whole) else _CUT.findall(whole)


@functools.cache
def _byte_tokenizer(path: str):
    """(texts -> lists of ids, bytes of each id) of a byte-level tokenizer; special tokens' strings are plain text."""
    tokenizer = _tokenizer(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    data = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        data[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    merge = _merger(path)
    if merge:
        return (lambda texts: list(map(merge, texts))), data
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return (lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]), data


@functools.cache
def _piece_tokenizer(path: str):
    """(texts -> lists of ids, bytes of each id, whether cuts are safe) of a sentencepiece model that puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    data = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    # No piece reaches over a space or a line feed from another character, so no merge does.
    safe = not any("▁" in p.lstrip("▁") or " " in p or "\n" in p for p in pieces)
    # What is put before a text, so that it can be taken off where a text is no beginning.
    space = model.encode("\n")[:1]

    def encode(texts: list[str]) -> list[list[int]]:
        found = model.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1)
        return [ids if x[0] == " " else ids[1:] if ids[:1] == space else ids for x, ids in zip(texts, found, strict=True)]

    return encode, data, safe


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Aligner:
    """The alignments of cuts that a worker has seen, by a cut's number: (n_a, n_b, n_groups, n_links), and its links.

    A link is A's id << 32 | B's id, in the order of the text; where it is the first of its A token bit 0 is set in
    `first`, of its B token bit 1.  Both are set where a group begins.
    """

    def __init__(self, byte_path: str, piece_path: str):
        self.encode_a, self.bytes_a = _byte_tokenizer(byte_path)
        self.encode_b, self.bytes_b, self.safe = _piece_tokenizer(piece_path)
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bad: set[int] = set()
        self.sizes, self.links, self.first = [np.empty((0, 4), np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]

    def cuts(self, text: str) -> list[str]:
        return cuts_of(text) if self.safe else [" " + text]

    def _given_back(self, cuts: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Whether both tokenizers give each cut back byte by byte."""
        return [b"".join([self.bytes_a[i] for i in a]) == x.encode("utf-8", "surrogatepass") == b"".join([self.bytes_b[i] for i in b]) for x, a, b in zip(cuts, ids_a, ids_b, strict=True)]

    def learn(self, cuts: list[str]) -> None:
        """Align new cuts.  One that a tokenizer does not give back gets no tokens and is bad."""
        if not cuts:
            return
        ids_a, ids_b = self.encode_a(cuts), self.encode_b(cuts)
        n_a, n_b, a, b, ends_a, ends_b = self._tokens(ids_a, ids_b)
        sizes = np.zeros((len(cuts), 4), np.int32)
        # All at once, as nearly all are given back; else one by one.
        whole = "".join(cuts).encode("utf-8", "surrogatepass")
        last = np.cumsum(np.fromiter((len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in cuts), np.int64, len(cuts)))
        same = bool(n_a.all() and n_b.all()) and np.array_equal(ends_a[np.cumsum(n_a) - 1], last) and np.array_equal(ends_b[np.cumsum(n_b) - 1], last)
        if not (same and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole == b"".join(map(self.bytes_b.__getitem__, b.tolist()))):
            kept = self._given_back(cuts, ids_a, ids_b)
            self.bad.update(len(self.number) + i for i, k in enumerate(kept) if not k)
            ids_a, ids_b = ([x if k else [] for x, k in zip(ids, kept, strict=True)] for ids in (ids_a, ids_b))
            n_a, n_b, a, b, ends_a, ends_b = self._tokens(ids_a, ids_b)
        # Between two neighbouring ends of any token lies one overlap, of one A and one B token.
        ends = np.union1d(ends_a, ends_b)
        u, v = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        root = components(len(a) + len(b), u, v + len(a))
        begins = np.diff(root[: len(a)], prepend=-1) != 0  # groups are stretches of tokens
        new_a, new_b = np.diff(u, prepend=-1) != 0, np.diff(v, prepend=-1) != 0
        sizes[:, 0], sizes[:, 1] = n_a, n_b
        cut_of_a = np.repeat(np.arange(len(cuts)), n_a)
        sizes[:, 2] = np.bincount(cut_of_a[begins], minlength=len(cuts))
        sizes[:, 3] = np.bincount(cut_of_a[u], minlength=len(cuts))
        self.number.update(zip(cuts, range(len(self.number), len(self.number) + len(cuts)), strict=True))
        self.sizes.append(sizes)
        self.links.append((a[u] << 32) | b[v])
        self.first.append(new_a.astype(np.uint8) | (new_b.astype(np.uint8) << 1))

    def _tokens(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[np.ndarray, ...]:
        """Tokens for each cut, all ids, and where each token ends in the joined bytes of the cuts, for A and B."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        return n_a, n_b, a, b, np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])

    def codes(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The numbers of each text's cuts; None for texts without tokens."""
        cut = [self.cuts(x) if x else None for x in texts]
        distinct: set[str] = set()
        for x in cut:
            if x:
                distinct.update(x)
        self.learn([x for x in distinct if x not in self.number])
        out: list[np.ndarray | None] = []
        for x in cut:
            numbers = None if x is None else list(map(self.number.__getitem__, x))
            out.append(None if numbers is None or (self.bad and not self.bad.isdisjoint(numbers)) else np.array(numbers, np.int32))
        return out

    def trim(self) -> None:
        """Forget everything where much is kept: many cuts, or one that is very long."""
        if len(self.number) > CACHE_ENTRIES or any(len(x) > CACHE_LENGTH for x in self.number):
            self.clear()

    def block(self, block: int, ids: list[int | None], codes: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
        """A row for each document and one for the dictionary of their cuts."""
        self.sizes, self.links, self.first = [np.concatenate(self.sizes)], [np.concatenate(self.links)], [np.concatenate(self.first)]
        there = [x for x in codes if x is not None]
        used, local, times = np.unique(np.concatenate(there) if there else np.empty(0, np.int32), return_inverse=True, return_counts=True)
        sizes = self.sizes[0][used]
        n_links = self.sizes[0][:, 3].astype(np.int64)
        at_links = _ragged((np.cumsum(n_links) - n_links)[used], n_links[used])
        keys, place = np.unique(self.links[0][at_links], return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, place, np.repeat(times, sizes[:, 3]))
        local, at, rows = local.astype("<i4"), 0, []
        for x in codes:
            size = 0 if x is None else len(x)
            rows.append(local[at : at + size].tobytes())
            at += size
        for low in range(0, len(ids), ROWS):
            part = slice(low, low + ROWS)
            given = {"block": [block] * len(ids[part]), "doc_id": ids[part], "codes": rows[part]}
            yield pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(ids[part]), f.type) for f in _BLOCKS], schema=_BLOCKS)
        pairs = pa.StructArray.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])
        one = {
            "block": pa.array([block]), "sizes": pa.array([sizes.astype("<i4").tobytes()]), "link_pairs": pa.array([place.astype("<i4").tobytes()]), "link_starts": pa.array([self.first[0][at_links].tobytes()]),
            "pairs": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pairs),
        }
        yield pa.RecordBatch.from_arrays([one[f.name].cast(f.type) if f.name in one else pa.nulls(1, f.type) for f in _BLOCKS], schema=_BLOCKS)


_aligners: dict[tuple[str, str], _Aligner] = {}


def _blocks(byte_path: str, piece_path: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligners.setdefault((byte_path, piece_path), _Aligner(byte_path, piece_path))
        block, chars, ids, codes = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                ids += part.column(0).to_pylist()
                codes += aligner.codes(texts)
                chars += sum(len(x) for x in texts if x)
                at += ROWS
                if chars >= block_chars:
                    yield from aligner.block(block, ids, codes)
                    block, chars, ids, codes = block + 1, 0, [], []
                    aligner.trim()
        if ids:
            yield from aligner.block(block, ids, codes)
        aligner.trim()

    return run


def cut_blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of BLOCKS: each document's cuts by number, and each block's dictionary of cuts (doc_id and codes null)."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(_blocks(byte_path, piece_path, block_chars), BLOCKS)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """block, k, a, b, n: how many links of the block hold A id a and B id b linked."""
    return blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("k", "p")).select("block", "k", "p.a", "p.b", "p.n")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count over all documents, best: whether the count is the highest of b.  A B id has at most as many rows as A has ids."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _written(pairs: np.ndarray, a: np.ndarray, b: np.ndarray, starts: np.ndarray, n_groups: np.ndarray) -> list[str]:
    """The groups of each cut as text, from the links' pairs (ids a and b by pair) in order and what begins at each.

    Most groups are one token each side, so their text is that of their pair and is made once.
    """
    group = np.flatnonzero(starts == 3)
    first_a, first_b = (starts & 1) > 0, (starts & 2) > 0
    # How many tokens of either kind stand before each group.
    before_a, before_b = (np.append((np.cumsum(first) - 1)[group], np.count_nonzero(first)) for first in (first_a, first_b))
    single = (np.diff(before_a) == 1) & (np.diff(before_b) == 1)
    out = np.empty(len(group), object)
    out[single] = np.array([f"{x}|{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)], object)[pairs[group[single]]]
    tokens_a, tokens_b = a[pairs[first_a]], b[pairs[first_b]]
    many = np.flatnonzero(~single)
    bounds = zip(before_a[many].tolist(), before_a[many + 1].tolist(), before_b[many].tolist(), before_b[many + 1].tolist(), strict=True)
    out[many] = [",".join(map(str, tokens_a[i:j].tolist())) + "|" + ",".join(map(str, tokens_b[k:m].tolist())) for i, j, k, m in bounds]
    groups, ends = out.tolist(), np.cumsum(n_groups).tolist()
    return [";".join(groups[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def _sums(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with the counts of their links."""
    known = pc.is_valid(rows.column("sizes"))
    head = rows.filter(known).to_pylist()[0]
    docs = rows.filter(pc.invert(known))
    sizes, pairs, starts = np.frombuffer(head["sizes"], "<i4").reshape(-1, 4).astype(np.int64), np.frombuffer(head["link_pairs"], "<i4"), np.frombuffer(head["link_starts"], np.uint8)
    order = np.argsort(counts.column("k").to_numpy())
    a, b, count, best = (counts.column(c).to_numpy(zero_copy_only=False)[order] for c in ("a", "b", "count", "best"))
    ends = np.cumsum(sizes[:, 3])

    def of_cuts(values: np.ndarray) -> np.ndarray:
        """Sums over the links of each cut."""
        before = np.concatenate(([0], np.cumsum(values[pairs])))
        return before[ends] - before[ends - sizes[:, 3]]

    per_cut = np.column_stack([sizes, of_cuts(best.astype(np.int64)), of_cuts(count)])
    written = _written(pairs, a, b, starts, sizes[:, 2])
    sums, groups = [], []
    for data in docs.column("codes").to_pylist():
        codes = np.frombuffer(data, "<i4")
        sums.append(per_cut[codes].sum(axis=0))
        groups.append(";".join(map(written.__getitem__, codes.tolist())))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    columns = np.array(sums, np.int64).reshape(-1, len(names)).T
    return pa.table({"doc_id": docs.column("doc_id"), **{c: pa.array(x) for c, x in zip(names, columns, strict=True)}, "groups": pa.array(groups, pa.string())})


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: numbers of A and B tokens, groups, links, links whose count is the highest of their B
    id (ties included), the sum of links' counts, and the groups themselves, `a1,a2|b1;a3|b2,b3` in order of the text.

    A are the tokens of a space and the text by the byte-level tokenizer at byte_path, B those of the text by the
    sentencepiece model at piece_path, which adds the space.  Texts that are null or empty, or that a tokenizer does not give
    back byte by byte, have no tokens: zeros and no groups, and count nowhere.  Repeated rows and rows without an id each get
    their row and count each time.  An empty table gives an empty table.  Only id_col and text_col are read.
    """
    blocks = staged(cut_blocks(docs, byte_path, piece_path, id_col, text_col, block_chars))
    pairs = block_pairs(blocks)
    counts = staged(pair_counts(pairs))
    counted = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "k", "a", "b", "count", "best")
    return blocks.drop("pairs").groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(_sums, ALIGNED)
