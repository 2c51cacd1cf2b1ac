"""Chat formatting by columnar byte assembly.

Rows of conversations are brought into order by a range partitioning over (conversation, turn), so that a conversation of
any size is dealt over tasks.  A batch of rows is then formatted at once: marks and escaped texts are Arrow columns, their
lengths give the offsets of all segments, and numpy scatters the bytes of each column into one preallocated buffer, which
is the data of the Arrow column that comes out.

The result are pieces: a conversation is one piece, or several where it is longer than a bound or lies on the edge of two
tasks.  Pieces of a conversation, in the order of `piece`, are its text without anything between.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: Rows and bytes of texts in one piece, about.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20


@dataclass(frozen=True)
class Template:
    """Marks before and after a turn's text, by role; other roles are named between `other` marks.

    Every mark is a control string.  Control strings inside texts and names get a backslash behind their first character;
    where backslashes stand there already, they get one more.  So no control string is left in a text, and taking one
    backslash off gives the text back.
    """

    roles: tuple[tuple[str, str, str], ...] = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    learned: str = "assistant"

    def __post_init__(self) -> None:
        marks = self.marks
        first = {x[0] for x in marks}
        if len(set(marks)) < len(marks) or any(len(x) < 2 or first & set(x[1:]) or "\\" in x for x in marks):
            raise ValueError("marks must differ, have two characters or more, no backslash, and begin with characters that stand nowhere else in marks")

    @property
    def marks(self) -> list[str]:
        return [m for _, *pair in self.roles for m in pair] + list(self.other)

    @property
    def _inside(self) -> tuple[str, str]:
        firsts = "".join(re.escape(c) for c in sorted({m[0] for m in self.marks}))
        rests = "|".join(re.escape(r) for r in sorted({m[1:] for m in self.marks}, key=lambda r: (-len(r), r)))
        return firsts, rests

    @property
    def control(self) -> str:
        """Pattern of what is escaped: a first character, backslashes, and the rest of a mark."""
        return "([{}])(\\\\*)({})".format(*self._inside)

    def escape(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, self.control, r"\1\\\2\3")

    def unescape(self, text: str) -> str:
        return re.sub("([{}])\\\\(\\\\*)({})".format(*self._inside), r"\1\2\3", text)

    def columns(self, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
        """Marks before the texts, escaped texts, marks after them, and whether a row is learned from."""
        names = pa.array([r for r, _, _ in self.roles])
        code = pc.index_in(roles, names)
        opened, shut = (pc.take(pa.array([r[k] for r in self.roles]), code) for k in (1, 2))
        named = pc.is_null(code)
        if pc.any(named).as_py():
            name = self.escape(pc.fill_null(roles, ""))
            opened = pc.if_else(named, pc.binary_join_element_wise(self.other[0], name, self.other[1], ""), opened)
            shut = pc.if_else(named, self.other[2], shut)
        learned = pc.fill_null(pc.equal(roles, self.learned), False).to_numpy(zero_copy_only=False)
        return opened, self.escape(texts), shut, learned

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        parts = re.split("({})".format("|".join(re.escape(m) for m in self.marks)), text)
        role_of, at = {opened: role for role, opened, _ in self.roles}, 1
        while at < len(parts):
            if parts[at] == self.other[0]:
                yield self.unescape(parts[at + 1]), self.unescape(parts[at + 3])
                at += 6
            else:
                yield role_of[parts[at]], self.unescape(parts[at + 1])
                at += 4


CHAT = Template()


def _lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, from its first value on, and each value's length."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return values, np.diff(at)


def assemble(columns: list[pa.Array], ends: np.ndarray) -> pa.Array:
    """Strings made of rows' columns side by side; string k has the rows from ends[k - 1] to ends[k]."""
    parts = [_lengths(c) for c in columns]
    sizes = np.stack([n for _, n in parts], axis=1)
    starts = np.concatenate(([0], np.cumsum(sizes.ravel())))
    out = np.empty(int(starts[-1]), np.uint8)
    for k, (values, n) in enumerate(parts):
        # Where each byte goes: its place in the column, shifted by as much as its segment is.
        source = np.cumsum(n) - n
        out[np.arange(len(values)) + np.repeat(starts[k : -1 : len(parts)] - source, n)] = values
    offsets = starts[np.concatenate(([0], ends)) * len(parts)]
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(out))


_PIECES = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.large_string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
PIECES = "conv_id long, piece long, n_turns long, formatted string, loss array<struct<start: bigint, end: bigint>>"


def format_rows(rows: pa.Table, template: Template, first_piece: int) -> pa.RecordBatch:
    """Pieces of rows (conv_id, role, text) in order: one for each stretch of a conversation, bounded in rows and bytes."""
    conv, role, text = (rows.column(c).combine_chunks() for c in ("conv_id", "role", "text"))
    text = pc.fill_null(text, "")
    opened, inner, shut, learned = template.columns(role, text)
    n = rows.num_rows
    ids, null = pc.fill_null(conv, 0).to_numpy(), pc.is_null(conv).to_numpy(zero_copy_only=False)
    bulk = np.cumsum(pc.binary_length(inner).to_numpy().astype(np.int64)) // PIECE_BYTES
    place = np.arange(n)
    other = np.ones(n, bool)
    other[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    since = place - np.maximum.accumulate(np.where(other, place, 0))
    new = other | (since % PIECE_ROWS == 0)
    new[1:] |= bulk[1:] != bulk[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    # Loss spans in code points from the beginning of the piece.
    chars = np.stack([pc.utf8_length(c).to_numpy().astype(np.int64) for c in (opened, inner, shut)], axis=1)
    before = np.cumsum(chars.sum(axis=1)) - chars.sum(axis=1)
    before = before - np.repeat(before[starts], ends - starts)
    low = before + chars[:, 0]
    spans = pa.StructArray.from_arrays([pa.array(low[learned]), pa.array((low + chars[:, 1])[learned])], ["start", "end"])
    bounds = np.concatenate(([0], np.cumsum(learned)))[np.concatenate(([0], ends))]
    columns = [
        conv.take(pa.array(starts)), pa.array(first_piece + np.arange(len(starts))), pa.array(ends - starts),
        assemble([opened, inner, shut], ends), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_PIECES)


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if not rows.num_rows:
                continue
            # The last conversation may go on in the next batch.
            conv = rows.column("conv_id").combine_chunks()
            last = conv[-1]
            same = pc.fill_null(pc.equal(conv, last), False) if last.is_valid else pc.is_null(conv)
            n = int(pc.sum(same).as_py())
            held = rows.slice(rows.num_rows - n) if n < PIECE_ROWS and rows.slice(rows.num_rows - n).nbytes < PIECE_BYTES else None
            now = rows.slice(0, rows.num_rows - (n if held is not None else 0))
            if now.num_rows:
                out = format_rows(now, template, piece)
                piece += out.num_rows
                yield out
        if held is not None:
            yield format_rows(held, template, piece)

    return run


def format_chat(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """Pieces of conversations: conv_id, piece (rising within a conversation), n_turns, formatted, loss.

    rows has conv_id, turn, role and text; other columns are not read.  Turns of a conversation are ordered by turn (null
    last), ties by role, then by the text's hash; repeated rows all stay.  Null texts and roles are empty.  Rows without a
    conv_id make one conversation.  loss are spans of `formatted` in code points, one for each turn of the learned role,
    that hold its escaped text.  An empty table gives an empty table.
    """
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The last key spreads repeated rows over tasks, whose order among themselves doesn't matter.
    order = [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("h1"), F.asc("h2"), F.asc("spread")]
    keyed = given.withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text"), "spread": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_format(template), PIECES)


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row() -> pa.RecordBatch:
            conv, turns, digest, loss, learned, chars = state
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            given = [pa.array([conv], pa.int64()), pa.array([turns]), pa.array([digest.hexdigest()]), pa.array([loss]), pa.array([learned.hexdigest()]), pa.array([chars])]
            return pa.RecordBatch.from_arrays(given, names)

        for batch in batches:
            for k in range(batch.num_rows):
                conv, text, spans = (batch.column(c)[k].as_py() for c in ("conv_id", "formatted", "loss"))
                if state is None or state[0] != conv:
                    if state is not None:
                        yield row()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = template.unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
        if state is not None:
            yield row()

    return run


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame, template: Template = CHAT) -> DataFrame:
    """For each conversation, what its formatted text says: number and sha256 of its turns (role, line feed, text, line feed),
    code points and sha256 of all that is learned from, and its length.

    A sha256 goes over a conversation from its beginning to its end, so its pieces pass through one task, one at a time.
    """
    kept = staged(pieces)
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss").mapInArrow(_read(template), READ)
