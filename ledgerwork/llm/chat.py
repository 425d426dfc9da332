"""Chat formatting by columnar byte assembly.

Every turn becomes

    <turn ROLE>\\n TEXT </turn>\\n

where ROLE and TEXT carry a backslash before each backslash, `<`, `>` and `#`, so no text can hold a
control string, and taking the backslashes away gives the text back. The loss mask of a
conversation covers the escaped text of its assistant turns, nothing of the markup.

The rows are spread by conversation and sorted by turn; a task streams them. Of each Arrow batch
the segment lengths, their cumulative offsets and the scatter indices are computed in numpy and
headers and contents are copied into one buffer that becomes the Arrow column. A conversation is
emitted in parts (one per batch it reaches into), so a very long one never is in memory whole.

Defined cases: a null text or role is empty; a null conversation id is a conversation of its own; rows of
a conversation with the same turn are ordered by role, then text; repeated rows are repeated turns; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.llm import runtime

LOSS_ROLE = "assistant"
BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT = b"<turn ", b">\n", b"</turn>\n"

_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b"\\<>#")] = True

PARTS = (
    "conv_id long, part long, last boolean, n_turns long, formatted string, "
    "spans array<struct<start: long, length: long>>"
)
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = runtime.text_bytes(column)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a backslash before each special one, and the new offsets."""
    special = _ESCAPED[data]
    added = np.concatenate(([0], np.cumsum(special)))
    # a byte moves by the backslashes before it, its own included
    at = np.arange(len(data)) + added[1:]
    out = np.full(len(data) + int(added[-1]), ord("\\"), np.uint8)
    out[at] = data
    return out, offsets + added[offsets]


def assemble(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of byte strings, row by row behind each other, in one new buffer: buffer, offset of each segment."""
    lengths = np.stack([np.diff(offsets) for _, offsets in segments], axis=1)
    starts = np.concatenate(([0], np.cumsum(lengths.ravel())))
    out = np.empty(starts[-1], np.uint8)
    place = starts[:-1].reshape(lengths.shape)
    for k, (data, offsets) in enumerate(segments):
        # scatter index of a byte: its own position, moved by as much as its segment is
        out[np.arange(len(data)) + np.repeat(place[:, k] - offsets[:-1], lengths[:, k])] = data
    return out, starts


def _constant(value: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(value, np.uint8), n), np.arange(n + 1, dtype=np.int64) * len(value)


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_PARTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("last", pa.bool_()),
        ("n_turns", pa.int64()),
        ("formatted", pa.string()),
        ("spans", pa.list_(_SPAN)),
    ]
)


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to parts of conversations. Every part but a conversation's last has `last` false."""
    held: pa.RecordBatch | None = None  # the last part so far: whether it was the last is known with the next row
    for batch in runtime.slices(batches, "text", 8 << 20):
        if not batch.num_rows:
            continue
        parts = _assembled(batch)
        if held is not None:
            same = held.column("conv_id")[0].as_py() == batch.column("conv_id")[0].as_py()
            yield _with_last(held, not same)
            if same:
                first = np.zeros(parts.num_rows, np.int64)
                first[0] = held.column("part")[0].as_py() + 1
                parts = parts.set_column(1, _PARTS.field("part"), pa.array(first))
        yield parts.slice(0, parts.num_rows - 1)
        held = parts.slice(parts.num_rows - 1)
    if held is not None:
        yield held


def _with_last(parts: pa.RecordBatch, last: bool) -> pa.RecordBatch:
    return parts.set_column(2, _PARTS.field("last"), pa.array([last] * parts.num_rows))


def _assembled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One part for each conversation of a batch of turns, each taken for its conversation's last.

    The buffer the turns are copied into is the data buffer of the column `formatted`; its offsets are those of
    the first turns."""
    n = batch.num_rows
    role, text = escape(*_bytes_and_offsets(batch.column("role"))), escape(*_bytes_and_offsets(batch.column("text")))
    fixed = [_constant(value, n) for value in (BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT)]
    out, starts = assemble([fixed[0], role, fixed[1], text, fixed[2]])
    ids = batch.column("conv_id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy()
    new = np.r_[True, (number[1:] != number[:-1]) | (known[1:] != known[:-1])]
    bounds = np.r_[np.flatnonzero(new), n]
    k = len(bounds) - 1
    learn = np.flatnonzero(pc.equal(batch.column("role"), LOSS_ROLE).fill_null(False).to_numpy(zero_copy_only=False))
    # characters before each byte: bytes that do not continue a UTF-8 character
    chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    begin, end = chars[starts[5 * learn + 3]], chars[starts[5 * learn + 4]]
    of = bounds[np.searchsorted(bounds, learn, "right") - 1]
    offsets = pa.py_buffer(starts[5 * bounds].astype(np.int32))
    formatted = pa.StringArray.from_buffers(k, offsets, pa.py_buffer(out))
    spans = pa.StructArray.from_arrays([pa.array(begin - chars[starts[5 * of]]), pa.array(end - begin)], fields=list(_SPAN))
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(learn, bounds).astype(np.int32)), spans)
    columns = [ids.take(pa.array(bounds[:-1])), pa.array(np.zeros(k, np.int64)), pa.array(np.ones(k, bool))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), formatted, spans], schema=_PARTS)


def format_chats(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) to parts of formatted conversations, in order within a partition.

    `spans` is the loss mask: start and length in characters of the part."""
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    spread = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return spread.select("conv_id", "role", "text").mapInArrow(_format, PARTS)


def unescape(text: str) -> str:
    """Every backslash away, whatever follows it kept."""
    pieces = text.split("\\\\")
    return "\\".join(piece.replace("\\", "") for piece in pieces)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    at = 0
    before, middle, after = (x.decode() for x in (BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT))
    while at < len(formatted):
        # no control string occurs inside an escaped role or text
        role_end = formatted.index(middle, at)
        text_end = formatted.index(after, role_end)
        yield (
            unescape(formatted[at + len(before) : role_end]),
            unescape(formatted[role_end + len(middle) : text_end]),
        )
        at = text_end + len(after)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_turns = loss_chars = chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            formatted = row["formatted"]
            chars += len(formatted)
            for role, text in read_turns(formatted):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in row["spans"]:
                learned = unescape(formatted[span["start"] : span["start"] + span["length"]])
                loss_chars += len(learned)
                loss.update(learned.encode())
            if row["last"]:
                rows.append((row["conv_id"], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                n_turns = loss_chars = chars = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: turns, learned text and length.

    `parts` is what `format_chats` returns, as it stands: parts of a conversation behind each other."""
    return parts.mapInArrow(_digest, DIGESTS)
