"""Fuzzy line dedup: of lines that are alike, over all documents, one stays.

Two lines are linked if the sets of their shingles of `CHARS` characters (A-Z as a-z; a shorter line
is one shingle) have a Jaccard similarity of 0.8 or more. Signatures are one-permutation MinHash: a
shingle's hash picks a place and offers its value there; empty places borrow from a place drawn
for them. 20 bands of three places miss a pair at 0.8 with probability 6e-7, closer pairs more rarely; the
sift of `near.links` has a margin of `MARGIN` deviations.
Equal lines are one item throughout: they meet in one shuffle, with their text, and only what they
have in common goes on. `near.links` compares whole lines and joins what is linked; of each component the
occurrence with the smallest document, row and line number stays.

Rows are told apart by their place in the input, whatever their ids. The input is read twice, and
each row's place is checked against a digest of its text before lines are taken out, so an input that comes in
another order the second time stops the job; write it to a table first.

Defined cases: lines end at a line feed; lines without a word are kept and never compared; null text
stays null; a document whose lines all go has the empty text and stays; rows with the same doc_id, or none, are
documents of their own (null ids first); other columns are passed through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwork.llm import near, runtime, shingles
from ledgerwork.llm.superminhash import band_keys, bytes_of

CHARS = 7
BANDS, ROWS = 20, 3
#: Places of a signature; the bands use the first of them, the sift all.
PLACES = 104
#: Standard deviations of the sift; places that borrow in short lines vary together, so more than for documents.
MARGIN = 8
#: Bytes of lines that one numpy step handles; its arrays hold some hundred times as many and stay in the cache.
SLICE = 1 << 17

_U = np.uint64
_NONE = np.uint32(0xFFFFFFFF)
_ALIKE = shingles.mix(np.arange(1, 1 << 16, dtype=_U))
_ALIKE = np.concatenate((shingles.mix(np.array([1 << 40], _U)), _ALIKE))
_ALIKE[65:91] = _ALIKE[97:123]

DISTINCT = "half_a long, half_b long, doc_id long, row long, line int, n long, text string"
PLACED = "row long, check long, line int, half_a long, half_b long"
SKETCH = "id long, bands array<long>"
SIGNED = "id long, size int, signature binary, bands32 binary"


def char_shingles(lines: list[str], size: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of every line in order, and n + 1 offsets."""
    lengths = np.array([len(x) for x in lines], np.int64)
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    each = _ALIKE[chars & 0xFFFF]
    high = chars >> 16
    if high.any():
        each = each + high.astype(_U) * _U(0x9E3779B97F4A7C15)
    power, inverse = shingles._powers_to(len(chars))
    sums = np.empty(len(chars) + 1, _U)
    sums[0] = 0
    np.cumsum(each * power[: len(chars)], out=sums[1:])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.where(lengths > 0, np.maximum(lengths - size + 1, 1), 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    # a shingle from every place on, without those that reach over their line's end
    within = np.ones(max(0, len(chars) - size + 1), bool)
    some = lengths > 0
    over = np.maximum(ends[some, None] - np.arange(1, size), starts[some, None]).reshape(-1)
    within[over[over < len(within)]] = False
    each = _spans(sums[size:] - sums[: len(within)], inverse[: len(within)])[within]
    short = np.flatnonzero(some & (lengths < size))
    if len(short):
        whole = _spans(sums[ends[short]] - sums[starts[short]], inverse[starts[short]])
        each = np.insert(each, offsets[short] - np.arange(len(short)), whole)
    return each, offsets


def _spans(sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of spans by the sums over them and where they begin."""
    return shingles.mix(sums * inverse)


def char_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each line, ascending, and the n + 1 offsets."""
    shingle, offsets = char_shingles(pc.fill_null(column, "").to_pylist())
    return shingles.distinct(shingle, offsets)


def signatures(shingle: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sets that are not empty, empty places filled."""
    n = len(offsets) - 1
    out = np.full((n, PLACES), _NONE)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n) * PLACES, np.diff(offsets))
    place = ((shingle >> _U(32)) * _U(PLACES) >> _U(32)).astype(np.int64)
    np.minimum.at(flat, owner + place, np.minimum(shingle.astype(np.uint32), _NONE - np.uint32(1)))
    filled = out.copy().reshape(-1)
    open_places = np.flatnonzero(flat == _NONE)
    attempt = 0
    while len(open_places):
        line, place = np.divmod(open_places, PLACES)
        attempt += 1
        if attempt <= PLACES:
            # the same draw for every line, so equal sets borrow alike
            drawn = shingles.mix(place.astype(_U) * _U(0x10001) + _U(attempt))
            source = ((drawn >> _U(32)) * _U(PLACES) >> _U(32)).astype(np.int64)
        else:
            source = (place + attempt - PLACES) % PLACES
        value = flat[line * PLACES + source]
        got = value != _NONE
        filled[open_places[got]] = value[got]
        open_places = open_places[~got]
    return filled.reshape(n, PLACES)


def _digests(lines: list[str]) -> list[pa.Array]:
    """Two numbers of each line, equal for equal lines."""
    both = b"".join([hashlib.blake2b(line.encode(), digest_size=16).digest() for line in lines])
    both = np.frombuffer(both, "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _distinct_lines(docs: DataFrame) -> DataFrame:
    """`docs` (row, doc_id, text) -> the different lines that have a word: how often they are there, their first
    place and their text. Equal lines meet where they stand near each other only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 1 << 20):
            known, places, counts = {}, [], []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    if line and not line.isspace():
                        at = known.setdefault(line, len(places))
                        if at == len(places):
                            places.append((doc_id, row, k))
                            counts.append(1)
                        else:
                            counts[at] += 1
                            places[at] = min(places[at], (doc_id, row, k), key=_order)
            lines = list(known)
            columns = zip(*places, strict=True) if places else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
            arrays = [*_digests(lines), *arrays, pa.array(counts, pa.int64()), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["half_a", "half_b", "doc_id", "row", "line", "n", "text"])

    return docs.mapInArrow(run, DISTINCT)


def _order(place: tuple[int | None, int, int]) -> tuple[int, ...]:
    """Places by document, null ids first, row and line."""
    doc_id, row, line = place
    return (0, 0, row, line) if doc_id is None else (1, doc_id, row, line)


def _placed_lines(docs: DataFrame) -> DataFrame:
    """`docs` (row, text) -> one row per line that has a word, `check` a digest of its document's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 1 << 20):
            at, numbers, lines = [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    if line and not line.isspace():
                        at.append(n)
                        numbers.append(k)
                        lines.append(line)
            at = pa.array(at, pa.int64())
            arrays = [batch.column("row").take(at), batch.column("check").take(at), pa.array(numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, *_digests(lines)], ["row", "check", "line", "half_a", "half_b"])

    return docs.select("row", F.xxhash64("text").alias("check"), "text").mapInArrow(run, PLACED)


def _signed(column: pa.Array) -> np.ndarray:
    shingle, offsets = char_shingles(column.to_pylist())
    return signatures(shingle, offsets).astype(_U)


def _keys(signed: np.ndarray) -> np.ndarray:
    return band_keys(signed[:, : BANDS * ROWS], BANDS)


def _bands(classes: DataFrame) -> DataFrame:
    """`classes` (id, text) -> the band keys of each line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", SLICE):
            keys = _keys(_signed(batch.column("text"))).view(np.int64)
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
            listed = pa.ListArray.from_arrays(starts, pa.array(np.ascontiguousarray(keys).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed], ["id", "bands"])

    return classes.select("id", "text").mapInArrow(run, SKETCH)


def _signatures(texts: DataFrame) -> DataFrame:
    """(id, text) to what `near.sift` needs. Sizes are not told, so no pair is left out for them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", SLICE):
            signed = _signed(batch.column("text"))
            one = pa.array(np.ones(batch.num_rows, np.int32))
            arrays = [batch.column("id"), one, bytes_of(signed), bytes_of(_keys(signed), "<u4")]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "size", "signature", "bands32"])

    return texts.select("id", "text").mapInArrow(run, SIGNED)


def dropped_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` (row, doc_id, text) -> (row, check, lines): the lines that go, for documents that lose any."""
    # equal lines by a digest of 128 bits; the text goes through the shuffle once a part of a task and line
    halves = ["half_a", "half_b"]
    equal = _distinct_lines(docs).repartition(*halves).groupBy(*halves).agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "row", "line")).alias("place"), F.first("text").alias("text")
    )
    classes = runtime.keep(equal.withColumn("id", F.monotonically_increasing_id()))
    runtime.release(docs.sparkSession)

    def texts(ids: DataFrame) -> DataFrame:
        return classes.select("id", "text").join(ids, "id", "left_semi")

    # the texts are needed no longer once those that share a bucket have been fetched
    known = runtime.keep(classes.drop("text"))
    linked = near.links(
        _bands(classes), _signatures, texts, char_sets, percent, MARGIN, lambda: runtime.drop(classes)
    )
    joined = known.join(linked, "id", "left").where("n > 1 or component is not null")
    several = runtime.keep(joined.select("half_a", "half_b", F.coalesce("component", "id").alias("component"), "place"))
    stays = several.groupBy("component").agg(F.min("place").alias("stays"))
    chosen = several.join(stays, "component").select("half_a", "half_b", "stays")
    return (
        _placed_lines(docs)
        .join(chosen, halves)
        .where("row != stays.row or line != stays.line")
        .groupBy("row", "check")
        .agg(F.collect_list("line").alias("lines"))
    )


def dedup_lines(docs: DataFrame, percent: int = 80, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """The documents without the lines that go; `text` changes, all other columns stay.

    Adds the columns `lines` and `dropped`, the numbers of lines before and of those that went."""
    row, check, of, lost = (runtime.free_name(n, docs) for n in ("_row", "_check", "_of", "_lost"))
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    texts = placed.select(
        F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    gone = runtime.keep(dropped_lines(texts, percent))
    gone = gone.select(F.col("row").alias(of), F.col("check").alias(check), F.col("lines").alias(lost))
    moved = F.raise_error(F.lit("the rows came in another order: write them to a table first"))
    same = F.col(of).isNull() | (F.col(check) == F.xxhash64(F.col("text").cast("string")))
    rows = placed.join(gone, F.col(row) == F.col(of), "left").withColumn(lost, F.when(same, F.col(lost)).otherwise(moved))
    rows = rows.drop(row, of, check)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 4 << 20):
            texts, counts, went = [], [], []
            for text, numbers in zip(batch.column("text").to_pylist(), batch.column(lost).to_pylist(), strict=True):
                parts = text.split("\n") if text is not None else []
                drop = {k for k in numbers or () if k < len(parts)}
                if drop:
                    text = "\n".join(x for k, x in enumerate(parts) if k not in drop)
                texts.append(text)
                counts.append(len(parts))
                went.append(len(drop))
            at = batch.schema.get_field_index("text")
            out = batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([lost])
            out = out.append_column(lines, pa.array(counts, pa.int64()))
            yield out.append_column(dropped, pa.array(went, pa.int64()))

    return rows.mapInArrow(run, schema)
