"""Near-duplicate documents by SuperMinHash.

Signature. Each member of a set draws a permutation of the places 0..m-1, step by step, and a
number below 1 at every step; at step j it offers j + that number to the place the permutation
names. A place keeps the smallest offer. The offers of one member are correlated, as ranks of a
permutation are, so places differ less by chance than independent minima. An offer of step j + 1
never beats one of step j, so a set needs no further step once all its places are taken:
usually after a few steps for long texts. All members of many texts take a step together.

Links. `near.links` puts texts that share a band of the signature together, compares the whole
shingle sets and joins what is linked.

Defined cases: null, empty and white texts have no shingles and are linked with nothing; equal sets
are linked; rows with the same id count as linked; every input row gives one output row; columns other than
`doc_id` and `text` are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.llm import near, runtime, shingles

BANDS, ROWS = 32, 6
PLACES = BANDS * ROWS

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_LOW = _U(0xFFFFFFFF)
_HIGH = _U(32)
_GOLDEN = 0x9E3779B97F4A7C15
#: Permutations (bytes of them) drawn out at once.
_PERMUTED = 24 << 20

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary, bands32 binary"


def _draw(member: np.ndarray, step: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The offer of each member at a step, and the index among step..places-1 that it swaps with."""
    random = shingles.mix(member + _U((step + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
    index = _U(step) + ((random >> _HIGH) * _U(places - step) >> _HIGH)
    return _U(step) << _HIGH | random & _LOW, index.astype(np.int64)


def signatures(member: np.ndarray, offsets: np.ndarray, places: int = PLACES) -> np.ndarray:
    """One row of `places` numbers for each set; of an empty set all are the largest number."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.full((n, places), _EMPTY)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), sizes)
    offer, index = _draw(member, 0, places)
    np.minimum.at(flat, owner * places + index, offer)
    open_sets = np.flatnonzero((sizes > 0) & (out == _EMPTY).any(axis=1))
    # the further steps need whole permutations; as many sets at once as their space allows
    room = max(1, _PERMUTED // places)
    first = 0
    ends = np.cumsum(sizes[open_sets])
    while first < len(open_sets):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + room, "right")))
        _further_steps(member, offsets, open_sets[first:last], out, index, places)
        first = last
    return out


def _further_steps(
    member: np.ndarray, offsets: np.ndarray, sets: np.ndarray, out: np.ndarray, index: np.ndarray, places: int
) -> None:
    flat = out.reshape(-1)
    rows = np.concatenate([np.arange(offsets[s], offsets[s + 1]) for s in sets])
    owner = np.repeat(sets, np.diff(offsets)[sets])
    member = member[rows]
    permuted = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(rows), 1))
    each = np.arange(len(rows))
    permuted[each, 0], permuted[each, index[rows]] = permuted[each, index[rows]], 0
    for step in range(1, places):
        offer, at = _draw(member, step, places)
        each = np.arange(len(member))
        place = permuted[each, at]
        permuted[each, at] = permuted[:, step]
        permuted[:, step] = place
        np.minimum.at(flat, owner * places + place, offer)
        # a set whose places are all taken is done
        open_now = (out[sets] == _EMPTY).any(axis=1)
        if not open_now.all():
            sets = sets[open_now]
            if not len(sets):
                return
            stay = np.isin(owner, sets)
            if np.count_nonzero(stay) < 0.8 * len(stay):
                member, owner, permuted = member[stay], owner[stay], permuted[stay]


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A number for each band of each signature; bands of different place never share one."""
    n, places = signature.shape
    parts = signature.reshape(n, bands, places // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(_GOLDEN), (n, bands))
    for k in range(parts.shape[2]):
        key = shingles.mix(key + parts[:, :, k])
    return key


def bytes_of(numbers: np.ndarray, kind: str = "u1") -> pa.Array:
    """The low bytes of each number, a binary value for each row."""
    n = len(numbers)
    data = np.ascontiguousarray(numbers.astype(kind))
    offsets = pa.py_buffer((np.arange(n + 1) * data.shape[1] * data.itemsize).astype(np.int32))
    data = pa.py_buffer(data)
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """Size and fingerprint of each document's shingle set and the band keys of its signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 1 << 19):
            member, offsets = shingles.word_shingles(batch.column("text"), words)
            sizes = np.diff(offsets)
            sets = shingles.fingerprint(member, offsets).view(np.int64)
            signed = signatures(member, offsets)
            every = band_keys(signed)
            keys = every.view(np.int64)[sizes > 0].reshape(-1)
            starts = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(sets[:, 0]),
                    pa.array(sets[:, 1]),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(keys)),
                    bytes_of(signed),
                    bytes_of(every, "<u4"),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature", "bands32"],
            )

    return docs.mapInArrow(run, SKETCH)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document.

    Two documents are linked if their sets of distinct shingles of `words` words share at least
    `percent` of a hundred of their union; a component is what links reach."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = runtime.keep(sketch(texts, words))
    sets = ["n_shingles", "set_a", "set_b"]
    # one document stands for all with the same set
    classes = sketched.where("n_shingles > 0").groupBy(*sets).agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands")
    )
    bands = classes.select("id", "bands")
    signed = sketched.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "signature", "bands32")
    by_id = texts.withColumnRenamed("doc_id", "id")
    linked = near.links(
        bands,
        signed,
        lambda ids: by_id.join(ids, "id", "left_semi"),
        lambda column: shingles.word_shingles(column, words),
        percent,
    )
    found = classes.select(*sets, "id").join(linked, "id", "left").select(
        *[F.col(c).alias(f"_{c}") for c in sets], F.coalesce("component", "id").alias("component")
    )
    same = [sketched[c] == found[f"_{c}"] for c in sets]
    return sketched.join(found, same, "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, the first in the input; all columns stay.

    Rows are told apart by their place, whatever their ids, so exact repeats of a row are a group as well. `docs` is
    read twice and has to come in the same order, as a table does."""
    row, gone_row = runtime.free_name("_row", docs), runtime.free_name("_gone", docs)
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    found = near_duplicates(placed.select(F.col(row).alias("doc_id"), "text"), words, percent)
    gone = runtime.keep(found.where("not kept").select(F.col("doc_id").alias(gone_row)))
    return placed.join(gone, F.col(row) == F.col(gone_row), "left_anti").drop(row)
