"""Toxicity by compression distance.

Two zstandard dictionaries are made of bounded samples of labelled documents, of long ones a passage. Both begin
with the same ordinary text, pieces from places drawn by a hash. The ordinary one goes on with more of that, the toxic one with the passages that
set toxic texts apart: runs of letter groups that are many times as frequent there, counted
over different contexts so that copies of one document count once, each adding letter groups that
none before it has. Every whole text is cut into overlapping windows; how much shorter a
window becomes with the toxic dictionary is its gain. A logistic model over a document's counts of
windows by gain, fitted on labelled documents that the dictionaries have not seen, makes the score; its intercept
is calibrated to the share of toxic labels.

Defined cases: null text is empty; an empty text is one empty window; without labels of both kinds every score
is the share of toxic labels (0 without labels); rows with the same doc_id are scored each; labels of unknown
documents are not used; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwork.llm import labelled, runtime, shingles

#: Most labelled documents that are learned from, by label. Half make the dictionaries, half the calibration.
SAMPLE = {1: 1_500, 0: 5_000}
#: Characters of a document that its dictionary is made of; of a longer one, a passage. Calibration takes whole texts.
LONGEST = 4_000
#: Bytes of the pieces of ordinary text.
PIECE = 40
#: Bytes of a window, and from one window to the next.
WINDOW, STEP = 48, 32
#: Bytes of the common part and of the parts that differ.
COMMON, OWN = 24_000, 4_000
#: Letter groups: bytes of one, contexts it must occur in, and how many times as frequent it must be in toxic text.
GROUP, LEAST, TIMES = 7, 3, 20
LEVEL = 3
GAINS = (3, 5, 7, 9)

_U = np.uint64
#: Parts in which letter groups are counted, for a small driver.
_PARTS = 8


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    share: float


def _groups(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the letter group at each position, and of the bytes before it."""
    data = np.frombuffer(text, np.uint8)
    start = np.arange(max(0, len(data) - GROUP + 1))
    return shingles.spans_hash(data, start, start + GROUP), shingles.spans_hash(data, np.maximum(start - 10, 0), start)


def telling_groups(toxic: list[bytes], ordinary: list[bytes]) -> set[int]:
    """The letter groups that set toxic text apart."""
    size = [sum(map(len, texts)) for texts in (toxic, ordinary)]
    hashed = [[_groups(text) for text in texts] for texts in (toxic, ordinary)]
    telling: set[int] = set()
    for part in range(_PARTS):
        counts = []
        for texts in hashed:
            chosen = [(g[mine], c[mine]) for g, c in texts for mine in [g % _U(_PARTS) == _U(part)]]
            group, context = (np.concatenate(x) for x in zip(*chosen, strict=True))
            order = np.lexsort((context, group))
            group, context = group[order], context[order]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (context[1:] != context[:-1])))[: len(group)]
            counts.append(np.unique(group[new], return_counts=True))
        (groups, many), (other, few) = counts
        at = np.searchsorted(other, groups)
        at[at == len(other)] = 0
        seen = np.where(other[at] == groups, few[at], 0) if len(other) else np.zeros(len(groups))
        apart = (many >= LEAST) & (many / size[0] > TIMES * (seen + 1) / max(1, size[1]))
        telling.update(groups[apart].tolist())
    return telling


def passages(toxic: list[bytes], telling: set[int], size: int) -> bytes:
    """Runs of telling letter groups, most frequent last, each with groups that no more frequent one has."""
    known = np.array(sorted(telling), _U)
    found: Counter[bytes] = Counter()
    for text in toxic:
        group, _ = _groups(text)
        at = np.flatnonzero(np.isin(group, known))
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            for low, high in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True):
                if high > low:
                    found[text[low : high + GROUP]] += 1
    out, covered = b"", set()
    for passage, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        groups = set(_groups(passage)[0].tolist())
        if len(groups - covered) * 2 >= len(groups):
            covered |= groups
            out = passage + out
            if len(out) > size:
                break
    return out


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def features(text: str, ordinary: bytes, toxic: bytes) -> list[float]:
    """Largest gains of a text's windows, and how many windows gain so much, as counts and shares."""
    plain, other = _compressor(ordinary).compress, _compressor(toxic).compress
    data = text.lower().encode()
    gains: Counter[int] = Counter()
    for at in range(0, max(1, len(data) - WINDOW + STEP), STEP):
        window = data[at : at + WINDOW]
        gains[len(plain(window)) - len(other(window))] += 1
    n = sum(gains.values())
    top = sorted(gains, reverse=True)
    largest = [g for g in top for _ in range(min(3, gains[g]))][:3]
    above = [sum(c for g, c in gains.items() if g >= k) for k in GAINS]
    return [top[0], sum(largest), *np.log1p(above), *(a / n for a in above), np.log(n)]


def _pieces(texts: list[bytes], number: int) -> bytes:
    """A piece of each text, from a place drawn by a hash of text and number."""
    out = []
    for text in texts:
        at = zlib.crc32(text + bytes([number])) % max(1, len(text) - PIECE)
        out.append(text[at : at + PIECE])
    return b" ".join(out)


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    own = passages(toxic, telling_groups(toxic, ordinary), OWN)
    common = _pieces(ordinary, 0)[:COMMON]
    return common + _pieces(ordinary, 1)[: len(own)], common + own


def _features_of(rows: DataFrame, ordinary: bytes, toxic: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of whole texts (text, label), computed where the texts are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 4 << 20):
            found = [features(text, ordinary, toxic) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    found = rows.select("label", "text").mapInArrow(run, "label int, x array<double>").collect()
    return np.array([r["x"] for r in found], float), np.array([r["label"] for r in found], float)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    chosen, share = labelled.choose(labels, "toxic", 5, 0, SAMPLE)
    half = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2))
    rows = labelled.texts_of(docs, chosen.withColumn("half", half))
    learned = labelled.passages(rows.where("half = 0"), LONGEST)
    by = {value: [text.lower().encode() for text, label in learned if label == value] for value in (0, 1)}
    nothing = Model(b"", b"", (), (), (), share)
    if min(map(len, by.values())) < 2:
        return nothing
    ordinary, toxic = dictionaries(by[1], by[0])
    if len(toxic) < 8:
        return nothing
    x, label = _features_of(rows.where("half = 1"), ordinary, toxic)
    if not 0 < label.sum() < len(label):
        return nothing
    # the order in which tasks end does not change the sums
    order = np.lexsort((*x.T, label))
    mean, scale, weights = labelled.logistic(x[order], label[order], share)
    # a driver that goes on to other work would hold it
    runtime.give_back()
    return Model(ordinary, toxic, tuple(mean), tuple(scale), tuple(weights), share)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows with a further column `name`, 0 to 1."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 4 << 20):
            if model.weights:
                texts = (text or "" for text in batch.column("text").to_pylist())
                x = np.array([features(text, model.ordinary, model.toxic) for text in texts], float)
                x = np.column_stack(((x - model.mean) / model.scale, np.ones(len(x))))
                scores = labelled.sigmoid(x @ np.array(model.weights))
            else:
                scores = np.full(batch.num_rows, model.share)
            yield batch.append_column(name, pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, schema)


def rejected_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents without those the classifier finds toxic; all columns stay."""
    name = runtime.free_name("_score", docs)
    return score(docs, fit(docs, labels), name).where(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(docs, labels))
    return scored.select(
        "doc_id",
        labelled.held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
