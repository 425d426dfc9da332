"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, its label says nothing about any one of them. Every passage is
encoded (shares of byte classes, word length, share of words and of word pairs that repeat within
the passage, then a learned layer); a gated attention, tanh of one projection times the sigmoid of another,
weighs the passages; the weighted sum of the encodings is scored. All weights are learned
together from document labels by gradient descent (Adam) over a bounded sample.

Defined cases: null text is empty; an empty text is one passage without bytes; without labels of both kinds every
score is the share of label 1 (0 without labels); rows with the same doc_id are scored each; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwork.llm import labelled, runtime, shingles

#: Most labelled documents that are learned from, by label.
SAMPLE = {0: 2_000, 1: 2_000}
#: Characters of a sampled document that are learned from; of a longer one, a passage.
LONGEST = 20_000
#: Bytes of a passage.
PASSAGE = 512
#: Width of the encoding and of the attention.
CODE, GATE = 16, 8
ROUNDS, RATE, DECAY, SEED = 120, 0.03, 1e-4, 7

_U = np.uint64
_CLASSES = ("lower", "upper", "digit", "other", " ", "\n", ".", ",", "!?", "|", "%#*&$", "<>/\\{}[]=", ":;", "\"'()-_")
_CLASS = np.full(256, _CLASSES.index("other"))
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _k, _name in enumerate(_CLASSES[4:], 4):
    _CLASS[list(_name.encode())] = _k

#: Numbers that describe a passage: shares of the byte classes, repeats of words and of pairs, word length, length.
FEATURES = len(_CLASSES) + 4

Weights = dict[str, np.ndarray]


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of all texts, row by row, and the n + 1 offsets of the texts."""
    data, offsets = shingles.buffers(column)
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    bags = np.concatenate(([0], np.cumsum(counts)))
    n = int(bags[-1])
    within = np.arange(n) - np.repeat(bags[:-1], counts)
    start = np.repeat(offsets[:-1], counts) + within * PASSAGE
    length = np.minimum(np.repeat(offsets[1:], counts), start + PASSAGE) - start
    owner = np.repeat(np.arange(n), length)
    classes = np.bincount(owner * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1)
    share = classes / np.maximum(length, 1)[:, None]

    word, first = shingles.placed_words(data, offsets)
    # passages without bytes begin where the next text does; the last one that begins there has them
    of = np.searchsorted(start, first, "right") - 1
    n_words = np.bincount(of, minlength=n)
    pair = np.flatnonzero(of[1:] == of[:-1])
    repeated = [
        1 - _distinct(of, word, n) / np.maximum(n_words, 1),
        1 - _distinct(of[pair], shingles.mix(word[pair]) + word[pair + 1], n) / np.maximum(n_words - 1, 1),
    ]
    letters = length - classes[:, 4] - classes[:, 5]
    columns = [share, np.column_stack(repeated), np.column_stack((letters / np.maximum(n_words, 1), length / PASSAGE))]
    out = np.hstack(columns)
    out[:, -2] = np.log1p(out[:, -2])
    return out, bags


def _distinct(of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each passage has."""
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])))[: len(of)]
    return np.bincount(of[new], minlength=n)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: Weights | None
    share: float


def _forward(x: np.ndarray, bags: np.ndarray, w: Weights) -> dict[str, np.ndarray]:
    code = np.tanh(x @ w["encode"] + w["encode_at"])
    tanh = np.tanh(code @ w["value"])
    gate = labelled.sigmoid(code @ w["gate"])
    raw = (tanh * gate) @ w["attend"]
    sizes = np.diff(bags)
    raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, bags[:-1]), sizes))
    attention = raw / np.repeat(np.add.reduceat(raw, bags[:-1]), sizes)
    pooled = np.add.reduceat(attention[:, None] * code, bags[:-1])
    logit = pooled @ w["score"] + w["score_at"]
    return {"code": code, "tanh": tanh, "gate": gate, "attention": attention, "pooled": pooled, "logit": logit}


def _gradients(x: np.ndarray, bags: np.ndarray, label: np.ndarray, w: Weights) -> Weights:
    f = _forward(x, bags, w)
    sizes = np.diff(bags)
    d_logit = (labelled.sigmoid(f["logit"]) - label) / len(label)
    d_pooled = np.repeat(d_logit[:, None] * w["score"], sizes, axis=0)
    d_attention = (d_pooled * f["code"]).sum(axis=1)
    mean = np.add.reduceat(f["attention"] * d_attention, bags[:-1])
    d_raw = f["attention"] * (d_attention - np.repeat(mean, sizes))
    both = d_raw[:, None] * w["attend"]
    d_tanh = both * f["gate"] * (1 - f["tanh"] ** 2)
    d_gate = both * f["tanh"] * f["gate"] * (1 - f["gate"])
    d_code = f["attention"][:, None] * d_pooled + d_tanh @ w["value"].T + d_gate @ w["gate"].T
    d_code *= 1 - f["code"] ** 2
    return {
        "encode": x.T @ d_code,
        "encode_at": d_code.sum(axis=0),
        "value": f["code"].T @ d_tanh,
        "gate": f["code"].T @ d_gate,
        "attend": (f["tanh"] * f["gate"]).T @ d_raw,
        "score": f["pooled"].T @ d_logit,
        "score_at": d_logit.sum(),
    }


def train(x: np.ndarray, bags: np.ndarray, label: np.ndarray) -> Weights:
    random = np.random.default_rng(SEED)
    shapes = {"encode": (x.shape[1], CODE), "value": (CODE, GATE), "gate": (CODE, GATE), "attend": (GATE,), "score": (CODE,)}
    w: Weights = {k: random.normal(0, shape[0] ** -0.5, shape) for k, shape in shapes.items()}
    w |= {"encode_at": np.zeros(CODE), "score_at": np.array(0.0)}
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, ROUNDS + 1):
        slope = _gradients(x, bags, label, w)
        for k in w:
            g = slope[k] + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def _features_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the passages of all texts (text, label), the offsets of the texts and their labels, computed where the
    texts are: the driver gets numbers. Equal texts count once; the order of the rows stays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 2 << 20):
            x, bags = passages(batch.column("text"))
            numbers = [x[low:high].tobytes() for low, high in zip(bags, bags[1:], strict=False)]
            arrays = [batch.column("digest"), batch.column("label"), pa.array(numbers, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "label", "x"])

    digests = rows.select(F.sha2("text", 256).alias("digest"), "label", "text")
    found = digests.mapInArrow(run, "digest string, label int, x binary").collect()
    once = {(r["digest"], r["label"]): r["x"] for r in reversed(found)}
    several = [(label, np.frombuffer(once.pop((digest, label)))) for digest, label, _ in found if (digest, label) in once]
    if not several:
        return np.empty((0, 0)), np.zeros(1, int), np.empty(0)
    x = np.concatenate([numbers for _, numbers in several]).reshape(-1, FEATURES)
    bags = np.concatenate(([0], np.cumsum([len(numbers) // FEATURES for _, numbers in several])))
    return x, bags, np.array([label for label, _ in several], float)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    chosen, share = labelled.choose(labels, "quality", 3, 1, SAMPLE)
    x, bags, label = _features_of(labelled.drawn(labelled.texts_of(docs, chosen), LONGEST))
    if not len(label) or label.min() == label.max():
        return Model(None, None, None, share)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = train((x - mean) / scale, bags, label)
    drawn = label.mean()
    # the sample is even, the documents are not
    w["score_at"] = w["score_at"] + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    runtime.give_back()
    return Model(mean, scale, w, share)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows with a further column `name`, 0 to 1."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.slices(batches, "text", 2 << 20):
            if model.weights is None:
                scores = np.full(batch.num_rows, model.share)
            else:
                x, bags = passages(batch.column("text"))
                scores = labelled.sigmoid(_forward((x - model.mean) / model.scale, bags, model.weights)["logit"])
            yield batch.append_column(name, pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, schema)


def rejected_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents without those the classifier finds of low quality; all columns stay."""
    name = runtime.free_name("_score", docs)
    return score(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(docs, labels))
    return scored.select(
        "doc_id",
        labelled.held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
