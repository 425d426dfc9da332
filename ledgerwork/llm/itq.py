"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Learning. On a bounded sample the vectors are centred and turned to their principal axes; a rotation is
learned that makes the signs of the turned vectors the best binary codes (Procrustes steps). Several
rotations from different starts give further bits.

Search. Codes are cut into substrings, one table each. Two vectors meet in a table if their substrings
there differ in one bit at most: every code is stored under its substring and looked up under it and all its
one-bit neighbours. Substrings have about log2 of the number of vectors bits, so a bucket holds
few by chance, and there are as many tables as find a pair at the similarity bound with probability `RECALL`
(closer pairs more surely). How often that is so depends on how far centring and axes widen angles, so it is measured
on made pairs: vectors of the sample and partners at exactly the bound, in any direction and in directions in which the
sample is spread. Where too many tables would be needed, substrings get shorter; of one bit, they let all pairs
meet. Pairs whose whole codes are too far apart go; what is left is reranked by the
cosine of the original vectors in double precision.

Equal vectors are one class and are never paired; links are pairs of classes, so the number of pairs is that of
real links (and of few near misses).

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing and
are kept; vectors of different length link with nothing of each other; rows with the same vec_id are one vector if
equal and linked as one node otherwise; label and other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwork.llm import runtime
from ledgerwork.llm.components import components

#: Most vectors that rotations are learned from, and most dimensions that are quantised.
SAMPLE, DIMENSIONS = 4_000, 64
ROUNDS, SEED = 30, 5
#: Probability to find a pair whose cosine is the bound.
RECALL = 0.999
#: Most tables, and pairs of each kind that are made to measure how many are needed.
TABLES, MADE = 64, 4_000


def made_pairs(sample: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors and partners at the cosine: off in any direction, and in that between two of the sample."""
    random = np.random.default_rng(SEED)
    own = sample[np.arange(MADE) % len(sample)]
    one, other = random.integers(len(sample), size=(2, MADE))
    pairs = []
    for off in (random.normal(size=own.shape), sample[one] - sample[other]):
        off = off - (off * own).sum(axis=1, keepdims=True) * own
        size = np.linalg.norm(off, axis=1)
        some = size > 1e-6
        if some.any():
            away = off[some] / size[some, None]
            pairs.append((own[some], cosine * own[some] + (1 - cosine * cosine) ** 0.5 * away))
    return pairs


def plan(sample: np.ndarray, substring: int, cosine: float) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Centre, projection, bits of a substring, tables, and bits in which the whole codes of a pair may differ."""
    pairs = made_pairs(sample, cosine)
    centre, projection = learn(sample, substring * TABLES)
    differ = [((a - centre) @ projection >= 0) != ((b - centre) @ projection >= 0) for a, b in pairs]
    for bits in range(substring if pairs else 1, 0, -1):
        tables = 1
        for x in differ:
            met = x[:, : bits * TABLES].reshape(len(x), TABLES, bits).sum(axis=2) <= 1
            found = np.maximum.accumulate(met, axis=1).mean(axis=0)
            tables = max(tables, int(np.searchsorted(found, RECALL)) + 1)
        if tables <= TABLES:
            break
    used = bits * tables
    most = 0
    for x in differ:
        apart = x[:, :used].sum(axis=1)
        # five standard deviations over what a pair at the bound differs in
        most = max(most, int(apart.max()), ceil(apart.mean() + 5 * apart.std()))
    return centre, projection[:, :used], bits, tables, min(used, most) if differ else used


def learn(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection to at least `bits` signs."""
    centre = sample.mean(axis=0)
    x = sample - centre
    width = min(DIMENSIONS, x.shape[1])
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[:width].T
    turned = x @ axes
    random = np.random.default_rng(SEED)
    projections = []
    for _ in range(ceil(bits / width)):
        rotation, _ = np.linalg.qr(random.normal(size=(width, width)))
        for _ in range(ROUNDS):
            codes = np.where(turned @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(turned.T @ codes)
            rotation = left @ right
        projections.append(axes @ rotation)
    return centre, np.hstack(projections)[:, :bits]


def _usable(vector: Column) -> Column:
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """`vectors` (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    ).withColumn("usable", _usable(F.col("vector")))
    classes = runtime.keep(
        rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    n = classes.count()
    links = _links(classes, n, cosine) if n > 1 else None
    if links is None:
        found = classes.select("vector", F.col("copies").alias("linked"), F.col("id").alias("component"))
    else:
        copies = classes.select(F.col("id").alias("b"), F.col("copies").alias("there"))
        both = links.union(links.select("b", "a"))
        counted = both.join(copies, "b").groupBy("a").agg(F.sum("there").alias("others"))
        placed = classes.join(counted.withColumnRenamed("a", "id"), "id", "left").join(components(links), "id", "left")
        found = placed.select(
            "vector",
            (F.col("copies") + F.coalesce("others", F.lit(0))).alias("linked"),
            F.coalesce("component", "id").alias("component"),
        )
    # a vector that is not usable finds nothing: a null never equals, and the others are in no class
    joined = rows.join(found.withColumnRenamed("vector", "_vector"), F.col("usable") & (F.col("vector") == F.col("_vector")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("linked") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _links(classes: DataFrame, n: int, cosine: float) -> DataFrame:
    """Pairs (a, b) of classes, a < b, whose cosine is at least the bound."""
    width = classes.select(F.max(F.size("vector"))).first()[0]
    drawn = classes.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").collect()
    sample = np.zeros((len(drawn), width))
    for k, row in enumerate(drawn):
        sample[k, : len(row[0])] = row[0]
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    centre, projection, substring, tables, most = plan(sample, min(24, max(8, round(log2(n)))), cosine)
    longs = ceil(substring * tables / 64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(substring)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.zeros((batch.num_rows, width))
            for k, vector in enumerate(batch.column("vector")):
                values = vector.values.to_numpy(zero_copy_only=False)
                x[k, : len(values)] = values
            x /= np.linalg.norm(x / np.abs(x).max(axis=1)[:, None], axis=1)[:, None] * np.abs(x).max(axis=1)[:, None]
            signs = (x - centre) @ projection >= 0
            parts = signs.reshape(len(x), tables, substring) @ weights
            whole = np.zeros((len(x), longs * 8), np.uint8)
            packed = np.packbits(signs, axis=1)
            whole[:, : packed.shape[1]] = packed
            offsets = np.arange(len(x) + 1, dtype=np.int32)
            columns = [
                batch.column("id"),
                pa.ListArray.from_arrays(pa.array(offsets * tables), pa.array(parts.ravel().astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(offsets * longs), pa.array(whole.view(np.int64).ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "parts", "code"])

    coded = runtime.keep(classes.select("id", "vector").mapInArrow(run, "id long, parts array<int>, code array<long>"))
    words = [F.col("code")[k].alias(f"word{k}") for k in range(longs)]
    stored = coded.select("id", *words, F.posexplode("parts").alias("table", "part"))
    flips = F.array(F.lit(0), *[F.lit(1 << k) for k in range(substring)])
    asked = stored.select(
        F.col("id").alias("b"),
        *[F.col(f"word{k}").alias(f"other{k}") for k in range(longs)],
        "table",
        F.explode(F.transform(flips, lambda flip: flip.bitwiseXOR(F.col("part")))).alias("part"),
    )
    apart = sum((F.bit_count(F.col(f"word{k}").bitwiseXOR(F.col(f"other{k}"))) for k in range(longs)), F.lit(0))
    met = stored.join(asked, ["table", "part"]).where((F.col("id") < F.col("b")) & (apart <= most))
    pairs = met.select(F.col("id").alias("a"), "b").distinct()

    # unit vectors, so the cosine is their product
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    most_of = F.array_max(F.transform("vector", F.abs))
    scaled = classes.select("id", F.transform("vector", lambda x: x / most_of).alias("vector"))
    unit = scaled.select("id", "vector", size.alias("size"))
    at_a = unit.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("size").alias("sa"))
    at_b = unit.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("size").alias("sb"))
    product = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    close = (F.size("va") == F.size("vb")) & (product / (F.col("sa") * F.col("sb")) >= cosine)
    return runtime.keep(pairs.join(at_a, "a").join(at_b, "b").where(close).select("a", "b"))
