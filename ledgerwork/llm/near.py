"""From band keys to links that hold on whole sets, without rows for all pairs of a bucket.

A bucket is a band key that several items share. First round: every item of a bucket is paired with
the bucket's pivot, which differs from bucket to bucket. What holds gives components. Second
round: items of a bucket that are not in its pivot's component are paired with the items of other
components in the bucket. After both, any two items of a bucket are in one component or have been
paired, so nothing that the bands find is lost, and a bucket full of near copies costs one pair each.

A pair of the second round is looked at in the first band that its items share and nowhere else: there one of
them is left over, if they are in different components, or it is the pivot, and they have been compared.
Its partners leave the task with the item, as one row for the item and chunk, so rows grow with the items.

A pair is sifted before its texts are fetched: signatures give an estimate of the similarity, and a
pair more than `margin` standard deviations under the bound is left out. In the second round the items of a bucket are
dealt out in chunks of about `CHUNK`, so no task holds a large bucket.

Comparisons are streamed: the texts to compare with a pivot come sorted behind the pivot's text;
the members of a pivot are dealt out in groups of about `MEMBERS`, so no pivot is one task's work. In the second round,
where an item is paired with many of its bucket, the texts of a chunk are held instead and each comes once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwork.llm import runtime, shingles
from ledgerwork.llm.components import components

#: Items that a task compares with a pivot, about; each group of them has the pivot's text once.
MEMBERS = 64
#: Items of a bucket that a task compares others with at once, about.
CHUNK = 500
#: Bits of a key that say its part, and keys that are dealt to the parts at once.
PART_BITS, DEALT = 12, 1 << 19
#: Bytes of signatures that are compared at once.
COMPARED = 8 << 20
#: Standard deviations of the estimate by signature that a pair may be under the bound.
MARGIN = 5

Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def links(
    items: DataFrame,
    signatures: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    sets: Sets,
    percent: int,
    margin: float = MARGIN,
    fetched: Callable[[], None] = lambda: None,
) -> DataFrame:
    """`items` (id, bands) -> (id, component) of every item that is linked.

    `signatures` (id, size, signature, bands32) has the items' sizes, a byte for each place, equal with a probability of
    the similarity, and the low 32 bits of each band's key: a table, or a function that makes it of the texts
    (id, text) of items. `fetch` turns some ids (id) into texts (id, text); `sets` gives the distinct members of each
    text's set; `fetched` is called when nothing further is asked of `fetch` and of `items`. Two items are linked if
    100 * shared >= percent * union."""
    # no key has more than one row of an item
    members = runtime.keep(buckets(items))
    runtime.release(items.sparkSession)
    ids = runtime.keep(members.select("id").distinct())
    # the texts go through one shuffle; signatures are made of those fetched
    involved = runtime.keep(fetch(ids))
    fetched()
    runtime.release(items.sparkSession)
    signed = signatures(involved) if callable(signatures) else signatures.join(ids, "id", "left_semi").dropDuplicates(["id"])
    signed = runtime.keep(signed)
    runtime.drop(ids)
    at_chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    other_chunks = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != at_chunk)

    def side(chunk: Column, kind: Column) -> Column:
        return F.struct(chunk.alias("chunk"), kind.alias("kind"))

    # an item and a pivot meet in many buckets, and each may be the pivot in some: once here
    is_pivot = F.col("id") == F.col("pivot")
    met = members.where(~is_pivot).groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    met = met.agg(F.max("pivot").alias("pivot"))
    met = met.select(F.when(F.col("pivot") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("id"), "pivot")
    pairs = runtime.keep(sift_pivots(met, signed, percent, margin))
    first = runtime.keep(compare(pairs, involved, sets, percent))
    joined = components(first)
    for table in (pairs, first):
        runtime.drop(table)

    at_id = joined.select("id", F.col("component").alias("own"))
    at_pivot = joined.select(F.col("id").alias("pivot"), F.col("component").alias("pivots"))
    placed = runtime.keep(
        members.join(at_id, "id", "left")
        .join(at_pivot, "pivot", "left")
        .select(
            "key",
            "chunks",
            "id",
            F.coalesce("own", "id").alias("own"),
            (F.coalesce("own", "id") != F.coalesce("pivots", "pivot")).alias("left_over"),
            is_pivot.alias("is_pivot"),
        )
    )
    runtime.drop(members)
    # buckets that have left-over items; the pivot has been paired with all
    others = placed.where("not is_pivot")
    # items of one component are not paired
    open_keys = others.groupBy("key").agg(F.max("left_over").alias("open"), (F.min("own") != F.max("own")).alias("apart"))
    dealt = others.join(open_keys.where("open and apart").select("key"), "key")
    # an item stands once in its own chunk, a left-over one in the others as well
    asked = F.when(F.col("left_over"), F.transform(other_chunks, lambda c: side(c, F.lit(2))))
    here = F.array(side(at_chunk, F.col("left_over").cast("int")))
    sides = F.concat(here, F.coalesce(asked, F.array().cast("array<struct<chunk:int,kind:int>>")))
    rest = dealt.select("key", F.inline(sides), "id", "own")
    runtime.release(items.sparkSession)
    # signatures have been shuffled and are gone before the texts of the few that are left are fetched
    maybe = runtime.keep(sift(rest, signed, percent, margin))
    runtime.release(items.sparkSession)
    second = runtime.keep(compare_within(maybe, involved, sets, percent))
    none = second.isEmpty()
    if not none:
        carried = second.join(at_id.withColumnRenamed("id", "a").withColumnRenamed("own", "root_a"), "a", "left").join(
            at_id.withColumnRenamed("id", "b").withColumnRenamed("own", "root_b"), "b", "left"
        )
        between = carried.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        # what the first round linked keeps its component as its neighbour
        joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(between))
    joined = runtime.keep(joined)
    for table in (signed, involved, placed, maybe, second):
        runtime.drop(table)
    return joined


def buckets(items: DataFrame) -> DataFrame:
    """`items` (id, bands) -> (id, key, pivot, chunks) for every key that several items have; the pivot is the item that is
    least when mixed with the key.

    Most keys have one item. So keys do not travel as rows but as bytes, those of a part of the numbers together, and
    a part's keys are sorted at once."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            batch = batch.filter(batch.column("id").is_valid())
            bands = batch.column("bands")
            counts = bands.value_lengths().fill_null(0).to_numpy()
            held.append((np.repeat(batch.column("id").to_numpy(), counts), bands.flatten().to_numpy()))
            many += len(held[-1][0])
            if many >= DEALT:
                yield _by_part(held)
                held, many = [], 0
        if many:
            yield _by_part(held)

    def meet(rows: pa.Table) -> pa.Table:
        item, key = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("ids", "keys"))
        order = np.argsort(key)
        item, key = item[order], key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[first, len(key)])
        pivot = np.minimum.reduceat(item ^ key, first) ^ key[first]
        chunks = -(-counts // CHUNK)
        several = np.repeat(counts > 1, counts)
        columns = (item, key, np.repeat(pivot, counts), np.repeat(chunks, counts).astype(np.int32))
        return pa.table([pa.array(x[several]) for x in columns], ["id", "key", "pivot", "chunks"])

    dealt = items.select("id", "bands").mapInArrow(deal, "part int, ids binary, keys binary")
    return dealt.groupBy("part").applyInArrow(meet, "id long, key long, pivot long, chunks int")


def _by_part(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Items and keys as bytes, a row for each part of the keys."""
    item, key = (np.concatenate(x) for x in zip(*held, strict=True))
    part = (shingles.mix(key.view(np.uint64)) >> np.uint64(64 - PART_BITS)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    offsets = pa.py_buffer((np.append(first, len(order)) * 8).astype(np.int32))
    found = [pa.Array.from_buffers(pa.binary(), len(parts), [None, offsets, pa.py_buffer(x[order])]) for x in (item, key)]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *found], ["part", "ids", "keys"])


def sift_pivots(pairs: DataFrame, signed: DataFrame, percent: int, margin: float) -> DataFrame:
    """The `pairs` (id, pivot) that may be linked, by size and signature."""
    one = signed.select("id", "size", "signature")
    other = signed.select(*[F.col(c).alias(f"pivot_{c}") for c in one.columns])
    both = pairs.join(one, "id").join(other, F.col("pivot") == F.col("pivot_id"))
    share = percent / 100

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [batch.column(c).to_numpy() for c in ("size", "pivot_size")]
            near = np.minimum(*sizes) * 100 >= np.maximum(*sizes) * percent
            signs = [_matrix(batch.column(c)) for c in ("signature", "pivot_signature")]
            least = share - margin * (share * (1 - share) / signs[0].shape[1]) ** 0.5
            near &= (signs[0] == signs[1]).mean(axis=1) >= least
            yield batch.select(["id", "pivot"]).filter(pa.array(near))

    columns = ("id", "pivot", "size", "pivot_size", "signature", "pivot_signature")
    return both.select(*columns).mapInArrow(run, "id long, pivot long")


def sift(rows: DataFrame, signed: DataFrame, percent: int, margin: float) -> DataFrame:
    """(key, chunk, kind, id, pivots): for left-over items (kind 1) those they may be linked with, by size and
    signature; each of these stands there once as an item of kind 0, without any.

    `rows` (key, chunk, kind, id, own): an item's kind is 1 if it is left over, in chunks other than its own 2, and else
    0. Left-over items are paired with those of kind 0 and 1 under the same key and chunk in the first band they
    share, unless they have the same component `own`; two left-over ones where the smaller id is asked. Ids
    descend, so what an item of kind 1 is paired with stands before it."""
    placed = rows.join(signed, "id").repartition("key", "chunk")
    placed = placed.sortWithinPartitions("key", "chunk", "kind", F.desc("id"))
    share = percent / 100

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the last group what the rows after it may be paired with, and whether it was told
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("key", "chunk", "kind", "id", "size", "own")]
            rows += [_matrix(batch.column("signature")), _matrix(batch.column("bands32")).view("<u4")]
            rows.append(np.zeros(batch.num_rows, bool))
            before = 0
            if carried is not None:
                before = len(carried[0])
                rows = [np.concatenate(x) for x in zip(carried, rows, strict=True)]
            key, chunk, kind, item, size, own, sign, bands, told = rows
            least = share - margin * (share * (1 - share) / sign.shape[1]) ** 0.5
            new = np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            partners = np.add.reduceat((kind < 2).astype(np.int64), first)
            asks = np.flatnonzero((kind > 0) & (np.arange(len(key)) >= before))
            low = first[group[asks]]
            counts = np.where(kind[asks] == 1, asks - low, partners[group[asks]])
            ends = np.cumsum(counts)
            found = [], [], [], [], [], []
            start = 0
            while start < len(asks):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + COMPARED // sign.shape[1], "right")))
                of = np.repeat(np.arange(start, stop), counts[start:stop])
                a = asks[of]
                b = low[of] + np.arange(done, ends[stop - 1]) - (ends - counts)[of]
                near = np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent
                near &= (own[a] != own[b]) & ((kind[b] == 0) | (item[a] < item[b]))
                a, b = a[near], b[near]
                alike = (sign[a] == sign[b]).mean(axis=1) >= least
                a, b = a[alike], b[alike]
                at_key = (bands[a] == (key[a] & 0xFFFFFFFF).astype(np.uint32)[:, None]).argmax(axis=1)
                mine = (bands[a] == bands[b]).argmax(axis=1) == at_key
                a, b = a[mine], b[mine]
                start = stop
                if not len(a):
                    continue
                # partners of one item stand together
                firsts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                untold = np.unique(b[~told[b]])
                told[untold] = True
                both = np.concatenate((untold, a[firsts]))
                kinds = np.repeat((0, 1), (len(untold), len(firsts)))
                sizes = np.concatenate((np.zeros(len(untold), np.int64), np.diff(np.r_[firsts, len(a)])))
                told_now = (key[both], chunk[both], kinds, item[both], sizes, item[b])
                for column, values in zip(found, told_now, strict=True):
                    column.append(values)
            if found[0]:
                out = [np.concatenate(x) for x in found]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                arrays = [pa.array(x, t) for x, t in zip(out, types, strict=False)]
                offsets = pa.array(np.r_[0, out[4].cumsum()].astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(out[5], pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["key", "chunk", "kind", "id", "pivots"])
            carried = [x[first[-1] : first[-1] + partners[-1]] for x in rows]

    columns = ["key", "chunk", "kind", "id", "size", "own", "signature", "bands32"]
    return placed.select(*columns).mapInArrow(run, "key long, chunk int, kind int, id long, pivots array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(column), -1)


def compare(pairs: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The `pairs` (id, pivot) whose texts' sets share enough, as links (a, b)."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    group = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    asked = pairs.join(parts, "pivot").select("pivot", group, "id", F.lit(1).alias("kind"))
    pivots = asked.select("pivot", "part").distinct().select("pivot", "part", F.col("pivot").alias("id"), F.lit(0).alias("kind"))
    rows = asked.union(pivots).join(texts, "id")
    placed = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, against = None, []
        for batch in runtime.slices(batches, "text", 1 << 18):
            member, offsets = sets(batch.column("text"))
            found = [], []
            columns = (batch.column(c).to_pylist() for c in ("pivot", "part", "kind", "id"))
            for k, (pivot, part, kind, item) in enumerate(zip(*columns, strict=True)):
                here = member[offsets[k] : offsets[k + 1]]
                if kind == 0:
                    if at != (pivot, part):
                        at, against = (pivot, part), []
                    against.append(here.copy())
                elif any(_close(here, other, percent) for other in against):
                    found[0].append(pivot)
                    found[1].append(item)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return placed.select("pivot", "part", "kind", "id", "text").mapInArrow(run, "a long, b long")


def compare_within(found: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """As `compare`, for what `sift` finds: items of a chunk, of which many share their partners.

    A text is fetched and cut up once for all its partners there; a chunk has about CHUNK partners, whose sets
    the task holds."""
    placed = found.join(texts, "id").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, {}
        for batch in runtime.slices(batches, "text", 1 << 18):
            member, offsets = sets(batch.column("text"))
            found = [], []
            columns = (batch.column(c).to_pylist() for c in ("key", "chunk", "kind", "id", "pivots"))
            for k, (key, chunk, kind, item, pivots) in enumerate(zip(*columns, strict=True)):
                here = member[offsets[k] : offsets[k + 1]]
                if group != (key, chunk):
                    group, known = (key, chunk), {}
                if kind == 0:
                    known.setdefault(item, []).append(here.copy())
                    continue
                for pivot in pivots:
                    if any(_close(here, other, percent) for other in known.get(pivot, ())):
                        found[0].append(pivot)
                        found[1].append(item)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return placed.select("key", "chunk", "kind", "id", "pivots", "text").mapInArrow(run, "a long, b long")


def _close(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = shingles.shared(left, right)
    return 100 * both >= percent * (len(left) + len(right) - both) and both > 0
