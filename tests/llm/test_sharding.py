from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from helpers import ODD_TEXTS, documents
from pyspark.sql import functions as F

from ledgerwork.functions import ranges
from ledgerwork.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 1000, 12_345])
def test_layout_is_a_permutation(spark, n):
    layout = sharding.Layout(n, 7)
    a, b = layout.grid
    assert a * b >= n and a * b - n < a
    shard, slot = layout.shard_and_slot(F.col("id"))
    placed = spark.range(n).select("id", shard.alias("s"), slot.alias("t"))
    rows = placed.withColumn("back", layout.row_at(F.col("s"), F.col("t"))).collect()
    assert all(r.id == r.back for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.s].append(r.t)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_neighbours_are_parted(spark):
    """Rows that follow each other land in the same shard as often as chance has it."""
    shard, _ = sharding.Layout(20_000, 10).shard_and_slot(F.col("id"))
    shards = [r.s for r in spark.range(20_000).select("id", shard.alias("s")).orderBy("id").collect()]
    same = sum(a == b for a, b in zip(shards, shards[1:], strict=False))
    assert 1700 < same < 2300


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PIECE", 5)
    texts = [*ODD_TEXTS, *[(None, "null id")] * 2, *[(77, "same row")] * 40]
    got = sharding.documents(documents(spark, [(k or 0, t) for k, t in texts]).withColumn("doc_id", F.expr("nullif(doc_id, 0)")), 4).collect()
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.documents(documents(spark, []), 4).count() == 0


def test_same_shards_whatever_the_partitions(spark):
    docs = documents(spark, [(k, f"text {k}") for k in range(500)])
    runs = [sorted(map(tuple, sharding.documents(d, 6).collect())) for d in (docs.repartition(7), docs.coalesce(1))]
    assert runs[0] == runs[1]


def test_query_follows_the_row_numbers(spark):
    """Row numbers by a plain sort, shards by the layout alone."""
    from ledgerwork.llm.registry import QUERIES

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    layout = sharding.Layout(len(docs), 24)
    shard, slot = layout.shard_and_slot(F.col("id"))
    at = {r.id: (r.s, r.t) for r in spark.range(len(docs)).select("id", shard.alias("s"), slot.alias("t")).collect()}
    want = set()
    for n, row in enumerate(sorted(docs, key=lambda r: r.doc_id)):
        data = (row.text or "").encode()
        want.add((row.doc_id, len(data) + 8, zlib.crc32(data), "rows", *at[n], None))
    assert set(map(tuple, QUERIES["op12_feistel_shards"](spark, folder).collect())) == want


def test_extra_columns_and_files(spark, tmp_path):
    docs = documents(spark, [(k, f"t{k}") for k in range(60)]).withColumn("slot", F.lit("own"))
    placed, layout = sharding.shard(docs, 3)
    assert placed.columns == [*docs.columns, "row_no", "shard", "_slot"]
    assert placed.select(docs.columns).exceptAll(docs).isEmpty()
    placed, layout = sharding.shard(docs.drop("slot"), 3)
    sharding.write(placed, layout, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().collect() and back.count() == 60
    one = back.where("shard = 1").orderBy("slot").select("row_no", "slot").collect()
    row = layout.row_at(F.lit(1).cast("long"), F.col("id")).alias("n")
    assert [r.row_no for r in one] == [r.n for r in spark.range(len(one)).orderBy("id").select(row).collect()]
