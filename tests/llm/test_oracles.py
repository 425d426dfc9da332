"""The queries that SQL can express, against it."""

from __future__ import annotations

import duckdb
import pytest
from compare import compare

from ledgerwork.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert compare(spark, con, name, registry.QUERIES[name], registry.SQL[name], FOLDER) is None


def test_links_are_counted_by_sql(spark, tmp_path):
    """The given embeddings hold no pair at the bound: made ones that do."""
    import numpy as np

    numbers = np.random.default_rng(4)
    base = numbers.normal(size=(30, 16))
    rows = [(k, (base[k % 30] + numbers.normal(size=16) * 0.15).tolist(), k % 3) for k in range(150)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "op1_itq_near_dedup"
    assert con.execute(f"SELECT SUM(n_links) FROM ({registry.SQL[name]}) q").fetchone()[0] > 100
    assert compare(spark, con, name, registry.QUERIES[name], registry.SQL[name], str(tmp_path)) is None
