"""The stages of the pipeline on odd rows, and the whole of it against its operators."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from helpers import word_sets

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

draw = random.Random(17)
LONG = " ".join(f"word{draw.randrange(900)}" for _ in range(60))
ODD = [
    (1, None, "en", "s", 0),
    (2, "", None, None, None),
    (3, LONG, "en", "s", 1),
    (3, LONG, "en", "s", 1),
    (3, "another text under the same id\n" + LONG[:200], "en", "s", 1),
    (None, LONG + " more", "en", "s", 1),
    (None, "without id", "en", "s", 1),
    (4, "x " * 30_000, "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(ODD, COLUMNS).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_stages_keep_the_columns(spark, odd, name):
    out = STAGES[name](spark, odd, FOLDER)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    assert STAGES[name](spark, odd.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_filters_take_rows_out_only(spark, odd, name):
    assert not rows(STAGES[name](spark, odd, FOLDER)) - rows(odd)


def test_one_row_of_a_group_stays(spark, odd):
    out = rows(STAGES["near_dedup"](spark, odd, FOLDER))
    assert out == rows(odd) - Counter([ODD[3], ODD[5]])


def test_lines_of_rows_that_share_an_id(spark, odd):
    out = sorted((str(r.doc_id), r.text or "") for r in STAGES["line_dedup"](spark, odd, FOLDER).collect())
    texts = [t for _, t in out]
    # the line and the nearly equal one stay once, the row with no id comes first
    assert sum(LONG in t for t in texts) == 1 and (str(None), LONG + " more") in out
    assert ("3", "another text under the same id\n" + LONG[:200]) in out and len(out) == len(ODD)
    lengths = {r.doc_id: (len(r.text), r.n_chars) for r in STAGES["line_dedup"](spark, odd, FOLDER).where("doc_id = 4").collect()}
    assert all(n == stated for n, stated in lengths.values())


def test_packing_of_every_row(spark, odd):
    packed = STAGES["packing"](spark, odd, FOLDER).collect()
    assert sum(r.piece == 0 for r in packed) == len(ODD) and max(r.offset + r.length for r in packed) <= 4096


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {r.doc_id for r in packed}
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()} and 0.5 * docs.count() < len(kept)
    assert folder is None or spark.conf.get("spark.checkpoint.dir") == folder
    # the stages one by one, near duplicates against all pairs of what the stages before have kept
    for name in ("toxicity", "quality", "line_dedup"):
        docs = STAGES[name](spark, docs, FOLDER)
    texts = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = word_sets([r.text for r in texts], 5)
    alone = {
        r.doc_id
        for k, r in enumerate(texts)
        if not any(k != j and len(sets[k] & s) * 100 >= 80 * len(sets[k] | s) > 0 for j, s in enumerate(sets))
    }
    assert alone <= kept <= {r.doc_id for r in texts}
