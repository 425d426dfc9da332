from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD_TEXTS, documents
from tokenizers import Tokenizer

from ledgerwork.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
PATHS = (A, B, public_tokenizers.PATTERN)

TEXTS = [
    "a\t\n  b  c\n\nd  ",
    " lead",
    "\nlead",
    "a▁b",
    "▁",
    "hi <|endoftext|> <s> </s> <unk> <0x41> x",
    "é☃漢字 \x1c.. \x1d!\x1f",
    "{\r\n}\r\n x y　z",
    "don't  stop 123abc!!  ",
    "\U0001f642\U0001f642 ﻿​ á",
    "x" * 3000,
    " " * 500,
    "ab cd " * 3000,
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    # characters of the byte-level vocabulary, by its own decoding of one entry at a time
    shown = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = iter(range(256, 400))
    shown |= {chr(next(rest)): c for c in range(256) if chr(c) not in shown}

    def ids(text):
        if not text:
            return [], [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(shown[c] for c in a.id_to_token(k)) for k in ids_a]
        pieces = [b.id_to_piece(k) for k in ids_b]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids_b, pieces, strict=True)
        ]
        same = b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode()
        return (ids_a, ids_b, bytes_a, bytes_b) if same else ([], [], [], [])

    return ids


def merge(ids_a, ids_b, bytes_a, bytes_b):
    """Groups of ids between common ends."""

    def ends(pieces):
        at, out = 0, []
        for p in pieces:
            at += len(p)
            out.append(at)
        return out

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    groups, first_a, first_b = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        last_a, last_b = ends_a.index(cut, first_a) + 1, ends_b.index(cut, first_b) + 1
        groups.append((ids_a[first_a:last_a], ids_b[first_b:last_b]))
        first_a, first_b = last_a, last_b
    return groups


def brute(docs, plain):
    per_doc = [(key, *(enc := plain(text))[:2], merge(*enc)) for key, text in docs]
    counts = Counter((g[0][-1], g[1][-1]) for *_, groups in per_doc for g in groups)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = Counter()
    for key, ids_a, ids_b, groups in per_doc:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out[
            key,
            len(ids_a),
            len(ids_b),
            len(groups),
            len(links),
            sum(counts[k] == most[k[1]] for k in links),
            sum(counts[k] for k in links),
            hashlib.sha256(said.encode()).hexdigest() if said else "",
        ] += 1
    return out


def test_ids_are_those_of_the_libraries(plain):
    pair = alignment.Pair(*PATHS)
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choices("ab.,'  \n\t\r\x1c1é▁ü!", k=draw.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(draw.choices("etaoinshrdlu", k=400)) for _ in range(200)]
    for text in texts:
        ids_a, ids_b, *_ = plain(text)
        assert [k.tolist() for k in pair.ids(text)] == [ids_a, ids_b], text[:200]


@pytest.mark.parametrize("stretch", [1, 2, 7, 1000])
def test_lockstep_finds_all_common_ends(stretch):
    draw = random.Random(stretch)
    docs = []
    for _ in range(60):
        total = draw.choice([0, 1, 2, 40, 300])
        both = [sorted({*draw.sample(range(1, total), draw.randint(0, total - 1)), total}) if total else [] for _ in "ab"]
        docs.append(both)
    flat = [np.array([e for d in docs for e in d[k]], np.int64) for k in (0, 1)]
    starts = [np.concatenate(([0], np.cumsum([len(d[k]) for d in docs]))).astype(np.int64) for k in (0, 1)]
    link_a, link_b = alignment.lockstep(*flat, *starts, stretch=stretch)
    want = [
        (starts[0][n] + a.index(e), starts[1][n] + b.index(e)) for n, (a, b) in enumerate(docs) for e in sorted(set(a) & set(b))
    ]
    assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == want


def test_odd_documents(spark, plain, monkeypatch):
    docs = [*ODD_TEXTS, *enumerate(TEXTS, 20), (None, "null id"), (None, None), *[(90, "same text. ")] * 50]
    table = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, block int, n_a int")
    got = Counter(map(tuple, alignment.align(table, *PATHS).collect()))
    assert got == brute(docs, plain)
    assert alignment.align(table.limit(0), *PATHS).count() == 0


def test_dictionary_and_links(spark, plain):
    docs = list(enumerate(["the cat. the dog", "the cats", "xyzzy the"]))
    aligned = alignment.blocks(documents(spark, docs).repartition(3), *PATHS)
    want = Counter()
    for key, text in docs:
        for a, b in merge(*plain(text)):
            want[key, a[-1], b[-1]] += 1
    assert {(r.doc_id, r.a, r.b): r.n for r in alignment.links(aligned).collect()} == want
    total = Counter()
    for (_, a, b), n in want.items():
        total[a, b] += n
    rows = alignment.dictionary(aligned).collect()
    assert {(r.a, r.b): r["count"] for r in rows} == total
    assert all(r.best == (r["count"] == max(n for (_, b), n in total.items() if b == r.b)) for r in rows)


def test_query_equals_brute_force(spark, plain):
    from ledgerwork.llm.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op13_lockstep_alignment"](spark, folder).collect())) == brute(docs, plain)
