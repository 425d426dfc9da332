"""Small tables and brute-force models for the operators."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars int, _score double, label string, id long"


def documents(spark, texts):
    """A documents table with extra columns whose names the operators use inside."""
    rows = [(k, t, None if k % 2 else "en", "s", None, 0.5, "x", -k) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (6, "the quick brown fox jumps over the lazy dog again and again today"),
    (7, "The quick brown fox jumps over the lazy dog again and again today"),
    (8, "x" * 50_000),
    (9, "word " * 20_000),
    (10, "üñî \U0001f642 你好 á <|endoftext|>\r\n\x0b\x0c end"),
]


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def join(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


def word_sets(texts, size):
    fold = re.compile(rb"[A-Z]")
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    out = []
    for text in texts:
        words = word.findall(fold.sub(lambda m: m[0].lower(), (text or "").encode()))
        if len(words) >= size:
            out.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)})
        else:
            out.append({tuple(words)} if words else set())
    return out
