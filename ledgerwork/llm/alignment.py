"""Tokens of two tokenizers put side by side, by lockstep vectorised merging.

Both tokenizers cut the same bytes, a space and the text. Where a token of each ends is a cut; between two cuts
stands a group, and the two tokens that end there are linked.

Documents go in blocks of bounded size. Of a block the ends of all tokens are two long numpy vectors; a state
vector holds one pointer into each for every lane, a lane being a document or a stretch of STRETCH tokens of a
longer one. In each step all lanes compare the two ends they point at: equal ends emit a link and a cut and
both pointers advance, else the one behind does. Lanes that are through are compacted away.

A block is one row: per document its counts, the digest of its groups, and which of the block's distinct id
pairs it links how often. Blocks are written once. The pairs, one row a block and pair, are counted over the
corpus by a shuffle; the counts a block needs come back to it as one row, so the corpus-wide table of pairs is
never in one place, and a pair that all documents have is one row a block.

Encoding. The first tokenizer's vocabulary is run as ranks, merging the adjacent pair whose union has the least
id. That gives the ids of its list of merges: each entry is the union of what the merges before it make of its own
bytes, so a pair whose union is an entry, with no lower merge left, is that entry's pair.

Defined cases: null and empty texts, and texts whose tokens do not give the bytes back, have zeros and an empty digest;
null ids stay null; rows are aligned each, repeated ids too; a very long text is a block of its own; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwork.llm import runtime

#: Bytes of text of a block, or one document.
BLOCK = 512 << 10
#: Tokens of the first tokenizer that a lane passes at most.
STRETCH = 256

BLOCKS = (
    "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
    "pair_a array<int>, pair_b array<int>, pair_n array<long>, starts array<long>, of_pair array<int>, times array<int>"
)
DOCUMENTS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)

_MARK = "▁"


def _byte_of_char() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable ones for themselves,
    the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Two tokenizers: byte-level `a` on a space and the text, `b`, which adds the space, on the text."""

    def __init__(self, path_a: str, path_b: str, pattern: str) -> None:
        chars = _byte_of_char()
        listed = Tokenizer.from_file(path_a)
        special = {token.content for token in listed.get_added_tokens_decoder().values()}
        vocabulary = listed.get_vocab(with_added_tokens=False)
        ranks = {bytes(chars[c] for c in token): k for token, k in vocabulary.items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_a[k] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)
        ]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and the text; none if they do not give its bytes."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        a, b = self.a.encode_ordinary(f" {text}"), self.b.encode(text, num_threads=1)
        data = f" {text}".encode()
        if b"".join([self.bytes_a[k] for k in a]) != data or b"".join([self.bytes_b[k] for k in b]) != data:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)


def lockstep(
    ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, stretch: int = STRETCH
) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the tokens that end together, in order.

    `ends_*` are the ends of the tokens of all documents behind each other, growing within a document, the last ends of
    a document equal; `starts_*` are where the documents' tokens start, and the total."""
    tokens = np.diff(starts_a)
    lanes = -(-tokens // stretch)
    doc = np.repeat(np.arange(len(tokens)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at_a = starts_a[doc] + nth * stretch
    end_a = np.minimum(at_a + stretch, starts_a[doc + 1])
    # the ends of a document behind those of the one before: one growing vector to search in
    top = int(max(ends_a.max(initial=0), ends_b.max(initial=0))) + 1
    far_b = ends_b + np.repeat(np.arange(len(tokens)) * top, np.diff(starts_b))
    before = np.where(nth > 0, ends_a[np.maximum(at_a - 1, 0)], 0) + doc * top
    at_b = np.searchsorted(far_b, before, "right")
    found_a, found_b = [], []
    while len(at_a):
        here_a, here_b = ends_a[at_a], ends_b[at_b]
        same = here_a == here_b
        found_a.append(at_a[same])
        found_b.append(at_b[same])
        step_a, step_b = here_a <= here_b, here_b <= here_a
        at_a = at_a + step_a
        at_b = at_b + step_b
        # a lane is through with its tokens of a; those of b that are left end inside the next lane
        going = at_a < end_a
        if not going.all():
            at_a, at_b, end_a = at_a[going], at_b[going], end_a[going]
    link_a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
    link_b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
    order = np.argsort(link_a, kind="stable")
    return link_a[order], link_b[order]


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to most - 1 with room for a separator, and their number."""
    texts = [str(k).encode() for k in range(most)]
    width = len(texts[-1]) + 1
    table = np.frombuffer(b"".join(t.ljust(width, b",") for t in texts), np.uint8).reshape(most, width)
    return table, np.array([len(t) for t in texts])


class Block:
    """The documents of one block, aligned."""

    def __init__(self, pair: Pair, digits: tuple[np.ndarray, np.ndarray], texts: list[str | None]) -> None:
        ids = [pair.ids(text) for text in texts]
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
        self.starts_a = np.concatenate(([0], np.cumsum(self.n_a)))
        self.starts_b = np.concatenate(([0], np.cumsum(self.n_b)))
        ends = [
            total - np.repeat((np.concatenate(([0], total)))[starts[:-1]], n)
            for total, starts, n in (
                (np.cumsum(pair.size_a[self.a]), self.starts_a, self.n_a),
                (np.cumsum(pair.size_b[self.b]), self.starts_b, self.n_b),
            )
        ]
        self.link_a, self.link_b = lockstep(ends[0], ends[1], self.starts_a, self.starts_b)
        self.doc_of_link = np.searchsorted(self.starts_a, self.link_a, "right") - 1
        self.n_groups = np.bincount(self.doc_of_link, minlength=len(texts))
        self.digests = self._digests(digits)

    def _digests(self, digits: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each document: all texts assembled in one buffer."""
        table, sizes = digits
        # tokens of b in the groups before a token of a, tokens of a up to the end of the group of a token of b
        group_a = np.searchsorted(self.link_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.link_b, np.arange(len(self.b)))
        ends_b = np.concatenate(([0], self.link_b + 1))
        place = np.concatenate((np.arange(len(self.a)) + ends_b[group_a], np.arange(len(self.b)) + self.link_a[group_b] + 1))
        tokens = np.empty(len(place), np.int64)
        tokens[place] = np.concatenate((self.a, self.b))
        sign = np.full(len(place), ord(","), np.uint8)
        sign[place[self.link_a]] = ord("|")
        sign[place[len(self.a) + self.link_b]] = ord(";")
        size = sizes[tokens]
        cells = table[tokens]
        cells[np.arange(len(tokens)), size] = sign
        out = cells[np.arange(table.shape[1]) <= size[:, None]]
        at = np.concatenate(([0], np.cumsum(size + 1)))[self.starts_a + self.starts_b]
        # without the last semicolon
        return [hashlib.sha256(out[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at, at[1:], strict=False)]

    def pairs(self) -> tuple[np.ndarray, ...]:
        """The block's distinct pairs with their number, and per document (from `starts`) which it has how often."""
        a, b = self.a[self.link_a], self.b[self.link_b]
        distinct, of_link, n = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
        cells, times = np.unique(self.doc_of_link * max(len(distinct), 1) + of_link, return_counts=True)
        doc, of_pair = np.divmod(cells, max(len(distinct), 1))
        starts = np.searchsorted(doc, np.arange(len(self.n_a) + 1))
        return distinct >> 32, distinct & 0xFFFFFFFF, n, starts, of_pair, times


@lru_cache(1)
def _pair(path_a: str, path_b: str, pattern: str) -> tuple[Pair, tuple[np.ndarray, np.ndarray]]:
    pair = Pair(path_a, path_b, pattern)
    return pair, _digits(max(len(pair.bytes_a), len(pair.bytes_b)))


def _aligner(path_a: str, path_b: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, digits = _pair(path_a, path_b, pattern)
        for batch in runtime.slices(batches, "text", BLOCK):
            block = Block(pair, digits, batch.column("text").to_pylist())
            values = [block.n_a, block.n_b, block.n_groups, block.digests, *block.pairs()]
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.int32()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))]
            rows = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays]
            yield pa.RecordBatch.from_arrays(rows, [part.split()[0] for part in BLOCKS.split(", ")])

    return align


def blocks(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """`docs` (doc_id, text) -> one row a block, written to the shared folder.

    `pattern` splits texts for the first tokenizer."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = texts.mapInArrow(_aligner(path_a, path_b, pattern), BLOCKS)
    return runtime.keep(aligned.withColumn("block", F.monotonically_increasing_id()))


def _pairs(aligned: DataFrame) -> DataFrame:
    """One row a block and distinct pair: block, at, a, b, n."""
    zipped = F.arrays_zip("pair_a", "pair_b", "pair_n")
    return aligned.select("block", F.posexplode(zipped).alias("at", "_p")).select(
        "block", "at", F.col("_p.pair_a").alias("a"), F.col("_p.pair_b").alias("b"), F.col("_p.pair_n").alias("n")
    )


def dictionary(aligned: DataFrame) -> DataFrame:
    """The id pairs that are linked anywhere: a, b, count over all links, best (no other a has more links with b)."""
    counts = _pairs(aligned).groupBy("a", "b").agg(F.sum("n").alias("count"))
    # as many rows as the second vocabulary has ids
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def links(aligned: DataFrame) -> DataFrame:
    """doc_id, a, b, n: the linked id pairs of each document and how often it links them."""
    per_doc = aligned.select("*", F.posexplode("doc_ids").alias("_doc", "doc_id"))
    first, end = F.col("starts")[F.col("_doc")], F.col("starts")[F.col("_doc") + 1]
    cells = F.slice(F.arrays_zip("of_pair", "times"), (first + 1).cast("int"), (end - first).cast("int"))
    rows = per_doc.select("doc_id", "pair_a", "pair_b", F.explode(cells).alias("_c"))
    at = F.col("_c.of_pair")
    return rows.select("doc_id", F.col("pair_a")[at].alias("a"), F.col("pair_b")[at].alias("b"), F.col("_c.times").alias("n"))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs to documents."""
    names = [part.split()[0] for part in DOCUMENTS.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].values for name in batch.schema.names if batch.column(name)[k].is_valid}
            docs = len(row["doc_ids"])
            sums = np.zeros((2, docs), np.int64)
            if "at" in row:
                at = row["at"].to_numpy()
                counts, best = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
                counts[at] = row["count"].to_numpy()
                best[at] = row["best"].to_numpy(zero_copy_only=False)
                of_pair, times = row["of_pair"].to_numpy(), row["times"].to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(docs), np.diff(row["starts"].to_numpy()))
                np.add.at(sums[0], doc, times * best[of_pair])
                np.add.at(sums[1], doc, times * counts[of_pair])
            yield pa.RecordBatch.from_arrays(
                [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_groups"], *map(pa.array, sums), row["digests"]], names
            )


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Two tokens end together only where both end, so every group has one link."""
    aligned = blocks(docs, path_a, path_b, pattern)
    known = _pairs(aligned).join(dictionary(aligned), ["a", "b"]).select("block", "at", "count", "best")
    # as many entries as a block has distinct pairs
    per_block = known.groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("_known")).select(
        "block", *[F.col(f"_known.{c}").alias(c) for c in ("at", "count", "best")]
    )
    rows = aligned.join(per_block, "block", "left").select(
        "doc_ids", "n_a", "n_b", "n_groups", "digests", "starts", "of_pair", "times", "at", "count", "best"
    )
    found = runtime.keep(rows.mapInArrow(_weigh, DOCUMENTS))
    runtime.drop(aligned)
    return found
