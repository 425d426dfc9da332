"""Best-fit packing planned over the histogram of lengths.

Documents are tokenized where they are read and cut into pieces; only (document, piece, length,
checksum) goes on. The plan is made over counts: lengths in descending order go, best fit
first, into groups of sequences that are filled alike, and each step takes as many pieces of a length
as a group holds. Histogram and plan depend on the capacity, not on the number of documents, so the
driver may hold them. A piece then takes the slot of its rank among the pieces of its
length; ranks are counted in two levels, so a length that very many pieces have is no single task.

Defined cases: null text is empty; a document without tokens is one piece, the closing id; rows with the
same doc_id are packed each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from ledgerwork.llm import runtime

#: Pieces of words that a Python worker remembers; beyond it, it forgets all.
PIECES_KNOWN = 500_000
#: Pieces encoded at once; the library holds many times their size meanwhile.
AT_ONCE = 5_000
#: Parts in which the pieces of one length are ranked.
PARTS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"

#: The split pattern's classes in the faster of the two pattern libraries, and the characters on which they
#: differ: numbers that are no digits, rare white space, and all but Latin letters and common signs.
_LETTERS, _DIGIT, _SIGNS = r"[^\W\d_]+", r"\d", r"(?:[^\s\w]|_)+"
_ODD = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u024f\u2010-\u2027]")


class Words:
    """Token ids of whole texts, pieces of words met before from memory.

    For tokenizers that put NFC and lower case before a split pattern whose matches hold no white
    space, and mark the end of each match: a text's ids are those of its matches. New matches of many texts are
    encoded together and told apart by the end marks. Texts that quote a special token's string are the library's
    as a whole, as it takes such strings for the token."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # pieces are normalized already, and a second time could change them
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        with open(path) as file:
            spec = json.load(file)
        end = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[number for token, number in spec["model"]["vocab"].items() if token.endswith(end)]] = True
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        fast = pattern.replace(r"[\p{L}]+", _LETTERS).replace(r"[\p{N}]", _DIGIT).replace(r"[^\s\p{L}\p{N}]+", _SIGNS)
        self.fast = None if r"\p" in fast else re.compile(fast)
        quoted = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, quoted)) or "(?!)")
        self.pieces: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        found = self.plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids
        ids = np.array(found, "<u4")
        bounds = np.flatnonzero(self.ends[ids]) + 1
        data, bounds = ids.tobytes(), (4 * bounds).tolist()
        if len(bounds) != len(pieces):
            raise ValueError("the tokenizer does not mark the end of each piece")
        return [data[low:high] for low, high in zip([0, *bounds], bounds, strict=False)]

    def _split(self, text: str) -> list[str]:
        text = _lower(text)
        return (self.split if self.fast is None or _ODD.search(text) else self.fast).findall(text)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > PIECES_KNOWN:
            self.pieces.clear()
        quoting = [self.special.search(text) is not None for text in texts]
        split = [[] if quotes else self._split(text) for text, quotes in zip(texts, quoting, strict=True)]
        missing = list(set().union(*split).difference(self.pieces))
        for low in range(0, len(missing), AT_ONCE):
            part = missing[low : low + AT_ONCE]
            self.pieces.update(zip(part, self._encode(part), strict=True))
        of = self.pieces.__getitem__
        for text, found, quotes in zip(texts, split, quoting, strict=True):
            if quotes:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(of, found))


def _lower(text: str) -> str:
    """NFC, then lower case letter by letter: a sigma at the end of a word is no special case."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.replace("\u03a3", "\u03c3").lower()


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    """One per Python worker, so that later tasks start with the words of earlier ones."""
    return Words(path)


def tokenize(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Documents to pieces of at most `capacity` tokens, `end_id` behind each document."""
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in runtime.slices(batches, "text", 2 << 20):
            rows = []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                ids = found + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Length -> count to steps (length, first rank, pieces per sequence, pieces, first sequence, offset).

    Best fit, longest first: a piece goes to the fullest sequence that has room. Sequences filled
    alike are one group; a step puts pieces of one length into a group."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, sequences)
    rooms: list[int] = []  # ascending
    used = 0
    steps = []

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, count = capacity, used, -(-left // (capacity // length))
                used += count
            each = room // length
            taken = min(left, each * count)
            full, part = divmod(taken, each)
            steps.append((length, rank, each, taken, first, capacity - room))
            put(room - each * length, first, full)
            if part:
                put(room - part * length, first + full, 1)
            put(room, first + full + bool(part), count - full - bool(part))
            rank += taken
            left -= taken
    return steps


def place(pieces: DataFrame, capacity: int, parts: int = PARTS) -> DataFrame:
    """`pieces` (of a kept table) with sequence_id and offset."""
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    steps = sorted(plan({r["length"]: r["count"] for r in counts}, capacity))
    table = np.array(steps, np.int64).reshape(-1, 6)

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("part")
    dealt = pieces.select("*", part)
    sizes = dealt.groupBy("length", "part").count()
    before = sizes.select(
        F.col("length").alias("of_length"),
        F.col("part").alias("of_part"),
        F.coalesce(
            F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("before"),
    )
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("own", F.row_number().over(own) - 1)
    ranked = numbered.join(
        before, (numbered["length"] == before["of_length"]) & (numbered["part"] == before["of_part"])
    ).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a step is found by length and first rank
        firsts = {n: table[table[:, 0] == n] for n in np.unique(table[:, 0]).tolist()}
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                own_steps = firsts[int(n)]
                step = own_steps[np.searchsorted(own_steps[:, 1], rank[mine], "right") - 1]
                in_sequence, slot = np.divmod(rank[mine] - step[:, 1], step[:, 2])
                sequence[mine] = step[:, 4] + in_sequence
                offset[mine] = step[:, 5] + slot * n
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    return ranked.mapInArrow(run, PLACED)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(runtime.keep(tokenize(docs, path, end_id, capacity)), capacity)
