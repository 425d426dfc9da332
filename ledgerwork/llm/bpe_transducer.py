"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. The merges of a rank file fix, for every prefix of a piece, the last token of that
prefix's encoding; the encoding of the prefix is the encoding of what precedes that token, plus
the token. So the transducer needs to know, after each byte, only the bytes that may still be
the beginning of a token and, for each of their positions, the last token there. That is its
state; states are numbered and their moves computed when first met. A token is emitted once all
positions that a later token can start from agree on it, hence after a lookahead bounded by
the longest token. Two tokens may stand side by side if the merges turn their joined bytes into
just these two.

Decoding. `Utf8Decoder` takes the bytes of tokens in pieces of any size and keeps the one to
three bytes of an unfinished character between them.

Defined cases: null text is empty text; an empty text has no tokens; bytes that are no UTF-8 decode
to U+FFFD as `bytes.decode(errors="replace")` has it; extra columns are dropped, repeated rows stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most states and most remembered pieces of one task; beyond it, all are forgotten and built anew.
STATES = 400_000
PIECES = 300_000
_NONE = 1 << 60
_BYTE = [bytes((b,)) for b in range(256)]

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Piece of text in, token ids out; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = STATES):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:k] for token in ranks for k in range(1, len(token) + 1)}
        self.most_states = most_states
        self._pairs: dict[tuple[int, int], bool] = {}
        self._own: dict[int, bool] = {}
        self._windows: dict[bytes, tuple[tuple[tuple[int, int], ...], int]] = {}
        self._clear()

    def _clear(self) -> None:
        # a state: (bytes that may begin a token, last token at each position before, between and after them)
        self._states: list[tuple[bytes, tuple[tuple[int, ...], ...]]] = [(b"", ((),))]
        self._numbers = {self._states[0]: 0}
        # by state and byte as one number
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first: the definition the transducer is compiled from."""
        rank_of = self.ranks.get
        parts = [data[k : k + 1] for k in range(len(data))]
        # the rank of each neighbouring pair, kept up to date around every merge
        ranks = [rank_of(data[k : k + 2], _NONE) for k in range(len(data) - 1)]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], _NONE)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._pairs[left, right] = known
        return known

    def reached(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _window(self, window: bytes) -> tuple[tuple[tuple[int, int], ...], int]:
        """Of some bytes that may begin a token and one more: the tokens they end with, longest first, with
        where these start; and from where on the bytes may still begin a token."""
        known = self._windows.get(window)
        if known is None:
            ranks, prefixes = self.ranks, self.prefixes
            ends = [(start, ranks[window[start:]]) for start in range(len(window)) if window[start:] in ranks]
            rest = next((start for start in range(len(window)) if window[start:] in prefixes), len(window))
            known = tuple(x for x in ends if self.reached(x[1])), rest
            self._windows[window] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte and the tokens that are certain by then.

        A state holds, for each position from which a token may still start, the tokens not yet
        emitted up to it."""
        seen, pending = self._states[state]
        window = seen + _BYTE[byte]
        ends, rest = self._window(window)
        here: tuple[int, ...] | None = None
        for start, token in ends:
            before = pending[start]
            if before is not None and (not before or self.fits(before[-1], token)):
                here = before + (token,)
                break
        paths = (*pending[rest:], here)
        open_paths = [p for p in paths if p is not None]
        # the last token of a path stays: what may follow it depends on it
        sure = 0
        first = open_paths[0]
        if len(open_paths) == 1:
            sure = max(0, len(first) - 1)
        elif len(first) > 1:
            most = min(map(len, open_paths)) - 1
            while sure < most and all(p[sure] == first[sure] for p in open_paths):
                sure += 1
        if sure > 0:
            paths = tuple(None if p is None else p[sure:] for p in paths)
        key = (window[rest:], paths)
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append(key)
        return number, first[:sure] if sure > 0 else ()

    def encode(self, piece: bytes) -> list[int]:
        if len(self._states) > self.most_states:
            self._clear()
        out: list[int] = []
        state = 0
        moves = self._moves
        for byte in piece:
            at = state << 8 | byte
            if at in moves:
                state, emitted = moves[at]
            else:
                state, emitted = moves[at] = self._move(state, byte)
            if emitted:
                out += emitted
        out += self._states[state][1][-1]
        return out


class Utf8Decoder:
    """Incremental UTF-8: `feed` returns the text that is complete, `end` what is left, as U+FFFD.

    The state is the unfinished character: its bytes so far, at most three."""

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more of them."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC2:
                needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF5 else 0
                if needs <= back:
                    return 0
                second = data[-back + 1] if back > 1 else None
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                return back if second is None or low <= second <= high else 0
            if byte >= 0xC0:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        rest = self._unfinished(data)
        self.open = data[len(data) - rest :]
        return data[: len(data) - rest].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


#: White space of the pattern other than blank, tab, line feed and carriage return.
_RARE_SPACE = re.compile("[\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: White space and what follows it up to the next white space. No match of the pattern goes on from
#: text to white space, so a text without rare spaces may be cut there before it is matched.
_UNIT = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Characters that are cut into units at once.
_STEP = 1 << 18


class Tokenizer:
    """Whole texts by pattern and transducer, units met before from memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = PIECES):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.most_pieces = most_pieces
        self._known = _Units(self.transducer, self.pattern)

    def encode_bytes(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, a part of the text at a time."""
        known = self._known
        if _RARE_SPACE.search(text):
            for match in self.pattern.finditer(text):
                yield known.piece(match[0])
            return
        start = 0
        while start < len(text):
            end = start + _STEP
            # cut only before white space that follows text
            while end < len(text) and not (text[end] in " \t\n\r" and text[end - 1] not in " \t\n\r"):
                end += 1
            yield b"".join(map(known.__getitem__, _UNIT.findall(text, start, end)))
            start = end
            if len(known) > self.most_pieces:
                known.clear()

    def decode_bytes(self, ids: bytes) -> bytes:
        of = self.transducer.bytes_of
        return b"".join(map(of.__getitem__, memoryview(ids).cast("I")))


class _Units(dict):
    """Unit of text -> its ids; a missing one is matched, encoded and kept."""

    def __init__(self, transducer: Transducer, pattern: regex.Pattern):
        self.transducer = transducer
        self.pattern = pattern
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("I", self.transducer.encode(piece.encode())).tobytes()
            if len(piece) <= 200:
                self.pieces[piece] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        if len(self.pieces) > 2 * PIECES:
            self.pieces.clear()

    def __missing__(self, unit: str) -> bytes:
        ids = b"".join(map(self.piece, self.pattern.findall(unit)))
        # a very long unit is not worth its place
        if len(unit) <= 200:
            self[unit] = ids
        return ids


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """One per Python worker, so that later tasks start with what earlier ones met."""
    return Tokenizer(read_ranks(ranks_path), pattern)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids again: counts and digests of both per document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                decoder = Utf8Decoder()
                for ids in coder.encode_bytes(text.as_py() or ""):
                    ids_hash.update(ids)
                    n += len(ids) // 4
                    text_hash.update(decoder.feed(coder.decode_bytes(ids)).encode())
                text_hash.update(decoder.end().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            counts, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)
