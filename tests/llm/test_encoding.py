from __future__ import annotations

import array
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import ODD_TEXTS, documents
from tokenizers import Tokenizer as Reference

from ledgerwork.llm import bpe_transducer, chat, packing, runtime

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aeioutnshrdl'  \n.ABCéüñ你好\U0001f6420123 \x0b\x1ć"


@pytest.fixture(scope="module")
def reference():
    ranks = bpe_transducer.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(n):
    draw = random.Random(4)
    return ["".join(draw.choices(ALPHABET, k=draw.randint(0, 40))) for _ in range(n)]


def test_transducer_encodes_as_the_reference(reference):
    coder = bpe_transducer.Tokenizer(bpe_transducer.read_ranks(RANKS), public_tokenizers.PATTERN)
    coder.transducer.most_states = 500  # states are forgotten and built anew on the way
    for text in [*_texts(2000), "ab " * 200_000, "z" * 3000]:
        ids = b"".join(coder.encode_bytes(text))
        assert list(memoryview(ids).cast("I")) == reference.encode_ordinary(text)
        assert coder.decode_bytes(ids).decode() == text


def test_transducer_emits_before_the_end():
    coder = bpe_transducer.Transducer(bpe_transducer.read_ranks(RANKS))
    state, emitted = 0, []
    for byte in b"thequickbrownfoxjumpsoverthelazydog" * 5:
        state, tokens = coder._move(state, byte)
        emitted += tokens
    assert len(emitted) > 30


def test_utf8_decoder_in_pieces_of_any_size():
    data = "aé你\U0001f642z".encode() + b"\xff\xe4\xbd" + b"ok\xf0\x9f"
    for size in (1, 2, 3, 5, 100):
        decoder = bpe_transducer.Utf8Decoder()
        text = "".join(decoder.feed(data[k : k + size]) for k in range(0, len(data), size)) + decoder.end()
        assert text == data.decode("utf-8", "replace"), size


def test_round_trip_of_odd_rows(spark, reference):
    docs = documents(spark, ODD_TEXTS)
    got = sorted(map(tuple, bpe_transducer.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()))
    want = []
    for key, text in ODD_TEXTS:
        ids = reference.encode_ordinary(text or "")
        digest = hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        want.append((key, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_transducer.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_are_the_tokenizers_ids():
    words = packing.Words(WORDS)
    library = Reference.from_file(WORDS)
    texts = [*_texts(2000), "İ̧ ΣσΣ ẞ it's 12", "hello <|endoftext|> world", "A<|startoftext|><|ENDOFTEXT|>b", "", " "]
    texts += ["a_-b __ x²½ ١٢ Ⅷ … – “q” \xa0 \x85y 9_9 ºª ǅ µm €5 'LL don't"]
    texts += ["".join(random.Random(k).choices("ab1_-'.,²½١Ⅷ\xa0\x1c \t\u2003é–", k=30)) for k in range(500)]
    assert words.fast is not None
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    draw = random.Random(seed)
    histogram = {n: draw.randint(1, 40) for n in draw.sample(range(1, 101), 30)}
    filled = defaultdict(list)
    placed = defaultdict(int)
    for length, rank, each, count, first, offset in packing.plan(histogram, 100):
        assert rank == placed[length]
        placed[length] += count
        for k in range(count):
            filled[first + k // each].append((offset + k % each * length, length))
    assert placed == histogram
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100
    total = sum(n * c for n, c in histogram.items())
    assert len(filled) <= 1.23 * -(-total // 100) + 1


def test_packing_of_odd_rows(spark):
    rows = packing.pack(documents(spark, ODD_TEXTS), WORDS, capacity=64).collect()
    reference = Reference.from_file(WORDS)
    want = []
    for key, text in ODD_TEXTS:
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((key, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(documents(spark, []), WORDS).count() == 0


def test_chats_read_back(spark):
    turns = [
        (1, 0, "user", "hi \\<#> </turn>\n<turn assistant>\n"),
        (1, 1, "assistant", "\\\\ é\U0001f642 ### Assistant:"),
        (1, 1, "assistant", "\\\\ é\U0001f642 ### Assistant:"),
        (2, None, None, None),
        (2, 5, "assistant", ""),
        (None, 0, "user", "x"),
        *[(3, k, "assistant" if k % 2 else "user", "y" * (k % 7)) for k in range(5000)],
    ]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn int, role string, text string, part int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(table)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append(((-1 if turn is None else turn), role or "", text or ""))
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows.sort()
        learned = "".join(t for _, r, t in rows if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(rows)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in rows).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digests(chat.format_chats(table.limit(0))).count() == 0


def test_new_words_are_encoded_in_parts(monkeypatch):
    path = WORDS
    words, parts = packing.Words(path), []
    encode = words._encode
    monkeypatch.setattr(packing, "AT_ONCE", 3)
    monkeypatch.setattr(words, "_encode", lambda pieces: parts.append(len(pieces)) or encode(pieces))
    texts = ["one two three four five six seven", "", "eight nine, ten one"]
    plain = Reference.from_file(path)
    expected = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(words.ids(texts)) == expected
    assert max(parts) <= 3 and sum(parts) == 11


def test_free_memory_is_given_back_after_each_batch(monkeypatch):
    given = []
    monkeypatch.setattr(runtime, "give_back", lambda: given.append(1))
    batch = pa.record_batch([pa.array(["a", None, "bc"])], ["text"])
    assert sum(x.num_rows for x in runtime.slices(iter([batch, batch[:0], batch]), "text", 1)) == 6
    assert len(given) == 4


def test_moves_of_many_states_are_kept_apart():
    ranks = bpe_transducer.read_ranks(RANKS)
    coder = bpe_transducer.Transducer(ranks)
    draw = np.random.default_rng(5)
    pieces = [bytes(draw.choice(list(b"etaoins \xc3\xa9\xf0\x9f"), draw.integers(1, 12)).tolist()) for _ in range(400)]
    assert [coder.encode(p) for p in pieces] == [coder.merge(p) for p in pieces]
    assert len(coder._states) > 256
