from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from helpers import ODD_TEXTS, documents, find, join, word_sets
from pyspark.sql import functions as F

from ledgerwork.llm import components, itq, line_dedup, near, shingles, simhash, superminhash


def _mutated(seed, groups, copies, words, change):
    """Texts in groups of near copies."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    out = []
    for _ in range(groups):
        base = draw.choices(vocabulary, k=words)
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randint(0, change)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            out.append(" ".join(text))
    return out


def _components(sets, percent=80):
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                join(parent, a, b)
    return [find(parent, k) for k in range(len(sets))]


def test_signatures_are_those_of_the_step_by_step_algorithm():
    members = shingles.mix(np.arange(1, 40, dtype=np.uint64))
    places = 16
    want = [None] * places
    for member in members:
        order = list(range(places))
        for step in range(places):
            offer, index = superminhash._draw(np.array([member]), step, places)
            order[step], order[index[0]] = order[index[0]], order[step]
            at = order[step]
            want[at] = int(offer[0]) if want[at] is None else min(want[at], int(offer[0]))
    got = superminhash.signatures(members, np.array([0, 0, len(members)]), places)
    assert got[1].tolist() == want
    assert (got[0] == superminhash._EMPTY).all()


def test_signatures_estimate_similarity():
    members = shingles.mix(np.arange(1, 1001, dtype=np.uint64))
    both = np.concatenate((members[:900], members[100:]))
    signed = superminhash.signatures(both, np.array([0, 900, 1800]))
    assert abs((signed[0] == signed[1]).mean() - 0.8) < 0.1


def test_word_shingles_match_plain_sets():
    texts = [t for _, t in ODD_TEXTS]
    got, offsets = shingles.word_shingles(pa.array(texts, pa.string()), 4)
    sets = word_sets(texts, 4)
    assert np.diff(offsets).tolist() == [len(s) for s in sets]
    assert got[offsets[6] : offsets[7]].tolist() == got[offsets[7] : offsets[8]].tolist()  # A-Z as a-z


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    texts = ["lorem ipsum  dolor\n" * 300, "", "a b c d e " * 200]
    whole = shingles.word_shingles(pa.array(texts), 4)
    monkeypatch.setattr(shingles, "_BLOCK", 64)
    cut = shingles.word_shingles(pa.array(texts), 4)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(500, 560)] + [(9, 9)]
    parent = {x: x for link in links for x in link}
    for a, b in links:
        join(parent, a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {x for x in parent if all(a == b for a, b in links if x in (a, b))}
    assert got == {x: find(parent, x) for x in parent if x not in alone}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 5)
    texts = _mutated(1, 12, 12, 80, 5) + [t for _, t in ODD_TEXTS if t != "one"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in superminhash.near_duplicates(documents(spark, rows), words=4).collect()}
    sets = word_sets(texts, 4)
    want = _components(sets)
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {
        k: (len(sets[k]), want[k], want[k] == k) for k in range(len(texts))
    }


def test_near_duplicates_of_odd_rows(spark):
    rows = superminhash.near_duplicates(documents(spark, ODD_TEXTS), words=4).collect()
    assert len(rows) == len(ODD_TEXTS)
    got = {r.doc_id: r.component_id for r in rows}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10}
    assert superminhash.near_duplicates(documents(spark, [])).count() == 0


def test_lines_against_all_pairs(spark):
    draw = random.Random(6)
    base = _mutated(2, 10, 1, 12, 0)
    texts = [None, "", "\n \n", "same\nsame"]
    for _ in range(40):
        lines = []
        for line in draw.choices(base, k=4):
            at = draw.randrange(len(line))
            lines.append(draw.choice((line, line.upper(), line[:at] + "#" + line[at + 1 :], line[: len(line) // 2])))
        texts.append("\n".join([*lines, "", "one of its own %d" % draw.randrange(10**9)]))
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, lines="_n", dropped="_d").collect()}
    places = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    low = [x.lower() for _, _, x in places]
    component = _components([{x[k : k + 7] for k in range(max(1, len(x) - 6))} for x in low])
    seen, gone = set(), {}
    for (d, k, _), c in zip(places, component, strict=True):
        if c in seen:
            gone.setdefault(d, set()).add(k)
        seen.add(c)
    for d, text in enumerate(texts):
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(d, ()))
        assert (got[d].text, got[d]._d, got[d].label) == (kept, len(gone.get(d, ())), "x"), d
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(5, "shared line\nonly in the first"), (5, "only in the second\nshared line"), (None, "shared line\nwithout id")]
    rows += [(None, "without id"), (7, "all here"), (7, "all here")]
    table = spark.createDataFrame([(k, t, n, "x") for n, (k, t) in enumerate(rows)], "doc_id long, text string, _row int, _check string")
    got = {r._row: r.text for r in line_dedup.dedup_lines(table.coalesce(1)).collect()}
    # null ids come first, then the row of input
    assert got == {0: "only in the first", 1: "only in the second", 2: "shared line\nwithout id", 3: "", 4: "all here", 5: ""}


def test_long_words_are_told_apart(spark):
    """Sums modulo 2^64 cannot tell these words from each other."""
    signs = [bin(k).count("1") % 2 for k in range(2048)]
    a, b = ("".join("ab"[s ^ flip] for s in signs) for flip in (0, 1))
    rows = [(1, f"one {a} two three"), (2, f"one {b} two three"), (3, f"one {a.upper()} two three")]
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(documents(spark, rows), words=4).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_left_over_items_of_a_bucket(spark, monkeypatch):
    """One base and copies with so many edits that few are alike, in buckets of several chunks."""
    monkeypatch.setattr(near, "CHUNK", 7)
    draw = random.Random(21)
    base = [f"w{k}" for k in range(160)]
    texts = [" ".join(base)]
    for _ in range(120):
        copy = list(base)
        for at in draw.sample(range(160), draw.randint(1, 9)):
            copy[at] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(documents(spark, list(enumerate(texts))), words=4).collect()}
    assert [got[k] for k in range(len(texts))] == _components(word_sets(texts, 4))


def test_isolated_lines_at_the_bound_are_found(spark):
    draw = random.Random(12)
    rows = []
    for k in range(1500):
        # 70 shingles, of which one changed character renews 7: 63 of 77 are shared, 0.818
        line = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=76))
        rows += [(2 * k, line), (2 * k + 1, line[:35] + "#" + line[36:])]
    got = line_dedup.dedup_lines(documents(spark, rows), lines="_n", dropped="_d").collect()
    assert sum(r._d for r in got) == 1500
    assert not any(r._d for r in got if r.doc_id % 2 == 0)


def test_fingerprints_of_odd_rows(spark):
    rows = [(k, t) for k, (_, t) in enumerate(ODD_TEXTS)]
    got = {r.doc_id: r for r in simhash.fingerprints(documents(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    for k, text in enumerate(texts):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(k + 1) % len(texts)][:half]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[3].fingerprint == got[4].fingerprint and got[3].near_next == 1
    assert got[0].fingerprint == "0" * 16
    assert simhash.fingerprints(documents(spark, [])).count() == 0


def test_fingerprints_in_many_ranges(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(draw.randrange(-(2**60), 2**60), " ".join(draw.choices("abcdefgh", k=9))) for _ in range(300)]
    rows = sorted(dict(rows).items())
    whole = {r.doc_id: tuple(r) for r in simhash.fingerprints(documents(spark, rows)).collect()}
    monkeypatch.setattr(simhash, "RANGE", 7)
    assert {r.doc_id: tuple(r) for r in simhash.fingerprints(documents(spark, rows)).collect()} == whole
    texts = [t for _, t in rows]
    for (key, text), after in zip(rows, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        assert whole[key][2] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_neighbours_against_all_pairs(spark):
    draw = random.Random(5)
    bits = [draw.getrandbits(64) - 2**63 for _ in range(60)]
    bits += [b ^ sum(1 << draw.randrange(63) for _ in range(draw.randint(1, 4))) for b in bits]
    frame = spark.createDataFrame([(b,) for b in bits], "bits long")
    mask = (1 << 64) - 1
    got = {(r.query, r.bits, r.distance) for r in simhash.neighbours(frame, frame.limit(30)).collect()}
    apart = {(a, b): bin((a ^ b) & mask).count("1") for a in bits[:30] for b in bits}
    assert got == {(a, b, d) for (a, b), d in apart.items() if d <= 3}


def test_embeddings_against_all_pairs(spark):
    random_numbers = np.random.default_rng(2)
    base = random_numbers.normal(size=(40, 24))
    rows = [b + random_numbers.normal(size=24) * 0.12 for b in base for _ in range(8)]
    vectors = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    vectors += [(1000, vectors[0][1]), (1001, [2 * x for x in vectors[1][1]]), (1002, None), (1003, [0.0] * 24)]
    vectors += [(1004, [float("nan")] * 24), (1005, [None] * 24), (1006, []), (1007, vectors[2][1][:20]), (1008, [float("inf")] * 24)]
    table = spark.createDataFrame([(k, v, "x", 0) for k, v in vectors], "vec_id long, embedding array<double>, id string, table int")
    got = {r.vec_id: r for r in itq.near_duplicates(table).collect()}
    good = {k: np.array(v) / np.linalg.norm(v) for k, v in vectors if k < 1002}
    parent = {k: k for k, _ in vectors}
    links = {k: 0 for k, _ in vectors}
    for a in good:
        for b in good:
            if a != b and good[a] @ good[b] >= 0.95:
                links[a] += 1
                join(parent, a, b)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {
        k: (links[k], find(parent, k), find(parent, k) == k) for k, _ in vectors
    }
    assert itq.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_with_a_common_direction(spark):
    random_numbers = np.random.default_rng(7)
    common = np.zeros(64)
    common[0] = 1.6
    base = random_numbers.normal(size=(1200, 64)) / 8 + common
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = random_numbers.normal(size=(1200, 64))
    off -= (off * base).sum(axis=1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    rows = np.vstack((base, 0.955 * base + (1 - 0.955**2) ** 0.5 * off))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(table).collect()}
    want = (rows @ rows.T >= 0.95).sum(axis=1) - 1
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.995 * want.sum()


def test_links_fetch_texts_once_and_deal_an_item_once_to_a_chunk(spark, monkeypatch):
    """Lines of one bucket: signatures are made of the texts fetched, and no item has two rows in its own chunk."""
    base = [f"{k} sentence number {k} has its own long wording {k * 7919}" for k in range(6)]
    lines = spark.createDataFrame(list(enumerate([*base, base[0] + "!", base[1] + "!"])), "id long, text string").coalesce(1)
    asked, fetched, dealt = [], [], []
    sift = near.sift

    def signatures(texts):
        asked.append(texts.columns)
        return line_dedup._signatures(texts)

    def fetch(ids):
        fetched.append(ids.columns)
        return lines.join(ids, "id", "left_semi")

    def watched(rows, *rest):
        dealt.extend(rows.select("key", "chunk", "id").collect())
        return sift(rows, *rest)

    monkeypatch.setattr(near, "sift", watched)
    monkeypatch.setattr(near, "CHUNK", 3)
    items = line_dedup._bands(lines).select("id", F.array(F.lit(77).cast("long"), F.col("bands")[0]).alias("bands"))
    found = near.links(items, signatures, fetch, line_dedup.char_sets, 80, line_dedup.MARGIN)
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 1), (6, 0), (7, 1)]
    assert len(fetched) == 1 and asked == [["id", "text"]]
    assert len(dealt) and len(set(dealt)) == len(dealt)


def test_buckets_against_a_plain_count(spark, monkeypatch):
    """Keys travel together, not as a row each; items without id and keys of one item are in no bucket."""
    monkeypatch.setattr(near, "DEALT", 300)
    monkeypatch.setattr(near, "CHUNK", 4)
    draw = random.Random(4)
    rows = [(k * 7919 - 90_000, [draw.choice((draw.randrange(60), draw.getrandbits(63))) - 2**62 for _ in range(5)]) for k in range(400)]
    rows = [(k, list(dict.fromkeys(keys))) for k, keys in rows] + [(None, [-(2**62)]), (5, []), (6, None)]
    want = {}
    for k, keys in rows:
        for key in keys or () if k is not None else ():
            want.setdefault(key, []).append(k)
    want = {(k, key, min(x ^ key for x in ids) ^ key, -(-len(ids) // 4)) for key, ids in want.items() if len(ids) > 1 for k in ids}
    got = near.buckets(spark.createDataFrame(rows, "id long, bands array<long>")).select("id", "key", "pivot", "chunks").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 500
    keys = shingles.mix(np.arange(1 << 17, dtype=np.uint64)).view(np.int64)
    assert near._by_part([(keys, keys)]).num_rows <= 1 << near.PART_BITS


def test_lines_meet_before_they_travel(spark):
    """A line that stands often in a part of the input is one row of it, at its first place; ids that are null come first."""
    rows = [(0, 7, "twice\ntwice\n\n \nonce"), (1, 3, "twice"), (2, None, "x\ntwice"), (3, None, None), (4, None, "twice")]
    docs = spark.createDataFrame(rows, "row long, doc_id long, text string").coalesce(1)
    found = line_dedup._distinct_lines(docs).collect()
    assert sorted((r.text, r.n, r.doc_id, r.row, r.line) for r in found) == [
        ("once", 1, 7, 0, 4), ("twice", 5, None, 2, 1), ("x", 1, None, 2, 0)
    ]
    halves = {(r.half_a, r.half_b): r.text for r in found}
    placed = line_dedup._placed_lines(docs).collect()
    assert [(r.row, r.line, halves[r.half_a, r.half_b]) for r in placed if r.row in (0, 2)] == [
        (0, 0, "twice"), (0, 1, "twice"), (0, 4, "once"), (2, 0, "x"), (2, 1, "twice")
    ]


def test_sift_goes_on_over_batches(spark, monkeypatch):
    """What one batch holds of a group is compared with what the next ones hold."""
    draw = random.Random(30)
    lines = [(k, "a line of words that all of them have in common %d" % draw.randrange(10**4)) for k in range(60)]
    table = spark.createDataFrame(lines, "id long, text string").coalesce(1)
    signed = line_dedup._signatures(table)
    rows = [(77, 0, k % 3, k, k) for k, _ in lines]
    rows = spark.createDataFrame(rows, "key long, chunk int, kind int, id long, own long")

    def pairs():
        found = near.sift(rows, signed, 50, 8).collect()
        told = [r.id for r in found if r.kind == 0]
        assert len(told) == len(set(told)) and set(told) == {p for r in found for p in r.pivots}
        return {(r.id, p) for r in found if r.kind == 1 for p in r.pivots}

    whole = pairs()
    monkeypatch.setattr(near, "COMPARED", 1)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "7")
    try:
        assert pairs() == whole
    finally:
        spark.conf.set(limit, before)
    kind = {k: k % 3 for k, _ in lines}
    assert len(whole) > 100 and all(kind[p] < 2 and (kind[p] == 0 or a < p or kind[a] == 2) for a, p in whole)
