from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerwork.llm import auction, repair

SHAPE = re.compile("(s?(ua)+)?")
LEGAL = {"su", "ua", "au"}


def cheapest(rows, most=14):
    """Least (cost, audit, roles) over all edit strings, by a search over costs that knows no prices or states."""
    best = {}
    frontier = {(0, ""): [(0, "")]}  # (rows read, roles put out) -> [(cost, audit)]
    todo = [(0, "", 0, "")]
    import heapq

    heapq.heapify(todo)
    while todo:
        cost, audit, i, roles = heapq.heappop(todo)
        if (i, roles) in best:
            continue
        best[i, roles] = (cost, audit)
        if i == len(rows) and SHAPE.fullmatch(roles):
            return cost, audit
        if len(roles) > most:
            continue
        for role in "ua":
            heapq.heappush(todo, (cost + 2, audit + "I", i, roles + role))
        if i < len(rows):
            initial, go, cut = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, roles))
            if not go:
                heapq.heappush(todo, (cost + cut, audit + "K", i + 1, roles + initial))
                for role in "ua":
                    heapq.heappush(todo, (cost + 2 + cut, audit + "R", i + 1, roles + role))
    del frontier


def as_bytes(rows):
    code = {"s": 0, "u": 1, "a": 2}
    return bytes(code.get(r, 3) | (4 if go else 8 * cut) for r, go, cut in rows)


def test_auction_finds_the_least_cheapest_audit():
    draw = random.Random(11)
    for n in (0, 1, 2, 3):
        for roles in itertools.product("suax", repeat=n):
            rows = [(r, 0, 0) for r in roles]
            assert repair.solve(as_bytes(rows)) == cheapest(rows), rows
    for _ in range(300):
        rows = [(draw.choice("suaux"), draw.random() < 0.2, int(draw.random() < 0.3)) for _ in range(draw.randint(1, 7))]
        assert repair.solve(as_bytes(rows)) == cheapest(rows), rows


def by_table(rows: bytes):
    """Cost and audit by distances from the end, without prices."""
    states = range(4)
    ends = [0 if auction.may_end(s) else 10**9 for s in states]
    table = []
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            ends = [min(c + table[-1][t] for a, c, r, t in auction.arcs(rows, i, s) if r > i) for s in states]
        for _ in range(4):
            ends = [min(ends[s], auction.INSERT + ends[auction.NEXT[s]]) for s in states]
        table.append(ends)
    table.reverse()
    i, s, audit = 0, 0, ""
    while not (i == len(rows) and auction.may_end(s) and table[i][s] == 0):
        letter, i, s = min((a, r, t) for a, c, r, t in auction.arcs(rows, i, s) if c + table[r][t] == table[i][s])
        audit += letter
    return table[0][0], audit


@pytest.mark.parametrize("n", [31, 32, 33, 64, 65, 400, 5000])
def test_auction_of_long_conversations(n):
    draw = random.Random(n)
    for _ in range(20 if n < 100 else 2):
        rows = bytes(draw.choice([0, 1, 2, 3, 1, 2, 4, 5, 9, 10]) for _ in range(n))
        lattice = auction.Lattice(rows)
        assert (lattice.cost, lattice.audit()) == by_table(rows)
        for i in range(n + 1):  # no arc is worth less than its prices differ
            for s in range(4):
                assert all(lattice.price[4 * i + s] <= c + lattice.price[4 * r + t] for _, c, r, t in auction.arcs(rows, i, s))


def brute(turns):
    """The contract, conversation by conversation."""
    rows, seen_ids = defaultdict(list), []
    for conv, turn, role, text in turns:
        seen_ids.append(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            rows[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in set(seen_ids):
        mine = sorted(
            rows[conv],
            key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()),
        )
        known = {t for t, _, _ in mine if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        blank = duplicate = truncated = 0
        marks, before = [], set()
        for _, role, text in mine:
            solid = re.findall("[^\x20\x09-\x0d]", text)
            faults = (not solid, (role, text) in before, bool(solid) and solid[-1] not in ".!?")
            before.add((role, text))
            blank += faults[0]
            duplicate += not faults[0] and faults[1]
            cut = not faults[0] and not faults[1] and faults[2]
            truncated += cut
            marks.append((role[:1] or "?", faults[0] or faults[1], int(cut)))
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))
        cost, audit = cheapest(marks, most=len(marks) + 6)
        put, queue, roles = [], list(mine), ""
        for letter in audit:
            expected = "assistant" if roles.endswith("u") else "user"
            if letter == "I":
                put.append((expected, ""))
            else:
                _, role, text = queue.pop(0)
                if letter == "D":
                    continue
                put.append((role if letter == "K" else expected, text))
            roles += put[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in put).encode()).hexdigest()
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return out


def run(spark, turns):
    table = spark.createDataFrame(
        [(*t, "x", -1) for t in turns], "conv_id long, turn int, role string, text string, report string, place int"
    )
    return {r[0]: tuple(r)[1:] for r in repair.digests(repair.repair(repair.damaged(table))).collect()}


def test_repair_of_odd_conversations(spark):
    draw = random.Random(5)
    texts = ["Yes.", "no", " \t\n", "", None, "What? ", "Ü!\x0b\x0c", "a. ", "x" * 60_000 + ".", " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    turns = [
        (conv, draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts))
        for conv in [None, *range(150)]
        for _ in range(draw.randint(1, 6))
    ]
    turns += [(1000 + c, k, "user" if k % 2 else "assistant", f"t {k}.") for c in range(30) for k in range(8)]
    assert run(spark, turns) == brute(turns)
    assert run(spark, turns[:0]) == {}


def test_conversation_without_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert run(spark, [(7, turn, "user", "a.")]) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversation_streams(spark):
    turns = [(3, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(20_000)]
    gaps, blank, duplicate, truncated, illegal, cost, audit, _ = run(spark, turns)[3]
    kinds = [zlib.crc32(f"3:{k}".encode()) % 20 for k in range(20_000)]
    assert (blank, duplicate, truncated) == (kinds.count(1), kinds.count(3), kinds.count(2))
    assert len(audit) - audit.count("I") == 20_000 - kinds.count(0) + kinds.count(3)
    assert gaps <= kinds.count(0) and illegal > 0 and cost > 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force(spark, folder):
    from ledgerwork.llm.registry import QUERIES

    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r for r in QUERIES["op11_auction_repair"](spark, folder).collect()}
    want = brute(turns)
    assert got.keys() == want.keys()
    for conv, row in got.items():
        assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit, row.repaired_sha256) == want[conv]
