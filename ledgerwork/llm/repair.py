"""Repair of conversation structure.

`damaged` plants faults in conversations by a checksum of conversation and turn. `repair` finds the faults of
each row, has `auction` choose the cheapest edits that make the roles read `(s?(ua)+)?`, and applies them.

Faults are found by Spark functions. Rows without their texts (a role, a digest, flags) are spread by
conversation, sorted by turn and streamed; a conversation is held as one byte a row, the digests of its
rows and four prices a row. The audits then go ahead of the texts through a second sorted stream, which
holds an audit and no texts. A conversation is one task, as its digest is of its rows in order; rounds over
a conversation that fills a task would not change that.

Defined cases: null ids, turns, roles and texts count as one space where they are read, ids and turns stay null in
results and order (first); a null conversation id is a conversation of its own; rows of one turn are ordered by role,
then by a digest of role and text; repeated rows are duplicates; an empty role has no initial and can
only be changed or deleted; a conversation whose rows are all dropped has zeros, an empty audit and the digest of
an empty text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwork.llm import auction, runtime

WHITE = "\\x20\\x09-\\x0D"
#: What a checksum's remainder by 20 does to a row; the others leave it as it is.
DROP, EMPTY, NO_STOPS, TWICE, AS_USER = range(5)
PARTS = 20
INITIALS = {"s": 0, "u": 1, "a": 2}
ROLES = {auction.USER: "user", auction.ASSISTANT: "assistant"}
#: Conversations of up to so many rows are remembered by their rows' bytes.
SHORT, REMEMBERED = 64, 100_000

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPORTS = f"conv_id long, {REPORT}"
REPAIRED = f"conv_id long, place long, role string, text string, report struct<{REPORT.replace(' ', ': ').replace(',:', ',')}>"
DIGESTS = f"{REPORTS}, repaired_sha256 string"


def _or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with faults; a dropped row stays as one without role and text."""
    kind = F.crc32(F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))) % PARTS
    text = _or_space(F.col("text"))
    text = F.when(kind == EMPTY, "").when(kind == NO_STOPS, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == AS_USER, "user").otherwise(_or_space(F.col("role")))
    times = F.explode(F.array_repeat(F.lit(True), F.when(kind == TWICE, 2).otherwise(1)))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind != DROP, role).alias("role"),
        F.when(kind != DROP, text).alias("text"),
        times.alias("_again"),
    ).drop("_again")


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with what the edits depend on: initial, digest, blank, cut off. Rows without a role are markers."""
    end = F.regexp_extract("text", f"[^{WHITE}](?=[{WHITE}]*\\z)", 0)
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.unhex(F.sha2(both, 256)).alias("_digest"),
        F.substring("role", 1, 1).alias("_initial"),
        (end == "").alias("_blank"),
        (~end.isin(".", "!", "?")).alias("_cut"),
    )


ORDER = ["turn", "role", "_digest"]


@lru_cache(REMEMBERED)
def _solved(rows: bytes) -> tuple[int, str]:
    lattice = auction.Lattice(rows)
    return lattice.cost, lattice.audit()


def solve(rows: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation's rows."""
    return _solved(rows) if len(rows) <= SHORT else _solved.__wrapped__(rows)


class _Conversation:
    """What is kept of a conversation while its rows pass."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.rows, self.seen = bytearray(), set()
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, digest: bytes, initial: str, blank: bool, cut: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        repeated = digest in self.seen
        self.seen.add(digest)
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        row = INITIALS.get(initial, auction.OTHER)
        if blank or repeated:
            self.blank += blank
            self.duplicate += not blank
            row |= auction.MUST_GO
        elif cut:
            self.truncated += 1
            row |= auction.CUT_OFF
        self.rows.append(row)

    def report(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit = solve(bytes(self.rows))
        faults = {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}
        return {"conv_id": self.conv_id, "gaps": gaps, **faults, "cost": cost, "audit": audit}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one report a conversation."""
    schema, here = _schema(REPORTS), None
    for batch in batches:
        done = []
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for conv_id, turn, digest, initial, blank, cut in zip(*columns, strict=True):
            if here is None or here.conv_id != conv_id:
                if here is not None:
                    done.append(here.report())
                here = _Conversation(conv_id)
            if digest is not None:
                here.add(turn, digest, initial, blank, cut)
        yield pa.RecordBatch.from_pylist(done, schema)
    if here is not None:
        yield pa.RecordBatch.from_pylist([here.report()], schema)


def _step(state: int, letter: str, role: str) -> tuple[int, str | None]:
    """State and role put out by an edit."""
    if letter == "D":
        return state, None
    if letter == "K" and role[:1] == "s":
        return auction.SYSTEM, role
    after = auction.NEXT[state]
    return after, role if letter == "K" else ROLES[after]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted reports and rows to repaired rows; the report of a conversation first, with place -1."""
    schema = None
    edits, at, state, place = "", 0, auction.START, 0
    conv_id = None
    for batch in runtime.slices(batches, "text", 8 << 20):
        if schema is None:
            report = batch.schema.field("report").type
            schema = pa.schema(
                [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("report", report)]
            )
        done = []

        def insert(done=done) -> None:
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                state, role = _step(state, "I", "")
                done.append({"conv_id": conv_id, "place": place, "role": role, "text": ""})
                at, place = at + 1, place + 1

        for row in batch.to_pylist():
            if row["report"] is not None:
                conv_id = row["conv_id"]
                edits, at, state, place = row["report"]["audit"], 0, auction.START, 0
                done.append({"conv_id": conv_id, "place": -1, "report": row["report"]})
                insert()
                continue
            state, role = _step(state, edits[at], row["role"])
            at += 1
            if role is not None:
                done.append({"conv_id": conv_id, "place": place, "role": role, "text": row["text"]})
                place += 1
            # inserts follow the row they stand behind, so none is left over at the end
            insert()
        yield pa.RecordBatch.from_pylist(done, schema)


def reports(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) -> per conversation: faults, cost and audit of the cheapest edits."""
    marked = _marked(rows).select("conv_id", *ORDER, "_initial", "_blank", "_cut")
    spread = marked.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return spread.select("conv_id", "turn", "_digest", "_initial", "_blank", "_cut").mapInArrow(_find, REPORTS)


def repair(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) -> conv_id, place, role, text of the repaired conversations.

    The rows of a conversation follow each other within a partition, behind one with place -1 and the `report`."""
    found = reports(rows)
    fields = [F.col(c) for c in found.columns if c != "conv_id"]
    ahead = found.select(
        "conv_id",
        F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("_digest"),
        F.lit(None).cast("string").alias("text"),
        F.struct(*fields).alias("report"),
    )
    kept = _marked(rows.where(F.col("role").isNotNull())).select("conv_id", *ORDER, "text")
    both = ahead.unionByName(kept, allowMissingColumns=True)
    spread = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("report").isNull(), *ORDER)
    return spread.select("conv_id", "role", "text", "report").mapInArrow(_apply, REPAIRED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, report, sha = _schema(DIGESTS), None, None
    for batch in runtime.slices(batches, "text", 8 << 20):
        done = []
        for row in batch.to_pylist():
            if row["place"] < 0:
                if report is not None:
                    done.append({**report, "repaired_sha256": sha.hexdigest()})
                report, sha = {"conv_id": row["conv_id"], **row["report"]}, hashlib.sha256()
                continue
            sha.update(f"{chr(10) if row['place'] else ''}{row['role']}:{row['text']}".encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if report is not None:
        yield pa.RecordBatch.from_pylist([{**report, "repaired_sha256": sha.hexdigest()}], schema)


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation its report and the digest of its repaired rows; `repaired` is what `repair` returns, as it stands."""
    return repaired.mapInArrow(_digest, DIGESTS)
