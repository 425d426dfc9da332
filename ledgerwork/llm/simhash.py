"""SimHash fingerprints of documents, in DataFrame functions only.

The terms of a text are its words in lower case. A term's 64-bit hash votes on 64 bits, once for
every occurrence, with a weight that grows with the word's length, as short words are common to
all texts. A bit is set if more than half of the weighted votes are for it. One sum counts two bits
(32 bits of a long each), so 32 sums count all 64. The terms are exploded and summed up where the
document stands, so counting needs no shuffle: the only one puts neighbouring ids together.

Search. `neighbours` finds all fingerprints within a Hamming radius: the bits are cut into more
blocks than the radius, and each permuted table is keyed by another choice of the blocks that may
have stayed equal, so two fingerprints within the radius share a key in at least one table.

Defined cases: null text is empty; a text without words has fingerprint 0 (no vote, no bit set); equal texts have
equal fingerprints; rows with the same doc_id are ordered by a hash of their text; an only document is its own
next one; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
#: Bit k and bit k + 32 of a hash, k = 0.
_TWO = 0x0000000100000001
#: Most weight of a term. With it, 2^32 / MOST occurrences fit a sum: texts of up to 67 million words.
MOST = 64
#: Documents that are ordered together, about, and the most ranges; with more documents the ranges grow.
RANGE, RANGES = 250, 1 << 16

_WHITE = "[\\x20\\x09-\\x0D]+"


def weight(word: Column) -> Column:
    """1 for a letter or two, then as the square of the length, up to MOST; 0 without letters."""
    n = F.least(F.length(word), F.lit(2 + isqrt(MOST)))
    return F.coalesce(F.when(n < 3, F.least(n, F.lit(1))).otherwise((n - 2) * (n - 2)), F.lit(0)).cast("long")


def _sums() -> list[Column]:
    """The weighted votes: all of them, and 32 sums of two bits each."""
    term, votes = F.col("_hash"), F.col("_weight")
    lanes = [
        F.sum(F.shiftrightunsigned(term, k).bitwiseAND(F.lit(_TWO)) * votes).alias(f"_lane{k}") for k in range(BITS // 2)
    ]
    return [F.sum(votes).alias("_votes"), *lanes]


def _fingerprint() -> Column:
    """The bits with more than half of the votes, from the sums."""
    bits = []
    for k in range(BITS // 2):
        lane = F.col(f"_lane{k}")
        for at, votes in ((k, lane.bitwiseAND(F.lit(0xFFFFFFFF))), (k + 32, F.shiftrightunsigned(lane, 32))):
            bits.append(F.when(votes * 2 > F.col("_votes"), F.lit(_signed(1 << at))).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def likeness(left: Column, right: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(left.bitwiseXOR(right)) / F.lit(float(BITS))


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at most the id: first among every so many, then among those between."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts)) + 1
    rows = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    starts = F.from_json(F.lit(str([r[0] for r in rows])), "array<bigint>")
    inner = F.from_json(F.lit(str(rows)), "array<array<bigint>>")
    row = F.size(F.filter(starts, lambda cut: cut <= doc_id))
    within = F.size(F.filter(F.element_at(inner, row), lambda cut: cut <= doc_id))
    return F.when(doc_id.isNull() | (row == 0), 0).otherwise((row - 1) * step + within)


def in_order(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with `_range`, `_guest` and `_place`: rows of a range in ascending id, at its end as
    guest a copy of the row that follows the range (after the last range: the first row of all).

    Ranges have about the same number of rows. At most RANGES cuts and first rows pass the driver."""
    rows = docs.withColumn("_key", F.xxhash64("text"))
    ids = docs.select("doc_id")
    wanted = min(RANGES, ids.count() // RANGE)
    cuts: list[int] = []
    if wanted > 1:
        share = [k / wanted for k in range(1, wanted)]
        found = ids.select(F.percentile_approx("doc_id", share, max(10_000, 4 * wanted)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(found or []))
    placed = rows.withColumn("_range", _range_of(F.col("doc_id"), cuts))
    firsts = (
        placed.groupBy("_range").agg(F.min(F.struct("doc_id", "_key")).alias("first")).orderBy("_range").collect()
    )
    guests = docs.sparkSession.createDataFrame(
        [(r["first"]["doc_id"], r["first"]["_key"], firsts[k - 1]["_range"]) for k, r in enumerate(firsts)],
        "_g_id long, _g_key long, _g_range int",
    )
    # at most RANGES rows, hence the broadcast
    first = placed["doc_id"].eqNullSafe(guests["_g_id"]) & (placed["_key"] == guests["_g_key"])
    doubled = placed.join(F.broadcast(guests), first, "left").select(
        "doc_id",
        "text",
        "_key",
        F.explode(
            F.when(F.col("_g_range").isNull(), F.array(F.struct(F.col("_range"), F.lit(0).alias("_guest")))).otherwise(
                F.array(
                    F.struct(F.col("_range"), F.lit(0).alias("_guest")),
                    F.struct(F.col("_g_range").alias("_range"), F.lit(1).alias("_guest")),
                )
            )
        ).alias("_at"),
    )
    at = doubled.select("doc_id", "text", "_key", "_at._range", "_at._guest")
    order = Window.partitionBy("_range").orderBy("_guest", "doc_id", "_key")
    return at.withColumn("_place", F.row_number().over(order)).drop("_key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: fingerprint of its text, of its text with the second half from the next document, likenesses."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ordered = in_order(texts)
    order = Window.partitionBy("_range").orderBy("_place")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), size - half), F.coalesce(F.substring("_next", F.lit(1), half), F.lit(""))
    )
    both = (
        ordered.withColumn("_next", F.lead("text").over(order))
        .withColumn("_edited", edited)
        .select(
            "_range",
            "_place",
            "_guest",
            "doc_id",
            size.cast("long").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("which"), F.col("text").alias("of")),
                    F.struct(F.lit(1).alias("which"), F.col("_edited").alias("of")),
                )
            ).alias("_text"),
        )
    )
    keys = ["_range", "_place", "_guest", "doc_id", "n_chars", "edited_sha256"]
    words = both.select(*keys, F.col("_text.which").alias("_which"), F.explode(F.split(F.lower("_text.of"), _WHITE)).alias("_word"))
    votes = words.select(*keys, "_which", F.xxhash64("_word").alias("_hash"), weight(F.col("_word")).alias("_weight"))
    summed = votes.groupBy(*keys, "_which").agg(*_sums()).select(*keys, "_which", _fingerprint().alias("_print"))
    of = {w: F.max(F.when(F.col("_which") == w, F.col("_print"))) for w in (0, 1)}
    paired = summed.groupBy(*keys).agg(of[0].alias("_own"), of[1].alias("_edited"))
    return (
        paired.withColumn("_next", F.lead("_own").over(order))
        .where("_guest = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("_own")).alias("fingerprint"),
            as_text(F.col("_edited")).alias("edited_fingerprint"),
            likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
            likeness(F.col("_own"), F.col("_next")).alias("near_next"),
        )
    )


def as_text(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def as_bits(text: Column) -> Column:
    """A fingerprint's text as a long again."""
    half = [F.conv(F.substring(text, at, 8), 16, 10).cast("long") for at in (1, 9)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """`prints`, `queries` (bits long) -> (query, bits, distance), every pair of different rows' values within the radius.

    Equal fingerprints count once: join the result back to documents by the value."""
    width = BITS // blocks
    bounds = [(k * width, BITS if k == blocks - 1 else (k + 1) * width) for k in range(blocks)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        tables = []
        for number, chosen in enumerate(combinations(bounds, blocks - radius)):
            mask = sum(1 << bit for low, high in chosen for bit in range(low, high))
            tables.append(F.struct(F.lit(number).alias("table"), F.col("bits").bitwiseAND(F.lit(_signed(mask))).alias("key")))
        return df.select("bits").distinct().select(F.col("bits").alias(name), F.inline(F.array(*tables)))

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("bits")))
    found = keyed(queries, "query").join(keyed(prints, "bits"), ["table", "key"]).where(distance <= radius)
    return found.select("query", "bits", distance.alias("distance")).distinct()
