"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A paragraph (a line of a text) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo 2**32. So the order of paragraphs doesn't matter, and a paragraph is inserted or
deleted by adding or subtracting its vector (`combined`). A vector has three kinds of lanes:

* 8 lanes, seeded hashes of the whole paragraph: equal sums mean equal multisets of paragraphs, but for chance;
* 1 lane, the number of its sentences;
* 128 lanes, the sums of the bits of two seeded hashes over its sentences. Twice such a lane less the number of sentences is
  a sum of random signs, which the modulus leaves exact for texts of under 2**31 sentences, so the product of two documents' lanes estimates how many sentences they have in
  common, whatever their lengths; over both lengths it is the likeness, 0 where it is negative, with an error of about
  1 / sqrt(128).

Documents are dealt into ranges of ids once; the next document, the sums and the comparison with neighbours all stay within
a range, to which the first document of the next range is added (the first of all to the last).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Ranges, Scratch

WHOLE, HASHES, SHIFTS = 8, 2, 32
FIELDS = 0x0000000100000001  # two lanes are summed in one long
LOW = (1 << 32) - 1
LANES = WHOLE + 1 + 2 * HASHES * SHIFTS


def summed(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key and lanes (array of LANES longs) of each text; rows of one key count as one text."""
    whole = F.transform(F.split(text, "\n", -1), lambda p: F.struct(F.lit(True).alias("whole"), p.alias("x")))
    parts = F.transform(F.split(text, r"\n|(?<=[.!?]) ", -1), lambda p: F.struct(F.lit(False).alias("whole"), p.alias("x")))
    unit = texts.select(*key, F.explode(F.concat(whole, parts)).alias("u")).select(*key, "u.whole", "u.x")
    none = F.lit(0).cast("long")
    strong = [F.when(F.col("whole"), F.xxhash64(F.lit(i), F.col("x")).bitwiseAND(F.lit(LOW))).otherwise(none).alias(f"w{i}") for i in range(WHOLE)]
    signs = [F.when(~F.col("whole"), F.xxhash64(F.lit(100 + i), F.col("x"))).otherwise(none).alias(f"h{i}") for i in range(HASHES)]
    unit = unit.select(*key, "whole", *strong, *signs)
    bits = [F.sum(F.shiftrightunsigned(f"h{i}", k).bitwiseAND(F.lit(FIELDS))).alias(f"b{i}_{k}") for i in range(HASHES) for k in range(SHIFTS)]
    sums = unit.groupBy(*key).agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(WHOLE)), F.sum((~F.col("whole")).cast("long")).alias("n"), *bits)
    low = [F.col(f"w{i}").bitwiseAND(F.lit(LOW)) for i in range(WHOLE)]
    fields = [F.shiftrightunsigned(f"b{i}_{k}", s).bitwiseAND(F.lit(LOW)) for i in range(HASHES) for k in range(SHIFTS) for s in (0, 32)]
    return sums.select(*key, F.array(*low, F.col("n").bitwiseAND(F.lit(LOW)), *fields).alias("lanes"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the sum (sign 1) or difference (sign -1) of two multisets, from theirs."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW)))


def written(lanes: Column) -> Column:
    """A fingerprint in hexadecimal, 8 digits for each lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two multisets, from their lanes, 0 to 1; equal lanes give 1."""

    def signs(x: Column) -> Column:
        half = 1 << 31
        return F.transform(F.slice(x, WHOLE + 2, LANES), lambda v: ((2 * v - F.element_at(x, WHOLE + 1) + half).bitwiseAND(F.lit(LOW)) - half).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    u, v = signs(a), signs(b)
    length = F.sqrt(dot(u, u) * dot(v, v))
    ratio = F.when(length > 0, dot(u, v) / length).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 50_000) -> DataFrame:
    """Per document: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document, in ascending order of ids and, where they are equal, of a hash of the texts; null ids come first, and
    after the last document comes the first. A null text counts as empty; an empty text is one empty paragraph. Other
    columns aren't read, and an empty table gives an empty one. rows: at most about so many documents make a range.
    """
    least = -(1 << 63)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = Ranges(Scratch(docs.sparkSession, "fingerprints"), own.select("k"), "k", rows)
    first = own.agg(F.min("k")).first()[0]
    # a row goes to its own range; the first of a range also behind the range before, the first of all also behind the last
    at = lambda p, wrap, ghost: F.struct(p.cast("int").alias("p"), F.lit(wrap).alias("wrap"), F.lit(ghost).alias("ghost"))
    to = F.array_compact(F.array(at(F.col("own"), 0, False), F.when(F.col("head"), at(F.col("own") - 1, 0, True)), F.when(F.col("k") == (least if first is None else first), at(F.lit(ranges.last), 1, True))))
    dealt = ranges.add(own, "own", "head").select("*", F.explode(to).alias("to")).select("to.*", "doc_id", "k", "text").repartitionById(ranges.last + 1, "p")
    order = W.partitionBy("p").orderBy("wrap", "k", "ghost", F.xxhash64("text"), "text")
    dealt = dealt.withColumns({"r": F.row_number().over(order), "next": F.lead("text").over(order)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    texts = F.array_compact(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("x")), F.when(~F.col("ghost"), F.struct(F.lit(1).alias("which"), edited.alias("x")))))
    both = dealt.select("p", "r", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.explode(texts).alias("t")).select("p", "r", "ghost", "doc_id", "n_chars", "t.which", F.col("t.x").alias("x"), F.when(F.col("t.which") == 1, F.sha2("t.x", 256)).alias("sha"))
    key = ["p", "r", "ghost", "doc_id", "n_chars", "which", "sha"]
    in_turn = W.partitionBy("p").orderBy("r", "which")
    lanes = summed(both, key, "x").withColumns({"edited": F.lead("lanes").over(in_turn), "edited_sha256": F.lead("sha").over(in_turn), "next": F.lead("lanes", 2).over(in_turn)})
    real = lanes.filter((F.col("which") == 0) & ~F.col("ghost"))
    return real.select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", written(F.col("lanes")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("edited")).alias("near_edited"), likeness(F.col("lanes"), F.col("next")).alias("near_next"))
