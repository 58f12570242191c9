"""Operator 6: homomorphic multiset fingerprints, in DataFrame functions only.

A text is a multiset of paragraph pieces: its lines, cut after every eighth word
so that long paragraphs also compare in part. Each piece hashes to a wide vector
and the fingerprint is the sum of the vectors modulo powers of two:

* 8 lanes of 32 bits, modulo 2^32, decide equality;
* 128 lanes of plus or minus one, modulo 2^32, whose inner products estimate how
  many pieces two texts share;
* the number of pieces, modulo 2^32.

Sums do not depend on the order of the pieces, and ``insert_pieces`` and
``delete_pieces`` add or take away the vectors of a part without its text.
Equal texts have equal fingerprints; so have texts whose pieces are the same in
another order. The likeness of two fingerprints is the cosine of their signed
lanes, at least 0; 1 for equal fingerprints.

Null and empty texts (and those of white space) have the zero fingerprint. The
next document goes by descending id (null ids last, ties by a hash of the text);
after the last comes the first, which in a table of one row is that row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions, ranked, stored, text_of

_PIECE = r"(?:\S++[^\S\n]*+){1,8}"
_SIGNED, _WIDE = 2, 4  # hashes of 64 bits for the signed and the wide lanes
_LOW = 0xFFFFFFFF
_PAIR = 0x100000001


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def lane_sums(piece: str) -> list[Column]:
    """Aggregates over rows of one piece each (null: none): a number of pieces,
    two signed lanes in each of 64 sums, and eight wide lanes."""
    sums = [F.count(piece).alias("n")]
    for s in range(_SIGNED):
        for k in range(32):
            bit = F.shiftrightunsigned(F.col(f"h{s}"), k).bitwiseAND(F.lit(_PAIR))
            sums.append(F.coalesce(F.sum(bit), F.lit(0)).alias(f"s{s}_{k}"))
    for w in range(_WIDE):
        h = F.col(f"h{_SIGNED + w}")
        sums.append(F.coalesce(F.sum(h.bitwiseAND(F.lit(_LOW))), F.lit(0)).alias(f"w{w}_0"))
        sums.append(F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)).alias(f"w{w}_1"))
    return sums


def piece_hashes(piece: str) -> list[Column]:
    return [F.when(F.col(piece).isNotNull(), F.xxhash64(piece, F.lit(i))).alias(f"h{i}") for i in range(_SIGNED + _WIDE)]


def lanes() -> Column:
    """The sums of ``lane_sums`` as struct(n, signed array<long> in -2^31..2^31-1, wide array<long>)."""
    signed = []
    for s in range(_SIGNED):
        for k in range(32):
            pair = F.col(f"s{s}_{k}")
            signed += [pair.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(pair, 32)]
    wide = [F.col(f"w{w}_{i}") for w in range(_WIDE) for i in range(2)]
    return F.struct(F.col("n").bitwiseAND(F.lit(_LOW)).alias("n"),
                    F.transform(F.array(*signed), lambda c: _lift(2 * c - F.col("n"))).alias("signed"),
                    F.transform(F.array(*wide), lambda c: c.bitwiseAND(F.lit(_LOW))).alias("wide"))


def _lift(x: Column) -> Column:
    return (x + (1 << 31)).bitwiseAND(F.lit(_LOW)) - (1 << 31)


def _joined(a: Column, b: Column, sign: int) -> Column:
    return F.struct((a["n"] + sign * b["n"]).bitwiseAND(F.lit(_LOW)).alias("n"),
                    F.zip_with(a["signed"], b["signed"], lambda x, y: _lift(x + sign * y)).alias("signed"),
                    F.zip_with(a["wide"], b["wide"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW))).alias("wide"))


def insert_pieces(whole: Column, part: Column) -> Column:
    """Lanes of a multiset after the pieces of ``part`` were added."""
    return _joined(whole, part, 1)


def delete_pieces(whole: Column, part: Column) -> Column:
    """Lanes of a multiset after the pieces of ``part`` were taken away."""
    return _joined(whole, part, -1)


def fingerprint(lane: Column) -> Column:
    """Lanes as lowercase hex: wide lanes, number of pieces, signed lanes."""
    def hexed(values: Column, mask: int, width: int) -> Column:
        return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(mask)))), width, "0")), "")
    return F.concat(hexed(lane["wide"], _LOW, 8), hexed(F.array(lane["n"]), _LOW, 8), hexed(lane["signed"], _LOW, 8))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two lanes."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a["signed"], a["signed"]) * dot(b["signed"], b["signed"]))
    cosine = F.when(norm > 0, dot(a["signed"], b["signed"]) / norm).otherwise(0.0)
    same = (a["wide"] == b["wide"]) & (a["n"] == b["n"])
    return F.when(same, F.lit(1.0)).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def text_lanes(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` and lanes of the texts of rows that ``key`` tells apart."""
    pieces = rows.select(*key, F.explode_outer(pieces_of(F.col(text))).alias("piece"))
    return (pieces.select(*key, "piece", *piece_hashes("piece")).groupBy(*key).agg(*lane_sums("piece"))
            .select(*key, lanes().alias("lanes")))


def _place(doc_id: str, h: str) -> Column:
    """A text that sorts as (doc_id, h), null ids first."""
    def hexed(c: str) -> Column:
        return F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(F.col(doc_id).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), hexed(doc_id))), hexed(h))


def _ranges(docs: DataFrame, n: int) -> Column:
    """A range number of ``place``, ascending, in about ``n`` even ranges, so that an id
    with many texts spans several. The bounds are every so manieth of the ranked
    rows, ``n`` at most; a row looks up a block of bounds, then a bound in the block."""
    placed = ranked(docs.select(F.lit(0).alias("all"), "place"), "all", ["place"], "ranges")
    size = placed.agg(F.max("size").alias("s")).first().s or 0
    step = max(1, math.ceil(size / n))
    bounds = sorted({r.place for r in placed.where((F.col("rank") % step == 0) & (F.col("rank") > 0)).select("place").collect()})
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    def passed(texts: Column) -> Column:
        return F.size(F.filter(F.split(texts, ","), lambda b: b <= F.col("place")))
    block = passed(F.lit(",".join(b[0] for b in blocks)))
    inner = F.element_at(F.split(F.lit(";".join(map(",".join, blocks))), ";"), F.greatest(block, F.lit(1)))
    return F.when(block == 0, 0).otherwise((block - 1) * width + passed(inner))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with part, row and next_text. Texts are dealt once, by ranges
    of ids and texts; each range also gets a copy of the next range's first document."""
    n = 4 * partitions(docs.sparkSession)
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("place", _place("doc_id", "h")).drop("h")
    docs = docs.withColumn("part", _ranges(docs, n))
    tops = stored(docs.groupBy("part").agg(F.max("place").alias("top")), "tops")  # a row for each range
    w = Window.orderBy(F.desc("part"))
    after = stored(tops.select("part", F.coalesce(F.lead("top").over(w), F.first("top").over(w)).alias("first")), "after")
    guests = (docs.select("text", "doc_id", F.col("place").alias("first"))
              .join(F.broadcast(after), "first").dropDuplicates(["part"]).select("doc_id", "text", "part"))
    both = docs.select("doc_id", "text", "part", F.lit(False).alias("guest")).unionByName(guests.withColumn("guest", F.lit(True)))
    inside = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    return (both.withColumn("next_text", F.lead("text").over(inside)).withColumn("row", F.row_number().over(inside))
            .where(~F.col("guest")).drop("guest"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the
    beginning of the next document, and their likenesses."""
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    key = ["part", "row", "doc_id", "n_chars", "edited_sha256"]
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), pieces_of(F.col(c)).alias("pieces"))
                                for i, c in enumerate(("text", "edited", "next_text"))])).alias("k")
    pieces = rows.select(*key, kinds).select(*key, "k.kind", F.explode_outer("k.pieces").alias("piece"))
    lane = (pieces.select(*key, "kind", "piece", *piece_hashes("piece")).groupBy(*key, "kind").agg(*lane_sums("piece"))
            .select(*key, "kind", lanes().alias("lanes")))
    of = [F.max(F.when(F.col("kind") == i, F.col("lanes"))).alias(c) for i, c in enumerate(("own", "edit", "next"))]
    wide = lane.groupBy(*key).agg(*of)
    return wide.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
                       fingerprint(F.col("edit")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("edit")).alias("near_edited"),
                       likeness(F.col("own"), F.col("next")).alias("near_next"))


def op6_multiset_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
