"""Operator 1: exact deduplication of a batch against an immutable snapshot.

A snapshot holds one row for each different text admitted so far: digest, count,
and the row that stays. Its digests are cut into buckets by their first bits,
and each bucket gets a static 3-wise binary fuse filter (about 9 bits a digest,
false positives 1 in 256), built once in the bucket's own task. An incoming
batch is grouped by digest first (partial aggregation, so a text that makes up a
third of the batch is one row), its digests are screened by the filters bucket
by bucket, and only those that a filter lets pass join the exact rows of the
snapshot. Screened-out digests are new and stand for themselves.

Texts of groups with more than one row are then compared byte for byte with the
text of the row that stays; groups that a digest has joined wrongly are taken
apart and grouped by their text.

Which row stays: the one with the most code points in the original text, then
the smallest id (a null id counts as the largest). Null texts count as empty;
all empty texts are equal. Rows repeated with the same id and text are one
document: they are kept or dropped together. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, partitions, stored, text_of

#: Digests that one filter bucket is sized for.
BUCKET_DIGESTS = 250_000
_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, _SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256) -> DataFrame:
    """doc_id, n_chars, text_sha256 (hex, of the normalised text) and digest (its
    first ``bits`` bits) of each row."""
    text = text_of(text_col)
    sha = F.sha2(normalised(text).cast("binary"), 256)
    return (docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), sha.alias("text_sha256"))
            .withColumn("digest", F.substring("text_sha256", 1, bits // 4)))


def text_groups(rows: DataFrame) -> DataFrame:
    """digest, group_size, best (n_chars, minus doc_id, doc_id) of (doc_id, n_chars, digest) rows."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("order"), "doc_id"))
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))


def _key(digest: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.rpad(F.substring(digest, 1, 15), 15, "0"), 16, 10).cast("long")


# --- binary fuse filter -------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _places(h: np.ndarray, segment: int, count: int):
    """The three slots of each hash: neighbouring segments, one slot in each."""
    first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _marks(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> dict:
    """A static filter of distinct 64-bit keys: seed, segment, count, slots (bytes)."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, math.ceil(n * factor / segment) - 2)
    size = (count + 2) * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        slots = np.stack(_places(h, segment, count), axis=1)
        order = _peel(slots, size)
        if order is not None:
            table = bytearray(size)
            marks = _marks(h).tolist()
            where = slots.tolist()
            for key, slot in reversed(order):
                a, b, c = where[key]
                table[slot] = 0
                table[slot] = marks[key] ^ table[a] ^ table[b] ^ table[c]
            return {"seed": seed, "segment": segment, "count": count, "slots": bytes(table)}
    raise RuntimeError("no seed gives a filter")


def _peel(slots: np.ndarray, size: int):
    """Keys in an order in which each has a slot that no later key uses, or None."""
    degree = np.bincount(slots.ravel(), minlength=size).tolist()
    joint = np.zeros(size, dtype=np.int64)
    for j in range(3):
        np.bitwise_xor.at(joint, slots[:, j], np.arange(len(slots)))
    joint = joint.tolist()
    where = slots.tolist()
    ready = [i for i, d in enumerate(degree) if d == 1]
    order = []
    while ready:
        slot = ready.pop()
        if degree[slot] != 1:
            continue
        key = joint[slot]
        order.append((key, slot))
        for s in where[key]:
            degree[s] -= 1
            joint[s] ^= key
            if degree[s] == 1:
                ready.append(s)
    return order if len(order) == len(where) else None


def probe_filter(f: dict, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never False for a key that is."""
    h = _mix(keys.astype(np.uint64), f["seed"] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    table = np.frombuffer(f["slots"], dtype=np.uint8)
    a, b, c = _places(h, f["segment"], f["count"])
    return (table[a] ^ table[b] ^ table[c]) == _marks(h)


# --- snapshots ------------------------------------------------------------------

def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter row (bucket, seed, segment, count, slots) for each bucket of a snapshot."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"bucket": pdf.bucket.iloc[0], **build_filter(pdf.key.to_numpy())}])
    keys = snapshot.select(_key(F.col("digest")).alias("key")).withColumn("bucket", F.col("key") % buckets)
    return keys.groupBy("bucket").applyInPandas(build, "bucket long, seed long, segment long, count long, slots binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``batch`` (digest, one row each) with ``maybe``: False where the snapshot cannot hold it."""
    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(left), dtype=bool)
        if len(left) and len(right):
            maybe = probe_filter(right.iloc[0].to_dict(), left.key.to_numpy())
        return pd.DataFrame({"digest": left.digest, "maybe": maybe})
    keys = batch.select("digest", _key(F.col("digest")).alias("key")).withColumn("bucket", F.col("key") % buckets)
    return (keys.groupBy("bucket").cogroup(filters.groupBy("bucket"))
            .applyInPandas(probe, "digest string, maybe boolean"))


def merge_groups(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The groups of a snapshot and a batch together (both stored tables of
    ``text_groups`` rows), the batch screened by the snapshot's filters."""
    spark = snapshot.sparkSession
    n = max(snapshot.count(), batch.count())
    buckets = max(partitions(spark), math.ceil(n / BUCKET_DIGESTS))
    filters = stored(snapshot_filters(snapshot, buckets), "fuse-filters")
    maybe = stored(screen(batch, filters, buckets), "screened")
    positives = batch.join(maybe.where("maybe").select("digest"), "digest", "left_semi")
    exact = positives.alias("b").join(snapshot.alias("s"), "digest").select(
        "digest", (F.col("b.group_size") + F.col("s.group_size")).alias("group_size"),
        F.greatest("b.best", "s.best").alias("best"))
    exact = stored(exact, "exact-buckets")
    found = exact.select("digest")
    return stored(exact.unionByName(snapshot.join(found, "digest", "left_anti"))
                  .unionByName(batch.join(found, "digest", "left_anti")), "groups")


def deduplicate(snapshot: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits: int = 256) -> DataFrame:
    """One row for each row of both tables: doc_id, keep_id, group_size, kept, text_sha256.

    ``bits`` is the part of the digest used to find groups; the byte check makes
    the result the same for every value."""
    keep = [F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")]
    old, new = snapshot.select(*keep), batch.select(*keep)
    known = stored(text_groups(digests(old, bits=bits)), "snapshot")
    fresh = stored(text_groups(digests(new, bits=bits)), "batch")
    groups = merge_groups(known, fresh).select("digest", "group_size", F.col("best.doc_id").alias("keep_id"))
    both = old.unionByName(new)
    rows = stored(digests(both, bits=bits).join(groups, "digest"), "rows")
    wrong = mismatched(both, groups, bits)
    if not wrong.isEmpty():
        rows = rows.join(wrong, "digest", "left_anti").unionByName(_by_text(both, wrong, bits).select(*rows.columns))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def mismatched(docs: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """Digests of groups in which some text differs in bytes from the text that stays."""
    text = normalised(F.col("text"))
    d = docs.select("doc_id", text.alias("norm"), F.substring(F.sha2(text.cast("binary"), 256), 1, bits // 4).alias("digest"))
    many = groups.where("group_size > 1")
    # members carry a salt, so that the copies of one text are compared in many tasks
    salts = F.floor((F.col("group_size") - 1) / 500)
    members = stored(d.join(many, "digest").select(
        "digest", "norm", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"),
        F.pmod(F.xxhash64("doc_id"), salts + 1).alias("salt"), salts.alias("salts")), "members")
    stays = (members.where("stays").groupBy("digest", "salts").agg(F.min("norm").alias("want"))
             .select("digest", "want", F.explode(F.sequence(F.lit(0).cast("long"), "salts")).alias("salt")))
    return stored(members.join(stays, ["digest", "salt"]).where("norm <> want").select("digest").distinct(), "mismatched")


def _by_text(docs: DataFrame, wrong: DataFrame, bits: int) -> DataFrame:
    """Rows of the given digests, grouped by the text itself."""
    text = normalised(F.col("text"))
    d = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), text.alias("norm"),
                    F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    d = d.withColumn("digest", F.substring("text_sha256", 1, bits // 4))
    d = d.join(wrong, "digest", "left_semi")
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("order"), "doc_id"))
    groups = d.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), best.alias("best"))
    return d.join(groups.withColumn("keep_id", F.col("best.doc_id")).drop("best"), ["digest", "norm"])


def halves(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table as an admitted half and an incoming half, by a hash of the id."""
    old = F.xxhash64(id_col) % 2 == 0
    return docs.where(old), docs.where(~old)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(*halves(documents(spark, sf_dir)))


def op1_sql() -> str:
    return r"""
with d as (select doc_id, coalesce(text, '') as text,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256 order by length(text) desc, doc_id)
"""
