"""Operator 4: shards of bounded size by extendible hashing.

The directory is indexed by leading bits of a 60-bit hash of the key (the first
15 hex digits of its MD5). It starts as one bucket of all rows; only buckets
over the byte limit split on one more bit, until each fits. Bucket sizes come
from a histogram of bytes per hash, aggregated before it shuffles and filtered
to the oversized buckets before each split, so a level costs what is still too
large. The directory is a table; a row finds its shard by an equi-join on the
bits that all buckets share, then by its place among that prefix's few buckets.

Rows whose hashes agree in all 60 bits (repeated keys) cannot be told apart by
them: if they are too many for a shard, the bucket goes on splitting by the bits of a
hash of the row itself, in the same way, into parts that fit the limit. A single row
larger than the limit gets a shard of its own, marked oversize. Null texts weigh 0
bytes, a null key hashes as the word null. An empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staging_path
from .common import documents, stored, text_of

BITS = 60
#: Byte limit of one shard in the registered query.
SHARD_BYTES = 8 << 20


def key_hash(key: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """base, depth, prefix, bytes of the buckets of (base, hash, bytes) rows, a directory
    for each base: the shortest prefixes whose rows together fit ``limit``. A bucket of
    one hash ends at all bits."""
    open_rows = stored(sizes.groupBy("base", "hash").agg(F.sum("bytes").alias("bytes")), "hash-bytes")
    found = None
    for depth in range(BITS + 1):
        at = open_rows.withColumn("prefix", F.shiftright("hash", BITS - depth))
        level = stored(at.groupBy("base", "prefix").agg(F.sum("bytes").alias("total"), F.min("hash").alias("one"), F.max("hash").alias("last")), "buckets")
        fits, alone = F.col("total") <= limit, F.col("one") == F.col("last")
        leaves = level.where(fits | alone).select(
            "base", F.when(fits, depth).otherwise(BITS).alias("depth"), F.when(fits, F.col("prefix")).otherwise(F.col("one")).alias("prefix"),
            F.col("total").alias("bytes"))
        found = leaves if found is None else found.unionByName(leaves)
        over = level.where(~(fits | alone))
        if over.isEmpty():
            break
        open_rows = at.join(over.select("base", "prefix"), ["base", "prefix"], "left_semi").select("base", "hash", "bytes")
        if depth % 4 == 3:
            open_rows = stored(open_rows, "hash-bytes")
    return stored(found, "directory")


def _placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (base, hash, ...) with depth, prefix and shard_bytes of their bucket."""
    least = buckets.agg(F.min("depth").alias("d")).first().d or 0
    low = F.expr(f"shiftleft(prefix, {BITS} - depth)")
    high = F.expr(f"shiftleft(prefix + 1, {BITS} - depth)")
    b = buckets.select("base", F.expr(f"shiftright(prefix, depth - {least})").alias("common"), "depth", "prefix",
                       F.col("bytes").alias("shard_bytes"), low.alias("low"), high.alias("high"))
    return (rows.withColumn("common", F.shiftright("hash", BITS - least))
            .join(b, ["base", "common"]).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("high")))
            .drop("common", "low", "high"))


def assign_shards(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (hash, bytes and further columns) with depth, prefix, part, shard
    (text of the prefix bits, with the number of the overflow part if any),
    shard_bytes and oversize."""
    rows = rows.withColumn("base", F.lit(0).cast("long"))
    buckets = directory(rows.select("base", "hash", "bytes"), limit)
    placed = _placed(rows, buckets).drop("base")
    if buckets.where(F.col("bytes") > limit).isEmpty():
        placed = placed.withColumn("part", F.lit(0).cast("long")).withColumn("oversize", F.lit(False))
    else:
        placed = _overflow(stored(placed, "placed"), limit)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    name = F.when(F.col("part") > 0, F.concat_ws("+", bits, F.col("part").cast("string"))).otherwise(bits)
    return placed.withColumn("shard", name)


def _overflow(placed: DataFrame, limit: int) -> DataFrame:
    """Splits the buckets that stay over the limit with all bits used by the bits of a
    hash of each row. ``part`` is the place of a part in its bucket's directory as a
    binary tree (1 the whole, 2 and 3 its halves, and so on)."""
    keep = placed.where(F.col("shard_bytes") <= limit).withColumn("part", F.lit(0).cast("long")).withColumn("oversize", F.lit(False))
    big = stored(placed.where(F.col("shard_bytes") > limit).withColumn("uid", F.monotonically_increasing_id()), "overflow")
    named = [c for c in placed.columns if c not in ("hash", "depth", "prefix", "shard_bytes")]
    rows = big.select(*named, F.col("hash").alias("key_hash"), F.col("depth").alias("key_depth"), F.col("prefix").alias("base"),
                      F.shiftrightunsigned(F.xxhash64("prefix", "uid"), 64 - BITS).alias("hash"))
    parts = _placed(rows, directory(rows.select("base", "hash", "bytes"), limit))
    split = parts.select(*named, F.col("key_hash").alias("hash"), F.col("key_depth").alias("depth"), F.col("base").alias("prefix"), "shard_bytes",
                         F.expr("shiftleft(1L, depth) + prefix").alias("part"), (F.col("bytes") > limit).alias("oversize"))
    return keep.unionByName(split.select(*keep.columns))


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash, n_bytes, depth, part, shard, shard_bytes, oversize of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), key_hash(F.col(id_col)).alias("hash"),
                       F.octet_length(text_of(text_col)).cast("long").alias("bytes"))
    out = assign_shards(rows, limit)
    return out.select("doc_id", "hash", F.col("bytes").alias("n_bytes"), "depth", "part", "shard", "shard_bytes", "oversize")


def write_shards(docs: DataFrame, limit: int, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> str:
    """Writes ``docs`` as one folder ``shard=<bits>`` for each shard, one file in each."""
    path = path or staging_path(docs.sparkSession, "shards")
    rows = docs.withColumn("hash", key_hash(F.col(id_col))).withColumn("bytes", F.octet_length(text_of(text_col)).cast("long"))
    out = assign_shards(rows, limit).withColumn("shard", F.concat(F.lit("b"), "shard"))
    drop = ["hash", "bytes", "depth", "prefix", "part", "shard_bytes", "oversize"]
    out.drop(*drop).repartition("shard").write.partitionBy("shard").parquet(path)
    return path


def op4_extendible_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op4_sql(limit: int = SHARD_BYTES) -> str:
    """DuckDB SQL: the shortest prefix, of up to 40 bits, whose documents fit the limit."""
    return f"""
with d as (select doc_id, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as hash,
                  cast(strlen(coalesce(text, '')) as bigint) as n_bytes from documents),
levels as (select cast(l as integer) as depth from generate_series(0, 40) g(l)),
sized as (select depth, hash >> ({BITS} - depth) as prefix, cast(sum(n_bytes) as bigint) as total
          from d, levels group by all),
fit as (select doc_id, hash, n_bytes, min(depth) as depth from d, levels
        join sized using (depth) where prefix = hash >> ({BITS} - depth) and total <= {limit} group by all)
select doc_id, hash, n_bytes, f.depth, cast(0 as bigint) as part,
       case when f.depth = 0 then '' else right(lpad(cast(cast(prefix as bit) as varchar), 64, '0'), f.depth) end as shard,
       total as shard_bytes, false as oversize
from fit f join sized s on s.depth = f.depth and s.prefix = f.hash >> ({BITS} - f.depth)
"""
