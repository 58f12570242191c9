"""Operator 13: hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become whole numbers and are ranked along a Hilbert curve over all
dimensions (``BITS`` bits each). The ranked rows are written as Parquet in that
order; ``BLOCK`` neighbours are a block, and its zone map holds each dimension's
least and greatest value and the labels in it. For an anchor, interval arithmetic
over a zone map bounds the inner products with all rows of the block, so a block
is read only if it can hold something that the anchor still wants:

* positives: the anchor first meets the rows of its own stretch of the curve (one
  read of the table), whose fifth best score is a threshold; then the blocks with
  its label whose upper bound reaches the threshold are read, exactly;
* negatives: each positive opens a window of scores; the blocks with another label
  whose bounds meet one of the anchor's windows are read.

Work is dealt by (chunk of anchors, stretch of zone maps) and then by (chunk of
anchors, group of blocks), all bounded stretches of the curve, so the size of a task
depends on no label or vector. Anchors are the stated
query set, in blocks against all rows; bounds decide which pairs of blocks meet.
Each task keeps the first few for each anchor or window, and a ranking over those
gives the result. Scores are exact: by floating point where no sum can pass 2^53,
else by Python's whole numbers (and kept within 64 bits in the result).

Rows with a null label or vector, or with a null or non-finite component, take no
part; nor do rows without an id, which nothing could name. Vectors shorter than the
longest count as filled up with zeros. Rows of one id are rows of their own: each is
an anchor if its id is, and only the anchor's own row is not another row. Ties go by
the smaller id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, ship, stored

#: Rows of a block, blocks read together by a task, ranks of a chunk of anchors, zone
#: maps that a task holds.
BLOCK, GROUP_BLOCKS, CHUNK_RANKS, ZONES = 512, 64, 25_600, 4096
#: Bits of each dimension on the curve.
BITS = 2
#: Percent of the positive's score from which a negative is hard, and where it ends.
LOW, HIGH = 80, 100
_SAFE = 2 ** 53
_LONG = 2 ** 63 - 1


# --- the curve ------------------------------------------------------------------

def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places on the Hilbert curve, as byte strings in order: ``cells`` are whole
    coordinates of ``bits`` bits. Coordinates are turned into the curve's transposed
    form by undoing its exchanges and reflections from the top bit down."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    if not n or not len(x):
        return [b""] * len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & (q - 1)
            swap[high] = 0
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    planes = np.concatenate([(x >> b) & 1 for b in reversed(range(bits))], axis=1)
    return [row.tobytes() for row in np.packbits(planes.astype(np.uint8), axis=1)]


def prepared(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, values of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return (embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("vector"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
            .select("vec_id", label.alias("label"), F.transform("vector", lambda x: F.floor(x * 256.0)).alias("values")))


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, values) in the order of the curve, stored: rank, block,
    grp (of blocks), vec_id, label, values (all as long as the longest)."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    span = rows.agg(F.max(F.size("values")).alias("n"), F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi")).first()
    n, low, high = span.n or 0, span.lo or 0, span.hi or 0

    def keyed(batches):
        for b in batches:
            x = np.zeros((b.num_rows, n), np.int64)
            for i, values in enumerate(b.column("values").to_pylist()):
                x[i, :len(values)] = values
            cells = np.clip((x.astype(float) - low) * (1 << BITS) / (float(high) - low + 1), 0, (1 << BITS) - 1).astype(np.int64)
            full = pa.array(list(x), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("row"), full, pa.array(hilbert_keys(cells), pa.binary())],
                                             names=["vec_id", "label", "row", "values", "key"])

    keys = rows.select("vec_id", "label", "row", "values").mapInArrow(keyed, "vec_id long, label long, row long, values array<long>, key binary")
    placed = ranked(keys.withColumn("curve", F.lit(0)), "curve", ["key", "vec_id", "row"], "curve")
    block = F.floor(F.col("rank") / BLOCK)
    return stored(placed.select("rank", block.alias("block"), F.floor(block / GROUP_BLOCKS).alias("grp"), "vec_id", "label", "values"), "blocks")


def zone_maps(blocks: DataFrame) -> DataFrame:
    """grp, block, low, high (of each dimension), labels: a row for each block, stored."""
    def bounds(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("values"))
        return pa.table({"grp": t.column("grp")[:1], "block": t.column("block")[:1], "low": pa.array([x.min(axis=0)], pa.list_(pa.int64())),
                         "high": pa.array([x.max(axis=0)], pa.list_(pa.int64())), "labels": pa.array([np.unique(t.column("label").to_numpy())], pa.list_(pa.int64()))})
    return stored(blocks.groupBy("block").applyInArrow(bounds, "grp long, block long, low array<long>, high array<long>, labels array<long>"), "zone-maps")


# --- scores and bounds ------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a.astype(float)).max() + 1) * int(np.abs(b.astype(float)).max() + 1) * a.shape[1]
    if most < _SAFE:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with vectors inside each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def best(scores: np.ndarray, ids: np.ndarray, ranks: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` allowed rows: higher scores, then smaller ids."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        own = scores[at]
        at = at[own >= np.partition(own, len(at) - k)[len(at) - k]]
    return at[np.lexsort((ranks[at], ids[at], -scores[at]))][:k]


def in_window(scores: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    if abs(positive) < _SAFE // 1000 and (scores.dtype == object or not len(scores) or np.abs(scores).max() < _SAFE):
        return (low * positive <= 100 * scores) & (100 * scores <= high * positive)
    wide = scores.astype(object)
    return ((low * int(positive) <= 100 * wide) & (100 * wide <= high * int(positive))).astype(bool)


# --- the two searches ---------------------------------------------------------------

_ANCHOR = "chunk long, grp long, rank long, vec_id long, label long, values array<long>, wants array<long>, blocks array<long>"
_FOUND = "rank long, anchor_id long, want long, slot int, vec_id long, found_rank long, score long"


def chosen_blocks(anchors: DataFrame, zones: DataFrame, last_block: int, chunks: int, same: bool, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchors`` (chunk, rank, vec_id, label, values, wants) with the blocks of each group
    that the bounds leave to be read, stored; a row for each group with any. ``same``:
    wants holds the score to reach, if any, among rows of the anchor's label; else the
    positives' scores, each a window for rows of other labels. A task holds a chunk of
    anchors and the zone maps of ``ZONES`` blocks."""
    def choose(a: pa.Table, z: pa.Table) -> pa.Table:
        order = np.argsort(z.column("block").to_numpy())
        block, grp = z.column("block").to_numpy()[order], z.column("grp").to_numpy()[order]
        labels = [set(z.column("labels")[int(i)].as_py()) for i in order]
        label, wants = a.column("label").to_pylist(), a.column("wants").to_pylist()
        own = {y: np.array([y in have for have in labels], bool) for y in set(label)}
        other = {y: np.array([bool(have - {y}) for have in labels], bool) for y in set(label)}
        x, box_low, box_high = _matrix(a.column("values")), _matrix(z.column("low"))[order], _matrix(z.column("high"))[order]
        rows, groups, chosen = [], [], []
        for first in range(0, a.num_rows, 64):
            least, most = score_bounds(x[first:first + 64], box_low, box_high)
            for i, (down, up) in enumerate(zip(least, most), start=first):
                if same:
                    ok = own[label[i]] & (up >= wants[i][0]).astype(bool) if wants[i] else own[label[i]]
                else:
                    ok = np.zeros(len(block), bool)
                    for p in wants[i]:
                        ok |= ((100 * up.astype(object) >= low * p) & (100 * down.astype(object) <= high * p)).astype(bool)
                    ok &= other[label[i]]
                for g in np.unique(grp[ok]).tolist():
                    rows.append(i)
                    groups.append(g)
                    chosen.append(block[ok & (grp == g)])
        t = a.take(pa.array(rows, pa.int64())).append_column("grp", pa.array(groups, pa.int64()))
        t = t.append_column("blocks", pa.array(chosen, pa.list_(pa.int64())))
        return t.select(["chunk", "grp", "rank", "vec_id", "label", "values", "wants", "blocks"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return choose(left.drop_columns(["zone"]), right) if left.num_rows and right.num_rows else _empty(_ANCHOR)

    zone = F.sequence(F.lit(0), F.lit(last_block // ZONES)).cast("array<long>")
    a = anchors.select("chunk", "rank", "vec_id", "label", "values", "wants").withColumn("zone", F.explode(zone))
    z = (zones.withColumn("zone", F.floor(F.col("block") / ZONES))
         .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>"))))
    return stored(a.groupBy("chunk", "zone").cogroup(z.groupBy("chunk", "zone")).applyInArrow(run, _ANCHOR), "reads")


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


def read_blocks(reads: DataFrame, blocks: DataFrame, same: bool, count: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The first ``count`` rows of each (chunk, group) that every anchor or window finds
    in its chosen blocks: rank and anchor_id, want (the positive's score), slot (its
    place), vec_id, found_rank, score."""
    def search(rows: pa.Table, a: pa.Table) -> pa.Table:
        if not rows.num_rows or not a.num_rows:
            return _empty(_FOUND)
        ids, ranks, label, block = (rows.column(c).to_numpy() for c in ("vec_id", "rank", "label", "block"))
        x, q = _matrix(rows.column("values")), _matrix(a.column("values"))
        out = []
        for first in range(0, len(q), 64):
            scores = products(q[first:first + 64], x)
            for i, own in enumerate(scores, start=first):
                me = {c: a.column(c)[i].as_py() for c in ("rank", "vec_id", "label", "wants", "blocks")}
                near = np.isin(block, me["blocks"])
                if same:
                    for j in best(own, ids, ranks, near & (label == me["label"]) & (ranks != me["rank"]), count):
                        out.append((me["rank"], me["vec_id"], 0, 0, int(ids[j]), int(ranks[j]), _long(own[j])))
                else:
                    near &= label != me["label"]
                    for slot, p in enumerate(me["wants"]):
                        for j in best(own, ids, ranks, near & in_window(own, p, low, high), count):
                            out.append((me["rank"], me["vec_id"], p, slot, int(ids[j]), int(ranks[j]), _long(own[j])))
        names = [c.split()[0] for c in _FOUND.split(", ")]
        if not out:
            return _empty(_FOUND)
        return pa.table({n: pa.array(c, pa.int32() if n == "slot" else pa.int64()) for n, c in zip(names, zip(*out))})

    wanted = reads.select(F.col("chunk").alias("reader"), F.explode("blocks").alias("block")).distinct()
    rows = blocks.join(wanted, "block").select("reader", "grp", "block", "rank", "vec_id", "label", "values")
    return rows.groupBy("reader", "grp").cogroup(reads.groupBy("chunk", "grp")).applyInArrow(search, _FOUND)


def _long(score) -> int:
    return max(-_LONG - 1, min(_LONG, int(score)))


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "found_rank"))
    return found.withColumn("place", place).where(F.col("place") <= count)


def thresholds(blocks: DataFrame, count: int, every: int) -> DataFrame:
    """rank, wants: for each anchor the ``count``-th best score (if any) among the rows of its
    label in its own group of blocks."""
    def search(t: pa.Table) -> pa.Table:
        ids, ranks, label, x = t.column("vec_id").to_numpy(), t.column("rank").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("values"))
        mine = np.flatnonzero(ids % every == 0)
        wants = []
        for first in range(0, len(mine), 64):
            part = mine[first:first + 64]
            for i, own in zip(part, products(x[part], x)):
                found = best(own, ids, ranks, (label == label[i]) & (ranks != ranks[i]), count)
                wants.append([_long(own[found[-1]])] if len(found) == count else [])
        return pa.table({"rank": pa.array(ranks[mine], pa.int64()), "wants": pa.array(wants, pa.list_(pa.int64()))})
    return blocks.groupBy("grp").applyInArrow(search, "rank long, wants array<long>")


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows``
    (vec_id, label, values)."""
    blocks = candidate_blocks(rows)
    zones = zone_maps(blocks)
    last = blocks.agg(F.max("rank").alias("r")).first().r or 0
    last_block, chunks = last // BLOCK, last // CHUNK_RANKS + 1
    anchors = (blocks.where(F.col("vec_id") % every == 0).select("rank", "vec_id", "label", "values")
               .withColumn("chunk", F.floor(F.col("rank") / CHUNK_RANKS)))
    seeded = stored(anchors.join(thresholds(blocks, positives, every), "rank"), "anchors")
    reads = chosen_blocks(seeded, zones, last_block, chunks, True, low, high)
    near = stored(_first(read_blocks(reads, blocks, True, positives), ["rank"], positives), "positives")
    wants = near.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).getField("score").alias("wants"))
    open_ = stored(seeded.drop("wants").join(wants, "rank"), "windows")
    reads = chosen_blocks(open_, zones, last_block, chunks, False, low, high)
    found = _first(read_blocks(reads, blocks, False, negatives, low, high), ["rank", "slot"], negatives)
    pairs = near.select("rank", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (found.select("rank", "anchor_id", "slot", "place", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pairs, ["rank", "slot"])
            .select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return mine(prepared(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")))


def op13_sql() -> str:
    return f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
           from embeddings where vec_id is not null and label is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
             cast(list_inner_product(a.q, b.q) as bigint) as score
      from v a join v b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.*, other_id as negative_id, score as negative_score,
             row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not same
      and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
