"""Operator 8: best-fit packing with certified bin counts.

Texts become ids in tasks; only (document, piece, length) rows move. Pieces are
dealt over partitions by a hash and packed there by best-fit decreasing. Each
partition's bin count is compared with a lower bound from dual feasible
functions (the sum of lengths rounded up by functions that no packing can beat);
where they agree the partition is certified and left alone. Partitions with a
gap give the documents of their unfilled sequences into a pool that is dealt
anew over fewer partitions and packed again; a round's result stands only where
it needs fewer sequences. Full sequences never move: no packing improves them.

Null texts count as empty (the closing id alone). A text with more ids than a
sequence holds is cut into full pieces and a rest; nothing else is cut. Repeated
rows are separate documents. An empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import documents, stored, text_of

#: Ids in one sequence.
CAPACITY = 2048
#: Pieces that one packing task is sized for.
PIECES_PER_TASK = 40_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text with
    ``end_id`` after them, cut at ``capacity``."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc = bpe.encoder(vocabulary, False)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of ``lengths`` needs fewer bins: the best of two families of
    dual feasible functions (thresholds, and rounding to 1/k of the capacity)."""
    sizes, counts = np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True)
    if not len(sizes):
        return 0
    best = math.ceil(int((sizes * counts).sum()) / capacity)
    for t in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 < t <= capacity // 2:
            value = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
            best = max(best, math.ceil(int((value * counts).sum()) / capacity))
    for k in range(1, 21):
        # x (k + 1) / capacity is whole: x counts as itself; else as its floor over k
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        value = np.where(whole, sizes * k, (scaled // capacity) * capacity)
        best = max(best, math.ceil(int((value * counts).sum()) / (capacity * k)))
    return best


def best_fit_decreasing(lengths: Iterable[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin with
    room. The remaining rooms in use are kept as bits of one integer."""
    lengths = np.asarray(lengths, dtype=np.int64)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, used
            used += 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - need
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets


def _pack(rows: DataFrame, tasks: int, salt: int, capacity: int) -> DataFrame:
    """Rows with part, sequence_id, offset, fill, n_bins, bound: every part packed on its own."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "uid"], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        part = int(pdf["part"].iloc[0])
        n = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        return pdf.assign(sequence_id=(((salt << 24) + part) << 32) + bins, offset=offsets, fill=fill[bins],
                          n_bins=n, bound=lower_bound(lengths, capacity))

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "uid", F.lit(salt)), F.lit(tasks)).cast("long"))
    schema = _PIECES + ", uid long, part long, sequence_id long, offset long, fill long, n_bins long, bound long"
    columns = [c.split()[0] for c in schema.split(", ")]
    return dealt.groupBy("part").applyInPandas(lambda pdf: run(pdf)[columns], schema)


def pack(items: DataFrame, capacity: int = CAPACITY, rounds: int = 3, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.
    Partitions with a gap are dealt anew until all are certified, until a round needs no
    fewer sequences, or ``rounds`` times: then some partitions may need more sequences
    than their bound says."""
    items = stored(items.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = items.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = items.where(F.col("length") < capacity)
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [full]
    tasks = max(1, math.ceil(pool.count() / per_task))
    packed = stored(_pack(pool, tasks, 0, capacity), "packed")
    for k in range(1, rounds + 1):
        open_ = (F.col("n_bins") > F.col("bound")) & (F.col("fill") < capacity)
        state = packed.where(open_).agg(F.countDistinct("sequence_id").alias("bins"), F.count("*").alias("n"),
                                        F.sum("length").alias("ids")).first()
        if not state.bins or state.bins <= math.ceil(state.ids / capacity):
            break
        pool = packed.where(open_).select("doc_id", "piece", "start", "length", "ids_crc32", "uid")
        tasks = max(1, min(tasks // 2, math.ceil(state.n / per_task)))
        again = stored(_pack(pool, tasks, k, capacity), "repacked")
        if again.select("sequence_id").distinct().count() >= state.bins:
            break
        done.append(packed.where(~open_).select(*out))
        packed = again
    done.append(packed.select(*out))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
