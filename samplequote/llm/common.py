"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staging_path


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        top, name = os.path.split(package)
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", top, name)
        spark.sparkContext.addPyFile(made)
        _SHIPPED.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared staging folder and read back: cuts lineage
    and survives the loss of executors."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_key(col: Column) -> Column:
    """A text never null that sorts as ``col`` does, null first."""
    return F.coalesce(F.concat(F.lit("."), col.cast("string")), F.lit("-"))


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within ``group``, by ``order``) and ``size`` of
    the group. Rows are dealt by ranges of (group, order) and sorted there; the
    ranges' counts, a row for each range and group, are summed up before them. A
    group of any size spans as many tasks as its rows need."""
    keys = [group, *order]
    dealt = stored(rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
                   .withColumn("at", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumn("dealt", F.shiftrightunsigned("at", 33))
    runs = dealt.groupBy(group, "dealt").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy(group)
    before = F.sum("n").over(of_group.orderBy("dealt")) - F.col("n")
    starts = stored(runs.select(group, "dealt", (F.col("first") - before).alias("shift"), F.sum("n").over(of_group).alias("size")), f"{label}-starts")
    return (dealt.join(starts, [group, "dealt"]).withColumn("rank", F.col("at") - F.col("shift"))
            .drop("at", "dealt", "shift"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of items of at most ``limit`` together, or of one larger item."""
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def in_parts(batches: Iterator[pa.RecordBatch], at: int, kept: list[int], names: list[str], made, limit: int) -> Iterator[pa.RecordBatch]:
    """The columns ``kept`` of each batch with the arrays that ``made`` gives for the texts
    (null as empty) in column ``at``, a part of about ``limit`` bytes of text at a time, a
    longer text alone: memory does not depend on the rows of a batch."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
        for i, j in by_size(sizes, limit):
            part = b.slice(i, j - i)
            texts = [t or "" for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + made(texts), names=names)


def map_texts(rows: DataFrame, text: str, maker, added: str, limit: int, keep_text: bool = False) -> DataFrame:
    """``rows`` with the columns ``added`` (DDL) that a function of a list of texts gives as
    Arrow arrays; ``maker`` makes that function in a task. The column ``text`` goes unless
    ``keep_text``."""
    kept = [i for i, c in enumerate(rows.columns) if keep_text or c != text]
    at = rows.columns.index(text)
    fields = [T.StructField(rows.schema[i].name, rows.schema[i].dataType) for i in kept] + T.StructType.fromDDL(added).fields
    names = [f.name for f in fields]
    return rows.mapInArrow(lambda batches: in_parts(batches, at, kept, names, maker(), limit), T.StructType(fields))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text falls on ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches sorted by ``key``: each table
    holds complete groups only, the open last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and held and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        ready = pa.Table.from_batches([*held, batch.slice(0, last)] if last else held) if held or last else None
        held = [batch.slice(last)]
        if ready is not None and ready.num_rows:
            yield ready
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal keys, with the end appended."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut, [len(keys)]))
