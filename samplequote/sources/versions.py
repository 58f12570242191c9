"""Lookup versions: immutable folders, published by a marker.

A version is written below ``v=<n>`` and exists for readers only once its marker is
there, so no reader meets half of one; it is never changed afterwards. Consumers
bind a piece of work (a micro-batch) to a version by a marker of their own: the
first binding stands, so work that is done again uses the version it used before.
Markers are empty files made with the file system's create-if-absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _mark(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False where it is there already."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    try:
        fs.create(p, False).close()
    except Exception as e:  # made by another writer meanwhile
        if fs.exists(p):
            return False
        raise e
    return True


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write ``tables`` as the next version and publish it. Returns its number."""
    n = max([int(x.split("-")[1]) for x in _names(spark, root) if x.startswith("taken-")], default=0) + 1
    while not _mark(spark, f"{root}/taken-{n}"):
        n += 1
    for name, df in tables.items():
        df.write.parquet(f"{root}/v={n}/{name}")
    _mark(spark, f"{root}/published-{n}")
    return n


def latest(spark: SparkSession, root: str) -> int:
    """The highest published version."""
    found = [int(x.split("-")[1]) for x in _names(spark, root) if x.startswith("published-")]
    if not found:
        raise ValueError(f"no lookup version below {root}")
    return max(found)


def read(spark: SparkSession, root: str, version: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}/{name}")


def bind(spark: SparkSession, bindings: str, work: int, root: str) -> int:
    """The version that ``work`` is bound to; binds it to the latest one if it is not yet."""
    def bound():
        found = [int(x.split("-")[1]) for x in _names(spark, bindings) if x.startswith(f"{work}-")]
        return min(found) if found else None
    version = bound()
    if version is None:
        version = latest(spark, root)
        _mark(spark, f"{bindings}/{work}-{version}")
    return version
