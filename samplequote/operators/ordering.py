"""Ranks of rows without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .broadcast import stored_lookup


def rank_rows(rows: DataFrame, group: list[str], order: list[str | Column], label: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0 within ``group``, by ``order``) and ``size`` of the
    group, stored in that order. Rows are dealt by ranges of (group, order) and sorted
    there; the ranges' counts, a row for each range and group, are summed up before
    them, so a group of any size spans as many tasks as its rows need. Rows equal in
    group and order are told apart by a number given when they are dealt."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order, F.monotonically_increasing_id()]
    named = [k.alias(f"_k{i}") if isinstance(k, Column) else F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    sort = [f"_k{i}" for i in range(len(keys))]
    dealt = stored_lookup(rows.select("*", *named).repartitionByRange(n, *sort).sortWithinPartitions(*sort)
                          .drop(*sort).withColumn("_at", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumn("_range", F.shiftrightunsigned("_at", 33))
    runs = dealt.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(*group)
    before = F.sum("_n").over(of_group.orderBy("_range")) - F.col("_n")
    starts = stored_lookup(runs.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"),
                                       (F.col("_first") - before).alias("_shift"), F.sum("_n").over(of_group).alias("size")), f"{label}-ranges")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & dealt[g].eqNullSafe(F.col(f"_g{i}"))
    return (dealt.join(starts, same).withColumn("rank", F.col("_at") - F.col("_shift"))
            .drop("_at", "_range", "_r", "_shift", *[f"_g{i}" for i in range(len(group))]))
