"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.broadcast import fits_broadcast
from .common import stored

#: Edges of a vertex (two numbers each) that a task gets at once; hubs (a vertex and a
#: number) that are broadcast at most.
HUB, MAX_HUBS = 1_000_000, 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """vertex, root (the smallest vertex reachable) of every vertex of ``edges`` (a, b).

    Each round links every vertex to the smallest one it knows; neighbour lists
    are never gathered, only their minima. Rounds end when the edges no longer
    change (their number and hash sum agree)."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stored(edges.where("a <> b").select(a, b).distinct(), "cc-edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = (_with_least(both, least, 2 * mark[0]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = stored(large, "cc-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, least, 2 * mark[0])
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = stored(small, "cc-edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    rooted = now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return rooted.unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())


def _with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """``edges`` (a, b; at most ``count``) with ``m`` of their ``a`` from ``least`` (a, m, n).
    The edges of vertices with more than ``HUB`` are dealt by a salt as well, and their
    ``m`` is repeated for each salt; such vertices are at most a ``HUB``-th of the edges."""
    if count <= HUB:
        return edges.join(least.select("a", "m"), "a")
    least = stored(least, "cc-least")
    hubs = least.where(F.col("n") > HUB)
    if hubs.isEmpty():
        return edges.join(least.select("a", "m"), "a")
    salts = hubs.select(F.col("a").alias("hub"), F.ceil(F.col("n") / HUB).alias("salts"))
    salted = (edges.join(F.broadcast(salts) if fits_broadcast(salts, MAX_HUBS) else salts, F.col("a") == F.col("hub"), "left")
              .withColumn("salt", F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("salts"))).cast("long")).select("a", "b", "salt"))
    copies = least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / HUB) - 1)).alias("salt"))
    return salted.join(copies, ["a", "salt"]).select("a", "b", "m")


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h
