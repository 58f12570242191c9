"""Reading the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stamp(spark: SparkSession, path: str) -> tuple:
    """(length, modification time) of the files below ``path``, through the file
    system that Spark reads it with."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def spread(df: DataFrame, keys) -> DataFrame:
    """``df`` dealt over as many partitions as the session asks for in
    ``spark.samplequote.inputPartitions`` by a hash of the full row key, and
    unchanged when it asks for none (the default). For inputs of a few large
    row groups on a small machine."""
    n = int(df.sparkSession.conf.get("spark.samplequote.inputPartitions", "0"))
    return df.repartition(n, *keys) if n else df


class Tables:
    """Attribute access to the tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)
