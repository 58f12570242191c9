"""Staging lookup tables: namespace, header CSV (all text) -> managed table,
scans by name, schema report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..schemas import RATES_SCHEMA


def create_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    """``CREATE DATABASE IF NOT EXISTS`` (optionally at a given location)."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{loc}")


def read_lookup_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Header CSV with every column read as text (no inference)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_lookup_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write a lookup table as header CSV (text columns)."""
    df.select(*[df[c].cast("string").alias(c) for c in df.columns]) \
      .write.mode(mode).option("header", True).csv(path)
    return path


def stage_lookup(df: DataFrame, table: str, fmt: str = "parquet",
                 mode: str = "errorifexists", path: str | None = None) -> str:
    """Save as a table (managed, or external at ``path``). The default mode
    fails when the table exists, as re-staging does in the original notebook."""
    w = df.write.format(fmt).mode(mode)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return table


def restage_lookup(df: DataFrame, table: str, path: str, fmt: str = "parquet") -> str:
    """Stage ``table`` anew (or for the first time) without a moment in which it is
    missing or half written: ``df`` goes to a new folder below ``path``, and only when
    that is complete the table's location moves there. Queries planned before keep
    reading the old folder, which stays until ``drop_old_stages``."""
    spark = df.sparkSession
    folder = f"{path.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.format(fmt).save(folder)
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(table, folder, fmt, df.schema)
    else:
        have = [(f.name, f.dataType) for f in spark.table(table).schema]
        if have != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"{table} has other columns: {have}")
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
    spark.catalog.refreshTable(table)
    return folder


def drop_old_stages(spark: SparkSession, table: str, path: str) -> int:
    """Delete the folders of earlier ``restage_lookup`` calls, for when no reader uses them."""
    now = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first().data_type.rstrip("/")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("stage-")
           and s.getPath().getName() != now.rsplit("/", 1)[-1]]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def stage_rates(rates: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Monthly rates as a folder for each month, so that a snapshot reads its month only."""
    rates.repartition("month").write.mode(mode).partitionBy("month").parquet(path)
    return path


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rates staged by month, every column as text."""
    return spark.read.schema(RATES_SCHEMA).parquet(path)


def scan(spark: SparkSession, table: str) -> DataFrame:
    """``SELECT * FROM table``."""
    return spark.sql(f"SELECT * FROM {table}")


def schema_report(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) pairs."""
    return df.dtypes
