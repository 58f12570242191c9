"""Size-checked broadcast.

A lookup side is broadcast only after a bounded count proves it holds at most
``max_rows`` rows; otherwise the plain DataFrame is returned and Spark plans a
shuffle join (sort-merge, with AQE splitting skewed partitions).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staging_path

log = logging.getLogger(__name__)


#: Bytes that a broadcast side may hold: its texts and a fixed width for each row and field.
MAX_BROADCAST_BYTES = 256 << 20
_ROW_BYTES, _FIELD_BYTES = 16, 8


def fits_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows whose fields and texts
    take at most ``max_bytes``. Reads no more than ``max_rows + 1`` rows per
    partition, so it is cheap on a small table and bounded on a large one."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    width = F.lit(_ROW_BYTES + _FIELD_BYTES * len(df.columns)).cast("long")
    for name in texts:
        width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return found.n <= max_rows and found.size <= max_bytes


def stored_lookup(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared staging folder and read back: what is
    derived from big tables is not derived again by each join or micro-batch,
    and stays as it is while a stream runs."""
    path = staging_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int, materialize: bool = False,
                      label: str = "lookup") -> DataFrame:
    """Broadcast ``df`` when it provably has at most ``max_rows`` rows.

    ``materialize=True`` first checkpoints ``df`` to the shared checkpoint
    folder: use it for a small table *derived* from big input (an aggregate),
    so that the size check and the join read the stored rows instead of
    recomputing the aggregate twice, and executor loss cannot lose them.
    """
    if materialize:
        df = df.checkpoint(eager=True)
    if fits_broadcast(df, max_rows):
        log.info("%s: broadcast (<= %d rows)", label, max_rows)
        return F.broadcast(df)
    log.info("%s: over %d rows, shuffle join", label, max_rows)
    return df
