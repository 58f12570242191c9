"""Quote sinks: JSON records, records arrays and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.broadcast import fits_broadcast, stored_lookup
from ..operators.ordering import rank_rows

#: Records of one array: what a task gathers into one row.
PAGE_RECORDS = 1_000
#: Proposals of several pages that are broadcast at most.
MAX_BROADCAST_LARGE = 100_000
#: The order of a proposal's records.
RECORD_ORDER = ("proposal_country_code", "audience_uuid", "fieldwork_company", "HighPrice", "LowPrice", "Strand2Price")
_NULLS = {"ignoreNullFields": "false"}


def quote_json(quotes: DataFrame, keys=("proposal_id", "revision_number")) -> DataFrame:
    """One JSON record per quote row, NULL prices written as ``null``."""
    return quotes.select(*keys, F.to_json(F.struct(*[F.col(c) for c in quotes.columns]), _NULLS).alias("json"))


def quote_records(quotes: DataFrame, by=("proposal_id", "revision_number"), order=RECORD_ORDER,
                  page_records: int = PAGE_RECORDS) -> DataFrame:
    """The records of each proposal (each value of ``by``) as one ordered JSON array:
    by, page_no, page_count, n_records, records.

    An array holds at most ``page_records`` records; the records of a larger proposal
    come as several, in order: page 0, 1, ... one after the other are the whole
    array (``join_pages`` cuts the brackets between them). Null order columns come
    first; rows equal in all of them keep any order.

    Quotes are stored once and counted. Those of a proposal of one page are gathered
    and sorted there; only larger proposals are ranked by ranges, without a task per
    proposal. All are gathered by page, so no group is larger than a page."""
    order = [c for c in order if c in quotes.columns]
    rest = [c for c in quotes.columns if c not in order and c not in by]
    rows = stored_lookup(quotes, "quotes")
    large = stored_lookup(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > page_records)
                          .select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(by)], F.lit(True).alias("_large")), "large-proposals")
    one_page = {"rank": F.lit(0).cast("long"), "page_no": F.lit(0), "page_count": F.lit(1)}
    if large.isEmpty():
        ranked = rows.withColumns(one_page)
    else:
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & rows[c].eqNullSafe(F.col(f"_l{i}"))
        found = rows.join(F.broadcast(large) if fits_broadcast(large, MAX_BROADCAST_LARGE) else large, same, "left")
        small = found.where(F.col("_large").isNull()).select(*quotes.columns).withColumns(one_page)
        by_range = rank_rows(found.where(F.col("_large")).select(*quotes.columns), list(by), order, "records")
        by_range = by_range.withColumns({"page_no": F.floor(F.col("rank") / page_records).cast("int"),
                                         "page_count": F.ceil(F.col("size") / page_records).cast("int")}).drop("size")
        ranked = small.unionByName(by_range)
    # the proposal's own columns come back from the key
    items = F.sort_array(F.collect_list(F.struct("rank", *[c for c in order if c not in by], *rest)))
    pages = ranked.groupBy(*by, "page_no", "page_count").agg(items.alias("_records"))
    record = F.transform("_records", lambda r: F.struct(*[(F.col(c) if c in by else r[c]).alias(c) for c in quotes.columns]))
    return pages.select(*by, "page_no", "page_count", F.size("_records").alias("n_records"), F.to_json(record, _NULLS).alias("records"))


def join_pages(pages: list[str]) -> str:
    """The arrays of consecutive pages as one array."""
    inner = [p[1:-1] for p in pages]
    return "[" + ",".join(p for p in inner if p) + "]"


def parse_records(records: DataFrame, schema, column: str = "records", keep=("page_no", "page_count")) -> DataFrame:
    """One row per record of JSON arrays, with its place in the array."""
    kind = f"array<{schema.simpleString()}>"
    return (records.select(*keep, F.posexplode(F.from_json(F.col(column), kind)).alias("record_no", "_r"))
            .select(*keep, "record_no", "_r.*"))


def write_quotes_json(quotes: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """JSON-lines files, NULLs kept (Spark drops NULL fields by default)."""
    quotes.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def write_quotes_table(quotes: DataFrame, table: str, fmt: str = "parquet",
                       mode: str = "errorifexists", partition_by=()) -> str:
    """Save quotes as a managed table."""
    w = quotes.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(table)
    return table
