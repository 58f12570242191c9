"""Streaming quotes: request documents in, quote rows out.

Stateless: each micro-batch is flattened and priced against static lookups
(stream-static joins, broadcast when their size is proven small). The
per-country count feature cannot be a batch-wide window on a stream, so the
stream computes it within each request document before exploding.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import COUNTRY_COUNT, with_features
from ..operators.flatten import flatten_request
from ..operators.scoring import needs_column
from ..params import DEFAULT_PARAMS, QuoteParams
from ..plans.quote import Lookups, prepare_lookups, quote
from ..schemas import REQUEST_DDL
from ..sources import versions


def country_counts_in_request(countries: Column) -> Column:
    """For each country entry, the number of audiences of its country: over the
    whole proposal where the entry carries it (pages), else as held by the
    request (array functions only: no shuffle)."""
    def count_for(c):
        same = F.filter(countries, lambda x: x["country_code"] == c["country_code"])
        return F.aggregate(same, F.lit(0).cast("bigint"),
                           lambda acc, x: acc + F.coalesce(F.size(x["audiences"]), F.lit(0)).cast("bigint"))
    return F.transform(countries, lambda c: c.withField(COUNTRY_COUNT, F.coalesce(c["country_audiences"], count_for(c))))


def read_request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_DDL)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def quote_stream(requests: DataFrame, lookups: Lookups, scorers: Mapping[str, object],
                 params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Streaming (or batch) requests -> quote rows. When a scorer reads the
    per-country count, it is computed within each request document before
    flattening (a batch-wide window is not available on a stream)."""
    if params.country_count_scope is not None and needs_column(scorers, COUNTRY_COUNT, _features(requests)):
        counted = requests.withColumn("countries", country_counts_in_request(F.col("countries")))
        flat = flatten_request(counted, country_extra=(COUNTRY_COUNT,))
        return quote(flat, lookups, scorers, replace(params, country_count_scope="given"))
    return quote(flatten_request(requests), lookups, scorers, replace(params, country_count_scope=None))


def _features(requests: DataFrame) -> DataFrame:
    return with_features(flatten_request(requests), None)


def stream_quotes_to_table(spark: SparkSession, requests_path: str, lookups: Lookups,
                           scorers: Mapping[str, object], params: QuoteParams, out_path: str,
                           max_files: int | None = None) -> str:
    """Run the quote stream over every request file present (availableNow),
    appending parquet files; the checkpoint lives next to the output in the
    shared folder, so a restarted query resumes where it stopped."""
    stream = read_request_stream(spark, requests_path, max_files)
    quotes = quote_stream(stream, lookups, scorers, params)
    q = (quotes.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{out_path}/_checkpoint")
         .trigger(availableNow=True)
         .start(f"{out_path}/data"))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return f"{out_path}/data"


def stream_quotes_refreshing(spark: SparkSession, requests_path: str, load_lookups,
                             scorers: Mapping[str, object], params: QuoteParams, out_path: str,
                             max_files: int | None = None, trigger: dict | None = None):
    """Quote stream whose lookups are re-read for every micro-batch
    (``load_lookups()`` returns fresh ``Lookups``), so rate changes reach
    quotes while the stream runs. Each batch overwrites its own
    ``epoch=<id>`` folder, so a batch replayed after a failure replaces its
    earlier output instead of duplicating it. Returns the started query."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        quotes = quote_stream(batch, load_lookups(), scorers, params)
        quotes.write.mode("overwrite").parquet(f"{out_path}/data/epoch={epoch_id}")

    writer = (read_request_stream(spark, requests_path, max_files).writeStream
              .foreachBatch(handle).option("checkpointLocation", f"{out_path}/_checkpoint"))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def publish_lookups(spark: SparkSession, root: str, price_factors: DataFrame, commission: DataFrame, rates: DataFrame) -> int:
    """The three lookup tables (text) as the next version below ``root``."""
    return versions.publish(spark, root, {"price_factors": price_factors, "commission": commission, "rates": rates})


def stream_quotes_versioned(spark: SparkSession, requests_path: str, lookups_root: str,
                            scorers: Mapping[str, object], params: QuoteParams, out_path: str,
                            max_files: int | None = None, trigger: dict | None = None):
    """Quote stream over published lookup versions. Each micro-batch is bound to the
    version that is the latest when it first runs; the binding is recorded before it is
    priced, so a batch replayed after a failure is priced by the same lookups even if
    newer ones have been published, and replaces its own ``epoch=<id>`` folder. Quotes
    carry ``lookup_version``. Returns the started query."""
    prepared: dict[int, Lookups] = {}

    def handle(batch: DataFrame, epoch_id: int) -> None:
        version = versions.bind(spark, f"{out_path}/_versions", epoch_id, lookups_root)
        if version not in prepared:
            prepared.clear()
            prepared[version] = prepare_lookups(*(versions.read(spark, lookups_root, version, t)
                                                  for t in ("price_factors", "commission", "rates")), params)
        quotes = quote_stream(batch, prepared[version], scorers, params).withColumn("lookup_version", F.lit(version))
        quotes.write.mode("overwrite").parquet(f"{out_path}/data/epoch={epoch_id}")

    writer = (read_request_stream(spark, requests_path, max_files).writeStream
              .foreachBatch(handle).option("checkpointLocation", f"{out_path}/_checkpoint"))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
