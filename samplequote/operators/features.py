"""Feature frame for the response scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT_PARAMS, QuoteParams
from ..schemas import FEATURE_RENAMES
from .broadcast import bounded_broadcast

COUNTRY_COUNT = "feaNumberOfAudienceCountryA3"
SAME_COUNTRY = "feaAudienceCountryIsAccountCountry"
FEATURE_COLUMNS = tuple(FEATURE_RENAMES.values()) + (COUNTRY_COUNT, SAME_COUNTRY)


def country_counts(df: DataFrame, country: str = "proposal_country_code",
                   by: Sequence[str] = ()) -> DataFrame:
    """Audience rows per country (NULL countries not counted). Partial
    aggregation runs map-side, so only one row per country and task is
    shuffled, however hot a country is."""
    return (df.where(F.col(country).isNotNull())
            .groupBy(*by, country).agg(F.count(F.lit(1)).alias(COUNTRY_COUNT)))


def with_country_count(df: DataFrame, scope: str | None = "batch",
                       country: str = "proposal_country_code",
                       proposal_keys: Sequence[str] = ("proposal_id", "revision_number"),
                       params: QuoteParams = DEFAULT_PARAMS, counted: DataFrame | None = None) -> DataFrame:
    """Add the number of audience rows sharing the row's audience country,
    over the whole batch (``"batch"``) or within one proposal
    (``"proposal"``). A NULL country gets NULL. ``counted`` are the rows that
    are counted, where ``df`` is a filtered part of them.

    Batch scope aggregates first and broadcasts the per-country counts once
    their number is proven small, instead of a window that would move every
    row of a country into one task."""
    if scope is None:
        return df.withColumn(COUNTRY_COUNT, F.lit(None).cast("bigint"))
    if scope == "given":  # computed upstream (per request, on streams)
        return df
    by = () if scope == "batch" else tuple(proposal_keys)
    counts = country_counts(df if counted is None else counted, country, by).withColumnRenamed(country, "_cc_country")
    if scope == "batch":
        counts = bounded_broadcast(counts, params.max_broadcast_countries, materialize=True,
                                   label="country counts")
    cond = F.col(country) == F.col("_cc_country")
    for k in by:
        counts = counts.withColumnRenamed(k, f"_cc_{k}")
        cond = cond & (F.col(k) == F.col(f"_cc_{k}"))
    return df.join(counts, cond, "left").drop("_cc_country", *[f"_cc_{k}" for k in by])


def with_features(df: DataFrame, scope: str | None = "batch",
                  params: QuoteParams = DEFAULT_PARAMS, counted: DataFrame | None = None) -> DataFrame:
    """Add the 14 scorer features next to the flat request columns."""
    aliases = [f"`{src}` AS `{dst}`" for src, dst in FEATURE_RENAMES.items() if src != dst]
    out = df.selectExpr("*", *aliases)
    out = with_country_count(out, scope, params=params, counted=counted)
    return out.selectExpr("*", "CAST(coalesce(AudienceCountryA3 = account_country_code, false) AS INT) "
                               f"AS {SAME_COUNTRY}")


def quote_features(df: DataFrame, scope: str | None = "batch",
                   params: QuoteParams = DEFAULT_PARAMS,
                   keep: Sequence[str] = ()) -> DataFrame:
    """The scorer feature frame itself (plus any ``keep`` columns)."""
    return with_features(df, scope, params).select(*keep, *FEATURE_COLUMNS)
