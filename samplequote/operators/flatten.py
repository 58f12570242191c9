"""Flattening nested pricing requests: proposal -> countries -> audiences.

Each audience stays under its own country (nested ``posexplode_outer``), and
its position in both arrays is kept as an explicit key, so no positional
re-join is needed. Generators are narrow: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import (ACCOUNT_RENAMES, AUDIENCE_RENAMES, COST_RENAMES,
                       COUNTRY_RENAMES, PROPOSAL_FIELDS)


def explode_countries(requests: DataFrame) -> DataFrame:
    """One row per (request, country); an empty or NULL country list keeps
    one row with NULL country (as pandas ``explode`` does)."""
    return requests.select("*", F.posexplode_outer("countries").alias("country_pos", "country")) \
                   .drop("countries")


def explode_audiences(countries: DataFrame) -> DataFrame:
    """One row per (request, country, audience), each audience under its own
    country."""
    return countries.select("*", F.posexplode_outer("country.audiences")
                            .alias("audience_pos", "audience"))


def flatten_request(requests: DataFrame, keep_positions: bool = False,
                    country_extra=()) -> DataFrame:
    """Nested requests -> flat audience rows with the renamed columns:
    ``total_costs.*`` -> ``*_costs``, ``account.*`` -> ``account_*``,
    country code -> ``proposal_country_code``, audience fields ->
    ``audience_*``. ``country_extra`` carries further fields of the country
    entry (e.g. a per-request count added before flattening)."""
    rows = explode_audiences(explode_countries(requests))
    cols = [F.col(f) for f in PROPOSAL_FIELDS]
    cols += [F.col(f"total_costs.{k}").alias(v) for k, v in COST_RENAMES.items()]
    cols += [F.col(f"account.{k}").alias(v) for k, v in ACCOUNT_RENAMES.items()]
    cols += [F.col(f"country.{k}").alias(v) for k, v in COUNTRY_RENAMES.items()]
    cols += [F.col(f"country.{k}").alias(k) for k in country_extra]
    cols += [F.col(f"audience.{k}").alias(v) for k, v in AUDIENCE_RENAMES.items()]
    if keep_positions:
        cols += [F.col("country_pos"), F.col("audience_pos")]
    return rows.select(*cols)
