"""The quoting plan: flat audience rows -> features -> scores -> four-way CPI
-> USD -> adjudicated band -> proposal currency.

One lazy DataFrame. The lookups are joined as broadcasts when their size is
proven small, so over the audience rows the whole plan is a single map-only
stage: no shuffle of the big input at any point.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.adjudicate import adjudicate, adjudication_inputs, price_band
from ..operators.broadcast import fits_broadcast, stored_lookup
from ..operators.currency import latest_rates, prepare_rates, require_unique_rates, to_local, with_rate
from ..operators.features import COUNTRY_COUNT, with_features
from ..operators.pricing import USD_RATE, four_way_quotes, prepare_factors, pricing_inputs
from ..operators.scoring import needs_column, score
from ..params import DEFAULT_PARAMS, QuoteParams
from ..schemas import FACTOR_CURRENCY, FEATURE_RENAMES, OUTPUT_COLUMNS
from .stages import stage


@dataclass(frozen=True)
class Lookups:
    """Prepared lookup tables and whether each provably fits a broadcast.
    ``rated`` are the factors with the USD rate of their currency."""

    factors: DataFrame
    factors_fit: bool
    rated: DataFrame
    rated_fit: bool
    commission: DataFrame
    commission_fit: bool
    rates: DataFrame
    rates_fit: bool


def prepare_lookups(price_factors: DataFrame, commission: DataFrame, rates: DataFrame,
                    params: QuoteParams = DEFAULT_PARAMS, strict: bool = False,
                    month_format: str | None = None, unique_rates: bool = False, store: bool = True) -> Lookups:
    """Parse the text lookups, keep the latest rate snapshot and check their
    sizes once, for all joins of the plan. ``unique_rates`` fails on a
    currency with several latest rates instead of fanning quotes out.

    Each is written once to the shared staging folder, so that no join and no
    micro-batch derives it again; pass ``store=False`` where they are used once
    (a stream that loads them anew for every micro-batch)."""
    keep = stored_lookup if store else (lambda df, label: df)
    factors = keep(prepare_factors(price_factors, strict), "factors")
    comm = keep(commission.select("Audience_Country_A3", "Company"), "commission")
    latest = keep(latest_rates(rates, month_format, strict).select("From_Currency", "Rate"), "rates")
    if unique_rates:
        latest = require_unique_rates(latest)
    latest, rates_fit = prepare_rates(latest, params.max_broadcast_rates)
    rated = keep(with_rate(factors, latest, FACTOR_CURRENCY, USD_RATE, rates_fit), "rated-factors")
    return Lookups(
        factors=factors,
        factors_fit=fits_broadcast(factors, params.max_broadcast_factors),
        rated=rated,
        rated_fit=fits_broadcast(rated, params.max_broadcast_factors),
        commission=comm,
        commission_fit=fits_broadcast(comm, params.max_broadcast_commission),
        rates=latest,
        rates_fit=rates_fit,
    )


# Flat columns the quote plan reads after scoring (plus the scores).
QUOTE_INPUTS = (
    "proposal_id", "proposal_uuid", "revision_number", "proposal_country_code", "audience_uuid",
    "currency_code", "account_company_number", "project_type", "brand",
    "audience_incidence_rate", "audience_length_of_interview", "proposal_strategic_index",
    "competitive_intensity_index", "client_strategic_index",
)
SCORES = ("Athena_IR", "Athena_CR", "Athena_LOI")


def scored_rows(flat: DataFrame, scorers: Mapping[str, object],
                params: QuoteParams = DEFAULT_PARAMS, keep=None, counted: DataFrame | None = None) -> DataFrame:
    """Flat rows plus clamped Athena_IR / Athena_CR / Athena_LOI. The
    per-country count feature is computed only when a scorer may read it, over
    ``counted`` where ``flat`` is a part of those rows.

    ``keep=None`` keeps every flat column; a sequence keeps only the columns
    the quote plan needs plus ``keep``, so later stages carry narrow rows."""
    scope = params.country_count_scope if needs_column(scorers, COUNTRY_COUNT, with_features(flat, None, params)) else None
    feats = with_features(flat, scope, params, counted)
    scored = score(feats, scorers, params)
    drop = [dst for src, dst in FEATURE_RENAMES.items() if src != dst]
    scored = scored.drop(*drop, COUNTRY_COUNT, "feaAudienceCountryIsAccountCountry")
    if keep is not None:
        cols = list(dict.fromkeys([*keep, *QUOTE_INPUTS, *SCORES]))
        scored = scored.select(*[c for c in cols if c in scored.columns])
    return stage(scored, "scored")


def priced_rows(scored: DataFrame, lk: Lookups, params: QuoteParams = DEFAULT_PARAMS,
                commission_how: str = "left") -> DataFrame:
    """Four CPI quotes per (audience, fieldwork company), each converted to
    USD by the latest rate of its upper-cased currency, which the factor row brings."""
    rows = pricing_inputs(scored, params)
    rows = four_way_quotes(rows, lk.rated, lk.commission, params, commission_how,
                           lk.rated_fit, lk.commission_fit)
    added = []
    for slot, cpi, currency in (
        ("fw_mod", "Fieldwork_Athena_CPI", "Fieldwork_Currency"),
        ("acc_mod", "Account_Athena_CPI", "Account_Currency"),
        ("fw_sold", "Fieldwork_Sold_CPI", "Fieldwork_Sold_Currency"),
        ("acc_sold", "Account_Sold_CPI", "Account_Sold_Currency"),
    ):
        added += [f"{slot}_cpi AS {cpi}", f"upper({slot}_currency) AS {currency}",
                  f"{slot}_cpi * {slot}_{USD_RATE} AS {cpi}_USD"]
    return stage(rows.selectExpr("*", *added), "usd_quotes")


def band_rows(priced: DataFrame, params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Adjudicated USD band. Audiences without a fieldwork company are not
    adjudicated: their prices stay NULL."""
    out = price_band(adjudicate(adjudication_inputs(priced, params), params))
    band = ("HighPriceUSD", "LowPriceUSD", "Strand2PriceUSD")
    cols = [f"`{c}`" for c in out.columns if c not in band]
    return stage(out.selectExpr(*cols, *[f"CASE WHEN fieldwork_company IS NOT NULL THEN {c} END AS {c}"
                                         for c in band]), "band")


def local_rows(banded: DataFrame, lk: Lookups, params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Band converted to the proposal currency (rate looked up as is)."""
    return to_local(banded, lk.rates, lk.rates_fit, "currency_code",
                    {"HighPriceUSD": "HighPrice", "LowPriceUSD": "LowPrice",
                     "Strand2PriceUSD": "Strand2Price"}, params.direction)


def split_conditions(conditions, made: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """Conditions on the finished quote that read only columns which pass through the
    plan as they are, and the others: those in whose text a name of ``made`` stands."""
    before, after = [], []
    names = re.compile("|".join(rf"\b{re.escape(m)}\b" for m in made), re.IGNORECASE)
    for c in conditions:
        (after if names.search(str(c)) else before).append(F.expr(c) if isinstance(c, str) else c)
    return before, after


def quote(flat: DataFrame, lookups: Lookups, scorers: Mapping[str, object],
          params: QuoteParams = DEFAULT_PARAMS, extra_columns=("fieldwork_company",), where=()) -> DataFrame:
    """End to end: one output row per audience and fieldwork company (one
    row with NULL prices when the audience country has no company).

    ``where`` are conditions (SQL texts or Columns, all must hold) on the finished
    quote. The stage markers keep Catalyst from moving a filter on the result below
    them, so those that read only columns passed through are applied to the flat
    rows, from where they reach the scans; the others filter the result. The batch's
    country counts stay those of all rows."""
    before, after = split_conditions(where, ("HighPrice", "LowPrice", "Strand2Price", "fieldwork_company"))
    whole = flat
    for c in before:
        flat = flat.where(c)
    keep = [c for c in extra_columns if c in flat.columns]
    scored = scored_rows(flat, scorers, params, keep, whole if before else None)
    rows = local_rows(band_rows(priced_rows(scored, lookups, params), params), lookups, params)
    cols = [F.col(c) for c in OUTPUT_COLUMNS]
    if params.output_scale is not None:
        cols = [F.bround(F.col(c), params.output_scale).alias(c)
                if c in ("HighPrice", "LowPrice", "Strand2Price") else F.col(c) for c in OUTPUT_COLUMNS]
    out = rows.select(*cols, *extra_columns)
    for c in after:
        out = out.where(c)
    return out
