"""Schemas and column-name maps of requests, lookups and intermediate frames."""

from __future__ import annotations

from pyspark.sql import types as T

# Nested pricing request: proposal -> countries -> audiences. A proposal too large
# for one document comes in ``page_count`` pages; ``country_audiences`` counts a
# country's audiences over all of them. Both are NULL in documents of others.
REQUEST_DDL = (
    "proposal_id bigint, proposal_uuid string, proposal_name string, revision_number int, "
    "pricing_formula string, brand string, proposed_fieldwork_length int, "
    "fieldwork_start_date string, fieldwork_end_date string, service_type string, "
    "project_type string, rush_job boolean, proposal_strategic_index int, "
    "competitive_intensity_index int, currency_code string, total_price double, "
    "total_costs struct<incentives:double,panel_partner:double,labor:double,"
    "translations:double,other:double,panel_investment:double>, "
    "account struct<account_uuid:string,account_name:string,client_strategic_index:int,"
    "client_segment:string,country_code:string,company_number:string,"
    "maconomy_number:string,preferred_currency:string>, "
    "page_no int, page_count int, "
    "countries array<struct<country_code:string,country_audiences:bigint,audiences:array<struct<audience_uuid:string,"
    "audience_name:string,completes:int,incidence_rate:int,length_of_interview:int,"
    "panel_source:string,panelist_type:string,sampling_complexity:string,"
    "audience_complexity_index:int,waves:int>>>>"
)

# Top-level proposal scalars, in request order.
PROPOSAL_FIELDS = (
    "proposal_id", "proposal_uuid", "proposal_name", "revision_number",
    "pricing_formula", "brand", "proposed_fieldwork_length",
    "fieldwork_start_date", "fieldwork_end_date", "service_type",
    "project_type", "rush_job", "proposal_strategic_index",
    "competitive_intensity_index", "currency_code", "total_price",
)

# --- Fixed values: flat column names of nested request fields ----------------
COST_RENAMES = {
    "incentives": "incentives_costs",
    "panel_partner": "panel_partner_costs",
    "labor": "labor_costs",
    "translations": "translations_costs",
    "other": "other_costs",
    "panel_investment": "panel_investment_costs",
}
ACCOUNT_RENAMES = {
    "account_uuid": "account_uuid",
    "account_name": "account_name",
    "client_strategic_index": "client_strategic_index",
    "client_segment": "client_segment",
    "country_code": "account_country_code",
    "company_number": "account_company_number",
    "maconomy_number": "account_maconomy_number",
    "preferred_currency": "account_preferred_currency",
}
COUNTRY_RENAMES = {"country_code": "proposal_country_code"}
AUDIENCE_RENAMES = {
    "audience_uuid": "audience_uuid",
    "audience_name": "audience_name",
    "completes": "audience_completes",
    "incidence_rate": "audience_incidence_rate",
    "length_of_interview": "audience_length_of_interview",
    "panel_source": "audience_panel_source",
    "panelist_type": "audience_panelist_type",
    "sampling_complexity": "audience_sampling_complexity",
    "audience_complexity_index": "audience_complexity_index",
    "waves": "audience_waves",
}
# Feature frame handed to the response scorers: source column -> feature name.
FEATURE_RENAMES = {
    "proposal_country_code": "AudienceCountryA3",
    "account_company_number": "AccountingCompanyNum",
    "client_segment": "GlobalClientSegment",
    "service_type": "OptionServiceType",
    "audience_panelist_type": "feaAudiencePanelistType",
    "audience_sampling_complexity": "fea_SugarSamplingComplexity_v2",
    "audience_length_of_interview": "SoldLOI",
    "proposed_fieldwork_length": "feaFieldworkLength",
    "audience_waves": "feaAudienceWaves",
    "audience_completes": "PrmReqCompletes",
    "audience_incidence_rate": "PrmWeightedIR_1",
    "account_country_code": "account_country_code",
}
# Price-factor key columns, in key order: company, brand, product, country,
# LOI bucket, client segment, client.
FACTOR_KEYS = ("RegionID", "BrandID", "ProductID", "CountryID", "LOI", "Client_Segment", "Client")
# Numeric price-factor columns (stored as text).
FACTOR_NUMERIC = (
    "Low_IR_Used", "Mid_IR_Used", "High_IR_Used",
    "Low_IR_Anchor", "Mid_IR_Anchor", "High_IR_Anchor",
    "xFactor_Low_IR", "xFactor_Mid_IR", "xFactor_High_IR",
    "Low_IR_Step", "Mid_IR_Step", "High_IR_Step",
    "Break1", "Break2", "Break3", "Break4", "Break5", "Break6",
)
FACTOR_CURRENCY = "Rate_Currency"
# Final quote record.
OUTPUT_COLUMNS = (
    "proposal_id", "proposal_uuid", "revision_number", "proposal_country_code",
    "audience_uuid", "currency_code", "HighPrice", "LowPrice", "Strand2Price",
)
# -----------------------------------------------------------------------------

# Flat request row after flattening, in order.
FLAT_REQUEST_COLUMNS = (
    tuple(f for f in PROPOSAL_FIELDS)
    + tuple(COST_RENAMES.values())
    + tuple(ACCOUNT_RENAMES.values())
    + tuple(COUNTRY_RENAMES.values())
    + tuple(AUDIENCE_RENAMES.values())
)


def all_string_schema(columns) -> T.StructType:
    """Schema for a header CSV read with every column as text."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


PRICE_FACTORS_SCHEMA = all_string_schema(FACTOR_KEYS + FACTOR_NUMERIC + (FACTOR_CURRENCY,))
RATES_SCHEMA = all_string_schema(("From_Currency", "month", "Rate"))
COMMISSION_SCHEMA = all_string_schema(("Audience_Country_A3", "Company"))
