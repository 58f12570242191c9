"""Quoting inputs derived from the driver's TPC-style tables.

The pricing pipeline needs a flat audience frame and three lookup tables
(commission, currency rates, price factors). These functions derive them from
``lineitem``/``orders``/``customer``/``supplier``/``part``/``nation``/``region``
so that every query's work grows with the data. ``plans/oracles.py`` holds the
same definitions as DuckDB SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.broadcast import bounded_broadcast, fits_broadcast
from .tables import Tables, spread

# --- Fixed values of the fixtures ------------------------------------------------
EXCLUDED_FIELDWORK_COUNTRY = "NATION_7"      # no commission row: audiences stay unpriced
MISSING_FACTOR_BRAND = "Brand#5"             # with PROMO: no price-factor row
MISSING_FACTOR_TYPE = "PROMO"
LOI_BUCKETS = (5, 60, 5)                     # start, stop, step of the factor grid
RATE_FOLD_DAY = dt.date(2001, 6, 1)          # later orders fold into this month
JPY_LAST_MONTH = "2000-12"                   # later JPY rates are not published
#: Suppliers, and orders with their customers, that are broadcast at most; more are
#: joined by a shuffle.
MAX_BROADCAST_SUPPLIERS = 500_000
MAX_BROADCAST_ORDERS = 20_000
# -------------------------------------------------------------------------------


def _nation(t: Tables) -> DataFrame:
    return bounded_broadcast(t.nation.select("n_nationkey", "n_name", "n_regionkey"),
                             10_000, label="nation")


def fx_commission(t: Tables) -> DataFrame:
    """Fieldwork company per audience country: the region of each country that
    hosts a supplier; countries with key ending in 3 also get the next region
    (fan-out); NATION_7 has none (unpriced audiences)."""
    hosts = t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    sn = hosts.join(_nation(t), "n_nationkey").where(F.col("n_name") != EXCLUDED_FIELDWORK_COUNTRY)
    region = F.col("n_regionkey")
    companies = F.when(F.col("n_nationkey") % 10 == 3,
                       F.array(region, (region + 1) % 5)).otherwise(F.array(region))
    return (sn.select(F.col("n_name").alias("Audience_Country_A3"),
                      F.explode(companies.cast("array<string>")).alias("Company"))
            .distinct())


def _currency_of_priority(priority: Column) -> Column:
    return (F.when(priority == "1-URGENT", "USD").when(priority == "2-HIGH", "EUR")
            .when(priority == "3-MEDIUM", "GBP").otherwise("JPY"))


def fx_rates(t: Tables) -> DataFrame:
    """Monthly currency-to-USD rates as text (From_Currency, month, Rate),
    one row per currency and month seen in ``orders``. JPY has no rate in the
    latest month, so JPY-priced quotes get no USD price."""
    counts = (t.orders
              .groupBy(_currency_of_priority(F.col("o_orderpriority")).alias("From_Currency"),
                       F.date_format(F.least(F.to_date("o_orderdate"), F.lit(RATE_FOLD_DAY)), "yyyy-MM").alias("month"))
              .agg(F.count(F.lit(1)).alias("n"))
              .where((F.col("From_Currency") != "JPY") | (F.col("month") <= JPY_LAST_MONTH)))
    cur, n = F.col("From_Currency"), F.col("n")
    units = (F.when(cur == "USD", F.lit(10000)).when(cur == "EUR", 10500 + n % 97)
             .when(cur == "GBP", 12500 + n % 89).otherwise(77 + n % 5))
    rate = F.concat((units / 10000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((units % 10000).cast("string"), 4, "0"))
    return counts.select("From_Currency", "month", rate.alias("Rate"))


def fx_price_factors(t: Tables) -> DataFrame:
    """Price factors as text: every region x (brand, type) pair x LOI bucket.
    The pairs with brand Brand#5 and type PROMO have no row."""
    pairs = (t.part
             .where((F.col("p_type") != MISSING_FACTOR_TYPE) | (F.col("p_brand") != MISSING_FACTOR_BRAND))
             .select("p_brand", "p_type").distinct()
             .withColumn("bi", F.substring("p_brand", 7, 16).try_cast("int")))
    region_keys = t.region.select(F.collect_list("r_regionkey")).scalar()
    start, stop, step = LOI_BUCKETS
    grid = (pairs.select("*", F.explode(region_keys).alias("rk"))
            .select("*", F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).alias("loi")))
    return grid.selectExpr(
        "CAST(rk AS STRING) AS RegionID", "p_brand AS BrandID", "p_type AS ProductID",
        "'(All)' AS CountryID", "CAST(loi AS STRING) AS LOI",
        "'(All)' AS Client_Segment", "'(All)' AS Client",
        "'0.2' AS Low_IR_Used", "'0.5' AS Mid_IR_Used", "'0.8' AS High_IR_Used",
        "CAST(10 + bi + loi AS STRING) AS Low_IR_Anchor", "CAST(8 + bi + loi AS STRING) AS Mid_IR_Anchor",
        "CAST(5 + bi + loi AS STRING) AS High_IR_Anchor",
        "'0.9' AS xFactor_Low_IR", "'0.8' AS xFactor_Mid_IR", "'0.7' AS xFactor_High_IR",
        "'0.05' AS Low_IR_Step", "'0.05' AS Mid_IR_Step", "'0.1' AS High_IR_Step",
        "CASE WHEN bi % 2 = 0 THEN '2' ELSE '0.75' END AS Break1",
        "'0.6' AS Break2", "'0.4' AS Break3", "'0.3' AS Break4", "'0.1' AS Break5", "'0.05' AS Break6",
        "CASE WHEN rk = 0 THEN 'usd' WHEN rk = 1 THEN 'EUR' WHEN rk = 2 THEN 'gbp' "
        "WHEN rk = 3 THEN 'eur' ELSE 'jpy' END AS Rate_Currency",
    )


def fx_audience(t: Tables) -> DataFrame:
    """One flat request row per line item: proposal = order, account =
    customer (and its nation), audience country = supplier's nation,
    brand/product = part. Row key: (proposal_id, audience_no, part_no,
    supp_no, ship_day, total_price)."""
    nation = _nation(t)
    ac = nation.select(F.col("n_nationkey").alias("ac_key"), F.col("n_name").alias("ac_name"),
                       F.col("n_regionkey").alias("ac_region"))
    fw = nation.select(F.col("n_nationkey").alias("fw_key"), F.col("n_name").alias("fw_name"))
    # Orders meet their customer before they meet the lines, which thus move once for
    # the parts, with a few numbers each, and once for the orders, and then lie by order.
    orders = t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).join(ac, F.expr("c_nationkey = ac_key"))
    if fits_broadcast(t.orders.select("o_orderkey"), MAX_BROADCAST_ORDERS):
        orders = F.broadcast(orders)
    suppliers = t.supplier.select("s_suppkey", "s_name", "s_nationkey").join(fw, F.expr("s_nationkey = fw_key"))
    lines = spread(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    j = lines.join(t.part, F.expr("l_partkey = p_partkey"))
    of_order, of_supplier = F.expr("l_orderkey = o_orderkey"), F.expr("l_suppkey = s_suppkey")
    if fits_broadcast(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), MAX_BROADCAST_SUPPLIERS):
        j = j.join(orders, of_order).join(F.broadcast(suppliers), of_supplier)
    else:
        j = j.join(suppliers, of_supplier).join(orders, of_order)
    return j.selectExpr(*AUDIENCE_COLUMNS)


# Flat request row per line item, as SQL expressions (one call into the JVM).
# Proposal fields come from the order and its customer only, so an order is one
# document with the countries and audiences of its lines.
AUDIENCE_COLUMNS = (
    "l_orderkey AS proposal_id",
    "concat('P-', CAST(l_orderkey AS STRING)) AS proposal_uuid",
    "concat('Proposal ', CAST(l_orderkey AS STRING)) AS proposal_name",
    "CAST(1 + o_orderkey % 3 AS INT) AS revision_number",
    "date_format(o_orderdate, 'yyyy-MM') AS pricing_formula",
    "concat('Brand#', CAST(1 + o_custkey % 25 AS STRING)) AS brand",
    "CAST(5 + o_custkey % 26 AS INT) AS proposed_fieldwork_length",
    "date_format(o_orderdate, 'MM/dd/yyyy') AS fieldwork_start_date",
    "date_format(date_add(o_orderdate, 30), 'MM/dd/yyyy') AS fieldwork_end_date",
    "o_orderpriority AS service_type",
    "CASE o_orderkey % 6 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'PROMO' WHEN 2 THEN 'ECONOMY' WHEN 3 THEN 'STANDARD' "
    "WHEN 4 THEN 'LARGE' ELSE 'SMALL' END AS project_type",
    "o_orderpriority = '1-URGENT' AS rush_job",
    "CAST(1 + o_orderkey % 5 AS INT) AS proposal_strategic_index",
    "CAST(1 + o_custkey % 5 AS INT) AS competitive_intensity_index",
    "CASE WHEN o_orderstatus = 'F' THEN 'USD' WHEN o_orderstatus = 'O' THEN 'EUR' ELSE 'JPY' END AS currency_code",
    "o_totalprice AS total_price",
    "CAST(o_orderkey % 10 AS DOUBLE) * 1.5D AS incentives_costs",
    "CAST(o_custkey % 8 AS DOUBLE) AS panel_partner_costs",
    "CAST(o_orderkey % 50 AS DOUBLE) AS labor_costs",
    "0.0D AS translations_costs",
    "0.0D AS other_costs",
    "CAST(o_custkey % 100 AS DOUBLE) AS panel_investment_costs",
    "concat('C-', CAST(c_custkey AS STRING)) AS account_uuid",
    "c_name AS account_name",
    "CAST(1 + c_nationkey % 5 AS INT) AS client_strategic_index",
    "c_mktsegment AS client_segment",
    "ac_name AS account_country_code",
    "CAST(ac_region AS STRING) AS account_company_number",
    "CAST(c_custkey AS STRING) AS account_maconomy_number",
    "CASE WHEN c_acctbal < 0 THEN 'EUR' ELSE 'USD' END AS account_preferred_currency",
    "fw_name AS proposal_country_code",
    "concat_ws('-', 'A', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
    "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS audience_uuid",
    "concat('Line ', CAST(l_linenumber AS STRING)) AS audience_name",
    "l_linenumber * 100 AS audience_completes",
    "CAST(l_quantity * 2 AS INT) AS audience_incidence_rate",
    "p_size AS audience_length_of_interview",
    "s_name AS audience_panel_source",
    "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'B2B' ELSE 'Consumer' END AS audience_panelist_type",
    "CASE WHEN p_size < 15 THEN 'Low' WHEN p_size < 35 THEN 'Medium' ELSE 'High' END AS audience_sampling_complexity",
    "CAST(1 + l_partkey % 5 AS INT) AS audience_complexity_index",
    "CAST(1 + l_suppkey % 4 AS INT) AS audience_waves",
    "l_linenumber AS audience_no",
    "l_partkey AS part_no",
    "l_suppkey AS supp_no",
    "to_date(l_shipdate) AS ship_day",
)


# Proposals that hold all audiences of an account country (hundreds to thousands of
# them each): the proposal's and the account's fields as SQL expressions of that country.
COUNTRY_PROPOSAL = {
    "proposal_id": "CAST(substring(account_country_code, 8, 9) AS BIGINT)",
    "proposal_uuid": "concat('P-', account_country_code)",
    "proposal_name": "concat('All of ', account_country_code)",
    "revision_number": "CAST(1 AS INT)",
    "pricing_formula": "'2000-01'",
    "brand": "concat('Brand#', substring(account_country_code, 8, 9))",
    "proposed_fieldwork_length": "CAST(10 AS INT)",
    "fieldwork_start_date": "'01/01/2000'",
    "fieldwork_end_date": "'02/01/2000'",
    "service_type": "CAST(NULL AS STRING)",
    "project_type": "'PROMO'",
    "rush_job": "account_company_number = '1'",
    "proposal_strategic_index": "CAST(3 AS INT)",
    "competitive_intensity_index": "CAST(4 AS INT)",
    "currency_code": "'EUR'",
    "total_price": "CAST(1000.5 AS DOUBLE)",
    "incentives_costs": "CAST(1.5 AS DOUBLE)",
    "panel_partner_costs": "CAST(0 AS DOUBLE)",
    "labor_costs": "CAST(0 AS DOUBLE)",
    "translations_costs": "CAST(0 AS DOUBLE)",
    "other_costs": "CAST(0 AS DOUBLE)",
    "panel_investment_costs": "CAST(0 AS DOUBLE)",
    "account_uuid": "concat('C-', account_country_code)",
    "account_name": "concat('Accounts of \"', account_country_code, '\"')",
    "client_strategic_index": "CAST(NULL AS INT)",
    "client_segment": "'(All)'",
    "account_maconomy_number": "'0'",
    "account_preferred_currency": "'USD'",
}


def fx_country_proposals(t: Tables) -> DataFrame:
    """The flat request rows with one proposal for each account country."""
    a = fx_audience(t)
    return a.selectExpr(*[f"{COUNTRY_PROPOSAL[c]} AS {c}" if c in COUNTRY_PROPOSAL else c for c in a.columns])


ROW_KEY = ("proposal_id", "audience_no", "part_no", "supp_no", "ship_day", "total_price")
