"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver registers the parquet tables as views; these statements rebuild
the fixtures (same definitions as ``sources/fixtures.py``) as CTEs and then
compute each query in plain SQL. Literals are cast to DOUBLE so DuckDB does
not fall back to DECIMAL arithmetic; integer casts truncate explicitly.
"""

from __future__ import annotations

from ..params import DEFAULT_PARAMS, QuoteParams

D = "DOUBLE"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# --- fixtures ---------------------------------------------------------------
FIXTURE_CTES = f"""
fx_commission AS (
  SELECT DISTINCT Audience_Country_A3, Company FROM (
    SELECT n_name AS Audience_Country_A3,
           unnest(CASE WHEN n_nationkey % 10 = 3
                       THEN [CAST(n_regionkey AS VARCHAR), CAST((n_regionkey + 1) % 5 AS VARCHAR)]
                       ELSE [CAST(n_regionkey AS VARCHAR)] END) AS Company
    FROM nation
    WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_name <> 'NATION_7')),
fx_rate_counts AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR'
              WHEN '3-MEDIUM' THEN 'GBP' ELSE 'JPY' END AS From_Currency,
         strftime(least(CAST(o_orderdate AS DATE), DATE '2001-06-01'), '%Y-%m') AS month,
         count(*) AS n
  FROM orders GROUP BY ALL),
fx_rates AS (
  SELECT From_Currency, month,
         CAST(units // 10000 AS VARCHAR) || '.' || lpad(CAST(units % 10000 AS VARCHAR), 4, '0') AS Rate
  FROM (SELECT From_Currency, month,
               CASE From_Currency WHEN 'USD' THEN 10000 WHEN 'EUR' THEN 10500 + n % 97
                    WHEN 'GBP' THEN 12500 + n % 89 ELSE 77 + n % 5 END AS units
        FROM fx_rate_counts WHERE From_Currency <> 'JPY' OR month <= '2000-12')),
fx_pairs AS (
  SELECT DISTINCT p_brand, p_type, TRY_CAST(substring(p_brand, 7, 16) AS INTEGER) AS bi
  FROM part WHERE p_type <> 'PROMO' OR p_brand <> 'Brand#5'),
fx_grid AS (
  SELECT p_brand, p_type, bi, rk, unnest(generate_series(5, 60, 5)) AS loi
  FROM (SELECT p_brand, p_type, bi, unnest((SELECT list(r_regionkey) FROM region)) AS rk FROM fx_pairs)),
fx_price_factors AS (
  SELECT CAST(rk AS VARCHAR) AS RegionID, p_brand AS BrandID, p_type AS ProductID,
         '(All)' AS CountryID, CAST(loi AS VARCHAR) AS LOI, '(All)' AS Client_Segment, '(All)' AS Client,
         '0.2' AS Low_IR_Used, '0.5' AS Mid_IR_Used, '0.8' AS High_IR_Used,
         CAST(10 + bi + loi AS VARCHAR) AS Low_IR_Anchor, CAST(8 + bi + loi AS VARCHAR) AS Mid_IR_Anchor,
         CAST(5 + bi + loi AS VARCHAR) AS High_IR_Anchor,
         '0.9' AS xFactor_Low_IR, '0.8' AS xFactor_Mid_IR, '0.7' AS xFactor_High_IR,
         '0.05' AS Low_IR_Step, '0.05' AS Mid_IR_Step, '0.1' AS High_IR_Step,
         CASE WHEN bi % 2 = 0 THEN '2' ELSE '0.75' END AS Break1,
         '0.6' AS Break2, '0.4' AS Break3, '0.3' AS Break4, '0.1' AS Break5, '0.05' AS Break6,
         CASE rk WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN 'gbp' WHEN 3 THEN 'eur' ELSE 'jpy' END
           AS Rate_Currency
  FROM fx_grid),
fx_audience AS (
  SELECT l_orderkey AS proposal_id,
         'P-' || CAST(l_orderkey AS VARCHAR) AS proposal_uuid,
         'Proposal ' || CAST(l_orderkey AS VARCHAR) AS proposal_name,
         CAST(1 + o_orderkey % 3 AS INTEGER) AS revision_number,
         strftime(o_orderdate, '%Y-%m') AS pricing_formula,
         'Brand#' || CAST(1 + o_custkey % 25 AS VARCHAR) AS brand,
         CAST(5 + o_custkey % 26 AS INTEGER) AS proposed_fieldwork_length,
         strftime(o_orderdate, '%m/%d/%Y') AS fieldwork_start_date,
         strftime(CAST(o_orderdate AS DATE) + 30, '%m/%d/%Y') AS fieldwork_end_date,
         o_orderpriority AS service_type,
         CASE o_orderkey % 6 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'PROMO' WHEN 2 THEN 'ECONOMY' WHEN 3 THEN 'STANDARD'
              WHEN 4 THEN 'LARGE' ELSE 'SMALL' END AS project_type,
         o_orderpriority = '1-URGENT' AS rush_job,
         CAST(1 + o_orderkey % 5 AS INTEGER) AS proposal_strategic_index,
         CAST(1 + o_custkey % 5 AS INTEGER) AS competitive_intensity_index,
         CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'EUR' ELSE 'JPY' END AS currency_code,
         o_totalprice AS total_price,
         CAST(o_orderkey % 10 AS DOUBLE) * {dbl(1.5)} AS incentives_costs,
         CAST(o_custkey % 8 AS DOUBLE) AS panel_partner_costs,
         CAST(o_orderkey % 50 AS DOUBLE) AS labor_costs,
         {dbl(0)} AS translations_costs,
         {dbl(0)} AS other_costs,
         CAST(o_custkey % 100 AS DOUBLE) AS panel_investment_costs,
         'C-' || CAST(c_custkey AS VARCHAR) AS account_uuid,
         c_name AS account_name,
         CAST(1 + c_nationkey % 5 AS INTEGER) AS client_strategic_index,
         c_mktsegment AS client_segment,
         ac.n_name AS account_country_code,
         CAST(ac.n_regionkey AS VARCHAR) AS account_company_number,
         CAST(c_custkey AS VARCHAR) AS account_maconomy_number,
         CASE WHEN c_acctbal < 0 THEN 'EUR' ELSE 'USD' END AS account_preferred_currency,
         fw.n_name AS proposal_country_code,
         concat_ws('-', 'A', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS audience_uuid,
         'Line ' || CAST(l_linenumber AS VARCHAR) AS audience_name,
         CAST(l_linenumber * 100 AS INTEGER) AS audience_completes,
         CAST(l_quantity * 2 AS INTEGER) AS audience_incidence_rate,
         p_size AS audience_length_of_interview,
         s_name AS audience_panel_source,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'B2B' ELSE 'Consumer' END
           AS audience_panelist_type,
         CASE WHEN p_size < 15 THEN 'Low' WHEN p_size < 35 THEN 'Medium' ELSE 'High' END
           AS audience_sampling_complexity,
         CAST(1 + l_partkey % 5 AS INTEGER) AS audience_complexity_index,
         CAST(1 + l_suppkey % 4 AS INTEGER) AS audience_waves,
         l_linenumber AS audience_no, l_partkey AS part_no, l_suppkey AS supp_no,
         CAST(l_shipdate AS DATE) AS ship_day
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ac ON c_nationkey = ac.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation fw ON s_nationkey = fw.n_nationkey
  JOIN part ON l_partkey = p_partkey)"""

FACTOR_NUMERIC = (
    "Low_IR_Used", "Mid_IR_Used", "High_IR_Used",
    "Low_IR_Anchor", "Mid_IR_Anchor", "High_IR_Anchor",
    "xFactor_Low_IR", "xFactor_Mid_IR", "xFactor_High_IR",
    "Low_IR_Step", "Mid_IR_Step", "High_IR_Step",
    "Break1", "Break2", "Break3", "Break4", "Break5", "Break6",
)
FACTOR_KEYS = ("RegionID", "BrandID", "ProductID", "CountryID", "LOI", "Client_Segment", "Client")

KEY = "proposal_id, audience_no, part_no, supp_no"


def nan_null(e: str) -> str:
    return f"(CASE WHEN isnan({e}) THEN NULL ELSE {e} END)"


def trunc_int(e: str, t: str = "INTEGER") -> str:
    return f"TRY_CAST(trunc({e}) AS {t})"


def pf_cte() -> str:
    nums = ",\n  ".join(f"{nan_null(f'TRY_CAST({c} AS DOUBLE)')} AS {c}" for c in FACTOR_NUMERIC)
    keys = ", ".join(FACTOR_KEYS)
    return f"pf AS (SELECT {keys},\n  {nums},\n  Rate_Currency FROM fx_price_factors)"


def latest_rates_cte(until: str = "9999-99") -> str:
    return f"""latest_rates AS (
  SELECT From_Currency, month, {nan_null('TRY_CAST(Rate AS DOUBLE)')} AS Rate FROM fx_rates
  WHERE month IN (SELECT max(month) FROM fx_rates WHERE month <= '{until}'))"""


LATEST_RATES_CTE = latest_rates_cte()


def feat_cte(scope: str | None = "batch") -> str:
    if scope == "batch":
        cnt = ("CASE WHEN proposal_country_code IS NULL THEN NULL ELSE "
               "count(proposal_country_code) OVER (PARTITION BY proposal_country_code) END")
    else:
        cnt = "CAST(NULL AS BIGINT)"
    return f"""feat AS (
  SELECT *, proposal_country_code AS AudienceCountryA3, account_company_number AS AccountingCompanyNum,
         client_segment AS GlobalClientSegment, service_type AS OptionServiceType,
         audience_panelist_type AS feaAudiencePanelistType,
         audience_sampling_complexity AS fea_SugarSamplingComplexity_v2,
         audience_length_of_interview AS SoldLOI, proposed_fieldwork_length AS feaFieldworkLength,
         audience_waves AS feaAudienceWaves, audience_completes AS PrmReqCompletes,
         audience_incidence_rate AS PrmWeightedIR_1,
         {cnt} AS feaNumberOfAudienceCountryA3,
         CAST(coalesce(proposal_country_code = account_country_code, false) AS INTEGER)
           AS feaAudienceCountryIsAccountCountry
  FROM fx_audience)"""


RAW_SCORES = {
    "ir": f"PrmWeightedIR_1 * {dbl(1.5)} - {dbl(10.0)}",
    "cr": f"feaAudienceWaves * {dbl(0.05)} + feaAudienceCountryIsAccountCountry * {dbl(0.1)}",
    "loi": f"SoldLOI * {dbl(3.0)} - {dbl(5.0)}",
}


def cast_cte(own: dict[str, str] | None = None) -> str:
    raw = {**RAW_SCORES, **(own or {})}
    return f"""casted AS (
  SELECT *, {trunc_int(f'CAST(({raw["ir"]}) AS DOUBLE)')} AS Athena_IR_raw,
         {trunc_int(f'CAST(({raw["cr"]}) AS DOUBLE) * {dbl(100)}')} AS Athena_CR,
         {trunc_int(f'CAST(({raw["loi"]}) AS DOUBLE)')} AS Athena_LOI_raw
  FROM feat)"""


def score_model_sql(keys: str, loi_cuts) -> str:
    """The models of the ``score_model`` query, fitted and applied in SQL."""
    def step(feature, cuts):
        return "CASE " + " ".join(f"WHEN {feature} <= {c} THEN {i}" for i, c in enumerate(cuts)) + f" ELSE {len(cuts)} END"
    cr, loi = step("feaAudienceWaves", (1, 2, 3)), step("SoldLOI", loi_cuts)
    return pipeline_sql(DEFAULT_PARAMS, "casted") + f""",
sums AS (SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(SoldLOI) AS HUGEINT) AS sx, CAST(sum(PrmWeightedIR_1) AS HUGEINT) AS sy,
                CAST(sum(SoldLOI * SoldLOI) AS HUGEINT) AS sxx, CAST(sum(SoldLOI * PrmWeightedIR_1) AS HUGEINT) AS sxy FROM feat),
line AS (SELECT CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) AS slope,
                CAST(sy * sxx - sx * sxy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) AS intercept FROM sums),
waves AS (SELECT {cr} AS s, CAST(sum(PrmReqCompletes) AS DOUBLE) / count(*) AS mean FROM feat GROUP BY 1),
lengths AS (SELECT {loi} AS s, CAST(sum(SoldLOI) AS DOUBLE) / count(*) AS mean FROM feat GROUP BY 1),
fitted AS (SELECT feat.*, intercept + slope * SoldLOI AS ir_score, waves.mean / 1000 AS cr_score, lengths.mean AS loi_score
           FROM feat, line JOIN waves ON waves.s = {cr} JOIN lengths ON lengths.s = {loi})
SELECT {keys}, ir_score, cr_score, loi_score, {trunc_int('ir_score')} AS Athena_IR,
       {trunc_int('cr_score * 100')} AS Athena_CR, {trunc_int('loi_score')} AS Athena_LOI FROM fitted"""


def clamp(e: str, low, high) -> str:
    return f"(CASE WHEN {e} <= {low} THEN {low} WHEN {e} >= {high} THEN {high} ELSE {e} END)"


def scored_cte(p: QuoteParams) -> str:
    return f"""scored AS (
  SELECT *, {clamp('Athena_IR_raw', max(2, p.min_ir), p.max_ir)} AS Athena_IR,
         {clamp('Athena_LOI_raw', p.min_loi, p.max_loi)} AS Athena_LOI
  FROM casted)"""


def loi_bucket(e: str, p: QuoteParams = DEFAULT_PARAMS) -> str:
    stepped = (f"(CASE WHEN ({e}) % {p.loi_step} = 0 THEN {trunc_int(e, 'BIGINT')} "
               f"ELSE {trunc_int(f'({e}) / {dbl(p.loi_step)} + 1', 'BIGINT')} * {p.loi_step} END)")
    return f"CAST(CASE WHEN {stepped} > {p.loi_cap} THEN {p.loi_cap} ELSE {stepped} END AS INTEGER)"


def pin_cte(p: QuoteParams) -> str:
    if p.binding == "reference":
        ml, mi = "CAST(Athena_IR AS DOUBLE) / 100", "CAST(Athena_LOI AS DOUBLE)"
        sl, si = "CAST(audience_incidence_rate AS DOUBLE) / 100", "CAST(audience_length_of_interview AS DOUBLE)"
    else:
        ml, mi = "CAST(Athena_LOI AS DOUBLE)", "CAST(Athena_IR AS DOUBLE) / 100"
        sl, si = "CAST(audience_length_of_interview AS DOUBLE)", "CAST(audience_incidence_rate AS DOUBLE) / 100"
    d = p.defaults
    return f"""pin0 AS (
  SELECT *, account_company_number AS company, project_type AS product,
         '{d["country"]}' AS country, '{d["segment"]}' AS segment, '{d["client"]}' AS client,
         '{d["srcSystem"]}' AS srcSystem,
         {ml} AS modelled_loi, {mi} AS modelled_jobIr, {sl} AS sold_loi, {si} AS sold_jobIr
  FROM scored),
pin AS (
  SELECT *, {loi_bucket('modelled_loi', p)} AS modelled_bucket, {loi_bucket('sold_loi', p)} AS sold_bucket
  FROM pin0)"""


def join_on(alias: str, company: str, bucket: str, left: str = "pin") -> str:
    """LEFT JOIN of the price factors on the 7-part key (row columns are
    qualified: DuckDB names are case-insensitive, so ``client`` would clash
    with the factor column ``Client``)."""
    return (f"LEFT JOIN pf {alias} ON {alias}.RegionID = {left}.{company} AND {alias}.BrandID = {left}.brand "
            f"AND {alias}.ProductID = {left}.product AND {alias}.CountryID = {left}.country "
            f"AND {alias}.LOI = CAST({left}.{bucket} AS VARCHAR) AND {alias}.Client_Segment = {left}.segment "
            f"AND {alias}.Client = {left}.client")


def quote_exprs(f: str, j: str, bucket: str, prefix: str, p: QuoteParams) -> list[str]:
    hit = f"{f}.RegionID IS NOT NULL"

    def pick(h, m, low):
        return (f"(CASE WHEN {j} > {f}.Mid_IR_Used THEN {f}.{h} WHEN {j} > {f}.Low_IR_Used "
                f"THEN {f}.{m} ELSE {f}.{low} END)")

    used = pick("High_IR_Used", "Mid_IR_Used", "Low_IR_Used")
    anchor = pick("High_IR_Anchor", "Mid_IR_Anchor", "Low_IR_Anchor")
    xf = pick("xFactor_High_IR", "xFactor_Mid_IR", "xFactor_Low_IR")
    step = pick("High_IR_Step", "Mid_IR_Step", "Low_IR_Step")
    brk = f"(CASE WHEN {f}.Break1 > 1 THEN {j} " + " ".join(
        f"WHEN {f}.Break{i} < {j} THEN {f}.Break{i}" for i in range(1, 6)) + f" ELSE {j} END)"

    def factor(x):
        steps = trunc_int(f"{x} / nullif({step}, 0) + 1", "BIGINT")
        return f"({dbl(1)} / nullif({steps}, 0))"

    price = nan_null(f"pow({factor(brk)} / nullif({factor(used)}, 0), {xf}) * {anchor}")
    cpi = f"round_even({price}, {p.cpi_scale})"
    return [
        f"CASE WHEN {hit} THEN {cpi} END AS {prefix}_cpi",
        f"CASE WHEN {hit} THEN {brk} END AS {prefix}_ir_used",
        f"CASE WHEN {hit} THEN {bucket} END AS {prefix}_loi_used",
        f"CASE WHEN {hit} THEN {f}.Rate_Currency END AS {prefix}_currency",
        f"CASE WHEN NOT ({hit}) THEN 'missing_factor' WHEN {cpi} IS NULL THEN 'invalid_factor' "
        f"ELSE 'ok' END AS {prefix}_status",
    ]


def priced_ctes(p: QuoteParams, commission_how: str = "LEFT") -> str:
    acc = (quote_exprs("fam", "modelled_jobIr", "modelled_bucket", "acc_mod", p)
           + quote_exprs("fas", "sold_jobIr", "sold_bucket", "acc_sold", p))
    fw = (quote_exprs("ffm", "modelled_jobIr", "modelled_bucket", "fw_mod", p)
          + quote_exprs("ffs", "sold_jobIr", "sold_bucket", "fw_sold", p))
    return f"""acc AS (
  SELECT pin.*, {", ".join(acc)}
  FROM pin {join_on("fam", "company", "modelled_bucket")} {join_on("fas", "company", "sold_bucket")}),
fwc AS (
  SELECT acc.*, c.Company AS fieldwork_company FROM acc
  {commission_how} JOIN fx_commission c ON proposal_country_code = c.Audience_Country_A3),
four AS (
  SELECT fwc.*, {", ".join(fw)}
  FROM fwc {join_on("ffm", "fieldwork_company", "modelled_bucket", "fwc")}
  {join_on("ffs", "fieldwork_company", "sold_bucket", "fwc")}),
usd AS (
  SELECT four.*,
         upper(fw_mod_currency) AS Fieldwork_Currency, upper(acc_mod_currency) AS Account_Currency,
         upper(fw_sold_currency) AS Fieldwork_Sold_Currency, upper(acc_sold_currency) AS Account_Sold_Currency,
         fw_mod_cpi * r1.Rate AS Fieldwork_Athena_CPI_USD, acc_mod_cpi * r2.Rate AS Account_Athena_CPI_USD,
         fw_sold_cpi * r3.Rate AS Fieldwork_Sold_CPI_USD, acc_sold_cpi * r4.Rate AS Account_Sold_CPI_USD
  FROM four
  LEFT JOIN latest_rates r1 ON upper(fw_mod_currency) = r1.From_Currency
  LEFT JOIN latest_rates r2 ON upper(acc_mod_currency) = r2.From_Currency
  LEFT JOIN latest_rates r3 ON upper(fw_sold_currency) = r3.From_Currency
  LEFT JOIN latest_rates r4 ON upper(acc_sold_currency) = r4.From_Currency)"""


def adjudicated_ctes(p: QuoteParams) -> str:
    di = p.default_index
    clip = ("CASE WHEN index_blend < 0 THEN index_blend ELSE CAST(0 AS DOUBLE) END"
            if p.gamma_clip == "negative" else "coalesce(index_blend, CAST(0 AS DOUBLE))")
    gam = ", ".join(f"{dbl(1)} / nullif(1 + {dbl(1.0 - beta)} * index_drop, 0) AS gamma{x}"
                    for x, beta in (("A", p.beta_a), ("B", p.beta_b), ("C", p.beta_c)))
    return f"""adj_in AS (
  SELECT usd.*,
         greatest(Fieldwork_Athena_CPI_USD, Account_Athena_CPI_USD) AS P2,
         greatest(Fieldwork_Sold_CPI_USD, Account_Sold_CPI_USD) AS P1,
         fw_sold_loi_used AS LOI1, fw_mod_loi_used AS LOI2,
         TRY_CAST(round_even(fw_sold_ir_used * 100, 0) AS INTEGER) AS IR1,
         TRY_CAST(round_even(fw_mod_ir_used * 100, 0) AS INTEGER) AS IR2,
         CASE WHEN client_strategic_index <= {di} THEN {di} ELSE client_strategic_index END AS CSI,
         CASE WHEN proposal_strategic_index <= {di} THEN {di} ELSE proposal_strategic_index END AS PSI,
         CASE WHEN competitive_intensity_index <= {di} THEN {di} ELSE competitive_intensity_index END AS CII
  FROM usd),
adj_s AS (
  SELECT *, sqrt(abs(P2 - P1)) / nullif({dbl(p.alpha)} * abs(LOI1 - LOI2) + abs(IR1 - IR2), 0) AS S
  FROM adj_in),
adj_c AS (
  SELECT *, {dbl(p.a)} * S + {dbl(p.b)} * (CSI - 3) + {dbl(p.c)} * (CII - 3) + {dbl(p.d)} * (PSI - 3)
    AS index_blend FROM adj_s),
adj_g AS (SELECT *, {clip} AS index_drop FROM adj_c),
adj_w AS (SELECT *, {gam} FROM adj_g),
adj AS (
  SELECT *, gammaA * P2 + (1 - gammaA) * P1 AS PriceA, gammaB * P2 + (1 - gammaB) * P1 AS PriceB,
         gammaC * P2 + (1 - gammaC) * P1 AS PriceC
  FROM adj_w),
band AS (
  SELECT *,
         CASE WHEN fieldwork_company IS NOT NULL THEN greatest(PriceA, PriceB, PriceC) END AS HighPriceUSD,
         CASE WHEN fieldwork_company IS NOT NULL THEN least(PriceA, PriceB, PriceC) END AS LowPriceUSD,
         CASE WHEN fieldwork_company IS NOT NULL THEN list_sort([PriceA, PriceB, PriceC])[2] END
           AS Strand2PriceUSD
  FROM adj)"""


def local_cte(p: QuoteParams) -> str:
    op = "*" if p.direction == "multiply" else "/"
    return f"""loc AS (
  SELECT band.*, r.Rate AS Rate_local,
         HighPriceUSD {op} r.Rate AS HighPrice, LowPriceUSD {op} r.Rate AS LowPrice,
         Strand2PriceUSD {op} r.Rate AS Strand2Price
  FROM band LEFT JOIN latest_rates r ON currency_code = r.From_Currency)"""


def pipeline_sql(p: QuoteParams, upto: str, scope: str | None = None,
                 commission_how: str = "LEFT", rates_until: str = "9999-99") -> str:
    """WITH clause up to the named stage."""
    stages = ["feat", "casted", "scored", "pin", "usd", "band", "loc"]
    parts = [FIXTURE_CTES.strip(), pf_cte(), latest_rates_cte(rates_until), feat_cte(scope), cast_cte(), scored_cte(p)]
    if stages.index(upto) >= stages.index("pin"):
        parts.append(pin_cte(p))
    if stages.index(upto) >= stages.index("usd"):
        parts.append(priced_ctes(p, commission_how))
    if stages.index(upto) >= stages.index("band"):
        parts.append(adjudicated_ctes(p))
    if stages.index(upto) >= stages.index("loc"):
        parts.append(local_cte(p))
    return "WITH " + ",\n".join(parts) + "\n"


def country_proposals_cte() -> str:
    """fx_country_proposals: one proposal for each account country."""
    from ..sources.fixtures import COUNTRY_PROPOSAL
    own = ", ".join(f"{e} AS {c}" for c, e in COUNTRY_PROPOSAL.items())
    return f"fx_country_proposals AS (SELECT * REPLACE ({own}) FROM fx_audience)"


def with_fixtures(*extra: str) -> str:
    return "WITH " + ",\n".join([FIXTURE_CTES.strip(), pf_cte(), LATEST_RATES_CTE, *extra]) + "\n"
