"""Registered queries: one per operator group of the inventory.

Every query reads the driver's tables (through the fixtures derived from
them) over the whole data; each has a DuckDB twin in ``oracle_sql()`` unless
it is not expressible in SQL (JSON text, streaming side effects are still
compared on rows).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import breakpoint_ir, ir_factor, ir_tier, loi_bucket, q, sql_breakpoint_ir, sql_ir_tier, sql_loi_key
from ..operators import pricing as pr
from ..operators.adjudicate import adjudicate, adjudication_inputs, floor_indices
from ..operators.broadcast import fits_broadcast, stored_lookup
from ..operators.currency import latest_rates
from ..operators.features import COUNTRY_COUNT, FEATURE_COLUMNS, country_counts, with_features
from ..operators.flatten import explode_audiences, explode_countries, flatten_request
from ..operators.models import fit_linear, fit_steps
from ..operators.quarantine import quarantine, with_reasons
from ..operators.scoring import apply_scorers, clamp_scores, count_scorers, demo_scorers, score_cast
from ..params import DEFAULT_PARAMS, VALID_COMPANIES, QuoteParams
from ..schemas import (FACTOR_KEYS, FACTOR_NUMERIC, FLAT_REQUEST_COLUMNS, PRICE_FACTORS_SCHEMA,
                       PROPOSAL_FIELDS, COST_RENAMES, ACCOUNT_RENAMES)
from ..session import ensure_checkpoint_dir, staging_path
from ..sources import fixtures as fx
from ..sources.requests import (count_request_documents, nest_requests, parse_requests, read_request_documents, read_requests,
                                request_json, write_request_documents, write_requests)
from ..sources.sinks import PAGE_RECORDS, RECORD_ORDER, parse_records, quote_json, quote_records
from ..sources.staging import create_namespace, read_lookup_csv, read_rates, stage_lookup, stage_rates, write_lookup_csv
from ..sources.tables import Tables, stamp
from . import oracles as o
from .quote import band_rows, local_rows, prepare_lookups, priced_rows, quote, scored_rows

KEYS = ("proposal_id", "audience_no", "part_no", "supp_no")
NAMED = replace(DEFAULT_PARAMS, binding="named")
BLEND = replace(DEFAULT_PARAMS, binding="named", b=-0.04)


class Ctx:
    """Fixtures and prepared lookups of one scale-factor folder (lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: QuoteParams = DEFAULT_PARAMS):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self.params = params
        self._lk = None

    @property
    def audience(self) -> DataFrame:
        return fx.fx_audience(self.t)

    @property
    def lookups(self):
        if self._lk is None:
            self._lk = _lookups(self.spark, self.t, self.params)
        return self._lk

    def scored(self, scorers=None) -> DataFrame:
        return scored_rows(self.audience, scorers or demo_scorers(), self.params, keep=KEYS)

    def priced(self) -> DataFrame:
        return priced_rows(self.scored(), self.lookups, self.params)


_LOOKUPS: dict = {}


def _lookups(spark: SparkSession, t: Tables, params: QuoteParams):
    """Lookups of one folder, prepared (and size-checked) once per session
    while the folder's files are unchanged."""
    seen = stamp(spark, t.sf_dir)
    key = (spark.sparkContext.applicationId, id(spark), t.sf_dir, seen, params.max_broadcast_factors, params.max_broadcast_rates,
           params.max_broadcast_commission)
    if key not in _LOOKUPS:
        _LOOKUPS[key] = prepare_lookups(fx.fx_price_factors(t), fx.fx_commission(t), fx.fx_rates(t), params)
    return _LOOKUPS[key]


def _ctx(spark, sf_dir, params=DEFAULT_PARAMS) -> Ctx:
    return Ctx(spark, sf_dir, params)


# --- sources ------------------------------------------------------------------

def q_latest_rates(spark, sf_dir):
    path = stage_rates(fx.fx_rates(Tables(spark, sf_dir)), staging_path(spark, "rates-by-month"))
    return latest_rates(read_rates(spark, path)).select("From_Currency", "month", "Rate")


def q_commission_scan(spark, sf_dir):
    path = staging_path(spark, "commission")
    fx.fx_commission(Tables(spark, sf_dir)).write.parquet(path)
    return spark.sql(f"SELECT * FROM parquet.`{path}`")


def q_csv_lookup_scan(spark, sf_dir):
    path = write_lookup_csv(fx.fx_price_factors(Tables(spark, sf_dir)), staging_path(spark, "factors-csv"))
    return pr.prepare_factors(read_lookup_csv(spark, path, PRICE_FACTORS_SCHEMA))


def q_staged_lookup(spark, sf_dir):
    base = staging_path(spark, "catalog")
    ns = "samplequote_stage"
    create_namespace(spark, ns, location=base)
    name = f"{ns}.rates_{base.rsplit('-', 1)[-1]}"
    stage_lookup(fx.fx_rates(Tables(spark, sf_dir)), name, path=f"{base}/rates")
    return spark.table(name)


def _nested(c: Ctx) -> DataFrame:
    return nest_requests(c.audience, together=True)  # lines lie by order, as they were joined by it


_REQUEST_FILES: dict = {}


def _request_files(c: Ctx) -> str:
    """Request documents of a folder written once (JSON lines in the shared
    staging folder) and read by the scan query, like a landing folder of
    incoming requests."""
    key = (c.spark.sparkContext.applicationId, id(c.spark), c.t.sf_dir, stamp(c.spark, c.t.sf_dir))
    if key not in _REQUEST_FILES:
        _REQUEST_FILES[key] = write_requests(_nested(c), staging_path(c.spark, "requests"))
    return _REQUEST_FILES[key]


def q_request_scan(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return flatten_request(read_requests(spark, _request_files(c))).select(*FLAT_REQUEST_COLUMNS)


def q_flatten_request(spark, sf_dir):
    return flatten_request(_nested(_ctx(spark, sf_dir))).select(*FLAT_REQUEST_COLUMNS)


def q_explode_countries(spark, sf_dir):
    rows = explode_countries(_nested(_ctx(spark, sf_dir)))
    return rows.select("proposal_id", "revision_number", "brand", "total_price",
                       F.col("country.country_code").alias("country_code"),
                       F.size("country.audiences").alias("n_audiences"))


def odd_documents(docs: DataFrame) -> DataFrame:
    """Request documents some of which have no country list or an empty one, and some of
    whose countries have no audience list or an empty one."""
    kind = F.col("proposal_id") % 11
    def country(c, i):
        lost = F.pmod(F.col("proposal_id") + i, F.lit(5))
        kept = F.when(lost == 0, F.lit(None)).when(lost == 1, F.filter(c["audiences"], lambda a: F.lit(False))).otherwise(c["audiences"])
        return c.withField("audiences", kept)
    countries = F.transform("countries", country)
    return docs.withColumn("countries", F.when(kind == 0, F.lit(None)).when(kind == 1, F.filter("countries", lambda c: F.lit(False))).otherwise(countries))


def q_audience_positions(spark, sf_dir):
    """Positions in both lists of every document, missing and empty lists included."""
    docs = odd_documents(_nested(_ctx(spark, sf_dir)))
    return flatten_request(docs, keep_positions=True).select(
        "proposal_id", "country_pos", "proposal_country_code", "audience_pos", "audience_uuid")


def q_explode_audiences(spark, sf_dir):
    rows = explode_audiences(explode_countries(_nested(_ctx(spark, sf_dir))))
    return rows.select("proposal_id", "revision_number",
                       F.col("country.country_code").alias("country_code"),
                       F.col("audience.audience_uuid").alias("audience_uuid"),
                       F.col("audience.completes").alias("completes"),
                       F.col("audience.incidence_rate").alias("incidence_rate"))


def q_request_json(spark, sf_dir):
    """Request documents written as JSON text and parsed back: typed columns to compare."""
    texts = request_json(_nested(_ctx(spark, sf_dir)))
    return flatten_request(parse_requests(texts, "json")).select(*FLAT_REQUEST_COLUMNS)


#: Proposals whose number of documents is broadcast at most.
MAX_BROADCAST_PROPOSALS = 100_000


def q_request_documents(spark, sf_dir):
    """Proposals of thousands of audiences, one JSON document each, written and read back;
    with the number of documents of each proposal."""
    t = Tables(spark, sf_dir)
    path = write_request_documents(fx.fx_country_proposals(t), staging_path(spark, "documents"))
    lines = stored_lookup(count_request_documents(spark, path).withColumnRenamed("proposal_id", "_p"), "documents-of-proposals")
    few = F.broadcast(lines) if fits_broadcast(lines, MAX_BROADCAST_PROPOSALS) else lines
    return (flatten_request(read_request_documents(spark, path)).join(few, F.col("proposal_id") == F.col("_p"))
            .select(*FLAT_REQUEST_COLUMNS, "documents"))


def q_nested_pages(spark, sf_dir):
    """The same proposals as typed documents in pages: audiences of each country over all pages."""
    docs = nest_requests(fx.fx_country_proposals(Tables(spark, sf_dir)))
    rows = explode_countries(docs).select("proposal_id", "page_count", F.col("country.country_code").alias("country_code"),
                                          F.col("country.country_audiences").alias("country_audiences"),
                                          F.size("country.audiences").alias("here"))
    return (rows.groupBy("proposal_id", "page_count", "country_code", "country_audiences")
            .agg(F.sum("here").alias("n_audiences")))


# --- features and scores ------------------------------------------------------

def q_quote_features(spark, sf_dir):
    return with_features(_ctx(spark, sf_dir).audience, "batch").select(*KEYS, *FEATURE_COLUMNS)


def q_country_counts(spark, sf_dir):
    return country_counts(_ctx(spark, sf_dir).audience)


def _raw_scores(c: Ctx) -> DataFrame:
    return score_cast(apply_scorers(with_features(c.audience, None), demo_scorers()))


def q_score_cast(spark, sf_dir):
    return _raw_scores(_ctx(spark, sf_dir)).select(*KEYS, "Athena_IR", "Athena_CR", "Athena_LOI")


def q_clamp_scores(spark, sf_dir):
    return clamp_scores(_raw_scores(_ctx(spark, sf_dir))).select(*KEYS, "Athena_IR", "Athena_CR", "Athena_LOI")


def q_score_responses(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return c.scored(count_scorers()).select(*KEYS, "Athena_IR", "Athena_CR", "Athena_LOI")


LOI_CUTS = (10, 20, 30, 40)


#: Features that the fitted models read.
MODEL_FEATURES = ("SoldLOI", "PrmWeightedIR_1", "feaAudienceWaves", "PrmReqCompletes")


def q_score_model(spark, sf_dir):
    """Scores of models fitted on all line items and compiled into Columns. The features
    are stored once, as the three fits and the scores read them."""
    feats = stored_lookup(with_features(_ctx(spark, sf_dir).audience, None).select(*KEYS, *MODEL_FEATURES), "model-features")
    fitted = {
        "ir": F.expr(fit_linear(feats, ["SoldLOI"], "PrmWeightedIR_1")),
        "cr": F.expr(fit_steps(feats, "feaAudienceWaves", "PrmReqCompletes", (1, 2, 3))) / 1000,
        "loi": F.expr(fit_steps(feats, "SoldLOI", "SoldLOI", LOI_CUTS)),
    }
    raw = apply_scorers(feats, fitted)
    return score_cast(raw.withColumns({"ir_score": F.col("_ir_score"), "cr_score": F.col("_cr_score"), "loi_score": F.col("_loi_score")})).select(
        *KEYS, "ir_score", "cr_score", "loi_score", "Athena_IR", "Athena_CR", "Athena_LOI")


# --- pricing ------------------------------------------------------------------

PRICING_INPUT_COLS = ("company", "brand", "product", "country", "segment", "client", "srcSystem",
                      "modelled_loi", "modelled_jobIr", "sold_loi", "sold_jobIr")


def q_pricing_input(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return pr.pricing_inputs(c.scored()).select(*KEYS, *PRICING_INPUT_COLS)


def q_factor_cast(spark, sf_dir):
    return pr.prepare_factors(fx.fx_price_factors(Tables(spark, sf_dir)))


def q_factor_key(spark, sf_dir):
    return pr.factor_key(fx.fx_price_factors(Tables(spark, sf_dir))).select(*FACTOR_KEYS, "price_key")


def q_loi_bucket(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    s = c.scored()
    return s.select(
        *KEYS,
        loi_bucket("CAST(audience_length_of_interview AS DOUBLE)").alias("loi_bucket_sold"),
        loi_bucket("CAST(Athena_LOI AS DOUBLE)").alias("loi_bucket_modelled"),
        loi_bucket("(audience_length_of_interview * 3.0D - 5.0D)").alias("loi_bucket_raw"),
        loi_bucket("(Athena_IR / 100)").alias("loi_bucket_reference"),
    )


def _f(name: str) -> str:
    """A column of the factor row that ``_named_lookup`` joins."""
    return q(f"_f_{name}")


def _named_lookup(c: Ctx) -> DataFrame:
    """Named-binding modelled inputs joined to their account factor row."""
    rows = pr.pricing_inputs(c.scored(), NAMED).withColumn("_bucket", loi_bucket("modelled_loi"))
    lk = c.lookups
    return pr.looked_up(rows, lk.factors, lk.factors_fit, "f",
                        ["company", "brand", "product", "country", sql_loi_key("_bucket"), "segment", "client"])


def q_factor_lookup(spark, sf_dir):
    j = _named_lookup(_ctx(spark, sf_dir))
    return j.select(*KEYS, F.col("_f_Low_IR_Anchor").alias("Low_IR_Anchor"),
                    F.col("_f_Break1").alias("Break1"), F.col("_f_Rate_Currency").alias("Rate_Currency"),
                    F.col("_f_hit").isNotNull().alias("factor_found"))


def q_ir_tier(spark, sf_dir):
    j = _named_lookup(_ctx(spark, sf_dir))
    return j.select(*KEYS, *[v.alias(f"tier_{k}") for k, v in ir_tier("modelled_jobIr", _f).items()])


def q_breakpoint_ir(spark, sf_dir):
    j = _named_lookup(_ctx(spark, sf_dir))
    return j.select(*KEYS, breakpoint_ir("modelled_jobIr", _f).alias("ir_used"))


def q_ir_factor(spark, sf_dir):
    j = _named_lookup(_ctx(spark, sf_dir))
    t = sql_ir_tier("modelled_jobIr", _f)
    used = sql_breakpoint_ir("modelled_jobIr", _f)
    return j.select(*KEYS, ir_factor(f"({used})", f"({t['step']})").alias("job_factor"),
                    ir_factor(f"({t['used']})", f"({t['step']})").alias("anchor_factor"))


def q_cpi_quote(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    rows = pr.pricing_inputs(c.scored(), NAMED)
    lk = c.lookups
    out = pr.price(rows, lk.factors, lk.factors_fit, "q", "company", "modelled_loi", "modelled_jobIr",
                   params=NAMED)
    return out.select(*KEYS, F.col("q_cpi").alias("cpi"), F.col("q_ir_used").alias("ir_used"),
                      F.col("q_loi_used").alias("loi_used"), F.col("q_currency").alias("currency"),
                      F.col("q_status").alias("quote_status"))


def q_missing_factors(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    rows = pr.pricing_inputs(c.scored(), NAMED)
    miss = pr.missing_factors(rows, c.lookups.factors, "company", "modelled_loi")
    return miss.select(*KEYS, "company", "brand", "product", F.col("_loi_key").alias("loi_key"))


def q_duplicate_factors(spark, sf_dir):
    factors = fx.fx_price_factors(Tables(spark, sf_dir))
    return pr.duplicate_factors(factors.unionByName(factors.where("LOI = '5' AND BrandID = 'Brand#1'")))


def q_company_validity(spark, sf_dir):
    a = _ctx(spark, sf_dir).audience
    # account numbers over a range that holds some valid companies and some others
    a = a.withColumn("company", (F.col("proposal_id") % 300).cast("string"))
    return a.select(*KEYS, "company", pr.company_valid("company").alias("company_valid"))


def q_fieldwork_inputs(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    rows = pr.pricing_inputs(c.scored())
    lk = c.lookups
    out = pr.with_fieldwork_company(rows, lk.commission, lk.commission_fit, "inner")
    return out.select(*KEYS, F.col("fieldwork_company").alias("company"), "brand", "product",
                      "modelled_loi", "modelled_jobIr", "sold_loi", "sold_jobIr")


FOUR_WAY_COLS = {
    "Fieldwork_Athena_CPI": "fw_mod_cpi", "Athena_IR": "fw_mod_ir_used", "Athena_LOI": "fw_mod_loi_used",
    "Fieldwork_Currency": "Fieldwork_Currency", "Account_Athena_CPI": "acc_mod_cpi",
    "Account_Currency": "Account_Currency", "Fieldwork_Sold_CPI": "fw_sold_cpi",
    "Sold_IR": "fw_sold_ir_used", "Sold_LOI": "fw_sold_loi_used", "Account_Sold_CPI": "acc_sold_cpi",
}
USD_COLS = ("Fieldwork_Athena_CPI_USD", "Account_Athena_CPI_USD", "Fieldwork_Sold_CPI_USD",
            "Account_Sold_CPI_USD", "Fieldwork_Currency", "Account_Currency")


def q_four_way_cpi(spark, sf_dir):
    p = _ctx(spark, sf_dir, NAMED).priced()
    return p.select(*KEYS, "fieldwork_company", *[F.col(v).alias(k) for k, v in FOUR_WAY_COLS.items()])


def q_cpi_to_usd(spark, sf_dir):
    return _ctx(spark, sf_dir, NAMED).priced().select(*KEYS, "fieldwork_company", *USD_COLS)


# --- adjudication -------------------------------------------------------------

def q_reference_prices(spark, sf_dir):
    p = adjudication_inputs(_ctx(spark, sf_dir).priced())
    return p.select(*KEYS, "fieldwork_company", "P2", "P1", "LOI1", "LOI2", "IR1", "IR2")


def q_floor_indices(spark, sf_dir):
    a = floor_indices(_ctx(spark, sf_dir).audience)
    return a.select(*KEYS, F.col("client_strategic_index").alias("CSI"),
                    F.col("proposal_strategic_index").alias("PSI"),
                    F.col("competitive_intensity_index").alias("CII"))


ADJ_COLS = ("S", "index_blend", "index_drop", "gammaA", "gammaB", "gammaC", "PriceA", "PriceB", "PriceC")


def q_adjudicate(spark, sf_dir):
    c = _ctx(spark, sf_dir, BLEND)
    a = adjudicate(adjudication_inputs(c.priced(), BLEND), BLEND)
    return a.select(*KEYS, "fieldwork_company", *ADJ_COLS)


def q_price_band(spark, sf_dir):
    c = _ctx(spark, sf_dir, BLEND)
    return band_rows(c.priced(), BLEND).select(*KEYS, "fieldwork_company", "HighPriceUSD", "LowPriceUSD",
                                        "Strand2PriceUSD")


def q_quote_local_currency(spark, sf_dir):
    c = _ctx(spark, sf_dir, BLEND)
    rows = local_rows(band_rows(c.priced(), BLEND), c.lookups, BLEND)
    return rows.select(*KEYS, "fieldwork_company", "currency_code", "HighPrice", "LowPrice", "Strand2Price")


def _final(params):
    def run(spark, sf_dir):
        c = _ctx(spark, sf_dir, params)
        return quote(c.audience, c.lookups, demo_scorers(), params)
    return run


q_final_quote = _final(DEFAULT_PARAMS)
q_final_quote_named = _final(NAMED)
q_final_quote_blend = _final(BLEND)


#: Conditions on the finished quote: two that reach the scans and one on the price.
QUOTE_CONDITIONS = ("proposal_country_code IN ('NATION_3', 'NATION_8')", "currency_code = 'EUR'", "HighPrice > 20")


def q_final_quote_where(spark, sf_dir):
    c = _ctx(spark, sf_dir, BLEND)
    return quote(c.audience, c.lookups, count_scorers(), BLEND, where=QUOTE_CONDITIONS)


#: Companies that the quarantine query takes as valid.
KNOWN_COMPANIES = ("0", "1", "2", "3")


def q_quarantined_rows(spark, sf_dir):
    """Both sides of the quarantine, with the reasons against each row."""
    c = _ctx(spark, sf_dir, NAMED)
    rows = pr.pricing_inputs(c.scored(), NAMED).withColumn("raw_loi", F.col("audience_length_of_interview") * 3.0 - 5.0)
    judged = with_reasons(rows, c.lookups.factors, "modelled_loi", ("sold_jobIr", "raw_loi"),
                          valid=F.col("company").isin(*KNOWN_COMPANIES), params=NAMED)
    sides = quarantine(judged.select(*KEYS, "company", "reasons"), staging_path(spark, "quarantine"))
    good = sides.accepted.select(*KEYS, "company", F.lit("").alias("reason"))
    return good.unionByName(sides.rejected.select(*KEYS, "company", F.concat_ws(",", "reasons").alias("reason")))


def q_quote_json(spark, sf_dir):
    """Quote records written as JSON text and parsed back, NULL prices included."""
    final = q_final_quote(spark, sf_dir)
    texts = quote_json(final)
    text = next(c for c, kind in reversed(texts.dtypes) if kind == "string")
    return texts.select(F.from_json(text, final.schema).alias("r")).select("r.*")


def _records(by, page_records=PAGE_RECORDS):
    def run(spark, sf_dir):
        quotes = q_final_quote_blend(spark, sf_dir)
        return parse_records(quote_records(quotes, by, page_records=page_records), quotes.schema)
    return run


#: The records array of each proposal, and of each country, whose arrays have several pages.
q_quote_records = _records(("proposal_id", "revision_number"))
q_country_records = _records(("proposal_country_code",))


#: The last month of the rates that the first lookup version knows.
FIRST_VERSION_MONTH = "2000-12"


def q_stream_refreshed(spark, sf_dir):
    """A stream over two published lookup versions: first revisions are priced by the
    rates up to 2000-12, the others, which arrive after, by all rates. A document has
    one revision, so each arrival is built from its own rows only."""
    from ..streaming.stream import publish_lookups, stream_quotes_versioned
    c = _ctx(spark, sf_dir)
    base = staging_path(spark, "stream-versions")
    rates = fx.fx_rates(c.t)
    for known, arrived in ((rates.where(F.col("month") <= FIRST_VERSION_MONTH), "revision_number = 1"), (rates, "revision_number <> 1")):
        publish_lookups(spark, f"{base}/lookups", fx.fx_price_factors(c.t), fx.fx_commission(c.t), known)
        write_requests(nest_requests(c.audience.where(arrived)), f"{base}/requests", mode="append")
        stream_quotes_versioned(spark, f"{base}/requests", f"{base}/lookups", demo_scorers(), DEFAULT_PARAMS, f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out/data").drop("epoch")


def q_stream_quotes(spark, sf_dir):
    from ..streaming.stream import stream_quotes_to_table
    c = _ctx(spark, sf_dir)
    requests = write_requests(_nested(c), staging_path(spark, "stream-requests"))
    out = stream_quotes_to_table(spark, requests, c.lookups, demo_scorers(), DEFAULT_PARAMS,
                                 staging_path(spark, "stream-out"))
    return spark.read.parquet(out)


# --- oracle SQL ---------------------------------------------------------------

K = ", ".join(KEYS)


def _sql() -> dict[str, str]:
    d, n, b = DEFAULT_PARAMS, NAMED, BLEND
    flat_cols = ", ".join(FLAT_REQUEST_COLUMNS)
    doc_fields = ", ".join(list(PROPOSAL_FIELDS) + list(COST_RENAMES.values()) + list(ACCOUNT_RENAMES.values()))
    pf_cols = ", ".join(list(FACTOR_KEYS) + list(FACTOR_NUMERIC) + ["Rate_Currency"])
    named_lookup = (o.pipeline_sql(n, "pin") + f""",
nl AS (SELECT pin.*, {", ".join(f"f.{c} AS {c}" for c in FACTOR_NUMERIC)},
              f.Rate_Currency AS f_currency, f.RegionID IS NOT NULL AS hit
       FROM pin {o.join_on("f", "company", "modelled_bucket")})
""")
    jq = "modelled_jobIr"

    def pick(h, m, low):
        return f"(CASE WHEN {jq} > Mid_IR_Used THEN {h} WHEN {jq} > Low_IR_Used THEN {m} ELSE {low} END)"

    brk = (f"(CASE WHEN Break1 > 1 THEN {jq} " + " ".join(
        f"WHEN Break{i} < {jq} THEN Break{i}" for i in range(1, 6)) + f" ELSE {jq} END)")
    step = pick("High_IR_Step", "Mid_IR_Step", "Low_IR_Step")

    def records_sql(by):
        place = (f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY "
                 + ", ".join(f"{c} NULLS FIRST" for c in RECORD_ORDER) + ") - 1")
        return o.pipeline_sql(b, "loc") + (
            f"SELECT CAST(place // {PAGE_RECORDS} AS INTEGER) AS page_no, CAST(ceil(size / {PAGE_RECORDS}) AS INTEGER) AS page_count, "
            f"CAST(place % {PAGE_RECORDS} AS INTEGER) AS record_no, {final_cols} FROM (SELECT {final_cols}, {place} AS place, "
            f"count(*) OVER (PARTITION BY {', '.join(by)}) AS size FROM loc)")

    def fac(x):
        return f"({o.dbl(1)} / nullif({o.trunc_int(f'{x} / nullif({step}, 0) + 1', 'BIGINT')}, 0))"

    final_cols = ("proposal_id, proposal_uuid, revision_number, proposal_country_code, audience_uuid, "
                  "currency_code, HighPrice, LowPrice, Strand2Price, fieldwork_company")
    return {
        "latest_rates": o.with_fixtures() + "SELECT From_Currency, month, Rate FROM latest_rates",
        "commission_scan": o.with_fixtures() + "SELECT * FROM fx_commission",
        "csv_lookup_scan": o.with_fixtures() + f"SELECT {pf_cols} FROM pf",
        "staged_lookup": o.with_fixtures() + "SELECT * FROM fx_rates",
        "request_scan": o.with_fixtures() + f"SELECT {flat_cols} FROM fx_audience",
        "flatten_request": o.with_fixtures() + f"SELECT {flat_cols} FROM fx_audience",
        "explode_countries": o.with_fixtures() + (
            "SELECT proposal_id, revision_number, brand, total_price, country_code, n_audiences FROM ("
            f"SELECT {doc_fields}, proposal_country_code AS country_code, "
            "CAST(count(*) AS INTEGER) AS n_audiences FROM fx_audience "
            f"GROUP BY {doc_fields}, proposal_country_code)"),
        "explode_audiences": o.with_fixtures() + (
            "SELECT proposal_id, revision_number, proposal_country_code AS country_code, audience_uuid, "
            "audience_completes AS completes, audience_incidence_rate AS incidence_rate FROM fx_audience"),
        "quote_features": o.pipeline_sql(d, "feat", "batch") + (
            f"SELECT {K}, " + ", ".join(FEATURE_COLUMNS) + " FROM feat"),
        "country_counts": o.with_fixtures() + (
            f"SELECT proposal_country_code, count(*) AS {COUNTRY_COUNT} FROM fx_audience "
            "WHERE proposal_country_code IS NOT NULL GROUP BY proposal_country_code"),
        "score_cast": o.pipeline_sql(d, "casted") + (
            f"SELECT {K}, Athena_IR_raw AS Athena_IR, Athena_CR, Athena_LOI_raw AS Athena_LOI FROM casted"),
        "clamp_scores": o.pipeline_sql(d, "scored") + f"SELECT {K}, Athena_IR, Athena_CR, Athena_LOI FROM scored",
        "score_responses": o.pipeline_sql(d, "scored") + (
            f"SELECT {K}, Athena_IR, CAST(25 * count(*) OVER (PARTITION BY proposal_country_code) AS INTEGER) "
            "AS Athena_CR, Athena_LOI FROM scored"),
        "pricing_input": o.pipeline_sql(d, "pin") + (
            f"SELECT {K}, " + ", ".join(PRICING_INPUT_COLS) + " FROM pin"),
        "factor_cast": o.with_fixtures() + f"SELECT {pf_cols} FROM pf",
        "factor_key": o.with_fixtures() + (
            "SELECT " + ", ".join(FACTOR_KEYS) + ", concat(" + ", ".join(FACTOR_KEYS)
            + ") AS price_key FROM fx_price_factors"),
        "loi_bucket": o.pipeline_sql(d, "scored") + (
            f"SELECT {K}, {o.loi_bucket('CAST(audience_length_of_interview AS DOUBLE)')} AS loi_bucket_sold, "
            f"{o.loi_bucket('CAST(Athena_LOI AS DOUBLE)')} AS loi_bucket_modelled, "
            f"{o.loi_bucket(f'audience_length_of_interview * {o.dbl(3.0)} - {o.dbl(5.0)}')} AS loi_bucket_raw, "
            f"{o.loi_bucket('CAST(Athena_IR AS DOUBLE) / 100')} AS loi_bucket_reference FROM scored"),
        "factor_lookup": named_lookup + (
            f"SELECT {K}, Low_IR_Anchor, Break1, f_currency AS Rate_Currency, hit AS factor_found FROM nl"),
        "ir_tier": named_lookup + (
            f"SELECT {K}, {pick('High_IR_Used', 'Mid_IR_Used', 'Low_IR_Used')} AS tier_used, "
            f"{pick('High_IR_Anchor', 'Mid_IR_Anchor', 'Low_IR_Anchor')} AS tier_anchor, "
            f"{pick('xFactor_High_IR', 'xFactor_Mid_IR', 'xFactor_Low_IR')} AS tier_xfactor, "
            f"{step} AS tier_step FROM nl"),
        "breakpoint_ir": named_lookup + f"SELECT {K}, {brk} AS ir_used FROM nl",
        "ir_factor": named_lookup + (
            f"SELECT {K}, {fac(brk)} AS job_factor, "
            f"{fac(pick('High_IR_Used', 'Mid_IR_Used', 'Low_IR_Used'))} AS anchor_factor FROM nl"),
        "cpi_quote": o.pipeline_sql(n, "pin") + (
            f"SELECT {K}, " + ", ".join(
                e.replace(" AS q_status", " AS quote_status").replace(" AS q_", " AS ")
                for e in o.quote_exprs("f", "modelled_jobIr", "modelled_bucket", "q", n))
            + f" FROM pin {o.join_on('f', 'company', 'modelled_bucket')}"),
        "missing_factors": o.pipeline_sql(n, "pin") + (
            f"SELECT {K}, company, brand, product, CAST(modelled_bucket AS VARCHAR) AS loi_key "
            f"FROM pin {o.join_on('f', 'company', 'modelled_bucket')} WHERE f.RegionID IS NULL"),
        "duplicate_factors": o.with_fixtures() + (
            "SELECT " + ", ".join(FACTOR_KEYS) + ", count(*) AS n_rows FROM (SELECT * FROM fx_price_factors UNION ALL SELECT * FROM fx_price_factors "
            "WHERE LOI = '5' AND BrandID = 'Brand#1') GROUP BY "
            + ", ".join(FACTOR_KEYS) + " HAVING count(*) > 1"),
        "company_validity": o.with_fixtures() + (
            f"SELECT {K}, CAST(proposal_id % 300 AS VARCHAR) AS company, CAST(proposal_id % 300 AS VARCHAR) IN ("
            + ", ".join(f"'{v}'" for v in VALID_COMPANIES)
            + ") AS company_valid FROM fx_audience"),
        "fieldwork_inputs": o.pipeline_sql(d, "pin") + (
            f"SELECT {K}, c.Company AS company, brand, product, modelled_loi, modelled_jobIr, sold_loi, "
            "sold_jobIr FROM pin JOIN fx_commission c ON proposal_country_code = c.Audience_Country_A3"),
        "four_way_cpi": o.pipeline_sql(n, "usd") + (
            f"SELECT {K}, fieldwork_company, " + ", ".join(f"{v} AS {k}" for k, v in FOUR_WAY_COLS.items())
            + " FROM usd"),
        "cpi_to_usd": o.pipeline_sql(n, "usd") + f"SELECT {K}, fieldwork_company, " + ", ".join(USD_COLS)
        + " FROM usd",
        "reference_prices": o.pipeline_sql(d, "band") + (
            f"SELECT {K}, fieldwork_company, P2, P1, LOI1, LOI2, IR1, IR2 FROM adj_in"),
        "floor_indices": o.with_fixtures() + (
            f"SELECT {K}, " + ", ".join(
                f"CASE WHEN {c} <= {d.default_index} THEN {d.default_index} ELSE {c} END AS {a}"
                for c, a in (("client_strategic_index", "CSI"), ("proposal_strategic_index", "PSI"),
                             ("competitive_intensity_index", "CII"))) + " FROM fx_audience"),
        "adjudicate": o.pipeline_sql(b, "band") + (
            f"SELECT {K}, fieldwork_company, " + ", ".join(ADJ_COLS) + " FROM adj"),
        "price_band": o.pipeline_sql(b, "band") + (
            f"SELECT {K}, fieldwork_company, HighPriceUSD, LowPriceUSD, Strand2PriceUSD FROM band"),
        "quote_local_currency": o.pipeline_sql(b, "loc") + (
            f"SELECT {K}, fieldwork_company, currency_code, HighPrice, LowPrice, Strand2Price FROM loc"),
        "final_quote": o.pipeline_sql(d, "loc") + f"SELECT {final_cols} FROM loc",
        "final_quote_named": o.pipeline_sql(n, "loc") + f"SELECT {final_cols} FROM loc",
        "final_quote_blend": o.pipeline_sql(b, "loc") + f"SELECT {final_cols} FROM loc",
        "request_json": o.with_fixtures() + f"SELECT {flat_cols} FROM fx_audience",
        "quote_json": o.pipeline_sql(d, "loc") + f"SELECT {final_cols} FROM loc",
        "final_quote_where": o.pipeline_sql(b, "loc", "batch").replace(o.cast_cte(), o.cast_cte(
            {"cr": f"feaNumberOfAudienceCountryA3 * {o.dbl(0.25)}"})) + (
            f"SELECT {final_cols} FROM loc WHERE " + " AND ".join(QUOTE_CONDITIONS)),
        "quarantined_rows": o.pipeline_sql(n, "pin") + (
            f"SELECT {K}, company, array_to_string(list_filter(["
            f"CASE WHEN company IN ({', '.join(repr(v) for v in KNOWN_COMPANIES)}) THEN NULL ELSE 'unknown_company' END, "
            "CASE WHEN f.RegionID IS NULL THEN 'missing_factor' END, "
            f"CASE WHEN sold_jobIr IS NULL OR sold_jobIr < 0 OR audience_length_of_interview * {o.dbl(3)} - {o.dbl(5)} < 0 THEN 'bad_number' END"
            f"], lambda r: r IS NOT NULL), ',') AS reason FROM pin {o.join_on('f', 'company', 'modelled_bucket')}"),
        "score_model": o.score_model_sql(K, LOI_CUTS),
        "audience_positions": o.with_fixtures() + (
            ", docs AS (SELECT proposal_id, proposal_country_code AS code, audience_uuid, "
            "dense_rank() OVER (PARTITION BY proposal_id ORDER BY proposal_country_code) - 1 AS country_pos, "
            "row_number() OVER (PARTITION BY proposal_id, proposal_country_code ORDER BY audience_uuid) - 1 AS audience_pos FROM fx_audience) "
            "SELECT DISTINCT proposal_id, CAST(NULL AS INTEGER) AS country_pos, CAST(NULL AS VARCHAR) AS proposal_country_code, "
            "CAST(NULL AS INTEGER) AS audience_pos, CAST(NULL AS VARCHAR) AS audience_uuid FROM docs WHERE proposal_id % 11 < 2 "
            "UNION ALL SELECT DISTINCT proposal_id, CAST(country_pos AS INTEGER), code, NULL, NULL FROM docs "
            "WHERE proposal_id % 11 >= 2 AND (proposal_id + country_pos) % 5 < 2 "
            "UNION ALL SELECT proposal_id, CAST(country_pos AS INTEGER), code, CAST(audience_pos AS INTEGER), audience_uuid FROM docs "
            "WHERE proposal_id % 11 >= 2 AND (proposal_id + country_pos) % 5 >= 2"),
        "stream_refreshed": " UNION ALL ".join(
            f"SELECT {final_cols}, CAST({v} AS INTEGER) AS lookup_version FROM ({o.pipeline_sql(d, 'loc', rates_until=until)} SELECT * FROM loc WHERE {arrived})"
            for v, until, arrived in ((1, FIRST_VERSION_MONTH, "revision_number = 1"), (2, "9999-99", "revision_number <> 1"))),
        "quote_records": records_sql(("proposal_id", "revision_number")),
        "country_records": records_sql(("proposal_country_code",)),
        "request_documents": o.with_fixtures(o.country_proposals_cte()) + (
            f"SELECT {flat_cols}, CAST(1 AS BIGINT) AS documents FROM fx_country_proposals"),
        "nested_pages": o.with_fixtures(o.country_proposals_cte()) + (
            "SELECT proposal_id, CAST(ceil(sum(n) OVER (PARTITION BY proposal_id) / 500) AS INTEGER) AS page_count, "
            "proposal_country_code AS country_code, n AS country_audiences, n AS n_audiences "
            "FROM (SELECT proposal_id, proposal_country_code, count(*) AS n FROM fx_country_proposals GROUP BY ALL)"),
        "stream_quotes": o.pipeline_sql(d, "loc") + f"SELECT {final_cols} FROM loc",
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "latest_rates": q_latest_rates,
    "commission_scan": q_commission_scan,
    "csv_lookup_scan": q_csv_lookup_scan,
    "staged_lookup": q_staged_lookup,
    "request_scan": q_request_scan,
    "flatten_request": q_flatten_request,
    "explode_countries": q_explode_countries,
    "explode_audiences": q_explode_audiences,
    "audience_positions": q_audience_positions,
    "request_json": q_request_json,
    "request_documents": q_request_documents,
    "nested_pages": q_nested_pages,
    "quote_features": q_quote_features,
    "country_counts": q_country_counts,
    "score_cast": q_score_cast,
    "clamp_scores": q_clamp_scores,
    "score_responses": q_score_responses,
    "score_model": q_score_model,
    "pricing_input": q_pricing_input,
    "factor_cast": q_factor_cast,
    "factor_key": q_factor_key,
    "loi_bucket": q_loi_bucket,
    "factor_lookup": q_factor_lookup,
    "ir_tier": q_ir_tier,
    "breakpoint_ir": q_breakpoint_ir,
    "ir_factor": q_ir_factor,
    "cpi_quote": q_cpi_quote,
    "missing_factors": q_missing_factors,
    "quarantined_rows": q_quarantined_rows,
    "duplicate_factors": q_duplicate_factors,
    "company_validity": q_company_validity,
    "fieldwork_inputs": q_fieldwork_inputs,
    "four_way_cpi": q_four_way_cpi,
    "cpi_to_usd": q_cpi_to_usd,
    "reference_prices": q_reference_prices,
    "floor_indices": q_floor_indices,
    "adjudicate": q_adjudicate,
    "price_band": q_price_band,
    "quote_local_currency": q_quote_local_currency,
    "final_quote": q_final_quote,
    "final_quote_named": q_final_quote_named,
    "final_quote_blend": q_final_quote_blend,
    "final_quote_where": q_final_quote_where,
    "quote_json": q_quote_json,
    "quote_records": q_quote_records,
    "country_records": q_country_records,
    "stream_quotes": q_stream_quotes,
    "stream_refreshed": q_stream_refreshed,
}


def oracle_sql() -> dict[str, str]:
    return _sql()
