"""Nested requests, flattening, scorers, staging and plan shape."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from samplequote.operators.features import COUNTRY_COUNT, with_country_count
from samplequote.operators.flatten import flatten_request
from samplequote.operators.scoring import clamp_scores, constant_scorers, score
from samplequote.schemas import FLAT_REQUEST_COLUMNS, REQUEST_DDL
from samplequote.sources.requests import nest_requests, parse_requests, request_json
from samplequote.sources.staging import create_namespace, read_lookup_csv, stage_lookup, write_lookup_csv
from samplequote.schemas import COMMISSION_SCHEMA
from samplequote.streaming.stream import country_counts_in_request


def audience(uuid, name, completes, ir, loi):
    return {"audience_uuid": uuid, "audience_name": name, "completes": completes, "incidence_rate": ir,
            "length_of_interview": loi, "panel_source": "Panel A", "panelist_type": "Consumer",
            "sampling_complexity": "Low", "audience_complexity_index": 2, "waves": 1}


SAMPLE = {
    "proposal_id": 77, "proposal_uuid": "p-77", "proposal_name": "Sample", "revision_number": 2,
    "pricing_formula": "2023-01", "brand": "Internal", "proposed_fieldwork_length": 10,
    "fieldwork_start_date": "01/09/2023", "fieldwork_end_date": "01/30/2023",
    "service_type": "Full service", "project_type": "Ad hoc", "rush_job": False,
    "proposal_strategic_index": 2, "competitive_intensity_index": 5, "currency_code": "EUR",
    "total_price": 1000.5,
    "total_costs": {"incentives": 1.0, "panel_partner": 2.0, "labor": 3.0, "translations": 0.0,
                    "other": 0.5, "panel_investment": 9.0},
    "account": {"account_uuid": "a-1", "account_name": "Acme", "client_strategic_index": 4,
                "client_segment": "Mid", "country_code": "ESP", "company_number": "13",
                "maconomy_number": "m-1", "preferred_currency": "EUR"},
    "countries": [
        {"country_code": "ITA", "audiences": [audience("u1", "Main", 500, 60, 10),
                                               audience("u2", "Boost", 100, 20, 15)]},
        {"country_code": "PRT", "audiences": [audience("u1", "Main", 400, 50, 20),
                                               audience("u3", "Boost", 50, 10, 25)]},
    ],
}


def sample_requests(spark, docs):
    import json
    rows = [(json.dumps(d),) for d in docs]
    return parse_requests(spark.createDataFrame(rows, "value string"))


def test_sample_request_each_audience_under_its_own_country(spark):
    flat = flatten_request(sample_requests(spark, [SAMPLE]), keep_positions=True)
    assert flat.columns[:len(FLAT_REQUEST_COLUMNS)] == list(FLAT_REQUEST_COLUMNS)
    got = sorted((r.proposal_country_code, r.audience_uuid, r.audience_completes, r.country_pos, r.audience_pos)
                 for r in flat.collect())
    assert got == [("ITA", "u1", 500, 0, 0), ("ITA", "u2", 100, 0, 1),
                   ("PRT", "u1", 400, 1, 0), ("PRT", "u3", 50, 1, 1)]
    r = flat.first()
    assert (r.account_country_code, r.account_company_number, r.incentives_costs) == ("ESP", "13", 1.0)


def test_empty_country_list_keeps_one_row(spark):
    doc = {**SAMPLE, "countries": []}
    rows = flatten_request(sample_requests(spark, [doc])).collect()
    assert len(rows) == 1 and rows[0].proposal_country_code is None and rows[0].audience_uuid is None


def test_nest_flatten_round_trip_with_pages(spark):
    flat = flatten_request(sample_requests(spark, [SAMPLE]))
    docs = nest_requests(flat, page_size=1)  # 4 hash pages for 4 audiences
    assert 2 <= docs.count() <= 4
    back = flatten_request(docs).select(*FLAT_REQUEST_COLUMNS)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))
    one = nest_requests(flat, page_size=500)
    assert one.count() == 1 and sorted(map(tuple, flatten_request(one).collect())) == sorted(map(tuple, flat.collect()))


def test_request_json_keeps_nulls(spark):
    doc = {**SAMPLE, "brand": None}
    js = request_json(sample_requests(spark, [doc])).first().json
    assert '"brand":null' in js


def test_country_count_in_request_equals_proposal_scope(spark):
    req = sample_requests(spark, [SAMPLE])
    counted = req.select(F.explode(country_counts_in_request(F.col("countries"))).alias("c"))
    got = sorted((r.c.country_code, r.c[COUNTRY_COUNT]) for r in counted.collect())
    assert got == [("ITA", 2), ("PRT", 2)]
    flat = flatten_request(req)
    per_prop = with_country_count(flat, "proposal").select("proposal_country_code", COUNTRY_COUNT).distinct()
    assert sorted(map(tuple, per_prop.collect())) == [("ITA", 2), ("PRT", 2)]


def test_constant_mock_scorers_clamp_to_floor(spark):
    df = spark.createDataFrame([(1,)], "id int")
    r = score(df, constant_scorers(0.0)).first()
    assert (r.Athena_IR, r.Athena_CR, r.Athena_LOI) == (2, 0, 1)


def test_clamps_keep_null_and_hit_bounds(spark):
    df = spark.createDataFrame([(None, None), (-5, 0), (2, 1), (100, 120), (250, 400), (50, 60)],
                               "Athena_IR int, Athena_LOI int")
    got = [tuple(r) for r in clamp_scores(df).collect()]
    assert got == [(None, None), (2, 1), (2, 1), (100, 120), (100, 120), (50, 60)]


def test_pandas_udf_scorer_equals_column_scorer(spark):
    @F.pandas_udf("double")
    def ir_model(x: pd.Series) -> pd.Series:
        return x * 1.5 - 10.0

    df = spark.createDataFrame([(i,) for i in range(0, 101, 7)], "PrmWeightedIR_1 int")
    col_scores = score(df, {"ir": F.col("PrmWeightedIR_1") * 1.5 - 10.0, "cr": F.lit(0.0), "loi": F.lit(5.0)})
    udf_scores = score(df, {"ir": lambda d: ir_model(F.col("PrmWeightedIR_1")), "cr": F.lit(0.0), "loi": F.lit(5.0)})
    assert sorted(map(tuple, col_scores.collect())) == sorted(map(tuple, udf_scores.collect()))


def test_staging_csv_all_text_and_error_if_exists(spark):
    base = tempfile.mkdtemp(prefix="sq-stage-")
    df = spark.createDataFrame([("FRA", "13"), ("DEU", "91")], "Audience_Country_A3 string, Company string")
    path = write_lookup_csv(df, os.path.join(base, "commission"))
    back = read_lookup_csv(spark, path, COMMISSION_SCHEMA)
    assert dict(back.dtypes) == {"Audience_Country_A3": "string", "Company": "string"}
    create_namespace(spark, "sq_test_ns", location=os.path.join(base, "ns"))
    name = "sq_test_ns.commission"
    stage_lookup(back, name)
    assert sorted(map(tuple, spark.table(name).collect())) == [("DEU", "91"), ("FRA", "13")]
    with pytest.raises(Exception):
        stage_lookup(back, name)  # default mode refuses to overwrite
    stage_lookup(back, name, mode="overwrite")


def test_quote_plan_has_no_shuffle_join(spark):
    import __spark_entry__ as e
    plan = e.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert plan.count("BroadcastHashJoin") >= 10
    assert "CollectMetrics" in plan


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns[:9] == ["proposal_id", "proposal_uuid", "revision_number", "proposal_country_code",
                              "audience_uuid", "currency_code", "HighPrice", "LowPrice", "Strand2Price"]
    assert df.count() > 0


def test_lookup_over_bound_falls_back_to_shuffle_join_same_result(spark):
    from dataclasses import replace
    from samplequote.operators.scoring import demo_scorers
    from samplequote.params import DEFAULT_PARAMS
    from samplequote.plans.quote import prepare_lookups, quote
    from samplequote.sources import fixtures as fx
    from samplequote.sources.tables import Tables
    t = Tables(spark, SF_SMALL)
    small = replace(DEFAULT_PARAMS, max_broadcast_factors=10, max_broadcast_commission=1)
    lk = prepare_lookups(fx.fx_price_factors(t), fx.fx_commission(t), fx.fx_rates(t), small)
    assert not lk.factors_fit and not lk.commission_fit and lk.rates_fit
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = quote(fx.fx_audience(t), lk, demo_scorers(), small)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        got = sorted(map(tuple, df.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    import __spark_entry__ as e
    want = sorted(map(tuple, e.entry(spark).collect()), key=repr)
    assert got == want


def test_stream_uses_per_request_country_count(spark):
    import json
    from samplequote.plans.quote import prepare_lookups
    from samplequote.streaming.stream import quote_stream
    base = tempfile.mkdtemp(prefix="sq-stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    with open(os.path.join(src, "r.json"), "w") as fh:
        fh.write(json.dumps(SAMPLE) + "\n")
    schema = ", ".join(f"{c} string" for c in ("RegionID", "BrandID", "ProductID", "CountryID", "LOI",
                                                 "Client_Segment", "Client"))
    factors = spark.createDataFrame([], schema + ", " + ", ".join(
        f"{c} string" for c in __import__("samplequote.schemas", fromlist=["x"]).FACTOR_NUMERIC) + ", Rate_Currency string")
    comm = spark.createDataFrame([("ITA", "13")], "Audience_Country_A3 string, Company string")
    rates = spark.createDataFrame([("EUR", "2023-01", "1.1")], "From_Currency string, month string, Rate string")
    lk = prepare_lookups(factors, comm, rates)
    scorers = {"ir": F.col(COUNTRY_COUNT) * 10.0, "cr": F.lit(0.0), "loi": F.lit(10.0)}
    stream = spark.readStream.schema(REQUEST_DDL).json(src)
    out = quote_stream(stream, lk, scorers)
    q = out.writeStream.format("memory").queryName("sq_stream_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM sq_stream_test").collect()
    assert len(rows) == 4  # ITA audiences priced (NULL: no factors), PRT without company
    assert {r.fieldwork_company for r in rows} == {"13", None}


def test_schema_report_lists_columns_and_types(spark):
    from samplequote.sources.staging import schema_report
    df = spark.createDataFrame([("a", 1.0)], "Rate_Currency string, Low_IR_Used double")
    assert schema_report(df) == [("Rate_Currency", "string"), ("Low_IR_Used", "double")]


def test_refreshing_stream_reads_lookups_per_batch(spark):
    import json
    from samplequote.plans.quote import prepare_lookups
    from samplequote.schemas import FACTOR_NUMERIC
    from samplequote.streaming.stream import stream_quotes_refreshing
    base = tempfile.mkdtemp(prefix="sq-refresh-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    with open(os.path.join(src, "r1.json"), "w") as fh:
        fh.write(json.dumps(SAMPLE) + "\n")
    keys = ("RegionID", "BrandID", "ProductID", "CountryID", "LOI", "Client_Segment", "Client")
    schema = ", ".join(f"{c} string" for c in keys + FACTOR_NUMERIC + ("Rate_Currency",))
    calls = []

    def load():
        calls.append(1)
        rates = spark.createDataFrame([("EUR", "2023-01", str(1.0 + len(calls)))],
                                      "From_Currency string, month string, Rate string")
        return prepare_lookups(spark.createDataFrame([], schema),
                               spark.createDataFrame([("ITA", "13")], "Audience_Country_A3 string, Company string"),
                               rates)

    q = stream_quotes_refreshing(spark, src, load, {"ir": F.lit(50.0), "cr": F.lit(0.0), "loi": F.lit(10.0)},
                                 __import__("samplequote.params", fromlist=["x"]).DEFAULT_PARAMS,
                                 os.path.join(base, "out"))
    q.awaitTermination()
    assert len(calls) >= 1
    out = spark.read.parquet(os.path.join(base, "out", "data"))
    assert out.count() == 4 and "epoch" in out.columns


def test_input_is_dealt_only_when_the_session_asks(spark):
    from samplequote.sources.tables import spread
    df = spark.range(0, 100, 1, 1)
    assert spread(df, ["id"]) is df
    spark.conf.set("spark.samplequote.inputPartitions", "3")
    try:
        assert spread(df, ["id"]).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.samplequote.inputPartitions")


def test_hot_proposal_is_paged_not_collected_whole(spark):
    flat = flatten_request(sample_requests(spark, [SAMPLE]))
    one = flat.where("proposal_country_code = 'ITA' AND audience_uuid = 'u1'")
    # one proposal holding 3,000 audiences (a hot key)
    hot = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2999)))) \
        .withColumn("audience_uuid", F.concat(F.lit("u-"), F.col("k").cast("string"))).drop("k")
    docs = nest_requests(hot, page_size=100)
    sizes = [r.n for r in docs.select(F.aggregate("countries", F.lit(0),
                                                  lambda acc, c: acc + F.size(c["audiences"])).alias("n")).collect()]
    assert sum(sizes) == 3000                      # every audience kept
    assert 20 <= len(sizes) <= 30                  # about ceil(3000 / 100) pages
    assert max(sizes) <= 200                       # no document near the whole proposal
    pages = docs.select("page_no", "page_count").collect()
    assert {r.page_count for r in pages} == {30} and len({r.page_no for r in pages}) == len(pages)
    # the country count is the proposal's, whatever the page size
    counted = docs.withColumn("countries", country_counts_in_request(F.col("countries")))
    counts = counted.select(F.explode("countries").alias("c")).select(f"c.{COUNTRY_COUNT}").distinct().collect()
    assert [r[0] for r in counts] == [3000]
    batch = with_country_count(hot, "proposal").select(COUNTRY_COUNT).distinct().collect()
    assert [r[0] for r in batch] == [3000]


def test_scorers_get_the_count_however_they_name_it(spark):
    from samplequote.operators.scoring import demo_scorers, needs_column
    from samplequote.operators.features import with_features
    feats = with_features(flatten_request(sample_requests(spark, [SAMPLE])), None)
    assert not needs_column(demo_scorers(), COUNTRY_COUNT, feats)
    for c in (F.col(COUNTRY_COUNT.lower()) * 1.0, F.expr(f"`{COUNTRY_COUNT}` + 1"), F.size(F.array(F.struct("*")))):
        assert needs_column({**demo_scorers(), "ir": c}, COUNTRY_COUNT, feats)
    assert needs_column({**demo_scorers(), "ir": lambda df: F.lit(1.0)}, COUNTRY_COUNT, feats)


def test_three_fitted_pipelines_with_equal_column_names(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from samplequote.operators.features import with_features
    from samplequote.operators.scoring import apply_scorers
    feats = with_features(flatten_request(sample_requests(spark, [SAMPLE])), "batch")
    train = feats.withColumn("label", F.col("SoldLOI") * 2.0)
    models = {}
    for name, col in (("ir", "PrmWeightedIR_1"), ("cr", COUNTRY_COUNT), ("loi", "SoldLOI")):
        model = Pipeline(stages=[VectorAssembler(inputCols=[col], outputCol="features"),
                                 LinearRegression(labelCol="label")]).fit(train)
        models[name] = (model, "prediction")
    rows = apply_scorers(feats, models).select("_ir_score", "_cr_score", "_loi_score", "SoldLOI").collect()
    assert len(rows) == 4 and all(abs(r._loi_score - 2 * r.SoldLOI) < 1e-6 for r in rows)


def test_documents_hold_several_countries_and_audiences(spark):
    from samplequote.plans import queries as q
    countries = q.q_explode_countries(spark, SF_SMALL)
    n = countries.count()
    assert n < q.q_explode_audiences(spark, SF_SMALL).count()
    assert countries.where("n_audiences > 1").count() > 10
    assert countries.groupBy("proposal_id").count().where("count > 1").count() > 100


@pytest.mark.parametrize("name, column", [("company_validity", "company_valid"), ("duplicate_factors", "LOI"),
                                          ("score_responses", "Athena_CR"), ("four_way_cpi", "Account_Athena_CPI")])
def test_rows_that_could_fail(spark, name, column):
    from samplequote.plans import queries as q
    got = q.QUERIES[name](spark, SF_SMALL).select(column).distinct().limit(2).count()
    assert got >= (1 if name == "duplicate_factors" else 2)


def test_price_band_is_a_band(spark):
    from samplequote.plans import queries as q
    assert q.q_price_band(spark, SF_SMALL).where("HighPriceUSD > LowPriceUSD").count() > 0


def test_lookups_are_stored_once(spark):
    from samplequote.plans.quote import prepare_lookups
    from samplequote.sources import fixtures as fx
    from samplequote.sources.tables import Tables

    t = Tables(spark, SF_SMALL)
    lk = prepare_lookups(fx.fx_price_factors(t), fx.fx_commission(t), fx.fx_rates(t))
    for df in (lk.factors, lk.rated, lk.commission, lk.rates):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan
    rated = {r.Rate_Currency for r in lk.rated.where("usd_rate is not null").select("Rate_Currency").distinct().collect()}
    known = {r.From_Currency for r in lk.rates.collect()}
    assert rated and {c.upper() for c in rated} <= known
    assert lk.rated.count() == lk.factors.count()


def test_several_rates_of_a_currency_fan_factors_out(spark):
    from samplequote.plans.quote import prepare_lookups
    from samplequote.sources import fixtures as fx
    from samplequote.sources.tables import Tables

    t = Tables(spark, SF_SMALL)
    rates = spark.createDataFrame([("USD", "2001-06", "1"), ("USD", "2001-06", "2")], "From_Currency string, month string, Rate string")
    lk = prepare_lookups(fx.fx_price_factors(t), fx.fx_commission(t), rates)
    usd = lk.factors.where("upper(Rate_Currency) = 'USD'").count()
    assert usd and lk.rated.count() == lk.factors.count() + usd


def test_broadcast_bound_counts_rows_and_bytes(spark):
    from samplequote.operators.broadcast import fits_broadcast

    df = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    assert fits_broadcast(df, 10)
    assert not fits_broadcast(df, 9)
    assert not fits_broadcast(df, 10, max_bytes=9000)
    assert fits_broadcast(spark.createDataFrame([], "t string"), 0)
