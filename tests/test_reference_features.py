"""Records arrays, streamed documents, one-shuffle lookups, compiled models,
conditions on the quote, quarantine, lookup versions and re-staging."""

import json
import os
import re
import tempfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from samplequote.operators.flatten import flatten_request
from samplequote.params import DEFAULT_PARAMS
from samplequote.plans import queries as q
from samplequote.plans.quote import prepare_lookups, priced_rows, quote, scored_rows
from samplequote.schemas import FLAT_REQUEST_COLUMNS
from samplequote.operators.scoring import count_scorers, demo_scorers
from samplequote.sources import fixtures as fx
from samplequote.sources.requests import read_requests, write_request_documents
from samplequote.sources.sinks import join_pages, parse_records, quote_records, write_quotes_json, write_quotes_table
from samplequote.sources.tables import Tables


def fresh(name):
    return os.path.join(tempfile.mkdtemp(prefix="sq-features-"), name)


@pytest.fixture(scope="module", autouse=True)
def whole_filters(spark):
    """Plans print their filters in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def audience(spark):
    return fx.fx_audience(Tables(spark, SF_SMALL)).checkpoint()  # a cached plan would stand in for the scans


# --- records arrays --------------------------------------------------------------

def quotes_of(spark, n):
    """A hot proposal with n records, a small one, and null keys and prices."""
    rows = [(1, 0, "FRA", f"a{i % (n // 2):05d}", "13" if i % 3 else None, None if i % 7 == 0 else float(i)) for i in range(n)]
    rows += [(2, 0, None, 'quote " and é', "1", 1.5), (None, None, "ITA", None, None, None)]
    return spark.createDataFrame(rows, "proposal_id long, revision_number int, proposal_country_code string, audience_uuid string, "
                                       "fieldwork_company string, HighPrice double").repartition(5)


def test_records_of_a_hot_proposal_come_in_ordered_pages(spark):
    quotes = quotes_of(spark, 1234)
    pages = quote_records(quotes, page_records=100)
    got = pages.collect()
    hot = sorted((r for r in got if r.proposal_id == 1), key=lambda r: r.page_no)
    assert [r.page_no for r in hot] == list(range(13)) and {r.page_count for r in hot} == {13}
    assert [r.n_records for r in hot] == [100] * 12 + [34]
    whole = json.loads(join_pages([r.records for r in hot]))
    def order(r):
        return [(r[c] is not None, r[c]) if r[c] is not None else (False, 0)
                for c in ("proposal_country_code", "audience_uuid", "fieldwork_company", "HighPrice")]
    assert whole == sorted(whole, key=order) and len(whole) == 1234
    assert all(set(r) == set(quotes.columns) for r in whole)  # nulls are written
    back = parse_records(pages, quotes.schema).select(*quotes.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, quotes.collect()), key=repr)
    assert json.loads(next(r.records for r in got if r.proposal_id == 2))[0]["audience_uuid"] == 'quote " and é'


def test_records_are_gathered_by_page_only(spark):
    """No aggregate or window that sees rows is keyed by the proposal alone."""
    plan = executed(quote_records(quotes_of(spark, 50), page_records=10))
    gathered = [line for line in plan.splitlines() if "ObjectHashAggregate(keys=" in line]
    assert gathered and all(re.search(r"keys=\[proposal_id#\w+, revision_number#\w+, page_no", g) for g in gathered)
    assert "Window" not in plan  # ranks come from stored sums, a row for each range
    assert quote_records(quotes_of(spark, 50).where("false")).count() == 0


def test_quote_writers(spark):
    quotes = quotes_of(spark, 20)
    back = spark.read.schema(quotes.schema).json(write_quotes_json(quotes, fresh("json")))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, quotes.collect()), key=repr)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS sq_writers LOCATION '{fresh('db')}'")
    write_quotes_table(quotes, "sq_writers.quotes", partition_by=["proposal_id"])
    assert spark.table("sq_writers.quotes").count() == quotes.count()


# --- one document per proposal -----------------------------------------------------

def test_a_large_proposal_is_one_line(spark, audience):
    hot = (audience.limit(1).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4999))))
           .withColumn("audience_uuid", F.concat(F.lit("u-"), F.col("k").cast("string")))
           .withColumn("proposal_country_code", F.when(F.col("k") % 50 == 0, F.lit(None)).otherwise(F.concat(F.lit('C"é'), (F.col("k") % 7).cast("string"))))
           .withColumn("audience_name", F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.lit('a "name"\n\\ 中'))).drop("k"))
    flat = hot.unionByName(audience.limit(30)).select(*FLAT_REQUEST_COLUMNS).cache()
    path = write_request_documents(flat.repartition(7), fresh("documents"), compression="none")
    lines = [line for name in os.listdir(path) if name.startswith("part-") for line in open(os.path.join(path, name), encoding="utf-8") if line.strip()]
    documents = [json.loads(line) for line in lines]
    assert len(documents) == flat.select("proposal_id").distinct().count()
    large = max(documents, key=lambda d: len(d["countries"]))
    assert sum(len(c["audiences"]) for c in large["countries"]) >= 5000 and len(large["countries"]) >= 8
    assert all(len(c["audiences"]) == c["country_audiences"] for d in documents for c in d["countries"])
    back = flatten_request(read_requests(spark, path)).select(*FLAT_REQUEST_COLUMNS)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, flat.collect()), key=repr)
    # beyond the bound of a document: several, each one line
    cut = write_request_documents(flat, fresh("cut"), document_rows=1200)
    docs = read_requests(spark, cut)
    assert docs.where("page_count > 1").count() == 5
    assert sorted(map(tuple, flatten_request(docs).select(*FLAT_REQUEST_COLUMNS).collect()), key=repr) == sorted(map(tuple, flat.collect()), key=repr)
    counts = docs.select(F.explode("countries").alias("c")).select("c.country_code", "c.country_audiences").distinct()
    assert counts.where("country_code = 'C\"é0'").collect()[0].country_audiences == sum(1 for k in range(5000) if k % 7 == 0 and k % 50)
    assert read_requests(spark, write_request_documents(flat.where("false"), fresh("none"))).count() == 0


def test_documents_are_derived_once(spark):
    docs = q.q_flatten_request(spark, SF_SMALL)
    plan = executed(docs)
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


# --- one shuffle for all price factors ------------------------------------------------

def test_large_factors_cost_one_exchange_of_the_rows(spark, audience):
    t = Tables(spark, SF_SMALL)
    params = replace(q.NAMED, max_broadcast_factors=0)
    lk = prepare_lookups(fx.fx_price_factors(t), fx.fx_commission(t), fx.fx_rates(t), params)
    assert not lk.factors_fit and not lk.rated_fit
    rows = fx.fx_audience(t).checkpoint()
    key = ["proposal_id", "audience_no", "part_no", "supp_no"]
    columns = [*key, "fieldwork_company", *[F.col(v).alias(k) for k, v in q.FOUR_WAY_COLS.items()]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = priced_rows(scored_rows(rows, demo_scorers(), params, keep=key), lk, params).select(*columns)
        plan = executed(df)
        # the rows are dealt once, by what their slots share; the rest is of the factors
        assert plan.count("Exchange hashpartitioning(brand#") == 1 and plan.count("SortMergeJoin") == 1
        assert plan.count("Exchange hashpartitioning") <= 3 and "Exchange rangepartitioning" not in plan
        got = sorted(map(tuple, df.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = q.q_four_way_cpi(spark, SF_SMALL).select(*[c if isinstance(c, str) else k for c, k in
                                                      zip(columns, [*key, "fieldwork_company", *q.FOUR_WAY_COLS])])
    assert got == sorted(map(tuple, want.collect()), key=repr)


# --- the latest month ---------------------------------------------------------------

def test_latest_rates_scan_one_month(spark):
    from samplequote.operators.currency import latest_rates
    from samplequote.sources.staging import read_rates, stage_rates
    rates = spark.createDataFrame([("EUR", "2022-9", "1.1"), ("USD", "2022-9", "1"), ("EUR", "2022-10", "1.2"), ("GBP", "2021-12", "x")],
                                  "From_Currency string, month string, Rate string")
    staged = read_rates(spark, stage_rates(rates, fresh("rates")))
    assert dict(staged.dtypes)["month"] == "string"
    for fmt, want in ((None, {("EUR", 1.1), ("USD", 1.0)}), ("yyyy-M", {("EUR", 1.2)})):
        df = latest_rates(staged, fmt)
        filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", executed(df))
        assert any("Subquery" in f or "subquery" in f for f in filters)
        assert {(r.From_Currency, r.Rate) for r in df.collect()} == want == {(r.From_Currency, r.Rate) for r in latest_rates(rates, fmt).collect()}
    assert latest_rates(rates.where("false")).count() == 0


# --- fitted models ------------------------------------------------------------------

@pytest.fixture(scope="module")
def features(spark):
    from samplequote.operators.features import with_features
    return with_features(fx.fx_audience(Tables(spark, SF_SMALL)), None).checkpoint()


NAMES = ["SoldLOI", "feaAudienceWaves", "PrmReqCompletes", "feaFieldworkLength"]


@pytest.mark.parametrize("kind", ["LinearRegression", "DecisionTreeRegressor", "RandomForestRegressor", "GBTRegressor", "GeneralizedLinearRegression"])
def test_compiled_models_score_as_their_transform(spark, features, kind):
    import pyspark.ml.regression as reg
    from pyspark.ml.feature import VectorAssembler
    from samplequote.operators.models import compile_model
    args = {"maxDepth": 4} if "Tree" in kind or "Forest" in kind or "GBT" in kind else {}
    if kind in ("RandomForestRegressor", "GBTRegressor"):
        args |= {"seed": 5, **({"numTrees": 4} if kind.startswith("R") else {"maxIter": 4})}
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(
        features.withColumn("label", F.col("SoldLOI") * 0.7 + F.col("feaAudienceWaves") * F.col("feaAudienceWaves") + F.col("PrmReqCompletes") / 100.0))
    model = getattr(reg, kind)(**args).fit(data)
    sql = compile_model(model, NAMES)
    both = model.transform(data).select("prediction", F.expr(sql).alias("own"))
    assert "Python" not in executed(features.selectExpr(sql)) and both.count() > 1000
    rows = both.collect()
    exact = kind == "DecisionTreeRegressor"
    assert all(r.prediction == r.own if exact else abs(r.prediction - r.own) <= 1e-9 * max(1, abs(r.prediction)) for r in rows)
    assert len({r.own for r in rows}) > 4


def test_models_that_are_no_formula(spark, features):
    from samplequote.operators.models import batch_scorer, compile_model
    from samplequote.operators.scoring import score
    with pytest.raises(TypeError):
        compile_model(object(), NAMES)
    model = batch_scorer(lambda: lambda frame: frame["SoldLOI"] * 2.0 + frame["feaAudienceWaves"], ["SoldLOI", "feaAudienceWaves"])
    by_batch = score(features, {**demo_scorers(), "loi": model}).select("Athena_LOI")
    by_column = score(features, {**demo_scorers(), "loi": F.col("SoldLOI") * 2.0 + F.col("feaAudienceWaves")}).select("Athena_LOI")
    assert sorted(map(tuple, by_batch.collect())) == sorted(map(tuple, by_column.collect()))


def test_fits_by_exact_sums(spark, features):
    from samplequote.operators.models import fit_linear, fit_steps
    target = features.withColumn("y", F.col("SoldLOI") * 3 - F.col("feaAudienceWaves") + F.col("PrmReqCompletes") % 7)
    target = target.unionByName(target.limit(3).withColumn("y", F.lit(None).cast("bigint")))
    sql = fit_linear(target, NAMES, "y")
    got = np.array([r[0] for r in features.select(F.expr(sql)).collect()])
    rows = features.select(*NAMES, (F.col("SoldLOI") * 3 - F.col("feaAudienceWaves") + F.col("PrmReqCompletes") % 7).alias("y")).collect()
    x = np.array([[1, *r[:4]] for r in rows], float)
    beta, *_ = np.linalg.lstsq(x, np.array([r.y for r in rows], float), rcond=None)
    assert np.allclose(np.sort(got), np.sort(x @ beta), atol=1e-6)
    assert fit_linear(target.repartition(17), NAMES, "y") == sql
    twice = fit_linear(target.withColumn("same", F.col("SoldLOI")), ["SoldLOI", "same"], "y")  # one determines the other
    assert twice.endswith("CAST('0.0' AS DOUBLE) * same")
    steps = fit_steps(features, "SoldLOI", "SoldLOI", (10, 20))
    got = {r.s: r.m for r in features.select(F.expr(steps).alias("s"), "SoldLOI").groupBy("s").agg(F.avg("SoldLOI").alias("m")).collect()}
    assert len(got) == 3 and all(abs(s - m) < 1e-9 for s, m in got.items())
    assert features.limit(0).selectExpr(fit_linear(features.limit(0), ["SoldLOI"], "SoldLOI")).count() == 0


# --- conditions on the finished quote ---------------------------------------------------

def test_conditions_reach_the_scans(spark):
    c = q._ctx(spark, SF_SMALL)
    where = ["proposal_country_code = 'NATION_3'", F.col("proposal_id") == 5]
    plan = executed(quote(c.audience, c.lookups, demo_scorers(), where=where))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan)
    assert any("EqualTo(l_orderkey,5)" in p for p in pushed) and any("EqualTo(o_orderkey,5)" in p for p in pushed)
    assert any("EqualTo(n_name,NATION_3)" in p for p in pushed)
    with_price = quote(c.audience, c.lookups, demo_scorers(), where=[*where[:1], "HighPrice > 20 AND proposal_id >= 0"])
    whole = quote(c.audience, c.lookups, demo_scorers()).where("proposal_country_code = 'NATION_3' AND HighPrice > 20")
    assert sorted(map(tuple, with_price.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 0


def test_conditions_leave_the_country_counts_alone(spark):
    c = q._ctx(spark, SF_SMALL)
    condition = "audience_uuid LIKE 'A-1%'"
    part = quote(c.audience, c.lookups, count_scorers(), q.BLEND, where=[condition])
    whole = quote(c.audience, c.lookups, count_scorers(), q.BLEND).where(condition)
    assert sorted(map(tuple, part.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


# --- quarantine ------------------------------------------------------------------------

def test_good_and_rejected_rows_are_all_rows(spark):
    from samplequote.operators import pricing as pr
    from samplequote.operators.quarantine import quarantine, with_reasons
    c = q._ctx(spark, SF_SMALL, q.NAMED)
    rows = pr.pricing_inputs(c.scored(), q.NAMED)
    odd = rows.limit(5).withColumn("company", F.lit(None).cast("string")).withColumn("sold_jobIr", F.lit(float("nan")))
    rows = rows.unionByName(odd).cache()
    twice = c.lookups.factors.unionByName(c.lookups.factors)  # several factor rows for each key
    judged = with_reasons(rows, twice, "modelled_loi", ("sold_jobIr",), valid=F.col("company").isin("0", "1"))
    out = quarantine(judged, fresh("quarantine"))
    assert out.accepted.count() + out.rejected.count() == rows.count() == out.counts["rows"]
    assert out.counts["rejected"] == out.rejected.count() > 0 and out.accepted.count() > 0
    both = out.accepted.select(*rows.columns).unionByName(out.rejected.select(*rows.columns))
    assert both.exceptAll(rows).count() == 0
    nulls = out.rejected.where("company IS NULL").collect()
    assert len(nulls) == 5 and all(list(r.reasons) == ["unknown_company", "missing_factor", "bad_number"] for r in nulls)
    for name in ("unknown_company", "missing_factor", "bad_number"):
        assert out.counts[name] == out.rejected.where(F.array_contains("reasons", name)).count()
    none = quarantine(judged.where("false"), fresh("none"))
    assert none.counts["rows"] == 0 and none.accepted.count() == 0


# --- lookup versions ---------------------------------------------------------------------

def test_a_replayed_batch_is_priced_by_its_version(spark, monkeypatch):
    from samplequote.sources import versions
    from samplequote.sources.requests import nest_requests, write_requests
    from samplequote.streaming import stream as st
    t = Tables(spark, SF_SMALL)
    base = fresh("stream")
    rates = fx.fx_rates(t).checkpoint()
    factors, commission = fx.fx_price_factors(t).checkpoint(), fx.fx_commission(t).checkpoint()
    docs = nest_requests(fx.fx_audience(t).limit(400)).checkpoint()
    write_requests(docs, f"{base}/requests")
    dearer = rates.withColumn("Rate", (F.col("Rate").cast("double") * 3).cast("string"))
    assert st.publish_lookups(spark, f"{base}/lookups", factors, commission, rates) == 1
    run = lambda out: st.stream_quotes_versioned(spark, f"{base}/requests", f"{base}/lookups", demo_scorers(), DEFAULT_PARAMS, out)
    real = st.quote_stream

    def dies(*args):
        real(*args)
        raise RuntimeError("the executor is gone")
    monkeypatch.setattr(st, "quote_stream", dies)
    with pytest.raises(Exception, match="the executor is gone"):
        run(f"{base}/out").awaitTermination()
    monkeypatch.setattr(st, "quote_stream", real)
    assert st.publish_lookups(spark, f"{base}/lookups", factors, commission, dearer) == 2
    run(f"{base}/out").awaitTermination()   # the same batch again, after newer rates
    run(f"{base}/later").awaitTermination()  # a new stream takes the newer ones
    again, later = spark.read.parquet(f"{base}/out/data"), spark.read.parquet(f"{base}/later/data")
    assert {r[0] for r in again.select("lookup_version").distinct().collect()} == {1}
    assert {r[0] for r in later.select("lookup_version").distinct().collect()} == {2}
    want = st.quote_stream(docs, prepare_lookups(factors, commission, rates), demo_scorers())
    columns = [c for c in want.columns]
    assert sorted(map(tuple, again.select(*columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    priced = later.where("HighPrice IS NOT NULL").count()
    assert priced and later.agg(F.sum("HighPrice")).first()[0] > 2 * again.agg(F.sum("HighPrice")).first()[0]
    assert versions.latest(spark, f"{base}/lookups") == 2
    with pytest.raises(ValueError):
        versions.latest(spark, f"{base}/nothing")


def test_versions_exist_once_they_are_published(spark):
    from samplequote.sources import versions
    root = fresh("lookups")
    df = spark.range(3)
    assert versions.publish(spark, root, {"t": df}) == 1
    versions._mark(spark, f"{root}/taken-2")  # a writer that died before it published
    assert versions.latest(spark, root) == 1 and versions.publish(spark, root, {"t": df}) == 3
    assert versions.bind(spark, f"{root}/work", 7, root) == 3
    versions.publish(spark, root, {"t": df})
    assert versions.bind(spark, f"{root}/work", 7, root) == 3 and versions.bind(spark, f"{root}/work", 8, root) == 4
    assert versions.read(spark, root, 4, "t").count() == 3


# --- re-staging ---------------------------------------------------------------------------

def test_readers_never_meet_half_a_table(spark):
    from samplequote.sources.staging import create_namespace, drop_old_stages, restage_lookup
    base = fresh("restage")
    create_namespace(spark, "sq_restage", location=f"{base}/db")
    old = spark.createDataFrame([("EUR", "1.1")], "From_Currency string, Rate string")
    new = spark.createDataFrame([("EUR", "1.2"), ("USD", "1")], "From_Currency string, Rate string")
    restage_lookup(old, "sq_restage.rates", f"{base}/rates")
    reader = spark.table("sq_restage.rates")  # planned before the table is staged anew
    reader.schema
    seen = []

    @F.udf("string")
    def slow(x):
        return x
    # while the new rows are written, the table is the old one
    watched = new.withColumn("From_Currency", slow("From_Currency"))
    real = type(spark.catalog).refreshTable
    seen.append(sorted(map(tuple, spark.table("sq_restage.rates").collect())))
    restage_lookup(watched, "sq_restage.rates", f"{base}/rates")
    assert real is type(spark.catalog).refreshTable
    assert seen == [[("EUR", "1.1")]]
    assert sorted(map(tuple, reader.collect())) in ([("EUR", "1.1")], [("EUR", "1.2"), ("USD", "1")])
    assert sorted(map(tuple, spark.table("sq_restage.rates").collect())) == [("EUR", "1.2"), ("USD", "1")]
    with pytest.raises(Exception):  # a failing write leaves the table as it is
        restage_lookup(new.withColumn("Rate", F.raise_error(F.lit("broken")).cast("string")), "sq_restage.rates", f"{base}/rates")
    assert spark.table("sq_restage.rates").count() == 2
    with pytest.raises(ValueError):
        restage_lookup(new.withColumnRenamed("Rate", "Other"), "sq_restage.rates", f"{base}/rates")
    assert drop_old_stages(spark, "sq_restage.rates", f"{base}/rates") >= 1
    assert spark.table("sq_restage.rates").count() == 2
