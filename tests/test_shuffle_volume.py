"""What moves: joins of the request rows, nested documents, records, stored features."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from samplequote.operators.flatten import flatten_request
from samplequote.plans import queries as q
from samplequote.sources import fixtures as fx
from samplequote.sources import requests, sinks
from samplequote.sources.tables import Tables
from test_reference_features import executed, quotes_of


def labels_of(monkeypatch, module):
    seen, store = [], module.stored_lookup
    monkeypatch.setattr(module, "stored_lookup", lambda df, label: seen.append(label) or store(df, label))
    return seen


def test_lines_move_for_parts_and_orders_only(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(fx, "MAX_BROADCAST_ORDERS", 0)
    try:
        few = fx.fx_audience(Tables(spark, SF_SMALL))
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan).count("l_suppkey") == 0
        assert sorted(k for k in re.findall(r"Exchange hashpartitioning\((\w+)#", plan) if k.startswith("l_")) == ["l_orderkey", "l_partkey"]
        rows = sorted(map(tuple, few.collect()), key=repr)
        monkeypatch.setattr(fx, "MAX_BROADCAST_SUPPLIERS", 1)
        many = fx.fx_audience(Tables(spark, SF_SMALL))
        assert "hashpartitioning(l_suppkey" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, many.collect()), key=repr) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_countries_are_counted_for_paged_documents_only(spark, monkeypatch):
    flat = fx.fx_audience(Tables(spark, SF_SMALL)).where("proposal_id < 40").select(*q.FLAT_REQUEST_COLUMNS).cache()
    seen = labels_of(monkeypatch, requests)
    one = requests.nest_requests(flat)
    assert seen == ["request-rows", "request-pages"]
    assert sorted(map(tuple, flatten_request(one).collect()), key=repr) == sorted(map(tuple, flat.collect()), key=repr)
    paged = requests.nest_requests(flat, page_size=3)
    assert seen[2:] == ["request-rows", "request-pages", "request-counts"]
    assert paged.where("page_count > 1").count() > 0
    assert sorted(map(tuple, flatten_request(paged).collect()), key=repr) == sorted(map(tuple, flat.collect()), key=repr)
    def counts(docs):
        return {tuple(r) for r in docs.select("proposal_id", F.explode("countries").alias("c")).select("proposal_id", "c.country_code", "c.country_audiences").collect()}
    assert counts(paged) == counts(one)
    monkeypatch.setattr(requests, "MAX_BROADCAST_PAGED", 0)
    assert counts(requests.nest_requests(flat, page_size=3)) == counts(one)


def test_documents_are_formed_where_their_rows_lie(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(fx, "MAX_BROADCAST_ORDERS", 0)
    stored, store = {}, requests.stored_lookup

    def keep(df, label):
        stored[label] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, label)
    monkeypatch.setattr(requests, "stored_lookup", keep)
    try:
        for query in (q.q_request_json, q.q_explode_audiences):
            docs = query(spark, SF_SMALL)
            assert "Exchange" not in executed(docs)
            moved = re.findall(r"Exchange hashpartitioning\((\w+)#", stored["request-parts"])
            assert "l_orderkey" in moved and not {"proposal_id", "_d1", "_d2"} & set(moved)
        assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "false"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_are_the_same_wherever_their_rows_lie(spark, monkeypatch):
    flat = fx.fx_audience(Tables(spark, SF_SMALL)).where("proposal_id < 50").select(*q.FLAT_REQUEST_COLUMNS)
    odd = flat.where("proposal_id % 4 = 0")
    flat = (flat.union(odd).union(odd.withColumn("proposal_id", F.lit(None).cast("long")))
            .union(odd.withColumn("proposal_country_code", F.lit(None).cast("string")).withColumn("brand", F.lit("other")))).cache()

    def rows(docs):
        return sorted(map(tuple, docs.collect()), key=repr)
    whole, paged = rows(requests.nest_requests(flat)), rows(requests.nest_requests(flat, page_size=3))
    assert len(paged) > len(whole)
    for run_rows, most, dealt in ((50_000, 100_000, flat.repartition(4)), (7, 0, flat.repartition(3, "proposal_id"))):
        monkeypatch.setattr(requests, "RUN_ROWS", run_rows)
        monkeypatch.setattr(requests, "MAX_BROADCAST_PAGED", most)
        assert rows(requests.nest_requests(dealt, together=True)) == whole
        assert rows(requests.nest_requests(dealt, page_size=3, together=True)) == paged


def test_each_arrival_is_nested_from_its_own_rows(spark, monkeypatch):
    seen, nest = [], q.nest_requests
    monkeypatch.setattr(q, "nest_requests", lambda flat: seen.append({r[0] for r in flat.select("revision_number").distinct().collect()}) or nest(flat))
    assert q.q_stream_refreshed(spark, SF_SMALL).count() > 0
    assert seen == [{1}, {2, 3}]


def test_streamed_requests_do_not_depend_on_an_earlier_query(spark, monkeypatch):
    q.q_request_scan(spark, SF_SMALL)
    seen, write = [], q.write_requests
    monkeypatch.setattr(q, "write_requests", lambda docs, path: seen.append(path) or write(docs, path))
    assert q.q_stream_quotes(spark, SF_SMALL).count() > 0 and len(seen) == 1


def test_models_are_fitted_on_stored_features(spark):
    plan = executed(q.q_score_model(spark, SF_SMALL))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_quotes_are_computed_once_and_only_large_proposals_ranked(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x
    quotes = quotes_of(spark, 300)
    made = quotes.withColumn("audience_uuid", F.udf(count, "string")("audience_uuid"))
    ranked, rank = [], sinks.rank_rows
    monkeypatch.setattr(sinks, "rank_rows", lambda rows, *a: ranked.append({r[0] for r in rows.select("proposal_id").collect()}) or rank(rows, *a))
    pages = sinks.quote_records(made, page_records=50).collect()
    assert seen.value == quotes.count() and ranked == [{1}]
    assert sorted(r.n_records for r in pages if r.proposal_id == 1) == [50] * 6
    one = sinks.quote_records(quotes).collect()
    assert ranked == [{1}] and all((r.page_no, r.page_count) == (0, 1) for r in one)
    whole = sinks.join_pages([r.records for r in sorted((r for r in pages if r.proposal_id == 1), key=lambda r: r.page_no)])
    assert whole == next(r.records for r in one if r.proposal_id == 1)


def test_all_queries_on_documents_form_them_where_rows_lie(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(fx, "MAX_BROADCAST_ORDERS", 0)
    seen = labels_of(monkeypatch, requests)
    try:
        for query in (q.q_flatten_request, q.q_audience_positions, q.q_explode_countries):
            assert "Exchange" not in executed(query(spark, SF_SMALL))
            assert "request-parts" in seen and "request-rows" not in seen
            seen.clear()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_proposal_of_most_rows_is_formed_by_several_tasks(spark, monkeypatch):
    flat = fx.fx_country_proposals(Tables(spark, SF_SMALL)).select(*q.FLAT_REQUEST_COLUMNS)
    large = flat.where("proposal_id = 3").select("*", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("_i"))
    flat = flat.where("proposal_id <> 3").union(large.withColumn("audience_uuid", F.concat_ws("-", "audience_uuid", "_i")).drop("_i")).repartition(6).cache()
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    stored, store = {}, requests.stored_lookup

    def keep(df, label):
        stored[label] = store(df, label)
        return stored[label]
    monkeypatch.setattr(requests, "stored_lookup", keep)

    def rows(docs):
        return sorted(map(tuple, docs.collect()), key=repr)
    whole = rows(requests.nest_requests(flat))
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = flat.join(spark.range(100).select(F.col("id").alias("proposal_id")).hint("merge"), "proposal_id")
        assert rows(requests.nest_requests(joined, together=True)) == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = stored["request-parts"].groupBy("_document.proposal_id").agg(F.sum("_n").alias("n"), F.count("*").alias("parts"))
    most = parts.orderBy(F.desc("n")).first()
    assert most.proposal_id == 3 and most.parts > 1
