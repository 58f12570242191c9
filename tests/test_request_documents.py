"""Documents of ``write_request_documents``: whole at any size, moved once, read in parts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from samplequote.operators.flatten import flatten_request
from samplequote.plans import queries as q
from samplequote.schemas import FLAT_REQUEST_COLUMNS
from samplequote.sources import fixtures as fx
from samplequote.sources import requests
from samplequote.sources.tables import Tables
from test_reference_features import executed, fresh


def rows(df):
    return sorted(map(tuple, df.select(*FLAT_REQUEST_COLUMNS).collect()), key=repr)


def texts(path):
    return [open(os.path.join(path, name), encoding="utf-8", newline="\n").read() for name in sorted(os.listdir(path)) if name.startswith("part-")]


def odd_rows(spark):
    flat = fx.fx_country_proposals(Tables(spark, SF_SMALL)).where("proposal_id < 4").select(*FLAT_REQUEST_COLUMNS)
    names = F.array(F.lit('a\t"tab"\n'), F.lit(']}\n'), F.lit('{"proposal_id":1'), F.lit(',{"country_code":'), F.lit(None).cast("string"), F.lit("中 é"))
    flat = flat.withColumn("audience_name", F.get(names, F.col("audience_completes").cast("int") / 100 % 6))
    odd = flat.where("audience_waves = 1")
    return (flat.union(odd).union(odd.where("proposal_id = 1").withColumn("proposal_id", F.lit(None).cast("long")))
            .union(odd.withColumn("proposal_country_code", F.lit(None).cast("string")))
            .union(odd.limit(1).withColumn("proposal_id", F.lit(99).cast("long")))
            .union(odd.limit(1).withColumn("proposal_id", F.lit(98).cast("long")).withColumn("proposal_country_code", F.lit('\t"]')))).cache()


def test_a_document_is_not_cut_at_any_size(spark):
    n = 1_000_300
    one = fx.fx_country_proposals(Tables(spark, SF_SMALL)).select(*FLAT_REQUEST_COLUMNS).limit(1)
    flat = (spark.range(n).crossJoin(F.broadcast(one)).withColumn("audience_uuid", F.concat(F.lit("u-"), F.col("id").cast("string")))
            .withColumn("proposal_country_code", (F.col("id") % 3).cast("string")).select(*FLAT_REQUEST_COLUMNS))
    path = requests.write_request_documents(flat, fresh("large"), compression="gzip")
    fragments = spark.read.option("lineSep", "\t").text(path)
    assert fragments.where(F.col("value").contains('"page_no":')).count() == 1
    assert [tuple(r) for r in requests.count_request_documents(spark, path).select("documents").collect()] == [(1,)]
    hashes = [F.count("*").alias("n"), F.sum(F.xxhash64("u").cast("decimal(38,0)")).alias("h")]
    countries = requests.read_request_documents(spark, path).select("page_count", F.explode("countries").alias("c"))
    found = (countries.select("page_count", "c.country_audiences", "c.country_code", F.explode("c.audiences.audience_uuid").alias("u"))
             .groupBy("page_count", "country_audiences", "country_code").agg(*hashes).collect())
    want = flat.select(F.col("proposal_country_code").alias("country_code"), F.col("audience_uuid").alias("u")).groupBy("country_code").agg(*hashes).collect()
    assert sorted(map(tuple, found)) == sorted((1, w.n, *w) for w in want) and sum(w.n for w in want) == n


def test_rows_move_once_to_their_documents(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen, store = [], requests.stored_lookup
    monkeypatch.setattr(requests, "stored_lookup", lambda df, label: seen.append(label) or store(df, label))
    try:
        flat = fx.fx_country_proposals(Tables(spark, SF_SMALL)).select(*FLAT_REQUEST_COLUMNS)
        plan = executed(requests.request_fragments(flat))
        assert seen == ["fragment-rows", "request-countries"]
        assert "Join" not in plan and "rangepartitioning" not in plan and plan.count("REPARTITION_BY_NUM") == 1
        assert "_document" not in plan
        read = executed(q.q_request_documents(spark, SF_SMALL))
        assert "hashpartitioning" not in read and "SortMergeJoin" not in read
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_are_ordered_and_whole(spark):
    flat = odd_rows(spark)
    want = {}
    for r in flat.select("proposal_id", "proposal_country_code", requests._audience().alias("a")).select("proposal_id", "proposal_country_code", F.to_json("a", requests._NULLS).alias("a")).collect():
        want.setdefault(r[0], {}).setdefault(r[1], []).append(r[2])
    for dealt in (flat.repartition(1), flat.repartition(5)):
        lines = [line for text in texts(requests.write_request_documents(dealt, fresh("whole"), compression="none")) for line in text.split("\n") if line.strip()]
        docs = [json.loads(line) for line in lines]
        assert len(docs) == len(want) and {d["proposal_id"] for d in docs} == set(want)
        for d in docs:
            of = want[d["proposal_id"]]
            assert [c["country_code"] for c in d["countries"]] == sorted(of, key=lambda c: (c is not None, c or ""))
            assert all(c["audiences"] == [json.loads(a) for a in sorted(of[c["country_code"]])] and c["country_audiences"] == len(c["audiences"]) for c in d["countries"])
            assert (d["page_no"], d["page_count"]) == (0, 1)


def test_documents_are_read_alike_in_parts(spark):
    flat = odd_rows(spark)
    path = requests.write_request_documents(flat, fresh("parts"))
    want = rows(flat)
    assert rows(flatten_request(requests.read_requests(spark, path))) == want
    n = len({r[0] for r in want})
    for chars in (1, 2_000, 1 << 30):
        docs = requests.read_request_documents(spark, path, chars)
        assert rows(flatten_request(docs)) == want
        assert docs.where("part_no = 0").count() == n
        assert (docs.count() == len(want)) if chars == 1 else (docs.count() == n) == (chars > 2_000)
    of = {r.proposal_id: r.documents for r in requests.count_request_documents(spark, path).collect()}
    assert set(of.values()) == {1} and len(of) == n
    cut = requests.write_request_documents(flat, fresh("pages"), document_rows=7)
    assert rows(flatten_request(requests.read_request_documents(spark, cut))) == want
    pages = {r[0]: r[1] for r in requests.read_requests(spark, cut).groupBy("proposal_id").count().collect()}
    assert pages == {r[0]: r[1] for r in requests.count_request_documents(spark, cut).collect()} and max(pages.values()) > 1


def test_cut_files_are_refused():
    import pyarrow as pa

    def read(*found):
        return [r for b in requests._parts(10)(iter([pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])])) for r in b.to_pylist()]
    whole = ('{"proposal_id":1,"countries":[', '{"country_code":"A","country_audiences":1,"audiences":[', '{"audience_uuid":"u"}', "]}]}\n")
    assert [json.loads(r["json"])["countries"][0]["audiences"] for r in read(*whole)] == [[{"audience_uuid": "u"}]]
    with pytest.raises(ValueError, match="begin"):
        read(*whole[2:])
    with pytest.raises(ValueError, match="end"):
        read(*whole[:3])
