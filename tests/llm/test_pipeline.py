"""The registered queries on the smallest tables, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from conftest import SF_SMALL
from oracle_check import canon, duck
from samplequote.llm import common, exact_dedup, near_dedup
from samplequote.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    found = duck(SF_SMALL).execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(found.fetchall(), columns)


def test_stages(spark):
    docs = common.documents(spark, SF_SMALL)
    columns = docs.columns
    labels = common.labels(spark, SF_SMALL)
    for name, stage in p.STAGES[:-1]:
        out = common.stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert out.columns == columns and out.join(docs, columns, "left_anti").count() == 0
        lost = docs.join(out, "doc_id", "left_anti").join(labels, "doc_id")
        if name == "toxicity":
            assert lost.where("toxic = 0").count() <= 0.02 * docs.count()
        if name == "quality":
            assert lost.where("quality = 1").count() <= 0.02 * docs.count()
        docs = out
    texts = docs.select(exact_dedup.normalised(F.col("text")))
    assert texts.count() == texts.distinct().count()
    again = near_dedup.near_duplicates(docs, p.NEAR_WORDS, p.NEAR_PERCENT)
    assert again.where("not kept").count() == 0
    packed = p.packed(spark, docs, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three", "en", "s", 13), (1, "one two three", "en", "s", 13), (None, "one two three", None, None, None), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.doc_id for r in p.exact(spark, docs, SF_SMALL).collect()) == [1, 2]
    assert sorted(r.doc_id for r in p.near(spark, docs, SF_SMALL).collect()) == [1, 2]
    for name, stage in p.STAGES:
        assert stage(spark, docs.where("false"), SF_SMALL).count() == 0


def test_rows_are_told_apart_whatever_their_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, quality string, toxicity double, score double"
    long = " ".join(f"w{i}" for i in range(60))
    def table(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, 7, "q", 0.5, 0.5) for i, t in rows], schema)
    # equal after normalising, under one id; without an id
    assert p.exact(spark, table([(1, "one two three"), (1, "onetwo three")]), SF_SMALL).count() == 1
    assert p.exact(spark, table([(None, "one two"), (None, "one two"), (4, "one two")]), SF_SMALL).collect()[0].doc_id == 4
    assert p.exact(spark, table([(None, "one two"), (None, "one two"), (None, "another")]), SF_SMALL).count() == 2
    # near copies under one id; without an id
    assert p.near(spark, table([(1, long), (1, long + " more"), (2, "some other words of a text")]), SF_SMALL).count() == 2
    assert p.near(spark, table([(None, long), (None, long + " more"), (None, long.upper())]), SF_SMALL).count() == 1
    # a third of the rows under one id
    many = [(9, f"text number {i} of the very same id") for i in range(20)] + [(i, f"document {i} on its own matters") for i in range(40, 60)]
    assert p.exact(spark, table(many + many), SF_SMALL).count() == 40
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, table([(1, "clean words of a text"), (2, None)]), SF_SMALL)
        assert out.columns == table([]).columns


def test_texts_of_one_id_are_judged_each(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a = "seven tall zebras watch the brown fox from a distant green hill today"
    b = "nobody ever counted how many small boats left that quiet harbour before winter came"
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((0, a), (1, a), (1, b))], schema)
    assert sorted((r.doc_id, r.text) for r in p.exact(spark, table, SF_SMALL).collect()) == [(0, a), (1, b)]
    assert sorted((r.doc_id, r.text) for r in p.near(spark, table, SF_SMALL).collect()) == [(0, a), (1, b)]
    # a and b are each the smallest of their sets under one id, and only a is like another text
    words = " ".join(f"w{i}" for i in range(60))
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((0, words), (1, words + " more"), (1, b), (2, b))], schema)
    assert sorted((r.doc_id, r.text) for r in p.near(spark, table, SF_SMALL).collect()) == [(0, words), (1, b)]
