"""Cleaning pipeline over ``documents``: five stages, each written as Parquet and
read again as the next one's input.

Filtering stages return the columns of their input. Every row is judged by its
text, whatever its id: of rows with equal texts, or of near duplicates, one stays,
also where they share an id or have none (then one that has an id, if any). Empty
tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplequote.llm import common, crf_toxicity, exact_dedup, knn_quality, near_dedup, packing

#: Words of a shingle and percent of similarity in the near-duplicate stage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagging model does not reject."""
    common.ship(spark)
    model = crf_toxicity.fit_from_tables(docs, common.labels(spark, sf_dir), ~common.held_out("doc_id", 3, 1))
    name = _free(docs, "toxicity")
    return crf_toxicity.with_toxicity(docs, model, spans=False, score=name).where(F.col(name) < crf_toxicity.THRESHOLD).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours do not vote them out."""
    common.ship(spark)
    model = knn_quality.fit_from_tables(docs, common.labels(spark, sf_dir), ~common.held_out("doc_id", 5, 0))
    name = _free(docs, "quality")
    return knn_quality.with_quality(docs, model, score=name).where(F.col(name) >= knn_quality.THRESHOLD).drop(name)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column that tells its rows apart: the id, or where ids are null
    or repeated a number given to each row, the largest ones to rows without an id."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs, "doc_id"
    name = _free(docs, "row")
    key = F.monotonically_increasing_id() + F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    return common.stored(docs.withColumn(name, key), "keyed"), name


def _kept(docs: DataFrame, judged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of ``docs`` that ``judged`` (doc_id: their key, kept) keeps."""
    dropped = judged.where("not kept").select(F.col("doc_id").alias("dropped"))
    return docs.join(dropped, docs[key] == F.col("dropped"), "left_anti").select(*columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    common.ship(spark)
    rows, key = _keyed(docs)
    return _kept(rows, exact_dedup.deduplicate(*exact_dedup.halves(rows, key), id_col=key), key, docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    common.ship(spark)
    rows, key = _keyed(docs)
    return _kept(rows, near_dedup.near_duplicates(rows, NEAR_WORDS, NEAR_PERCENT, id_col=key), key, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    common.ship(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("packing", packed)]

#: No SQL: the classifiers and the packing have none. tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
