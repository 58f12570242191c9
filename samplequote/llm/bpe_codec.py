"""Operator 10: BPE encoding and decoding of whole texts.

Ids come from ``bpe.Merger`` (priority queue over a linked symbol list), decoded
text from the vocabulary strings of those ids. A map-only pass: texts never
shuffle, and each task holds one Arrow batch and a bounded memo of pre-tokens.

Null texts count as empty: no ids, empty decoded text. Repeated rows give one
result row each; rows of an empty table give none; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import documents, text_of

CODED = "doc_id long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers) and their decoded text."""
    def run(batches):
        enc = bpe.encoder(vocabulary)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            texts = [enc.merger.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "decoded"])
    return _docs(docs, id_col, text_col).mapInArrow(run, CODED)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per document the number of ids and digests of the ids and of the decoded text."""
    def run(batches):
        enc = bpe.encoder(vocabulary)
        decode = enc.merger.decode
        for b in batches:
            n, a, d = [], [], []
            for text in b.column(1).to_pylist():
                ids = enc.encode(text)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                back = decode(np.frombuffer(ids, "<u4").tolist())
                d.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _docs(docs, id_col, text_col).mapInArrow(run, DIGESTS)


def op10_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
