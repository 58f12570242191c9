"""Operator 2: token counts from distinct pre-tokens.

Pass one counts in how many documents each pre-token occurs (texts are split in
tasks, only distinct pre-tokens of a batch shuffle) and asks the tokenizer for
the pieces of each distinct pre-token once. Pass two writes the pre-token
frequencies of each document; they join the piece counts, and the products sum
per document. No token id is ever made.

The most widespread pre-tokens, at most ``common`` (by default 50,000) of up to
``WORD_BYTES`` bytes, are broadcast, and their part is summed where the text is
split, so only rare pre-tokens move through the join. Which they are follows from a
histogram of document counts, a few hundred rows, so no more than the broadcast
itself reaches the driver. Every other pre-token takes the join: the bound changes
where work is done and not the result.

Null texts count as empty (0 bytes, 0 tokens). Repeated rows give one row each:
rows are told apart by a number given when pass two is stored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import documents, stored, text_of

#: Bytes of a word that may be broadcast; steps of the histogram for each doubling.
WORD_BYTES = 64
_STEPS = 8


def pretoken_pieces(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """word, n_docs, pieces: every distinct pre-token of the texts, counted once."""
    def words(batches):
        enc = bpe.encoder(vocabulary, False)
        for b in batches:
            seen: Counter = Counter()
            for text in b.column(0).to_pylist():
                seen.update({w for part, _ in enc.parts(text) for w in part})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "n_docs"])

    def count(batches):
        enc = bpe.encoder(vocabulary, False)
        for b in batches:
            n = [len(enc.library_ids(w)) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32())],
                                             names=["word", "n_docs", "pieces"])

    distinct = (docs.select(text_of(text_col).alias("text")).mapInArrow(words, "word string, n_docs long")
                .groupBy("word").agg(F.sum("n_docs").alias("n_docs")))
    return distinct.mapInArrow(count, "word string, n_docs long, pieces int")


def widespread(pieces: DataFrame, common: int) -> DataFrame:
    """word, pieces: at most ``common`` words that most documents have, all of those above
    a number of documents."""
    step = F.floor(F.log2("n_docs") * _STEPS)
    short = pieces.where(F.octet_length("word") <= WORD_BYTES).withColumn("step", step)
    total, least = 0, None
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        total += r.n
        if total > common:
            break
        least = r.step
    return short.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "pieces")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, common: int = 50_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    spark = docs.sparkSession
    pieces = stored(pretoken_pieces(docs, vocabulary, text_col), "pretokens")
    known = spark.sparkContext.broadcast({r.word: r.pieces for r in widespread(pieces, common).collect()})

    def frequencies(batches):
        enc = bpe.encoder(vocabulary, False)
        table = known.value
        for b in batches:
            sums, names, counts = [], [], []
            for text in b.column(2).to_pylist():
                freq: Counter = Counter()
                total = 0
                for part, special in enc.parts(text):
                    freq.update(part)
                    total += special is not None
                rare = []
                for w, n in freq.items():
                    p = table.get(w)
                    if p is None:
                        rare.append(w)
                    else:
                        total += n * p
                sums.append(total)
                names.append(rare)
                counts.append([freq[w] for w in rare])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sums, pa.int64()), pa.array(names, pa.list_(pa.string())),
                 pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "known", "words", "counts"])

    per_doc = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
               .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
               .mapInArrow(frequencies, "doc_id long, n_bytes long, known long, words array<string>, counts array<int>")
               .withColumn("row", F.monotonically_increasing_id()))
    per_doc = stored(per_doc, "pretoken-frequencies")
    rare = (per_doc.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w"))
            .select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
            .join(pieces.select("word", "pieces"), "word")
            .groupBy("row").agg(F.sum(F.col("n").cast("long") * F.col("pieces")).alias("rare")))
    n = (F.col("known") + F.coalesce("rare", F.lit(0))).cast("long")
    return (per_doc.select("row", "doc_id", "n_bytes", "known").join(rare, "row", "left")
            .select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
