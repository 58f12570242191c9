"""Quarantine: rows that cannot be priced, set apart with the reasons.

One pass writes every row once, below ``accepted=true`` or ``accepted=false``, and
counts rows and reasons on the way (observed metrics), so nothing is scanned again
to report them. Every row lands on exactly one side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pricing import q, sql_loi_bucket, sql_loi_key
from ..params import DEFAULT_PARAMS, QuoteParams
from ..schemas import FACTOR_KEYS
from .broadcast import fits_broadcast
from .pricing import company_valid

#: Reasons, in the order in which a row lists them.
UNKNOWN_COMPANY, MISSING_FACTOR, BAD_NUMBER = "unknown_company", "missing_factor", "bad_number"
REASONS = (UNKNOWN_COMPANY, MISSING_FACTOR, BAD_NUMBER)


@dataclass(frozen=True)
class Quarantine:
    accepted: DataFrame
    rejected: DataFrame
    #: rows, rejected and one count for each reason (a row may have several).
    counts: dict[str, int]


def reasons(company: str, numbers: tuple[str, ...], found: Column, valid: Column | None = None) -> Column:
    """The reasons against a row, an empty array if none: its company is not valid (or
    null), ``found`` does not hold, or one of ``numbers`` is null, NaN or negative."""
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.col(n).isNull() | F.isnan(n) | (F.col(n) < 0)
    ok = F.coalesce(company_valid(company) if valid is None else valid, F.lit(False))
    tests = ((UNKNOWN_COMPANY, ~ok), (MISSING_FACTOR, ~F.coalesce(found, F.lit(False))), (BAD_NUMBER, bad))
    return F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in tests]), lambda r: r.isNotNull())


def with_reasons(rows: DataFrame, factors: DataFrame, loi: str, numbers: tuple[str, ...], company: str = "company",
                 valid: Column | None = None, params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Pricer inputs (``pricing_inputs``) with ``reasons``. A key of several factor rows
    is found once: rows are neither lost nor multiplied."""
    keys = factors.select(*[F.col(k).alias(f"_k_{k}") for k in FACTOR_KEYS]).distinct().withColumn("_k_found", F.lit(True))
    if fits_broadcast(keys, params.max_broadcast_factors):
        keys = F.broadcast(keys)
    parts = (q(company), "brand", "product", "country", sql_loi_key(sql_loi_bucket(q(loi), params.loi_step, params.loi_cap)), "segment", "client")
    same = F.expr(" AND ".join(f"{p} = _k_{k}" for p, k in zip(parts, FACTOR_KEYS)))
    return (rows.join(keys, same, "left").withColumn("reasons", reasons(company, numbers, F.col("_k_found"), valid))
            .drop("_k_found", *[f"_k_{k}" for k in FACTOR_KEYS]))


def quarantine(judged: DataFrame, path: str, mode: str = "errorifexists") -> Quarantine:
    """Write rows with ``reasons`` to ``path`` and give both sides back, with counts."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count(F.when(F.size("reasons") > 0, 1)).alias("rejected")]
    counts += [F.count(F.when(F.array_contains("reasons", r), 1)).alias(r) for r in REASONS]
    (judged.observe(seen, *counts).withColumn("accepted", F.size("reasons") == 0)
     .write.mode(mode).partitionBy("accepted").parquet(path))
    schema = T.StructType([*judged.schema.fields, T.StructField("accepted", T.BooleanType())])
    written = judged.sparkSession.read.schema(schema).parquet(path)
    return Quarantine(written.where("accepted").drop("accepted", "reasons"), written.where("NOT accepted").drop("accepted"), dict(seen.get))
