"""Pluggable response scorers (IR, CR, LOI), their integer casts and clamps.

A scorer is one of
  * a ``Column`` expression over the feature columns (runs in codegen),
  * a callable ``f(df) -> Column`` (e.g. a pandas_udf applied to features),
  * a ``(transformer, output_col)`` pair of a fitted ``pyspark.ml`` model.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT_PARAMS, MIN_IR_G, QuoteParams

SCORE_NAMES = ("ir", "cr", "loi")
RAW = {"ir": "_ir_score", "cr": "_cr_score", "loi": "_loi_score"}
SCORE_COLUMNS = ("Athena_IR", "Athena_CR", "Athena_LOI")


def demo_scorers() -> dict[str, Column]:
    """Stand-in response models over the feature frame, used by the test
    queries: IR from the sold IR, CR from waves and country match, LOI from
    the sold LOI. Their ranges hit every clamp."""
    return {
        "ir": F.col("PrmWeightedIR_1") * 1.5 - 10.0,
        "cr": F.col("feaAudienceWaves") * 0.05 + F.col("feaAudienceCountryIsAccountCountry") * 0.1,
        "loi": F.col("SoldLOI") * 3.0 - 5.0,
    }


def constant_scorers(value: float = 0.0) -> dict[str, Column]:
    """Scorers that always return ``value`` (the mocks return 0)."""
    return {k: F.lit(float(value)) for k in SCORE_NAMES}


def count_scorers() -> dict[str, Column]:
    """The stand-in models with a CR that reads the per-country count."""
    return {**demo_scorers(), "cr": F.col("feaNumberOfAudienceCountryA3") * 0.25}


def needs_column(scorers: Mapping[str, object], name: str, features: DataFrame) -> bool:
    """Whether any scorer may read column ``name`` of the feature frame: all but
    Columns that resolve without it (names as Spark compares them) and do not
    expand a star. Callables and models are taken to read it."""
    without = features.drop(name)
    for s in scorers.values():
        if not isinstance(s, Column) or re.search(r"unresolvedstar|\*(?!\()", str(s)):
            return True
        try:
            without.select(s).schema
        except AnalysisException:
            return True
    return False


def apply_scorers(df: DataFrame, scorers: Mapping[str, object]) -> DataFrame:
    """Add raw scores ``_ir_score``, ``_cr_score``, ``_loi_score``."""
    out = df
    for name in SCORE_NAMES:
        s = scorers[name]
        if isinstance(s, Column):
            out = out.withColumn(RAW[name], s)
        elif isinstance(s, tuple):
            model, col = s
            # the model's intermediate columns go, so the next model may use their names
            made = model.transform(out).withColumnRenamed(col, RAW[name])
            out = made.select(*out.columns, RAW[name])
        else:
            out = out.withColumn(RAW[name], s(out))
    return out


def score_cast(df: DataFrame) -> DataFrame:
    """Integer scores, truncated toward zero: Athena_IR, Athena_CR (x100
    first), Athena_LOI."""
    kept = [f"`{c}`" for c in df.columns if c not in RAW.values() and c not in SCORE_COLUMNS]
    return df.selectExpr(
        *kept,
        f"try_cast(CAST(`{RAW['ir']}` AS DOUBLE) AS INT) AS Athena_IR",
        f"try_cast(CAST(`{RAW['cr']}` AS DOUBLE) * 100 AS INT) AS Athena_CR",
        f"try_cast(CAST(`{RAW['loi']}` AS DOUBLE) AS INT) AS Athena_LOI",
    )


def clamp_scores(df: DataFrame, params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """IR into [2, 100] (floored at 2 twice), LOI into [1, 120]; NULL stays."""
    def low(e, v):
        return f"CASE WHEN {e} <= {v} THEN {v} ELSE {e} END"

    def high(e, v):
        return f"CASE WHEN {e} >= {v} THEN {v} ELSE {e} END"

    ir = high(low(low("Athena_IR", MIN_IR_G), params.min_ir), params.max_ir)
    loi = high(low("Athena_LOI", params.min_loi), params.max_loi)
    kept = [f"`{c}`" if c not in ("Athena_IR", "Athena_LOI") else
            (f"{ir} AS Athena_IR" if c == "Athena_IR" else f"{loi} AS Athena_LOI") for c in df.columns]
    return df.selectExpr(*kept)


def score(df: DataFrame, scorers: Mapping[str, object],
          params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Scores -> integer casts -> clamps, added to ``df`` (which must hold
    the feature columns the scorers read)."""
    return clamp_scores(score_cast(apply_scorers(df, scorers)), params)
