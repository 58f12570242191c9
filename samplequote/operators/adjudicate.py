"""Adjudication: reference prices, distance, index combination, gamma
weights, blended prices and the high/low/median band. All Column
arithmetic on the wide quote row; no join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp_low
from ..params import DEFAULT_PARAMS, QuoteParams


def floor_indices(df: DataFrame, params: QuoteParams = DEFAULT_PARAMS,
                  cols=("proposal_strategic_index", "competitive_intensity_index",
                        "client_strategic_index")) -> DataFrame:
    """Strategic indices at or below the default index become the default."""
    return df.withColumns({c: clamp_low(F.col(c), params.default_index) for c in cols})


def reference_prices(df: DataFrame, sold_ir: str = "fw_sold_ir_used",
                     sold_loi: str = "fw_sold_loi_used", mod_ir: str = "fw_mod_ir_used",
                     mod_loi: str = "fw_mod_loi_used") -> DataFrame:
    """P2 / P1: the higher of the fieldwork and account USD CPI on modelled /
    sold inputs (NULLs skipped); LOI1/LOI2 and IR1/IR2 (x100, rounded half
    even) from the fieldwork quotes."""
    return df.selectExpr(
        "*",
        "greatest(Fieldwork_Athena_CPI_USD, Account_Athena_CPI_USD) AS P2",
        "greatest(Fieldwork_Sold_CPI_USD, Account_Sold_CPI_USD) AS P1",
        f"`{sold_loi}` AS LOI1", f"`{mod_loi}` AS LOI2",
        f"try_cast(bround(`{sold_ir}` * 100, 0) AS INT) AS IR1",
        f"try_cast(bround(`{mod_ir}` * 100, 0) AS INT) AS IR2",
    )


def _d(x: float) -> str:
    """A double literal that parses back to exactly ``x``."""
    return f"{float(x)!r}D"


def adjudicate(df: DataFrame, params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Distance S, index combination, gamma weights and blended prices
    (input: P1, P2, LOI1, LOI2, IR1, IR2, CSI, CII, PSI)."""
    p = params
    out = df.selectExpr("*", f"try_divide(sqrt(abs(P2 - P1)), {_d(p.alpha)} * abs(LOI1 - LOI2) + abs(IR1 - IR2)) AS S")
    out = out.selectExpr("*", f"{_d(p.a)} * S + {_d(p.b)} * (CSI - 3) + {_d(p.c)} * (CII - 3) "
                              f"+ {_d(p.d)} * (PSI - 3) AS index_blend")
    g0 = ("CASE WHEN index_blend < 0 THEN index_blend ELSE 0.0D END" if p.gamma_clip == "negative"
          else "coalesce(index_blend, 0.0D)")
    out = out.selectExpr("*", f"{g0} AS index_drop")
    out = out.selectExpr("*", *[f"try_divide(1.0D, 1 + {_d(1.0 - beta)} * index_drop) AS gamma{x}"
                                for x, beta in (("A", p.beta_a), ("B", p.beta_b), ("C", p.beta_c))])
    return out.selectExpr("*", *[f"gamma{x} * P2 + (1 - gamma{x}) * P1 AS Price{x}" for x in "ABC"])


def price_band(df: DataFrame) -> DataFrame:
    """High / low / median of the three blended prices (in USD)."""
    return df.selectExpr(
        "*",
        "greatest(PriceA, PriceB, PriceC) AS HighPriceUSD",
        "least(PriceA, PriceB, PriceC) AS LowPriceUSD",
        "element_at(array_sort(array(PriceA, PriceB, PriceC)), 2) AS Strand2PriceUSD",
    )


def adjudication_inputs(df: DataFrame, params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Reference prices plus the floored indices under their short names."""
    out = reference_prices(floor_indices(df, params))
    return out.withColumns({
        "CSI": F.col("client_strategic_index"),
        "PSI": F.col("proposal_strategic_index"),
        "CII": F.col("competitive_intensity_index"),
    })
