"""Currency operators: latest-snapshot rates, conversion to and from USD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_double
from .broadcast import fits_broadcast


def latest_rates(rates: DataFrame, month_format: str | None = None,
                 strict: bool = False) -> DataFrame:
    """Rows of the latest ``month`` (all of them, as ``WHERE month IN (SELECT
    max(month) ...)``), with ``Rate`` parsed to double.

    ``month_format=None`` compares months as text (``2022-9`` beats
    ``2022-10``); a pattern such as ``"yyyy-M"`` compares parsed dates.
    The latest month is a scalar subquery over the month column alone: on a table
    staged by month (``staging.stage_rates``) it reads no rates, and the filter it gives is
    a partition filter, so only the latest month's files are scanned.
    """
    order = F.col("month") if month_format is None else F.to_date("month", month_format)
    latest = rates.select(order.alias("_month_order")).agg(F.max("_month_order"))
    return rates.where(order == latest.scalar()).withColumn("Rate", to_double("Rate", strict))


def prepare_rates(latest: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """(From_Currency, Rate) of the latest snapshot and whether it provably
    fits a broadcast."""
    lookup = latest.select("From_Currency", "Rate")
    return lookup, fits_broadcast(lookup, max_rows)


def with_rate(df: DataFrame, rates: DataFrame, currency: str, rate_col: str,
              fits: bool, upper: bool = True) -> DataFrame:
    """Left-join the rate of column ``currency`` (upper-cased when ``upper``)
    as ``rate_col``. Several rates for one currency fan the row out, as the
    original merge does."""
    key = f"_{rate_col}_cur"
    side = rates.selectExpr(f"From_Currency AS `{key}`", f"Rate AS `{rate_col}`")
    if fits:
        side = F.broadcast(side)
    cur = f"upper(`{currency}`)" if upper else f"`{currency}`"
    return df.join(side, F.expr(f"{cur} = `{key}`"), "left").drop(key)


def to_usd(df: DataFrame, rates: DataFrame, fits: bool, amount: str, currency: str,
           out: str, rate_col: str, upper_in_place: bool = True) -> DataFrame:
    """``out = amount * rate(upper(currency))``; the upper-cased currency
    replaces ``currency`` (pass ``upper_in_place=False`` when it already is
    upper case)."""
    if upper_in_place:
        cols = [f"`{c}`" if c != currency else f"upper(`{c}`) AS `{c}`" for c in df.columns]
        df = df.selectExpr(*cols)
    df = with_rate(df, rates, currency, rate_col, fits, upper=False)
    return df.selectExpr("*", f"`{amount}` * `{rate_col}` AS `{out}`")


def to_local(df: DataFrame, rates: DataFrame, fits: bool, currency: str,
             prices: dict[str, str], direction: str = "multiply",
             rate_col: str = "Rate") -> DataFrame:
    """Convert USD prices to the proposal currency. The reference applies the
    same local->USD rate by multiplication; ``direction="divide"`` divides."""
    df = with_rate(df, rates, currency, rate_col, fits, upper=False)
    rate = F.col(rate_col)
    conv = {}
    for src, dst in prices.items():
        conv[dst] = F.col(src) * rate if direction == "multiply" else F.try_divide(F.col(src), rate)
    return df.withColumns(conv)


def duplicate_rates(latest: DataFrame) -> DataFrame:
    """Currencies with more than one rate in the snapshot (they fan quotes out)."""
    return (latest.groupBy("From_Currency").agg(F.count(F.lit(1)).alias("n_rates"))
            .where(F.col("n_rates") > 1))


def require_unique_rates(latest: DataFrame) -> DataFrame:
    """Fail when a currency has several latest rates; otherwise return ``latest``."""
    dup = duplicate_rates(latest).limit(5).collect()
    if dup:
        raise ValueError("several latest rates for " + ", ".join(r.From_Currency for r in dup))
    return latest
