"""Adjudication band, index floors, currency snapshot and conversion."""

from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import adjudicate as py_adj
from samplequote.operators.adjudicate import adjudicate, floor_indices, price_band
from samplequote.operators.currency import latest_rates, to_local, to_usd
from samplequote.params import DEFAULT_PARAMS

ADJ_SCHEMA = "P2 double, P1 double, LOI1 int, LOI2 int, IR1 int, IR2 int, CSI int, CII int, PSI int"


def band(spark, rows, params=DEFAULT_PARAMS):
    df = spark.createDataFrame(rows, ADJ_SCHEMA)
    df = df.withColumns({c: F.when(F.col(c) <= 3, 3).otherwise(F.col(c)) for c in ("CSI", "CII", "PSI")})
    return price_band(adjudicate(df, params)).collect()


def test_default_params_give_identity_band(spark):
    # S >= 0 and floored indices >= 3 make every gamma 1: High = Low = Median = P2.
    rows = [(10.0, 7.0, 5, 15, 4000, 200, 5, 4, 3), (3.5, 9.0, 5, 5, 100, 100, 3, 3, 3)]
    for r in band(spark, rows):
        assert r.HighPriceUSD == r.LowPriceUSD == r.Strand2PriceUSD == r.P2


def test_zero_distance_denominator_is_null_not_error(spark):
    r = band(spark, [(10.0, 7.0, 5, 5, 100, 100, 3, 3, 3)])[0]
    assert r.S is None and r.index_drop == 0.0 and r.HighPriceUSD == 10.0


def test_missing_sold_price_gives_null_band(spark):
    r = band(spark, [(10.0, None, 5, 15, 100, 200, 3, 3, 3)])[0]
    assert r.HighPriceUSD is None and r.LowPriceUSD is None and r.Strand2PriceUSD is None


def test_negative_weight_blends_and_matches_brute_force(spark):
    p = replace(DEFAULT_PARAMS, b=-0.04)
    rows = [(10.0, 7.0, 5, 15, 4000, 200, 5, 4, 3), (12.0, 20.0, 5, 10, 80, 60, 5, 3, 3)]
    for row, r in zip(rows, band(spark, rows, p)):
        hi, lo, med = py_adj(*row, b=-0.04)
        assert (r.HighPriceUSD, r.LowPriceUSD, r.Strand2PriceUSD) == pytest.approx((hi, lo, med))
        assert r.LowPriceUSD <= r.Strand2PriceUSD <= r.HighPriceUSD
        assert r.HighPriceUSD != r.LowPriceUSD


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(0.5, 500), st.floats(0.5, 500), st.integers(1, 60), st.integers(1, 60),
                          st.integers(0, 12000), st.integers(0, 12000), st.integers(1, 5),
                          st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=15))
def test_band_order_property(spark, rows):
    p = replace(DEFAULT_PARAMS, b=-0.04)
    for row, r in zip(rows, band(spark, rows, p)):
        assert r.LowPriceUSD <= r.Strand2PriceUSD <= r.HighPriceUSD
        hi, lo, med = py_adj(*row, b=-0.04)
        assert (r.HighPriceUSD, r.LowPriceUSD, r.Strand2PriceUSD) == pytest.approx((hi, lo, med), rel=1e-12)


def test_floor_indices_keeps_null(spark):
    df = spark.createDataFrame([(1, 3, 5), (None, 4, 2)],
                               "client_strategic_index int, proposal_strategic_index int, competitive_intensity_index int")
    got = [tuple(r) for r in floor_indices(df).collect()]
    assert got == [(3, 3, 5), (None, 4, 3)]


RATES = [("USD", "2022-9", "1.0"), ("EUR", "2022-9", "1.1"), ("GBP", "2022-9", "1.3"),
         ("USD", "2022-10", "1.0"), ("EUR", "2022-10", "1.2")]


def test_latest_month_is_text_max(spark):
    rates = spark.createDataFrame(RATES, "From_Currency string, month string, Rate string")
    got = sorted((r.From_Currency, r.month) for r in latest_rates(rates).collect())
    assert got == [("EUR", "2022-9"), ("GBP", "2022-9"), ("USD", "2022-9")]
    parsed = sorted(r.From_Currency for r in latest_rates(rates, month_format="yyyy-M").collect())
    assert parsed == ["EUR", "USD"]


def test_bad_rate_text_is_null(spark):
    rates = spark.createDataFrame([("USD", "2022-01", ""), ("EUR", "2022-01", "x")],
                                  "From_Currency string, month string, Rate string")
    assert [r.Rate for r in latest_rates(rates).collect()] == [None, None]


def test_usd_upper_cases_and_fans_out_on_duplicate_rates(spark):
    rates = spark.createDataFrame([("EUR", 1.1), ("EUR", 1.2), ("USD", 1.0)], "From_Currency string, Rate double")
    df = spark.createDataFrame([(1, 10.0, "eur"), (2, 5.0, "jpy")], "id int, cpi double, cur string")
    out = sorted((r.id, r.cur, r.usd) for r in to_usd(df, rates, True, "cpi", "cur", "usd", "_r").collect())
    assert out == [(1, "EUR", pytest.approx(11.0)), (1, "EUR", pytest.approx(12.0)), (2, "JPY", None)]


def test_local_conversion_direction(spark):
    rates = spark.createDataFrame([("EUR", 2.0)], "From_Currency string, Rate double")
    df = spark.createDataFrame([(10.0, "EUR"), (10.0, "eur")], "p double, currency_code string")
    mult = [r.q for r in to_local(df, rates, True, "currency_code", {"p": "q"}).collect()]
    div = [r.q for r in to_local(df, rates, True, "currency_code", {"p": "q"}, "divide").collect()]
    assert mult == [20.0, None] and div == [5.0, None]  # proposal currency is looked up as is


def test_unique_rates_check(spark):
    from samplequote.operators.currency import duplicate_rates, require_unique_rates
    latest = spark.createDataFrame([("EUR", 1.1), ("EUR", 1.2), ("USD", 1.0)], "From_Currency string, Rate double")
    assert [r.From_Currency for r in duplicate_rates(latest).collect()] == ["EUR"]
    with pytest.raises(ValueError, match="EUR"):
        require_unique_rates(latest)
    ok = latest.where("From_Currency = 'USD'")
    assert require_unique_rates(ok).count() == 1


def test_numeric_column_helpers(spark):
    from samplequote.functions import numeric as N
    df = spark.createDataFrame([(1.0, None, 3.0, "a", "a"), (None, None, None, None, "b"), (5.0, 2.0, 9.0, "x", None)],
                               "a double, b double, c double, s string, t string")
    rows = df.select(N.row_max("a", "b").alias("mx"), N.row_min("a", "c").alias("mn"),
                     N.row_median3("a", "c", "c").alias("md"), N.clamp("c", 2.0, 4.0).alias("cl"),
                     N.equal_flag("s", "t").alias("eq"), N.safe_divide("a", F.lit(0.0)).alias("dz"),
                     N.round_half_even(F.lit(2.5), 0).alias("r")).collect()
    assert [tuple(r) for r in rows] == [
        (1.0, 1.0, 3.0, 3.0, 1, None, 2.0),
        (None, None, None, None, 0, None, 2.0),
        (5.0, 5.0, 9.0, 4.0, 0, None, 2.0),
    ]
