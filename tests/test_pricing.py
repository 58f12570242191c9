"""Pricer expressions: LOI bucket, IR tier, breakpoint, IR factor, CPI."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import loi_bucket as py_bucket
from brute import quote as py_quote
from samplequote.functions.pricing import breakpoint_ir, ir_factor, ir_tier, loi_bucket
from samplequote.operators import pricing as pr
from samplequote.params import DEFAULT_PARAMS
from samplequote.schemas import FACTOR_KEYS, FACTOR_NUMERIC

BASE_FACTORS = {
    "Low_IR_Used": 0.2, "Mid_IR_Used": 0.5, "High_IR_Used": 0.8,
    "Low_IR_Anchor": 20.0, "Mid_IR_Anchor": 15.0, "High_IR_Anchor": 10.0,
    "xFactor_Low_IR": 0.9, "xFactor_Mid_IR": 0.8, "xFactor_High_IR": 0.7,
    "Low_IR_Step": 0.05, "Mid_IR_Step": 0.05, "High_IR_Step": 0.1,
    "Break1": 0.75, "Break2": 0.6, "Break3": 0.4, "Break4": 0.3, "Break5": 0.1, "Break6": 0.05,
}


def one_col(spark, values, dtype="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


@pytest.mark.parametrize("loi,expected", [
    (4, 5), (5, 5), (6, 10), (59, 60), (60, 60), (61, 60), (125, 60), (0, 0), (-7, 0), (-12, -5),
    (0.02, 5), (1.0, 5), (15.0, 15),
])
def test_loi_bucket_boundaries(spark, loi, expected):
    got = one_col(spark, [float(loi)]).select(loi_bucket("x").alias("b")).first().b
    assert got == expected == py_bucket(loi)


def test_loi_bucket_null(spark):
    assert one_col(spark, [None]).select(loi_bucket("x").alias("b")).first().b is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(min_value=-200, max_value=400, allow_nan=False), min_size=1, max_size=30))
def test_loi_bucket_property(spark, values):
    rows = one_col(spark, values).select("x", loi_bucket("x").alias("b")).collect()
    for r in rows:
        assert r.b == py_bucket(r.x)
        if r.x > 0:
            assert r.b % 5 == 0 and r.b <= 60


def factor_frame(spark, job_irs, **over):
    f = {**BASE_FACTORS, **over}
    cols = ", ".join(f"{c} double" for c in FACTOR_NUMERIC)
    return spark.createDataFrame([(ir, *[f[c] for c in FACTOR_NUMERIC]) for ir in job_irs],
                                 f"ir double, {cols}")


@pytest.mark.parametrize("ir,used,step", [
    (0.2, 0.2, 0.05), (0.2000001, 0.5, 0.05), (0.5, 0.5, 0.05), (0.51, 0.8, 0.1), (None, 0.2, 0.05),
])
def test_ir_tier_strict_thresholds(spark, ir, used, step):
    df = factor_frame(spark, [ir])
    t = ir_tier("ir")
    r = df.select(t["used"].alias("u"), t["step"].alias("s")).first()
    assert (r.u, r.s) == (used, step)


@pytest.mark.parametrize("b1,ir,expected", [
    (2.0, 0.9, 0.9),      # first break above 1: job IR itself
    (0.75, 0.9, 0.75),    # first break below the IR
    (0.75, 0.5, 0.4),     # 0.75 and 0.6 not below 0.5 -> 0.4
    (0.75, 0.4, 0.3),     # strict <
    (0.75, 0.05, 0.05),   # none below -> job IR (Break6 never tested)
    (1.0, 0.9, 0.6),      # b1 == 1 is not > 1; 1.0 < 0.9 false; then 0.6
])
def test_breakpoint(spark, b1, ir, expected):
    df = factor_frame(spark, [ir], Break1=b1)
    got = df.select(breakpoint_ir("ir").alias("b")).first().b
    assert got == pytest.approx(expected)


def test_ir_factor_zero_step_is_null(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 0.05), (-0.06, 0.05)], "ir double, step double")
    got = [r.f for r in df.select(ir_factor("ir", "step").alias("f")).collect()]
    assert got[0] is None
    assert got[1] == pytest.approx(1 / 11)
    assert got[2] is None  # trunc(-1.2 + 1) = 0 -> no divisor


def priced(spark, rows, factors_rows=None, params=DEFAULT_PARAMS):
    """rows: (company, brand, product, loi, jobIr)."""
    df = spark.createDataFrame(rows, "company string, brand string, product string, loi double, jobIr double") \
        .withColumns({"country": F.lit("(All)"), "segment": F.lit("(All)"), "client": F.lit("(All)")})
    if factors_rows is None:
        factors_rows = [("1", "B", "P", "(All)", str(b), "(All)", "(All)",
                         *[str(BASE_FACTORS[c]) for c in FACTOR_NUMERIC], "eur") for b in range(5, 65, 5)]
    schema = ", ".join(f"{c} string" for c in FACTOR_KEYS + FACTOR_NUMERIC + ("Rate_Currency",))
    factors = pr.prepare_factors(spark.createDataFrame(factors_rows, schema))
    return pr.price(df, factors, True, "q", "company", "loi", "jobIr", params=params)


def test_cpi_matches_brute_force(spark):
    irs = [0.02, 0.1, 0.2, 0.25, 0.45, 0.5, 0.55, 0.75, 0.8, 0.95, 1.0]
    rows = [("1", "B", "P", 12.0, ir) for ir in irs]
    out = priced(spark, rows).select("jobIr", "q_cpi", "q_ir_used", "q_loi_used", "q_currency", "q_status").collect()
    for r in out:
        price, ir_used = py_quote(r.jobIr, BASE_FACTORS)
        assert r.q_cpi == pytest.approx(round(price, 2), abs=0.0051)
        assert r.q_ir_used == pytest.approx(ir_used)
        assert r.q_loi_used == 15 and r.q_currency == "eur" and r.q_status == "ok"


def test_missing_and_null_keys(spark):
    rows = [("9", "B", "P", 12.0, 0.5), (None, "B", "P", 12.0, 0.5), ("1", "B", "P", 75.0, 0.5)]
    out = {r.company: r for r in priced(spark, rows).collect()}
    assert out["9"].q_cpi is None and out["9"].q_status == "missing_factor"
    assert out[None].q_cpi is None and out[None].q_status == "missing_factor"
    assert out["1"].q_loi_used == 60 and out["1"].q_status == "ok"


def test_on_missing_raise(spark):
    from dataclasses import replace
    with pytest.raises(Exception, match="no price factor"):
        priced(spark, [("9", "B", "P", 12.0, 0.5)], params=replace(DEFAULT_PARAMS, on_missing="raise")).collect()


def test_bad_factor_text_is_null_and_invalid(spark):
    bad = [("1", "B", "P", "(All)", "15", "(All)", "(All)",
            *["" if c == "Mid_IR_Anchor" else str(BASE_FACTORS[c]) for c in FACTOR_NUMERIC], "eur")]
    r = priced(spark, [("1", "B", "P", 12.0, 0.3)], bad).first()
    assert r.q_cpi is None and r.q_status == "invalid_factor"


def test_duplicate_factor_keys_reported_and_fan_out(spark):
    rows = [("1", "B", "P", "(All)", "15", "(All)", "(All)", *[str(BASE_FACTORS[c]) for c in FACTOR_NUMERIC], "eur")] * 2
    schema = ", ".join(f"{c} string" for c in FACTOR_KEYS + FACTOR_NUMERIC + ("Rate_Currency",))
    dup = pr.duplicate_factors(spark.createDataFrame(rows, schema)).collect()
    assert len(dup) == 1 and dup[0].n_rows == 2
    assert priced(spark, [("1", "B", "P", 12.0, 0.3)], rows).count() == 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(min_value=0.0, max_value=1.2), st.floats(min_value=1, max_value=120)),
                min_size=1, max_size=20))
def test_cpi_property_brute_force(spark, pairs):
    rows = [("1", "B", "P", loi, ir) for ir, loi in pairs]
    for r in priced(spark, rows).collect():
        price, _ = py_quote(r.jobIr, BASE_FACTORS)
        assert r.q_loi_used == py_bucket(r.loi)
        assert r.q_cpi is not None and math.isclose(r.q_cpi, round(price, 2), abs_tol=0.0051)
