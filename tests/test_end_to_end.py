"""The whole quote on a hand-made request against a plain-Python walk-through
of the original pipeline (reference binding: the pricer's LOI slot gets IR/100
and its IR slot gets LOI)."""

import pytest
from pyspark.sql import functions as F

from brute import adjudicate as py_adj
from brute import loi_bucket as py_bucket
from brute import quote as py_quote
from samplequote.operators.flatten import flatten_request
from samplequote.plans.quote import prepare_lookups, quote
from samplequote.schemas import FACTOR_KEYS, FACTOR_NUMERIC
from test_pricing import BASE_FACTORS
from test_requests_scoring import SAMPLE, sample_requests

ACCOUNT, FIELDWORK = "13", "21"
RATES = {"EUR": 1.1, "USD": 1.0}
CURRENCY = {ACCOUNT: "eur", FIELDWORK: "usd"}  # lower case on purpose: upper() before lookup


def lookups(spark):
    rows = [(company, "Internal", "Ad hoc", "(All)", str(b), "(All)", "(All)",
             *[str(BASE_FACTORS[c]) for c in FACTOR_NUMERIC], CURRENCY[company])
            for company in (ACCOUNT, FIELDWORK) for b in range(5, 65, 5)]
    schema = ", ".join(f"{c} string" for c in FACTOR_KEYS + FACTOR_NUMERIC + ("Rate_Currency",))
    factors = spark.createDataFrame(rows, schema)
    commission = spark.createDataFrame([("ITA", FIELDWORK)], "Audience_Country_A3 string, Company string")
    rates = spark.createDataFrame([(k, "2023-01", str(v)) for k, v in RATES.items()] + [("EUR", "2022-12", "9.9")],
                                  "From_Currency string, month string, Rate string")
    return prepare_lookups(factors, commission, rates)


def expected(aud, ir_score=50, loi_score=12, named=False, b=0.04):
    """The original pipeline for one audience with a fieldwork company."""
    def cpi(company, loi_in, job_ir):
        price, ir_used = py_quote(job_ir, BASE_FACTORS)
        return round(price, 2), ir_used, py_bucket(loi_in), RATES[CURRENCY[company].upper()]

    if named:
        mod = (float(loi_score), ir_score / 100)
        sold = (float(aud["length_of_interview"]), aud["incidence_rate"] / 100)
    else:
        mod = (ir_score / 100, float(loi_score))
        sold = (aud["incidence_rate"] / 100, float(aud["length_of_interview"]))
    fw_m, acc_m = cpi(FIELDWORK, *mod), cpi(ACCOUNT, *mod)
    fw_s, acc_s = cpi(FIELDWORK, *sold), cpi(ACCOUNT, *sold)
    p2 = max(fw_m[0] * fw_m[3], acc_m[0] * acc_m[3])
    p1 = max(fw_s[0] * fw_s[3], acc_s[0] * acc_s[3])
    ir1, ir2 = round(fw_s[1] * 100), round(fw_m[1] * 100)
    hi, lo, med = py_adj(p2, p1, fw_s[2], fw_m[2], ir1, ir2,
                         SAMPLE["account"]["client_strategic_index"], SAMPLE["competitive_intensity_index"],
                         SAMPLE["proposal_strategic_index"], b=b)
    rate = RATES[SAMPLE["currency_code"]]
    return hi * rate, lo * rate, med * rate


@pytest.mark.parametrize("named,b", [(False, 0.04), (True, 0.04), (True, -0.04)])
def test_sample_request_end_to_end(spark, named, b):
    from dataclasses import replace
    from samplequote.params import DEFAULT_PARAMS
    params = replace(DEFAULT_PARAMS, binding="named" if named else "reference", b=b)
    flat = flatten_request(sample_requests(spark, [SAMPLE]))
    scorers = {"ir": F.lit(50.0), "cr": F.lit(0.0), "loi": F.lit(12.0)}
    rows = quote(flat, lookups(spark), scorers, params).collect()
    assert len(rows) == 4
    by_key = {(r.proposal_country_code, r.audience_uuid): r for r in rows}
    for country in SAMPLE["countries"]:
        for aud in country["audiences"]:
            r = by_key[(country["country_code"], aud["audience_uuid"])]
            assert r.currency_code == "EUR" and r.proposal_id == 77
            if country["country_code"] == "ITA":
                hi, lo, med = expected(aud, named=named, b=b)
                assert r.fieldwork_company == FIELDWORK
                assert (r.HighPrice, r.LowPrice, r.Strand2Price) == pytest.approx((hi, lo, med), abs=0.02)
                if b > 0:
                    assert r.HighPrice == r.LowPrice == r.Strand2Price  # default weights: identity band
                assert r.LowPrice <= r.Strand2Price <= r.HighPrice
            else:  # no fieldwork company: kept, unpriced
                assert r.fieldwork_company is None
                assert r.HighPrice is None and r.LowPrice is None and r.Strand2Price is None
