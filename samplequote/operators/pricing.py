"""Pricing operators: factor preparation, pricer inputs, the keyed factor
lookup and the four-way CPI (account/fieldwork x modelled/sold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import (q, sql_breakpoint_ir, sql_ir_factor, sql_ir_tier, sql_local_price,
                                 sql_loi_bucket, sql_loi_key)
from ..params import DEFAULT_PARAMS, VALID_COMPANIES, QuoteParams
from ..schemas import FACTOR_CURRENCY, FACTOR_KEYS, FACTOR_NUMERIC
from ..plans.stages import stage
from .broadcast import fits_broadcast

#: Column of factors joined with the USD rate of their currency.
USD_RATE = "usd_rate"
#: Key parts that all slots of a row share, and the column of their factor rows.
FAMILY_KEYS = ("BrandID", "ProductID", "CountryID", "Client_Segment", "Client")
FAMILY = "_family"

# Pricer slots: (prefix, company column, inputs kind).
QUOTE_SLOTS = (
    ("acc_mod", "company", "modelled"),
    ("acc_sold", "company", "sold"),
    ("fw_mod", "fieldwork_company", "modelled"),
    ("fw_sold", "fieldwork_company", "sold"),
)


def prepare_factors(factors: DataFrame, strict: bool = False) -> DataFrame:
    """Keys stay text; the 18 numeric columns are parsed to double (NULL on
    bad text, and NaN text to NULL, unless ``strict``)."""
    cast = "CAST" if strict else "try_cast"
    return factors.selectExpr(
        *[f"`{k}`" for k in FACTOR_KEYS],
        *[f"nanvl({cast}(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)) AS `{c}`" for c in FACTOR_NUMERIC],
        f"`{FACTOR_CURRENCY}`",
    )


def factor_key(df: DataFrame, cols=FACTOR_KEYS, name: str = "price_key") -> DataFrame:
    """Delimiter-less concatenation of the key parts (NULL if any part is
    NULL), for display and reports; joins use the separate columns."""
    return df.withColumn(name, F.concat(*[F.col(c) for c in cols]))


def pricing_inputs(df: DataFrame, params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Add the pricer inputs to each scored row.

    company <- account company, product <- project type, constant country /
    segment / client / source system, and the (loi, jobIr) pair for the
    modelled scores and for the sold values. With ``binding="reference"``
    the pricer's LOI slot receives IR/100 and its IR slot receives LOI.
    """
    d = params.defaults
    if params.binding == "reference":
        mod_loi, mod_ir = "Athena_IR / 100", "Athena_LOI"
        sold_loi, sold_ir = "audience_incidence_rate / 100", "audience_length_of_interview"
    else:
        mod_loi, mod_ir = "Athena_LOI", "Athena_IR / 100"
        sold_loi, sold_ir = "audience_length_of_interview", "audience_incidence_rate / 100"
    lit = lambda v: "'" + str(v).replace("'", "''") + "'"
    added = {
        "company": "account_company_number",
        "product": "project_type",
        "country": lit(d["country"]),
        "segment": lit(d["segment"]),
        "client": lit(d["client"]),
        "srcSystem": lit(d["srcSystem"]),
        "modelled_loi": f"CAST({mod_loi} AS DOUBLE)",
        "modelled_jobIr": f"CAST({mod_ir} AS DOUBLE)",
        "sold_loi": f"CAST({sold_loi} AS DOUBLE)",
        "sold_jobIr": f"CAST({sold_ir} AS DOUBLE)",
    }
    kept = [f"`{c}`" for c in df.columns if c not in added]
    return df.selectExpr(*kept, *[f"{v} AS `{k}`" for k, v in added.items()])


def factor_side(factors: DataFrame, prefix: str, fits: bool) -> DataFrame:
    """Factor columns renamed ``_{prefix}_*`` plus a match marker."""
    side = factors.selectExpr(*[f"`{c}` AS `_{prefix}_{c}`" for c in factors.columns],
                              f"true AS `_{prefix}_hit`")
    return F.broadcast(side) if fits else side


def with_family(df: DataFrame, factors: DataFrame, brand: str = "brand", product: str = "product",
                country: str = "country", segment: str = "segment", client: str = "client") -> DataFrame:
    """``df`` with ``FAMILY``: the factor rows that share the five key parts which are
    the same in all slots of a row, as an array; a slot picks by company and LOI.

    For factors too large to broadcast: one shuffle of the rows serves every slot (a
    hot key's rows are split by the skew join). A family holds a key's companies
    times its LOI buckets."""
    families = (factors.groupBy(*[F.col(k).alias(f"_family_{k}") for k in FAMILY_KEYS])
                .agg(F.collect_list(F.struct(*factors.columns)).alias(FAMILY)))
    same = F.lit(True)
    for c, k in zip((brand, product, country, segment, client), FAMILY_KEYS):
        same = same & (F.col(c) == F.col(f"_family_{k}"))
    return df.join(families, same, "left").drop(*[f"_family_{k}" for k in FAMILY_KEYS])


def looked_up(rows: DataFrame, factors: DataFrame, fits: bool, p: str, row_keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their factor row as ``_{p}_*`` (NULL without one, a
    row for each of several): from the row's family where it has one, else by a join.
    ``row_keys`` are the seven key parts of a row as SQL."""
    f = lambda name: q(f"_{p}_{name}")
    if FAMILY not in rows.columns:
        cond = " AND ".join(f"{rk} = {f(fk)}" for rk, fk in zip(row_keys, FACTOR_KEYS))
        return rows.join(factor_side(factors, p, fits), F.expr(cond), "left")
    own = " AND ".join(f"x.{fk} = {rk}" for rk, fk in zip(row_keys, FACTOR_KEYS) if fk not in FAMILY_KEYS)
    fields = ", ".join(f"'_{p}_{c}', x.`{c}`" for c in factors.columns)
    hits = f"transform(filter({FAMILY}, x -> {own}), x -> named_struct({fields}, '_{p}_hit', true))"
    return rows.selectExpr("*", f"inline_outer({hits})")


def price(df: DataFrame, factors: DataFrame, fits: bool, prefix: str, company: str, loi: str,
          job_ir: str, brand: str = "brand", product: str = "product", country: str = "country",
          segment: str = "segment", client: str = "client",
          params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Price every row against its 7-part factor key (left join, so rows
    without a factor row keep NULL prices and status ``missing_factor``).

    Arguments name columns of ``df``. Adds ``{prefix}_cpi``, ``_ir_used``,
    ``_loi_used``, ``_currency`` and ``_status``, and ``_usd_rate`` where the
    factors carry it. Rows that carry their ``FAMILY`` of factors join nothing."""
    p = prefix
    f = lambda name: q(f"_{p}_{name}")
    bucket = f"{p}_loi_bucket"
    keep = df.columns
    rows = df.selectExpr("*", f"{sql_loi_bucket(q(loi), params.loi_step, params.loi_cap)} AS {q(bucket)}")
    row_keys = [q(company), q(brand), q(product), q(country), sql_loi_key(q(bucket)), q(segment), q(client)]
    joined = looked_up(rows, factors, fits, p, row_keys)
    # Three projections, each intermediate computed once: tier and
    # breakpoint, then the price, then the outputs that test the price.
    tier = sql_ir_tier(q(job_ir), f)
    t = {k: f"_{p}_t_{k}" for k in tier}
    irb = f"_{p}_irb"
    staged = joined.selectExpr("*", *[f"{v} AS {q(t[k])}" for k, v in tier.items()],
                               f"{sql_breakpoint_ir(q(job_ir), f)} AS {q(irb)}")
    price_sql = sql_local_price(sql_ir_factor(q(irb), q(t["step"])), sql_ir_factor(q(t["used"]), q(t["step"])),
                                q(t["anchor"]), q(t["xfactor"]))
    raw = f"_{p}_price"
    staged = staged.selectExpr("*", f"bround({price_sql}, {params.cpi_scale}) AS {q(raw)}")
    hit = f"{f('hit')} IS NOT NULL"
    cpi = f"CASE WHEN {hit} THEN {q(raw)} END"
    if params.on_missing == "raise":
        key = "concat_ws('|', " + ", ".join(f"CAST({rk} AS STRING)" for rk in row_keys) + ")"
        cpi = f"CASE WHEN NOT ({hit}) THEN raise_error(concat('no price factor for key ', {key})) ELSE {cpi} END"
    out = staged.selectExpr(
        *[q(c) for c in keep],
        f"{cpi} AS {q(p + '_cpi')}",
        f"CASE WHEN {hit} THEN {q(irb)} END AS {q(p + '_ir_used')}",
        f"CASE WHEN {hit} THEN {q(bucket)} END AS {q(p + '_loi_used')}",
        f"CASE WHEN {hit} THEN {f(FACTOR_CURRENCY)} END AS {q(p + '_currency')}",
        f"CASE WHEN NOT ({hit}) THEN 'missing_factor' WHEN {q(raw)} IS NULL THEN 'invalid_factor' "
        f"ELSE 'ok' END AS {q(p + '_status')}",
        *([f"{f(USD_RATE)} AS {q(f'{p}_{USD_RATE}')}"] if USD_RATE in factors.columns else []),
    )
    return stage(out, f"{p}_quotes")


def with_fieldwork_company(df: DataFrame, commission: DataFrame, fits: bool,
                           how: str = "left") -> DataFrame:
    """Attach the fieldwork company of the audience country. Several
    companies fan the row out; ``how="inner"`` drops countries without one,
    ``"left"`` keeps them with a NULL company."""
    side = commission.select(F.col("Audience_Country_A3").alias("_fw_country"),
                             F.col("Company").alias("fieldwork_company"))
    if fits:
        side = F.broadcast(side)
    return df.join(side, F.col("proposal_country_code") == F.col("_fw_country"), how).drop("_fw_country")


def slot_inputs(kind: str) -> tuple[str, str]:
    return f"{kind}_loi", f"{kind}_jobIr"


def four_way_quotes(df: DataFrame, factors: DataFrame, commission: DataFrame,
                    params: QuoteParams = DEFAULT_PARAMS, commission_how: str = "left",
                    factors_fit: bool | None = None, commission_fits: bool | None = None) -> DataFrame:
    """Price each row for the account company and for every fieldwork
    company, on modelled and on sold inputs, all on one wide row.

    The account quotes are computed before the commission join, so rows fanned
    out to several fieldwork companies share them instead of repricing."""
    if factors_fit is None:
        factors_fit = fits_broadcast(factors, params.max_broadcast_factors)
    if commission_fits is None:
        commission_fits = fits_broadcast(commission, params.max_broadcast_commission)
    out = df if factors_fit else with_family(df, factors)
    for prefix, company, kind in QUOTE_SLOTS[:2]:
        loi, job_ir = slot_inputs(kind)
        out = price(out, factors, factors_fit, prefix, company, loi, job_ir, params=params)
    out = with_fieldwork_company(out, commission, commission_fits, commission_how)
    for prefix, company, kind in QUOTE_SLOTS[2:]:
        loi, job_ir = slot_inputs(kind)
        out = price(out, factors, factors_fit, prefix, company, loi, job_ir, params=params)
    return out.drop(FAMILY)


def missing_factors(df: DataFrame, factors: DataFrame, company: str, loi: str,
                    params: QuoteParams = DEFAULT_PARAMS) -> DataFrame:
    """Rows whose 7-part key has no price-factor row (left anti join)."""
    keyed = df.withColumn("_loi_key", F.expr(sql_loi_key(sql_loi_bucket(q(loi), params.loi_step, params.loi_cap))))
    keys = factors.select(*[F.col(k).alias(f"_pf_{k}") for k in FACTOR_KEYS])
    if fits_broadcast(keys, params.max_broadcast_factors):
        keys = F.broadcast(keys)
    row_keys = [F.col(company), F.col("brand"), F.col("product"), F.col("country"),
                F.col("_loi_key"), F.col("segment"), F.col("client")]
    cond = None
    for rk, fk in zip(row_keys, FACTOR_KEYS):
        e = rk == F.col(f"_pf_{fk}")
        cond = e if cond is None else cond & e
    return keyed.join(keys, cond, "left_anti")


def duplicate_factors(factors: DataFrame) -> DataFrame:
    """Factor keys that occur more than once (they would fan quotes out)."""
    return (factors.groupBy(*FACTOR_KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def company_valid(company) -> Column:
    """True when the company number is one of the valid companies."""
    c = F.col(company) if isinstance(company, str) else company
    return c.isin(*VALID_COMPANIES)
