"""The CPI pricer's rules (LOI bucket, IR tier, breakpoint, IR factor, local price).

Each rule is one SQL text: a plan that applies it with ``selectExpr`` makes one call
into the JVM, where the same tree of Python Column objects costs a round trip per
node. Arguments are SQL expressions (column names, quoted where they need it); the
functions without ``sql_`` give the same text as a Column. No UDF, no per-row Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import LOI_CAP, LOI_STEP


def q(name: str) -> str:
    """Quoted column reference."""
    return f"`{name}`"


def sql_loi_bucket(loi: str, step: int = LOI_STEP, cap: int = LOI_CAP) -> str:
    """LOI rounded up to the next multiple of ``step`` (kept when already a
    multiple), capped at ``cap``. Non-multiples step by truncation toward zero,
    so a negative LOI such as -7 lands on 0. NULL stays NULL."""
    stepped = (f"(CASE WHEN ({loi}) % {step} = 0 THEN try_cast({loi} AS BIGINT) "
               f"ELSE try_cast(({loi}) / {step} + 1 AS BIGINT) * {step} END)")
    return f"CAST(CASE WHEN {stepped} > {cap} THEN {cap} ELSE {stepped} END AS INT)"


def sql_loi_key(bucket: str) -> str:
    """Text form of the LOI bucket, as stored in the price-factor key."""
    return f"CAST({bucket} AS STRING)"


def sql_ir_tier(ir: str, f: Callable[[str], str]) -> dict[str, str]:
    """The IR tier: above the mid threshold -> high set, above the low threshold -> mid
    set, else the low set. Gives used IR, anchor price, x-factor and IR step of that
    tier; ``f(name)`` renders a factor column reference."""
    def pick(h, m, low):
        return (f"CASE WHEN {ir} > {f('Mid_IR_Used')} THEN {f(h)} "
                f"WHEN {ir} > {f('Low_IR_Used')} THEN {f(m)} ELSE {f(low)} END")
    return {
        "used": pick("High_IR_Used", "Mid_IR_Used", "Low_IR_Used"),
        "anchor": pick("High_IR_Anchor", "Mid_IR_Anchor", "Low_IR_Anchor"),
        "xfactor": pick("xFactor_High_IR", "xFactor_Mid_IR", "xFactor_Low_IR"),
        "step": pick("High_IR_Step", "Mid_IR_Step", "Low_IR_Step"),
    }


def sql_breakpoint_ir(ir: str, f: Callable[[str], str]) -> str:
    """IR used for pricing: the job IR itself when the first break is above 1,
    else the first of the first five breaks lying below the job IR, else the
    job IR. (The sixth break is carried but never tested.)"""
    branches = " ".join(f"WHEN {f(f'Break{i}')} < {ir} THEN {f(f'Break{i}')}" for i in range(1, 6))
    return f"CASE WHEN {f('Break1')} > 1 THEN {ir} {branches} ELSE {ir} END"


def sql_ir_factor(ir: str, step: str) -> str:
    """1 / trunc(ir / step + 1); NULL on a zero step or a zero divisor."""
    return f"try_divide(1.0D, try_cast(try_divide({ir}, {step}) + 1 AS BIGINT))"


def sql_local_price(job_factor: str, anchor_factor: str, anchor_price: str, xfactor: str) -> str:
    """(job factor / anchor factor) ^ x-factor * anchor price; a NaN result
    (negative base, fractional power) is NULL."""
    return (f"nanvl(power(try_divide({job_factor}, {anchor_factor}), {xfactor}) * {anchor_price}, "
            f"CAST(NULL AS DOUBLE))")


def loi_bucket(loi: str, step: int = LOI_STEP, cap: int = LOI_CAP) -> Column:
    return F.expr(sql_loi_bucket(loi, step, cap))


def ir_tier(ir: str, f: Callable[[str], str] = q) -> dict[str, Column]:
    return {k: F.expr(v) for k, v in sql_ir_tier(ir, f).items()}


def breakpoint_ir(ir: str, f: Callable[[str], str] = q) -> Column:
    return F.expr(sql_breakpoint_ir(ir, f))


def ir_factor(ir: str, step: str) -> Column:
    return F.expr(sql_ir_factor(ir, step))
