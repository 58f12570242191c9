"""Physical-plan summaries (from ``DataFrame.explain``), used to check that
the quote plan keeps its shape: broadcast hash joins, no shuffle of the
audience rows, no nested-loop or cartesian join."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

OPERATORS = {
    "BroadcastHashJoin": r"BroadcastHashJoin",
    "SortMergeJoin": r"SortMergeJoin",
    "ShuffledHashJoin": r"ShuffledHashJoin",
    "BroadcastNestedLoopJoin": r"BroadcastNestedLoopJoin",
    "CartesianProduct": r"CartesianProduct",
    "shuffle Exchange": r"(?<![A-Za-z])Exchange \(",
    "BroadcastExchange": r"BroadcastExchange \(",
    "ReusedExchange": r"ReusedExchange \(",
    "HashAggregate": r"(?<!Object)HashAggregate \(",
    "ObjectHashAggregate": r"ObjectHashAggregate \(",
    "Window": r"(?<![A-Za-z])Window \(",
    "Generate": r"Generate \(",
    "CollectMetrics": r"CollectMetrics \(",
    "Scan parquet": r"Scan parquet",
}


def formatted_plan(df: DataFrame) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def plan_summary(df: DataFrame) -> dict[str, int]:
    """Operator counts in the tree part of the formatted plan."""
    tree = formatted_plan(df).split("\n\n(1)")[0]
    if "== Final Plan ==" in tree:  # executed adaptive plan: count the final part only
        tree = tree.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    counts = {op: len(re.findall(pat, tree)) for op, pat in OPERATORS.items()}
    return {op: n for op, n in counts.items() if n}
