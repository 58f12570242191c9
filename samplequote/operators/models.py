"""Fitted response models as Column expressions.

A model that is a formula over a row's features needs no UDF and no transformer:
it is fitted once and rendered as SQL, so scoring stays in the generated code of the
quote plan and the same text runs in other engines. ``compile_model`` renders fitted
linear and tree regressions of ``pyspark.ml``; ``fit_linear`` and ``fit_steps`` fit
by exact sums of whole numbers, which every engine and every partitioning gives
alike. ``batch_scorer`` is for all other models: one call for an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(x) -> str:
    """A float as an SQL double that reads back to the same value."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def linear_sql(intercept: float, coefficients: Sequence[float], features: Sequence[str]) -> str:
    """intercept + sum of coefficient * feature, added from the left."""
    return " + ".join([number(intercept), *(f"{number(c)} * {f}" for c, f in zip(coefficients, features))])


def _tree_sql(node, features: Sequence[str]) -> str:
    if node.subtreeDepth() == 0:
        return number(node.prediction())
    split = node.split()
    feature = features[split.featureIndex()]
    left, right = _tree_sql(node.leftChild(), features), _tree_sql(node.rightChild(), features)
    return f"CASE WHEN {feature} <= {number(split.threshold())} THEN {left} ELSE {right} END"


def compile_model(model, features: Sequence[str]) -> str:
    """SQL of a fitted ``pyspark.ml`` regression over ``features``, the inputs of its
    vector in order: linear models, and trees and their ensembles on continuous
    features. A tree's text grows with its nodes, which its depth bounds."""
    trees = getattr(model, "trees", None)
    if trees is not None:
        weights = list(model.treeWeights)
        total = sum(weights) if type(model).__name__.startswith("RandomForest") else 1.0
        parts = [f"{number(w)} * ({_tree_sql(t._java_obj.rootNode(), features)})" for t, w in zip(trees, weights)]
        return "(" + " + ".join(parts) + f") / {number(total)}"
    if hasattr(model, "coefficients"):
        return linear_sql(model.intercept, model.coefficients.toArray().tolist(), features)
    if hasattr(model, "depth"):
        return _tree_sql(model._java_obj.rootNode(), features)
    raise TypeError(f"{type(model).__name__} is no formula: pass (model, column) or batch_scorer(...) to the scorers instead")


def fit_linear(df: DataFrame, features: Sequence[str], target: str) -> str:
    """SQL of the least squares fit of a whole-number target on whole-number features.

    One aggregation of exact sums (a row for each task), then the normal equations in
    exact fractions on the driver: their size is the number of features. Rows with a
    null take no part. Features that others determine get the coefficient 0."""
    names = ["1", *features]
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*features, target]))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.expr(f"CAST({names[i]} AS DECIMAL(18,0)) * CAST({names[j]} AS DECIMAL(18,0))")).alias(f"a{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.expr(f"CAST({n} AS DECIMAL(18,0)) * CAST({target} AS DECIMAL(18,0))")).alias(f"b{i}") for i, n in enumerate(names)]
    found = rows.agg(*sums).first()
    n = len(names)
    a = [[Fraction(found[f"a{min(i, j)}_{max(i, j)}"] or 0) for j in range(n)] + [Fraction(found[f"b{i}"] or 0)] for i in range(n)]
    solution, used = [Fraction(0)] * n, []
    for col in range(n):
        pivot = next((r for r in range(n) if r not in [u for u, _ in used] and a[r][col] != 0), None)
        if pivot is None:
            continue
        a[pivot] = [x / a[pivot][col] for x in a[pivot]]
        for r in range(n):
            if r != pivot and a[r][col] != 0:
                a[r] = [x - a[r][col] * y for x, y in zip(a[r], a[pivot])]
        used.append((pivot, col))
    for pivot, col in used:
        solution[col] = a[pivot][n]
    return linear_sql(solution[0], solution[1:], list(features))


def fit_steps(df: DataFrame, feature: str, target: str, cuts: Sequence[int]) -> str:
    """SQL of a one-feature regression tree with given cuts: the mean of a whole-number
    target between neighbouring cuts (a cut belongs to the lower side; NULL where a
    step has no rows). One aggregation, a row for each step."""
    step = "CASE " + " ".join(f"WHEN {feature} <= {c} THEN {i}" for i, c in enumerate(cuts)) + f" ELSE {len(cuts)} END"
    found = {r.s: r for r in df.where(f"{feature} IS NOT NULL AND {target} IS NOT NULL")
             .groupBy(F.expr(step).alias("s")).agg(F.sum(F.col(target).cast("long")).alias("t"), F.count("*").alias("n")).collect()}
    mean = [number(found[i].t / found[i].n) if i in found else "CAST(NULL AS DOUBLE)" for i in range(len(cuts) + 1)]
    return ("CASE " + f"WHEN {feature} IS NULL THEN CAST(NULL AS DOUBLE) "
            + " ".join(f"WHEN {feature} <= {c} THEN {m}" for c, m in zip(cuts, mean)) + f" ELSE {mean[-1]} END")


def batch_scorer(load: Callable[[], Callable[[pd.DataFrame], pd.Series]], features: Sequence[str]) -> Callable[[DataFrame], Column]:
    """A scorer for a model that is no formula: ``load`` gives the model's function once
    for each task, which then gets the features of an Arrow batch as a pandas frame."""
    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for frame in batches:
            yield pd.Series(model(frame), dtype="float64")
    return lambda df: predict(F.struct(*[F.col(c) for c in features]))
