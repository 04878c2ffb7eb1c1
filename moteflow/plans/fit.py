"""Least squares from sums: the rows are reduced to Gram matrices per group, only those are solved."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from moteflow.functions.field import combine
from moteflow.plans.quantile import exact_quantiles
from moteflow.session import cut


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve(gram: pd.Series, rhs: pd.Series) -> pd.Series:
    """Solution of each row's normal equations (minimum norm when singular)."""
    return pd.Series([solve_normal(np.asarray(g, float).reshape(len(b), len(b)), np.asarray(b, float)) for g, b in zip(gram, rhs)])


def solve_normal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-13)[0] / scale


def fit_terms(df: DataFrame, keys: list[str], terms: list[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """Coefficients per group as an array: one map-side combined aggregation, then a tiny solve per group."""
    t = df.withColumns({f"_t{i}": c for i, c in enumerate(terms)}).withColumn("_y", y)
    w = weight if weight is not None else F.lit(1.0)
    t = t.withColumn("_w", w)
    n = len(terms)
    g = [F.sum(F.col(f"_t{min(i, j)}") * F.col(f"_t{max(i, j)}") * F.col("_w")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    b = [F.sum(F.col(f"_t{i}") * F.col("_y") * F.col("_w")).alias(f"b{i}") for i in range(n)]
    s = t.groupBy(*keys).agg(*g, *b, F.count("*").alias("fit_rows"))
    full = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)])
    return s.select(*keys, "fit_rows", solve(full, F.array(*[F.col(f"b{i}") for i in range(n)])).alias("coef"))


def clipped_fit(df: DataFrame, keys: list[str], terms: list[Column], y: Column, passes: int = 5, k: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Repeated least squares; after each pass only rows within ``k`` robust SDs of the fit are used.
    Returns (keys, coef, fit_rows, scale) and the rows with ``_res`` and ``_use``."""
    rows = df.withColumn("_use", F.lit(True))
    coef = None
    for _ in range(passes):
        coef = fit_terms(rows.where("_use"), keys, terms, y)
        res = rows.drop("_res").join(coef.select(*keys, "coef"), keys).withColumn("_res", y - combine(terms, F.col("coef"))).drop("coef")
        scale = exact_quantiles(res.where("_use").withColumn("_abs", F.abs("_res")), keys, "_abs", {"scale": 0.5}) \
            .withColumn("scale", F.col("scale") * 1.4826 + 1e-6)
        coef = coef.join(scale, keys)
        rows = cut(res.join(scale, keys).withColumn("_use", F.abs("_res") <= F.col("scale") * k).drop("scale"))
    return coef, rows
