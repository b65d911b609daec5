"""Wilcoxon signed-rank p-values and corrections for several tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Differences up to which an untied test without zeros uses the exact distribution.
EXACT_UP_TO = 50


def wilcoxon_p(w: float, n: int, tie_term: float, exact: bool) -> float:
    """Two-sided p of the lesser rank sum ``w`` of ``n`` non-zero differences.

    ``tie_term`` is the sum of t^3 - t over groups of equal sizes.  Exact by counting subsets of ranks, else the normal
    approximation without continuity correction.
    """
    if n == 0:
        return 1.0
    if exact:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for rank in range(1, n + 1):
            ways[rank:] += ways[:-rank].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


def benjamini_hochberg(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Adds ``q_value``; nulls stay null.  The rows are tests, a handful: one task ranks them."""
    n = F.count(p).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last()))
    ranked = df.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * n / rank)).withColumn("_r", rank)
    return ranked.withColumn("q_value", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_q").over(Window.orderBy(F.desc("_r")))))).drop("_q", "_r")
