"""Two-sided p-values as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of erf, Abramowitz & Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_pvalue(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of whole degrees of freedom by the finite series of A&S 26.7.3 and 26.7.4. A step of
    the series is one product for all rows that still have terms; a row is done when its terms no longer change its sum."""
    with np.errstate(divide="ignore", invalid="ignore"):
        theta = np.arctan(np.abs(t) / np.sqrt(df))
    cos2 = np.cos(theta) ** 2
    # terms c_k = c_{k-1} cos^2 * (2k-1)/(2k) for even df, (2k)/(2k+1) for odd df
    even = (df % 2 == 0).astype(float)
    count = np.nan_to_num(np.floor((df - 3 + even) / 2), nan=0.0)
    series = np.ones(len(theta))
    rows = np.flatnonzero(count >= 1)
    term, k = np.ones(len(rows)), 0
    while len(rows):
        k += 1
        e = even[rows]
        term = term * (cos2[rows] * (2.0 * k - e) / (2.0 * k + 1.0 - e))
        series[rows] += term
        # what is left is at most a geometric series of cos^2
        left = (count[rows] > k) & ~(term * cos2[rows] <= 1e-18 * (1.0 - cos2[rows]) * series[rows])
        rows, term = rows[left], term[left]
    odd_area = (2.0 / math.pi) * (theta + np.where(df > 1, np.sin(theta) * np.cos(theta) * series, 0.0))
    return np.maximum(0.0, 1.0 - np.where(even > 0, np.sin(theta) * series, odd_area))


def _student(t: pa.Array, df: pa.Array) -> pa.Array:
    found = student_tail(*(c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in (t, df)))
    return pa.array(found, mask=~(np.array(t.is_valid()) & np.array(df.is_valid())))


def student_pvalue(t: Column, df: Column) -> Column:
    """Exact for whole degrees of freedom; null where either is."""
    tail = F.arrow_udf(_student, "double", F.ArrowUDFType.SCALAR)
    return tail(t.cast("double"), df.cast("double"))
