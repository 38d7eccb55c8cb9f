"""Intervals, exact tests and prevalence arithmetic on counts.

Plain arithmetic stays a column expression. The exact tests are Arrow functions: they run on
aggregated counts (a handful of rows), never on mails.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95, digits: int = 4) -> tuple[Column, Column]:
    """Bounds of the Wilson interval for k of n; nulls when n is 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    scale = F.lit(1.0) + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), F.lit(2.0) * n)) / scale
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), F.lit(4.0) * n * n)) / scale
    return (F.when(n > 0, F.round(F.greatest(F.lit(0.0), centre - half), digits)),
            F.when(n > 0, F.round(F.least(F.lit(1.0), centre + half), digits)))


def share(k: Column, n: Column, digits: int = 4) -> Column:
    """k / n rounded; null when n is 0."""
    return F.round(F.try_divide(k.cast("double"), n.cast("double")), digits)


def _binomial_tail(b, c):
    n, k = int(b) + int(c), min(int(b), int(c))
    if n == 0:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    term = total = 1.0
    for i in range(k, 0, -1):  # terms shrink from k downwards
        term *= i / (n - i + 1)
        total += term
        if term < total * 1e-18:
            break
    return min(1.0, 2 * total * math.exp(log_term))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    """Exact two-sided p-value from the two discordant counts."""
    return pd.Series([_binomial_tail(b, c) for b, c in zip(only_a, only_b)], dtype="float64")


def _fisher(a, b, c, d):
    """Terms are taken outward from the mode until they vanish: work grows with the spread, not with the counts."""
    a, b, c, d = int(a), int(b), int(c), int(d)
    row, column, n = a + b, a + c, a + b + c + d
    low, high = max(0, column - (n - row)), min(row, column)
    mode = min(high, max(low, (row + 1) * (column + 1) // (n + 2)))
    terms = {mode: 1.0}
    for way in (1, -1):
        x, term = mode, 1.0
        while low <= x + way <= high and term > 1e-300:
            up, down = (row - x) * (column - x), (x + 1) * (n - row - column + x + 1)
            if way < 0:
                up, down = x * (n - row - column + x), (row - x + 1) * (column - x + 1)
            term *= up / down
            x += way
            terms[x] = term
    bar = terms.get(a, 0.0) * (1 + 1e-7)
    return min(1.0, math.fsum(t for t in terms.values() if t <= bar) / math.fsum(terms.values()))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Exact two-sided p-value of the table [[a, b], [c, d]]."""
    return pd.Series([_fisher(*row) for row in zip(a, b, c, d)], dtype="float64")


def _upper_gamma(s, x):
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    b, c = x + 1 - s, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([_upper_gamma(f / 2.0, s / 2.0) if f > 0 else None for s, f in zip(statistic, freedom)], dtype="float64")


def precision_at_prevalence(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    caught = tpr * prevalence
    return F.coalesce(F.try_divide(caught, caught + fpr * (1 - prevalence)), F.lit(0.0))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def jeffreys_precision_draws(tp: pd.Series, fn: pd.Series, fp: pd.Series, tn: pd.Series, prevalence: pd.Series,
                             draws: pd.Series, block: pd.Series) -> pd.Series:
    """One block of precision draws from the Beta posteriors of recall and false-alarm rate."""
    out = []
    for a, b, c, d, pi, n, i in zip(tp, fn, fp, tn, prevalence, draws, block):
        rng = np.random.default_rng([0, int(i)])
        tpr, fpr = rng.beta(a + 0.5, b + 0.5, int(n)), rng.beta(c + 0.5, d + 0.5, int(n))
        out.append(tpr * pi / np.maximum(tpr * pi + fpr * (1 - pi), 1e-300))
    return pd.Series(out)
