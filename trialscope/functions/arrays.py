"""Array and scalar helpers over list cells (F7-F11, F13, F14, F18) as Column expressions.

Higher-order functions (``transform``, ``aggregate``, ``zip_with``, ``filter``) keep
list-cell work inside the JVM; the arrays are bounded per row (draws of one stimulus,
a heuristic vector), never a whole table.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialscope.functions.normal import _col, plogis, qlogis


def arr_sum(arr) -> Column:
    return F.aggregate(_col(arr), F.lit(0.0), lambda acc, x: acc + x)


def arr_mean(arr) -> Column:
    return arr_sum(arr) / F.size(_col(arr))


def arr_range(arr) -> Column:
    return F.array_max(_col(arr)) - F.array_min(_col(arr))


def arr_first(arr, k: int) -> Column:
    return F.slice(_col(arr), 1, k)


def arr_count_below(arr, v: float = 0.0) -> Column:
    return F.size(F.filter(_col(arr), lambda x: x < v))


def arr_diff(b, a) -> Column:
    """element-wise b - a of two equal-length lists."""
    return F.zip_with(_col(b), _col(a), lambda x, y: x - y)


def softmax(arr) -> Column:
    """exp(x - max) / sum, stable for large values."""
    a = _col(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def logsumexp(arr) -> Column:
    """F8 over a list: max + ln(sum(exp(x - max)))."""
    a = _col(arr)
    m = F.array_max(a)
    return m + F.ln(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def logit_grid(lo, hi, n: int) -> Column:
    """n points equally spaced in log odds between lo and hi, back on the probability scale."""
    a, b = qlogis(_col(lo)), qlogis(_col(hi))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: plogis(F.when(i == n - 1, b).otherwise(a + i * (b - a) / (n - 1))))


def ppoints(n) -> Column:
    """R ``ppoints(n)``: (i - a) / (n + 1 - 2a), a = 3/8 if n <= 10 else 1/2."""
    nn = _col(n) if not isinstance(n, int) else F.lit(n)
    a = F.when(nn <= 10, F.lit(3.0 / 8)).otherwise(F.lit(0.5))
    return F.transform(F.sequence(F.lit(1), nn), lambda i: (i - a) / (nn + 1 - 2 * a))


def est_in_bounds(c, lo: float = 0.0025, hi: float = 0.9975) -> Column:
    """keep a probability estimate strictly inside (lo, hi)."""
    c = _col(c)
    return F.when(c.isNull(), None).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), c)))


def round_array(arr, digits: int = 6) -> Column:
    return F.transform(_col(arr), lambda x: F.bround(x, digits))
