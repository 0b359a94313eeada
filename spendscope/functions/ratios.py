"""Division rules of the metrics.

Reports know two kinds of ratio. *Protected* ones turn every undefined result
into 0. *Raw* ones keep a signed infinity for x/0 and are missing for 0/0.
Neither ever uses ``/``, which raises on zero under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_INF = float("inf")


def protected_ratio(a: Column, b: Column) -> Column:
    q = F.try_divide(a, b)
    # NaN and infinities only arise from infinite operands; a plain zero
    # denominator already gives NULL
    return F.coalesce(F.when(F.abs(q) < _INF, q), F.lit(0.0))


def raw_ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    by_zero = F.when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF))
    q = F.when(b == 0, by_zero).otherwise(F.nullif(F.try_divide(a, b), F.lit(float("nan"))))
    return q if scale == 1.0 else q * F.lit(scale)


def relative_change(before: Column, after: Column) -> Column:
    """(after - before) / before; missing when ``before`` is 0 or undefined."""
    return F.when(before != 0, F.nullif(F.try_divide(after - before, before), F.lit(float("nan"))))
