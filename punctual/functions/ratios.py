"""Rates and rounded averages.

Percentages are rounded half away from zero to two digits on whole numbers, so
no binary fraction decides a tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rate_pct(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole`` to two digits; null when ``whole`` is zero."""
    part, whole = _col(part).cast("bigint"), F.nullif(_col(whole).cast("bigint"), F.lit(0).cast("bigint"))
    hundredths = F.call_function("div", part * 20000 + whole, whole * 2)
    return hundredths / F.lit(100.0)


def safe_ratio(part: Column | str, whole: Column | str) -> Column:
    """Plain ratio with 0 where it is undefined."""
    return F.coalesce(F.try_divide(_col(part).cast("double"), _col(whole).cast("double")), F.lit(0.0))
