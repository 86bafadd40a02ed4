"""Date functions (D1-D4). All are column expressions inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import ADMIT_YEAR, DISCHARGE_YEAR_NEXT


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_timestamp(col, fmt: str | None = None) -> Column:
    """Text to timestamp. Under ANSI mode (Spark 4 default) a bad value
    fails the job, as ``to_datetime(errors='raise')`` does."""
    return F.to_timestamp(_c(col), fmt) if fmt else F.to_timestamp(_c(col))


def actual_age(disch, anchor_year, anchor_age) -> Column:
    """Age at discharge = year(discharge) - anchor_year + anchor_age."""
    return (F.year(_c(disch)) - _c(anchor_year) + _c(anchor_age)).cast("int")


def shift_year(ts, year) -> Column:
    """D3: same month, day and time in ``year``; 29 February becomes the 28th
    (adding a year-month interval clamps to the month end)."""
    year = F.lit(year) if isinstance(year, int) else _c(year)
    return _c(ts) + F.make_ym_interval((year - F.year(_c(ts))).cast("int"), F.lit(0))


def shift_stay(admit, disch) -> tuple[Column, Column]:
    """D3 for a stay: admission to 2025; discharge to 2025, or to 2026 when
    admission and discharge fall in different years."""
    same = F.year(_c(admit)) == F.year(_c(disch))
    target = F.when(same, F.lit(ADMIT_YEAR)).otherwise(F.lit(DISCHARGE_YEAR_NEXT))
    return shift_year(admit, ADMIT_YEAR), shift_year(disch, target)


def birth_year(shifted_disch, age) -> Column:
    """Birth year = year(shifted discharge) - age."""
    return (F.year(_c(shifted_disch)) - _c(age)).cast("int")


def ts_text(ts) -> Column:
    """Timestamp as 'YYYY-MM-DD HH:MM:SS' (how the values are written into notes)."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")
