"""Period keys. Source files carry MMYYYY integers without zero padding, which
do not sort by time; everything downstream orders by YYYYMM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_yyyymm(mmyyyy) -> Column:
    """122018 -> 201812 and 12019 -> 201901."""
    c = _col(mmyyyy).cast("bigint")
    month = F.floor(c / 10000).cast("bigint")
    return (c % 10000) * 100 + month


def to_yyyymm_text(mmyyyy) -> Column:
    """Same conversion from text; NULL unless it has 5 or 6 digits and a real month."""
    c = F.trim(_col(mmyyyy).cast("string"))
    padded = F.lpad(c, 6, "0")
    month = F.substring(padded, 1, 2).try_cast("int")
    return F.when(
        c.rlike("^[0-9]{5,6}$") & month.between(1, 12),
        F.substring(padded, 3, 4).try_cast("bigint") * 100 + month,
    )


def to_mmyyyy(yyyymm) -> Column:
    c = _col(yyyymm).cast("bigint")
    return (c % 100) * 10000 + F.floor(c / 100).cast("bigint")


def yyyymm_to_date(yyyymm) -> Column:
    c = _col(yyyymm).cast("bigint")
    year, month = F.floor(c / 100).cast("int"), (c % 100).cast("int")
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def period_to_date(mmyyyy) -> Column:
    """MMYYYY integer to the first day of its month, NULL when malformed."""
    return yyyymm_to_date(to_yyyymm_text(_col(mmyyyy).cast("string")))


def month_floor(date) -> Column:
    return F.trunc(_col(date), "month")


def month_index(yyyymm) -> Column:
    """Months since year 0, for month arithmetic."""
    c = _col(yyyymm).cast("bigint")
    return F.floor(c / 100).cast("bigint") * 12 + c % 100


def months_between_ym(start_yyyymm, end_yyyymm) -> Column:
    return month_index(end_yyyymm) - month_index(start_yyyymm)


def date_to_yyyymm(date) -> Column:
    d = _col(date)
    return (F.year(d) * 100 + F.month(d)).cast("bigint")
