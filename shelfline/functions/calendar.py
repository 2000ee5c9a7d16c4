"""Calendar columns: weekday family, cyclic angles, period labels and bounds, holiday flags."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import TAU, flag

# fixed values: gazetted full-moon (Poya) days of Sri Lanka, 2024-2027
POYA_DAYS = """
2024-01-25 2024-02-23 2024-03-24 2024-04-23 2024-05-23 2024-05-24 2024-06-21 2024-07-20
2024-08-19 2024-09-17 2024-10-17 2024-11-15 2024-12-15
2025-01-13 2025-02-12 2025-03-13 2025-04-12 2025-05-12 2025-06-10 2025-07-10 2025-08-08
2025-09-07 2025-10-06 2025-11-05 2025-12-04
2026-01-02 2026-02-01 2026-03-03 2026-04-01 2026-05-01 2026-05-31 2026-06-29 2026-07-29
2026-08-27 2026-09-26 2026-10-25 2026-11-24 2026-12-23
2027-01-22 2027-02-20 2027-03-22 2027-04-20 2027-05-20 2027-06-19 2027-07-18 2027-08-17
2027-09-15 2027-10-15 2027-11-13 2027-12-13
""".split()
# fixed values: yearly holidays as month-day
PUBLIC_MONTH_DAYS = ("01-01", "02-04", "04-12", "04-13", "04-14", "05-01", "12-25")
MERCANTILE_MONTH_DAYS = ("02-04", "04-13", "04-14", "05-01", "12-25")
QUARTER_NAMES = ("Jan-Mar", "Apr-Jun", "Jul-Sep", "Oct-Dec")


def weekday(day: Column) -> Column:
    """Monday = 0."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return flag(F.weekday(day) >= 5)


def is_month_start(day: Column) -> Column:
    return flag(F.dayofmonth(day) == 1)


def is_month_end(day: Column) -> Column:
    return flag(F.last_day(day) == day)


def is_payday_window(day: Column) -> Column:
    return flag((F.dayofmonth(day) >= 25) | (F.dayofmonth(day) <= 3))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(TAU) / period
    return F.sin(angle), F.cos(angle)


def _dates(values: Iterable[date | str]) -> list[date]:
    return [v if isinstance(v, date) else date.fromisoformat(v) for v in values]


def _is_any(day: Column, values: Iterable[date | str]) -> Column:
    days = _dates(values)
    return day.isin(days) if days else F.lit(False)


def holiday_flags(
    day: Column,
    poya: Iterable[date | str] | None = None,
    public: Iterable[date | str] = (),
    mercantile: Iterable[date | str] = (),
) -> dict[str, Column]:
    """Four 0/1 flags. A given ``poya`` list replaces the known one; the others add days."""
    month_day = F.date_format(day, "MM-dd")
    month, dom = F.month(day), F.dayofmonth(day)
    is_poya = _is_any(day, POYA_DAYS if poya is None else poya)
    festive = (
        ((month == 4) & dom.between(10, 18))
        | ((month == 5) & ((dom <= 25) | _is_any(day, POYA_DAYS)))
        | ((month == 12) & (dom >= 15))
    )
    return {
        "is_public_holiday": flag(is_poya | month_day.isin(*PUBLIC_MONTH_DAYS) | _is_any(day, public)),
        "is_mercantile_holiday": flag(
            is_poya | month_day.isin(*MERCANTILE_MONTH_DAYS) | _is_any(day, mercantile)
        ),
        "is_poya_day": flag(is_poya),
        "is_festive_peak": flag(festive),
    }


def period_structs(day: Column) -> Column:
    """Array of (kind, label, period_start, period_end) for week, month, quarter and year."""
    monday = F.date_sub(day, F.weekday(day))
    month_start = F.trunc(day, "MM")
    quarter_start = F.trunc(day, "quarter")
    year_start = F.trunc(day, "year")
    year = F.year(day).cast("string")
    quarter = F.quarter(day)
    names = F.array(*[F.lit(n) for n in QUARTER_NAMES])

    def entry(kind: str, label: Column, start: Column, end: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            label.alias("label"),
            start.alias("period_start"),
            end.alias("period_end"),
        )

    week_label = F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )
    return F.array(
        entry("weekly", week_label, monday, F.date_add(monday, 6)),
        entry("monthly", F.date_format(day, "yyyy-MM"), month_start, F.last_day(day)),
        entry(
            "seasonal",
            F.concat(year, F.lit("-Q"), quarter.cast("string"), F.lit(" ("),
                     F.element_at(names, quarter), F.lit(")")),
            quarter_start,
            F.date_sub(F.add_months(quarter_start, 3), 1),
        ),
        entry("yearly", year, year_start, F.date_sub(F.add_months(year_start, 12), 1)),
    )
