"""Dates: season codes, tolerant parsing, calendar attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import digit_sum, digital_root

#: Month and day of the year's turning points.
TURNING_POINTS = ((3, 20), (6, 21), (9, 22), (12, 21))
#: Code of the weekday's ruler, Monday first.
DAY_RULER = (1, 4, 2, 5, 3, 6, 0)


def season_code(d: Column) -> Column:
    """2026-09-13 -> 2627; the season turns on 1 July."""
    start = F.year(d) - F.when(F.month(d) >= 7, 0).otherwise(1)
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(start), two(start + 1))


def day_month_year(text: Column) -> Column:
    """A date written dd/MM/yyyy or dd/MM/yy; null otherwise."""
    short = F.try_to_date(text, "dd/MM/yy")  # two digits from 69 on are years of the last century
    return F.coalesce(F.try_to_date(text, "dd/MM/yyyy"), F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short))


def kickoff_hour(text: Column) -> Column:
    """The hour of a time written H:mm or HH:mm; null otherwise."""
    return F.regexp_extract(text, r"^(\d{1,2}):\d{2}$", 1).try_cast("int")


def day_attributes(d: Column) -> dict[str, Column]:
    near = F.least(*[F.abs(F.datediff(d, F.make_date(F.year(d), F.lit(m), F.lit(day)))) for m, day in TURNING_POINTS])
    number = digital_root(digit_sum(F.date_format(d, "yyyyMMdd")))
    ruler = F.element_at(F.array(*[F.lit(x) for x in DAY_RULER]), F.weekday(d) + 1)
    return {
        "day_ruler": ruler, "eq_sol_prox": near, "univ_day": number, "univ_master": F.when(number.isin(11, 22, 33), 1).otherwise(0),
        "cn_animal": F.pmod(F.year(d) - 4, F.lit(12)), "cn_element": F.floor(F.pmod(F.year(d) - 4, F.lit(10)) / 2).cast("int")}
