"""Calendar columns: holidays, day types, school breaks, daylight."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days after Easter Sunday and (month, day) that are holidays or run on holiday routes.
MOVING_HOLIDAYS = (-7, -3, -2, 0, 1, 39, 49, 50)
FIXED_HOLIDAYS = ((1, 1), (5, 1), (5, 17), (12, 24), (12, 25), (12, 26), (12, 31))
# School breaks of the region, first and last day.
SCHOOL_BREAKS = (
    ("2024-12-21", "2024-12-31"),
    ("2025-01-01", "2025-01-02"),
    ("2025-02-24", "2025-02-28"),
    ("2025-04-14", "2025-04-22"),
    ("2025-06-20", "2025-08-18"),
    ("2025-09-29", "2025-10-03"),
    ("2025-12-20", "2025-12-31"),
)
LATITUDE = 63.43


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, b: int | Column) -> Column:
    return F.floor(a / b).cast("int")


def easter(day: Column | str) -> Column:
    """Easter Sunday of the year of a date: the Sunday after the paschal full moon (Gregorian)."""
    y = F.year(_column(day))
    century, golden = _div(y, 100), y % 19
    h = (century - _div(century, 4) - _div(century * 8 + 13, 25) + golden * 19 + 15) % 30
    moon = h - _div(h, 28) * (F.lit(1) - _div(F.lit(29), h + 1) * _div(F.lit(21) - golden, 11))
    weekday = (y + _div(y, 4) + moon + 2 - century + _div(century, 4)) % 7
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def is_holiday(day: Column | str) -> Column:
    d = _column(day)
    fixed = [(F.month(d) == m) & (F.dayofmonth(d) == n) for m, n in FIXED_HOLIDAYS]
    moving = F.datediff(d, easter(d)).isin(*MOVING_HOLIDAYS)
    out = moving
    for c in fixed:
        out = out | c
    return out


def is_in(day: Column | str, days: Iterable[str]) -> Column:
    """Another calendar: a holiday if the day is in the list."""
    return _column(day).isin(*[F.lit(d).cast("date") for d in days])


def daytype(day: Column | str, holiday: Column | None = None) -> Column:
    """2 Sunday or holiday, 1 Saturday, 0 weekday."""
    d = _column(day)
    return F.when((F.weekday(d) == 6) | (is_holiday(d) if holiday is None else holiday), 2).when(F.weekday(d) == 5, 1).otherwise(0)


def is_school_break(day: Column | str, breaks=SCHOOL_BREAKS) -> Column:
    d, out = _column(day), F.lit(False)
    for a, b in breaks:
        out = out | d.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return out


def missing_years(df: DataFrame, day: str, breaks=SCHOOL_BREAKS) -> DataFrame:
    """Years in the data for which no school break is known."""
    known = sorted({int(a[:4]) for a, _ in breaks})
    return df.select(F.year(day).alias("year")).distinct().filter(~F.col("year").isin(*known))


# The tilt of the earth's axis in degrees, and the number of days that Cooper's formula adds to the day of the year.
TILT, COOPER_DAYS, YEAR_DAYS = 23.44, 284, 365


def declination(day: Column | str) -> Column:
    """The sun's height over the equator in radians (Cooper's formula)."""
    turn = F.radians((F.dayofyear(_column(day)) + COOPER_DAYS) * (360.0 / YEAR_DAYS))
    return F.sin(turn) * math.radians(TILT)


def daylight_hours(day: Column | str, latitude: float = LATITUDE) -> Column:
    """Hours from sunrise to sunset: the earth turns by twice the hour angle at which the sun sets, 15 degrees an hour."""
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.tan(declination(day)) * -math.tan(math.radians(latitude)))))
    return sunset * (2 * 12 / math.pi)
