"""Column expressions of the delay jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_bucket(key: Column | str, modulo: int = 100) -> Column:
    """A bucket that any engine can make again: the first 15 hex digits of the MD5, modulo `modulo`."""
    return F.pmod(F.conv(F.substring(F.md5(_column(key)), 1, 15), 16, 10).cast("long"), F.lit(modulo)).cast("int")


def random_lead(journey: Column | str, first: int = 5, last: int = 90) -> Column:
    """One pseudo-random number of minutes before departure for each journey."""
    return (hash_bucket(F.concat(_column(journey), F.lit("#lead")), last - first + 1) + first).cast("int")


def clipped(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null (greatest and least skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def in_zone(df: DataFrame, t: str, zone: str) -> Column:
    """A column's time as clock time of a zone, whatever the session's own zone. Times without a zone are UTC."""
    of = F.lit("UTC") if df.schema[t].dataType == TimestampNTZType() else F.current_timezone()
    return F.convert_timezone(of, F.lit(zone), F.col(t).cast("timestamp_ntz"))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("SECOND", _column(a), _column(b))


def minutes_between(a: Column | str, b: Column | str) -> Column:
    """Minute boundaries crossed, not whole minutes: 10:00:59 to 11:31:00 is 91."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", _column(a)), F.date_trunc("minute", _column(b)))


def months_between_starts(a: Column | str, b: Column | str) -> Column:
    a, b = _column(a), _column(b)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def plus_seconds(t: Column | str, n: Column) -> Column:
    return F.timestamp_add("SECOND", n.cast("int"), _column(t))


def plus_minutes(t: Column | str, n: Column) -> Column:
    return F.timestamp_add("MINUTE", n.cast("int"), _column(t))


def minute_of_day(t: Column | str) -> Column:
    return F.hour(_column(t)) * 60 + F.minute(_column(t))


def start_key(t: Column | str) -> Column:
    return F.date_format(_column(t), "HH:mm")


def month_start(d: Column | str) -> Column:
    return F.trunc(_column(d), "month")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def day_fold(d: Column | str, folds: int = 5) -> Column:
    return F.dayofyear(_column(d)) % folds


def week_fold(d: Column | str, data_start: str, folds: int = 5) -> Column:
    """Whole weeks, counted from the Monday of the week in which the data begin."""
    monday = F.trunc(F.lit(data_start).cast("date"), "week")
    return (F.floor(F.datediff(_column(d), monday) / 7) % folds).cast("int")


def fold(d: Column | str, scheme: str, data_start: str) -> Column:
    if scheme not in ("day", "week"):
        raise ValueError(f"folds must be day or week, not {scheme!r}")
    return day_fold(d) if scheme == "day" else week_fold(d, data_start)


def minutes_since_start(minute: Column | str, start: Column | str) -> Column:
    """Minutes from a trip's start to a clock minute, over midnight too."""
    return F.pmod(_column(minute) - _column(start), F.lit(1440))


def binned(x: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the right-closed bin (edges[i], edges[i + 1]] that x falls in; the last edge may be infinite."""
    x, out = _column(x), None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        inside = (x > low) & (F.lit(True) if high == float("inf") else x <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def line_number(line: Column | str) -> Column:
    return F.substring_index(_column(line), "_", -1)


def delay_text(seconds: Column | str) -> Column:
    """12 s, -30 s, 5 min 00 s."""
    x = _column(seconds)
    s = F.rint(F.abs(x)).cast("long")
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(" s"))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).otherwise(minutes))


def clock_text(minute: Column | str) -> Column:
    m = F.pmod(_column(minute).cast("int"), F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def number_text(x: Column | str, decimals: int = 1, sign: bool = False) -> Column:
    """A number with a decimal comma."""
    return F.replace(F.format_string(f"%{'+' if sign else ''}.{decimals}f", _column(x).cast("double")), F.lit("."), F.lit(","))


# Names of days and months in Norwegian, Monday and January first.
DAYS = ("mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag")
MONTHS = ("januar", "februar", "mars", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "desember")


def date_text(d: Column | str) -> Column:
    """søndag 15. august 2027."""
    d = _column(d)
    names, months = F.array(*map(F.lit, DAYS)), F.array(*map(F.lit, MONTHS))
    return F.concat(names[F.weekday(d)], F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(". "), months[F.month(d) - 1], F.lit(" "), F.year(d).cast("string"))
