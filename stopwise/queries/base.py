"""The registry, and the frames and SQL fragments that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.scalars import hash_bucket, minute_of_day, month_start
from ..plans.datasets import credible
from ..sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def core(visits: DataFrame) -> DataFrame:
    """Credible visits with the columns that history and evaluation need."""
    d, t = F.col("operatingDate"), F.col("aimed_arrival_local")
    return credible(visits).select(
        F.col("arrival_delay_s").cast("int").alias("y"), d.alias("date"), month_start(d).alias("month"), F.col("lineRef").alias("line"), F.col("stopPointRef").alias("stop"), F.col("directionRef").alias("direction"), "seq",
        F.hour(t).alias("hour"), cal.daytype(d).alias("daytype"), minute_of_day(t).alias("minute_of_day"), hash_bucket("journey_id").alias("bucket"), "journey_id",
    )


def daily(spark, sf_dir):
    return core(adapters.visits_daily(spark, sf_dir))


def live(spark, sf_dir):
    return core(adapters.visits_live(spark, sf_dir))


def _holidays() -> str:
    import datetime as dt

    from dateutil.easter import easter

    days = []
    for y in range(1994, 2027):
        days += [easter(y) + dt.timedelta(days=n) for n in cal.MOVING_HOLIDAYS] + [dt.date(y, m, d) for m, d in cal.FIXED_HOLIDAYS]
    return ", ".join(f"DATE '{d}'" for d in sorted(set(days)))


HOLIDAYS = _holidays()


def daytype_sql(d: str) -> str:
    return f"CASE WHEN isodow({d}) = 7 OR {d} IN ({HOLIDAYS}) THEN 2 WHEN isodow({d}) = 6 THEN 1 ELSE 0 END"


_PHI, _DELTA = "radians(63.43)", "radians(23.44) * sin(radians(360.0 * (dayofyear({d}) + 284) / 365))"


def daylight_sql(d: str) -> str:
    """Hours between sunrise and sunset from the sun's declination, by sines and cosines."""
    delta = _DELTA.format(d=d)
    return f"24 / pi() * acos(greatest(-1, least(1, -(sin({_PHI}) * sin({delta})) / (cos({_PHI}) * cos({delta})))))"


def bucket_sql(key: str, modulo: int = 100) -> str:
    return f"CAST(CAST(concat('0x', left(md5({key}), 15)) AS BIGINT) % {modulo} AS INTEGER)"


def core_sql(visits: str) -> str:
    """CTEs v (visits) and c (credible rows)."""
    return f"""v AS ({adapters.duck(visits)}),
 c AS (SELECT CAST(arrival_delay_s AS INTEGER) AS y, operatingDate AS date, CAST(date_trunc('month', operatingDate) AS DATE) AS month, lineRef AS line, stopPointRef AS stop, directionRef AS direction, seq,
   CAST(hour(aimed_arrival_local) AS INTEGER) AS hour, {daytype_sql('operatingDate')} AS daytype, CAST(hour(aimed_arrival_local) * 60 + minute(aimed_arrival_local) AS INTEGER) AS minute_of_day, {bucket_sql('journey_id')} AS bucket, journey_id
   FROM v WHERE arrival_delay_s BETWEEN -1800 AND 3600)"""


DAILY, LIVE = core_sql(adapters.VISITS_DAILY), core_sql(adapters.VISITS_LIVE)
V_DAILY, V_LIVE = f"v AS ({adapters.duck(adapters.VISITS_DAILY)})", f"v AS ({adapters.duck(adapters.VISITS_LIVE)})"
