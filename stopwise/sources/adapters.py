"""The relational test tables in the shape of delay data, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import in_zone
from ..schema import Period, Setup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VISITS_LIVE = """
 SELECT concat('J', lpad(CAST(j AS {str}), 9, '0')) AS journey_id, CAST(t0 AS DATE) AS operatingDate,
   concat('L', CAST(j % 3 AS {str})) AS lineRef, CASE WHEN dir = 0 THEN 'Outbound' ELSE 'Inbound' END AS directionRef,
   CASE WHEN seq = 3 THEN 'HUB' ELSE concat('L', CAST(j % 3 AS {str}), '_', CAST(CASE WHEN dir = 0 THEN seq ELSE 6 - seq END AS {str})) END AS stopPointRef,
   CAST(seq AS BIGINT) AS seq, CAST(date_trunc('hour', t0) AS {ntz}) + (seq - 1) * INTERVAL '4' MINUTE AS aimed_arrival_local, CAST(round(value * 8) AS BIGINT) - 120 AS arrival_delay_s
 FROM (SELECT *, CAST(floor(j / 3) AS BIGINT) % 2 AS dir, min(ts) OVER (PARTITION BY j) AS t0
       FROM (SELECT CAST(ts AS {ntz}) AS ts, value, CAST(floor(event_id / 5) AS BIGINT) AS j, CAST(event_id % 5 + 1 AS INT) AS seq FROM events) e) s
 WHERE NOT (seq >= 4 AND j % 7 = 3)"""

VISITS_DAILY = """
 SELECT concat('J', lpad(CAST(l_orderkey AS {str}), 9, '0')) AS journey_id, CAST(o_orderdate AS DATE) AS operatingDate,
   concat('L', CAST(o_custkey % 4 AS {str})) AS lineRef, CASE WHEN o_orderkey % 2 = 0 THEN 'Outbound' ELSE 'Inbound' END AS directionRef,
   concat('L', CAST(o_custkey % 4 AS {str}), '_', CAST(least(rn, 8) AS {str})) AS stopPointRef, CAST(rn AS BIGINT) AS seq,
   CAST(o_orderdate AS {ntz}) + (6 + o_orderkey % 4 * 4) * INTERVAL '1' HOUR + (rn - 1) * INTERVAL '4' MINUTE AS aimed_arrival_local,
   CAST(round(l_quantity * 90) AS BIGINT) - 600 AS arrival_delay_s
 FROM (SELECT l.*, o.*, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS rn
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) x"""

WEATHER = """
 SELECT time, temperature_2m, precipitation, snowfall, snow_depth, wind_speed_10m FROM (
   SELECT CAST(date_trunc('hour', CAST(ts AS {ntz})) AS {ntz}) AS time, avg(value) / 10 AS temperature_2m, CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE) AS precipitation,
     CAST(count(CASE WHEN event_type = 'signup' THEN 1 END) AS DOUBLE) AS snowfall, CAST(0.0 AS DOUBLE) AS snow_depth, max(value) / 10 AS wind_speed_10m
   FROM events GROUP BY date_trunc('hour', CAST(ts AS {ntz}))) w"""

_DUCK = {"str": "VARCHAR", "ntz": "TIMESTAMP"}
_SPARK = {"str": "STRING", "ntz": "TIMESTAMP_NTZ"}


def duck(sql: str) -> str:
    return sql.format(**_DUCK)


def _frame(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    parts = {t: table(spark, sf_dir, t) for t in tables}
    if "events" in parts:
        parts["events"] = parts["events"].withColumn("ts", in_zone(parts["events"], "ts", "UTC"))
    text = sql.format(**_SPARK)
    for t in tables:  # {events} is given as a frame, not as a global view
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **parts)


def visits_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys of five stops from `events`; every seventh loses its last two."""
    v = _frame(spark, sf_dir, VISITS_LIVE, "events")
    return v.withColumn("stopPointName", F.col("stopPointRef"))


def visits_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys from `lineitem` and `orders`."""
    v = _frame(spark, sf_dir, VISITS_DAILY, "lineitem", "orders")
    return v.withColumn("stopPointName", F.col("stopPointRef"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather from `events`; the last hour stands twice."""
    w = _frame(spark, sf_dir, WEATHER, "events")
    last = w.agg(F.max("time").alias("last"))
    return w.unionByName(w.join(F.broadcast(last), F.col("time") == F.col("last")).drop("last"))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a feed of recorded arrivals."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("ts", in_zone(e, "ts", "UTC"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.concat(F.lit("J"), F.col("user_id")).alias("datedServiceJourneyId"), F.to_date("ts").alias("operatingDate"), F.concat(F.lit("L"), F.col("user_id") % 5).alias("lineRef"),
        F.lit("Outbound").alias("directionRef"), F.concat(F.lit("S"), F.col("event_id") % 17).alias("stopPointRef"), F.concat(F.lit("Stop "), F.col("event_id") % 17).alias("stopPointName"),
        F.col("event_id").cast("string").alias("sequenceNr"), F.when(F.col("event_type") != "signup", "ATB").otherwise("OTHER").alias("dataSource"), F.lit("bus").alias("vehicleMode"),
        (k % 10 == 0).alias("journeyCancellation"), (k % 10 == 1).alias("stopCancellation"), F.lit(False).alias("extraJourney"), (k % 10 == 2).alias("estimated"),
        F.when(k % 10 != 3, F.timestamp_add("SECOND", F.round("value").cast("int"), F.date_trunc("second", "ts").cast("timestamp_ntz"))).alias("arrivalTime"), F.col("ts").alias("aimedArrivalTime"),
    )


DAILY = Setup(train=Period("1995-01-01", "1999-12-31"), valid=Period("2000-01-01", "2000-12-31"), test=Period("2001-01-01", "2001-08-01"), data_start="1994-12-01")
LIVE = Setup(train=Period("2024-01-01", "2024-01-20"), valid=Period("2024-01-21", "2024-01-25"), test=Period("2024-01-26", "2024-01-30"), data_start="2024-01-01", past_unit="week")
