"""Tables for looking at single trips and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clock_text, delay_text


def trip_table(pred: DataFrame) -> DataFrame:
    """One row per trip: line, direction, day, start, ends and mean delay."""
    first = lambda c: F.min_by(c, "seq").alias(c)
    return pred.groupBy("journey_id").agg(*[first(c) for c in ("line", "direction", "date", "trip_start_min", "origin_name", "dest_name")], F.avg("y").alias("mean_y"))


def hourly_profile(pred: DataFrame, live: DataFrame | None = None, lead: int | None = None) -> DataFrame:
    """Median delay, prediction and baseline in minutes per line, direction and hour; the real-time
    prediction of a lead where there is one, else the one from the day before."""
    p = pred.withColumn("p", F.col("pred"))
    if live is not None:
        rt = live.filter(F.col("lead_min") == lead).select("journey_id", "seq", "pred_rt")
        p = p.join(rt, ["journey_id", "seq"], "left").withColumn("p", F.coalesce("pred_rt", "pred"))
    return p.groupBy("line", "direction", F.floor(F.col("minute_of_day") / 60).cast("int").alias("time")).agg(*[(F.median(c) / 60).alias(n) for c, n in (("y", "y_min"), ("p", "pred_min"), ("baseline", "baseline_min"))])


def usual_destination(trips: DataFrame) -> DataFrame:
    """Most frequent destination per line and direction; ties go to the first by name."""
    n = trips.groupBy("line", "direction", "dest_name").agg(F.count("*").alias("n"))
    return n.groupBy("line", "direction").agg(F.min_by("dest_name", F.struct(-F.col("n"), F.col("dest_name"))).alias("dest_name"))


def trip_errors(pred: DataFrame) -> DataFrame:
    """Mean absolute error of prediction and baseline per trip."""
    return pred.groupBy("journey_id").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae_model"), F.avg(F.abs(F.col("baseline") - F.col("y"))).alias("mae_base"))


def trip_series(pred: DataFrame) -> DataFrame:
    """One row per trip, stop and series, with texts for display."""
    rows = pred.select("journey_id", "seq", "minute_of_day", *[F.col(c).cast("double").alias(c) for c in ("y", "pred", "baseline")])
    long = rows.unpivot(["journey_id", "seq", "minute_of_day"], ["y", "pred", "baseline"], "series", "seconds")
    return long.select("journey_id", "seq", "series", (F.col("seconds") / 60).alias("minutes"), clock_text("minute_of_day").alias("planned"), delay_text("seconds").alias("shown"))


def worst_rush_trip(trips: DataFrame, start: int = 15 * 60, end: int = 17 * 60) -> DataFrame:
    """Per line, direction and day the trip of the afternoon rush with the highest mean delay; ties to the first id."""
    w = Window.partitionBy("line", "direction", "date").orderBy(F.desc("mean_y"), "journey_id")
    rush = trips.filter((F.col("trip_start_min") >= start) & (F.col("trip_start_min") < end))
    return rush.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
