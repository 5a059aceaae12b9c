"""Planned trip structure from earlier days, and the audit of trips that lost stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import daytype
from ..functions.scalars import month_start, seconds_between, start_key
from ..schema import DELAY_RANGE

PLAN_KEY = ["line", "direction", "daytype", "origin", "start_hm"]
LINE_KEY = ["line", "direction", "daytype"]


def at_lowest(value: str, order: str = "seq") -> Column:
    """The value at the lowest order, nulls of the value left out."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def at_highest(value: str, order: str = "seq") -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def trip_summary(visits: DataFrame) -> DataFrame:
    """One row per journey: line, direction, day, stops, origin, destination, start, duration, day type."""
    t = visits.groupBy("journey_id").agg(
        F.coalesce(F.min("lineRef"), F.lit("")).alias("line"), F.coalesce(F.min("directionRef"), F.lit("")).alias("direction"), F.min("operatingDate").alias("d"), F.max("seq").alias("n"),
        F.coalesce(at_lowest("stopPointName"), F.lit("")).alias("origin"), at_highest("stopPointName").alias("dest"), F.min("aimed_arrival_local").alias("_a"), F.max("aimed_arrival_local").alias("_b"),
    )
    return t.select("journey_id", "line", "direction", "d", "n", "origin", "dest", start_key("_a").alias("start_hm"), (seconds_between("_a", "_b") / 60.0).alias("dur_min"), daytype("d").alias("daytype"))


def best_trip_per_day(trips: DataFrame) -> DataFrame:
    """Of the same planned trip on a day the one with most stops, then the highest id."""
    w = Window.partitionBy(*PLAN_KEY, "d").orderBy(F.desc("n"), F.desc("journey_id"))
    return trips.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*PLAN_KEY, "d", "n", "dest", "dur_min")


def upper_median(values: Column) -> Column:
    """The upper median of an array: of 1, 2, 3, 4 it is 3; null for an empty array."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def grouped_upper_median(value: str) -> Column:
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{value})").cast("long")


def _days_before(keys: list[str], days: int):
    number = F.datediff("d", F.lit("1970-01-01").cast("date"))
    return Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, -1)


def planned_trips(day_trips: DataFrame, days: int = 28) -> DataFrame:
    """Per planned trip and day: stops planned (upper median of the days before), and destination and
    duration of the last earlier day with just so many stops.  All earlier days count for the
    latter, as their last day per number of stops."""
    w = _days_before(PLAN_KEY, days)
    e = day_trips.withColumn("plan_n", upper_median(F.collect_list("n").over(w)))
    probes = e.select(*PLAN_KEY, "d", F.col("plan_n").alias("_n"), F.lit(0).alias("_side"), F.lit(None).cast("struct<dest:string,dur_min:double>").alias("_found"))
    known = day_trips.select(*PLAN_KEY, "d", F.col("n").alias("_n"), F.lit(1).alias("_side"), F.struct("dest", F.col("dur_min").cast("double").alias("dur_min")).alias("_found"))
    last = Window.partitionBy(*PLAN_KEY, "_n").orderBy("d", "_side").rowsBetween(Window.unboundedPreceding, -1)  # a day's own row sorts after its probe
    both = probes.unionByName(known).withColumn("_last", F.last("_found", ignorenulls=True).over(last)).filter("_side = 0")
    hit = F.when(F.col("_n").isNotNull(), F.col("_last"))
    return both.select(*PLAN_KEY, "d", F.col("_n").alias("plan_n"), hit["dest"].alias("dest"), hit["dur_min"].alias("dur_min"))


def planned_lines(trips: DataFrame, days: int = 28) -> DataFrame:
    """Per line, direction, day type and day: upper median of the earlier days' upper medians."""
    per_day = trips.groupBy(*LINE_KEY, "d").agg(grouped_upper_median("n").alias("n"))
    return per_day.select(*LINE_KEY, "d", upper_median(F.collect_list("n").over(_days_before(LINE_KEY, days))).alias("plan_n"))


def trip_plan(visits: DataFrame, days: int = 28) -> DataFrame:
    """One row per journey: planned stops, destination, duration, and whether they come from the same planned trip.
    A journey's own day never counts."""
    k = trip_summary(visits)
    p = planned_trips(best_trip_per_day(k), days)
    lines = planned_lines(k, days).withColumnRenamed("plan_n", "line_n")
    k = k.select("journey_id", *PLAN_KEY, "d").join(p, [*PLAN_KEY, "d"], "left").join(lines, [*LINE_KEY, "d"], "left")
    return k.select("journey_id", F.coalesce("plan_n", "line_n").cast("int").alias("n_stops"), F.col("dest").alias("dest_name"), "dur_min", F.col("plan_n").isNotNull().alias("same_trip"))


def plan_coverage(plan: DataFrame) -> DataFrame:
    """Journeys, and the shares planned from the same trip, from the line, and not at all."""
    same, line = F.col("same_trip").cast("int"), (~F.col("same_trip") & F.col("n_stops").isNotNull()).cast("int")
    return plan.agg(F.count("*").alias("n_trips"), F.avg(same).alias("from_trip"), F.avg(line).alias("from_line"), F.avg(F.lit(1) - same - line).alias("unknown"))


def recorded_trips(visits: DataFrame) -> DataFrame:
    """Per journey the recorded stops, and mean delays over credible rows: all, and the first three stops."""
    ok = F.col("arrival_delay_s").between(*DELAY_RANGE)
    t = visits.groupBy("journey_id").agg(
        F.min("lineRef").alias("line"), F.min("directionRef").alias("direction"), F.min("operatingDate").alias("date"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("n_rec"),
        F.min("aimed_arrival_local").alias("_a"), F.avg(F.when(ok, F.col("arrival_delay_s"))).alias("mean_delay"), F.avg(F.when(ok & (F.col("seq") <= 3), F.col("arrival_delay_s"))).alias("delay_first3"),
    )
    plain = F.when(F.weekday("date") == 6, 2).when(F.weekday("date") == 5, 1).otherwise(0)
    return t.withColumns({"month": month_start("date"), "daytype": plain, "start_hm": start_key("_a")}).drop("_a")


USUAL_KEY = ["line", "direction", "month", "daytype", "start_hm"]


def usual_structure(trips: DataFrame, least_days: int = 3) -> DataFrame:
    """Per planned trip and month its most frequent first and last stop number; ties go to the smallest."""
    g = trips.groupBy(*USUAL_KEY).agg(F.count("*").alias("n_days"), F.mode("max_seq", True).alias("usual_max"), F.mode("min_seq", True).alias("usual_min"))
    return g.filter(F.col("n_days") >= least_days)


def with_usual(trips: DataFrame) -> DataFrame:
    """Each trip beside its usual structure: compared, missing_end, missing_start, truncated."""
    d = trips.join(usual_structure(trips), USUAL_KEY, "left")
    d = d.withColumns({"compared": F.col("n_days").isNotNull(), "missing_end": F.coalesce(F.col("max_seq") < F.col("usual_max"), F.lit(False)), "missing_start": F.coalesce(F.col("min_seq") > F.col("usual_min"), F.lit(False))})
    return d.withColumn("truncated", F.col("missing_end") | F.col("missing_start"))


def structure_by_line(compared: DataFrame) -> DataFrame:
    """Per line: trips, shares of truncated trips and rows, delay on the first stops of full and truncated trips."""
    share = lambda c: (F.avg(F.col(c).cast("int")) * 100)
    cut = F.col("truncated")
    return compared.filter("compared").groupBy("line").agg(
        F.count("*").alias("trips"), share("truncated").alias("truncated_pct"), share("missing_end").alias("missing_end_pct"), share("missing_start").alias("missing_start_pct"),
        (F.sum(F.when(cut, F.col("n_rec")).otherwise(0)) * 100.0 / F.sum("n_rec")).alias("rows_pct"), F.avg(F.when(~cut, F.col("delay_first3"))).alias("first3_full_s"), F.avg(F.when(cut, F.col("delay_first3"))).alias("first3_truncated_s"),
    )


def structure_audit(compared: DataFrame) -> DataFrame:
    """The audit in one row: shares, mean delay on the first three stops, and the difference inside a line
    weighted by truncated trips."""
    c = compared.filter("compared")
    cut = F.col("truncated")
    line = c.groupBy("line").agg(F.avg(F.when(cut, F.col("delay_first3"))).alias("t"), F.avg(F.when(~cut, F.col("delay_first3"))).alias("f"), F.sum(cut.cast("long")).alias("w")).filter("t is not null and f is not null")
    within = line.agg((F.sum((F.col("t") - F.col("f")) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("within_line_s"))
    total = c.agg(F.count("*").alias("compared"), F.sum(cut.cast("long")).alias("truncated"), F.avg(F.when(~cut, F.col("delay_first3"))).alias("first3_full_s"), F.avg(F.when(cut, F.col("delay_first3"))).alias("first3_truncated_s"))
    return total.crossJoin(within)  # one row each


def lowest_seq_shares(trips: DataFrame) -> DataFrame:
    """How often each stop number is a trip's lowest."""
    n = trips.groupBy("min_seq").agg(F.count("*").alias("n"))
    return n.select("min_seq", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
