"""Real-time features: what is known so many minutes before departure, from observations made until then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clipped, minutes_between, plus_minutes, plus_seconds, random_lead, seconds_between
from ..operators.asof import Series, asof_join, asof_lookups, bucket_sums, latest_per, running_sums, window_series, windowed_sums, with_windows
from ..operators.trips import at_lowest
from ..sources.scratch import stored
from ..schema import DEVIATION_RANGE, GROWTH_RANGE, Setup
from .datasets import Histories, sampled

#: Running sums: keys, bucket minutes, value.
SERIES = {"ld": (["line", "direction"], 5, "anom"), "stop": (["stop"], 15, "anom"), "net": ([], 5, "anom"), "seg": (["prev_stop", "stop"], 5, "growth")}


def trip_times(visits: DataFrame, plan: DataFrame) -> DataFrame:
    """Per journey: start, origin, and the planned end (start plus planned duration)."""
    t = visits.groupBy("journey_id").agg(F.min("lineRef").alias("line"), F.min("aimed_arrival_local").cast("timestamp_ntz").alias("trip_start_ts"), at_lowest("stopPointName").alias("origin_name"))
    t = t.join(plan.select("journey_id", "dest_name", "n_stops", "dur_min"), "journey_id", "left")
    return t.withColumn("trip_end_ts", plus_seconds("trip_start_ts", F.round(F.col("dur_min") * 60))).drop("dur_min")


def observations(rows: DataFrame, times: DataFrame, histories: Histories) -> DataFrame:
    """Each visit at its actual time, with its deviation from the baseline of its month and the growth since the previous stop."""
    c = histories.whole_past().baseline(rows, histories.key).join(times.select("journey_id", "trip_start_ts"), "journey_id")
    c = c.withColumn("anom", clipped(F.col("y") - F.col("baseline"), *DEVIATION_RANGE)).withColumn("obs_ts", plus_seconds("trip_start_ts", F.round(F.col("sched_min_from_start") * 60) + F.col("y")))
    j = Window.partitionBy("journey_id").orderBy("seq")
    c = c.withColumns({"growth": clipped(F.col("anom") - F.lag("anom").over(j), *GROWTH_RANGE), "prev_stop": F.lag("stop").over(j)})
    return c.select("journey_id", "seq", "line", "direction", "stop", "y", "obs_ts", "anom", "growth", "prev_stop")


def series(obs: DataFrame, name: str) -> DataFrame:
    keys, minutes, value = SERIES[name]
    rows = obs.filter("prev_stop is not null") if name == "seg" else obs
    return running_sums(bucket_sums(rows, keys, minutes, value), keys)


def last_by_line(obs: DataFrame) -> DataFrame:
    return latest_per(obs.filter("anom is not null"), ["line", "direction", "obs_ts"], ["journey_id", "seq"])


def last_by_stop(obs: DataFrame) -> DataFrame:
    return latest_per(obs.filter("anom is not null"), ["line", "direction", "stop", "obs_ts"], ["journey_id", "seq"])


def last_by_journey(obs: DataFrame) -> DataFrame:
    return latest_per(obs, ["journey_id", "obs_ts"], ["seq"])


def trip_ends(times: DataFrame, any_line: bool = False) -> DataFrame:
    ended = times.filter("trip_end_ts is not null").select("journey_id", "line", "dest_name", "trip_end_ts", "n_stops")
    return latest_per(ended, ["dest_name", "trip_end_ts"] if any_line else ["line", "dest_name", "trip_end_ts"], ["journey_id"])


def query_rows(rows: DataFrame, times: DataFrame, setup: Setup, split: str) -> DataFrame:
    """Sampled rows with their lead, the time T up to which data are known, and the previous stop.
    Test rows stand once for each of the fixed leads, others have one lead drawn per trip."""
    q = sampled(rows, setup, split).join(times.select("journey_id", "trip_start_ts", F.col("origin_name").alias("origin_stopname")), "journey_id")
    lead = F.explode(F.array(*[F.lit(x) for x in setup.test_leads])) if split == "test" else random_lead("journey_id", setup.lead_min, setup.lead_max)
    q = q.withColumn("lead_min", lead)
    q = q.withColumn("T", plus_minutes("trip_start_ts", -(F.col("lead_min") + setup.buffer_min)))
    return q.withColumn("prev_stop", F.lag("stop").over(Window.partitionBy("journey_id", "lead_min").orderBy("seq")))


def minutes(a: str, b: str):
    return seconds_between(a, b) / 60.0


def incoming(trips: DataFrame, times: DataFrame, max_gap: int, any_line: bool = False) -> DataFrame:
    """The vehicle that will run each trip: the last planned trip that ends at its origin before its start, of
    the same line; with any_line, of another one where there is none. Gaps over max_gap minutes do not count."""
    found = asof_join(trips.withColumn("dest_name", F.col("origin_stopname")), trip_ends(times), ["line", "dest_name"], "trip_start_ts", "trip_end_ts", ["journey_id", "trip_end_ts", "n_stops"], "in_", strict=True)
    ok = minutes_between("in_trip_end_ts", "trip_start_ts") <= max_gap
    if not any_line:
        return found.withColumns({"in_journey_id": F.when(ok, F.col("in_journey_id")), "in_trip_end_ts": F.when(ok, F.col("in_trip_end_ts"))}).drop("dest_name")
    found = asof_join(found, trip_ends(times, True), ["dest_name"], "trip_start_ts", "trip_end_ts", ["journey_id", "trip_end_ts", "n_stops", "line"], "in2_", strict=True)
    ok2 = minutes_between("in2_trip_end_ts", "trip_start_ts") <= max_gap
    pick = {f"in_{c}": F.when(ok, F.col(f"in_{c}")).when(ok2, F.col(f"in2_{c}")) for c in ("journey_id", "trip_end_ts", "n_stops")}
    same = F.when(ok, F.lit(1)).when(ok2, (F.col("in2_line") == F.col("line")).cast("int"))
    return found.withColumns({**pick, "rt_in_same_line": same}).drop("dest_name", "in2_journey_id", "in2_trip_end_ts", "in2_n_stops", "in2_line")


def incoming_delay(trips: DataFrame, obs: DataFrame) -> DataFrame:
    """The incoming vehicle's last known delay at T, its age, progress along its trip and remaining slack."""
    o = last_by_journey(obs).withColumnRenamed("journey_id", "in_journey_id")
    f = asof_join(trips, o, ["in_journey_id"], "T", "obs_ts", ["obs_ts", "y", "seq"], "o_")
    gap = minutes("in_trip_end_ts", "trip_start_ts")
    return f.withColumns(
        {
            "rt_in_gap_min": gap, "rt_in_delay": F.col("o_y").cast("double"), "rt_in_age_min": minutes("o_obs_ts", "T"),
            "rt_in_progress": F.col("o_seq") / F.nullif(F.col("in_n_stops").cast("double"), F.lit(0.0)), "rt_in_slack_min": gap - F.col("o_y") / 60.0,
        }
    ).drop("o_obs_ts", "o_y", "o_seq")


TRIP = ["journey_id", "lead_min"]


def line_features(tr: DataFrame, obs: DataFrame) -> DataFrame:
    """Windows of the line and its last observation, from one lookup: both have the line's keys."""
    windows = [20, 60, 180]
    sums = window_series(series(obs, "ld"), windows, "ld")
    last = Series(last_by_line(obs), "obs_ts", ["anom", "obs_ts"], "l_")
    f = with_windows(asof_lookups(tr, ["line", "direction"], "T", [sums, last]), sums, windows, "ld")
    return f.withColumns({"rt_ld_last_anom": F.col("l_anom"), "rt_ld_last_age_min": minutes("l_obs_ts", "T")}).drop("l_anom", "l_obs_ts")


def trip_features(q: DataFrame, obs: DataFrame, times: DataFrame, setup: Setup, any_line: bool = False) -> DataFrame:
    """Features that all stops of a (journey, lead) share: line and network windows, last observation, incoming vehicle.
    Each lookup adds its columns to the rows of the one before, which are written as a lookup reads them twice."""
    tr = stored(q.select(*TRIP, "line", "direction", "T", "trip_start_ts", "origin_stopname").distinct())
    f = windowed_sums(line_features(tr, obs), series(obs, "net"), [], [15, 60], "net").drop("rt_net_n60")
    f = stored(incoming(stored(f), times, setup.incoming_max_gap, any_line))
    f = incoming_delay(f, obs)
    return f.select(*TRIP, *[c for c in f.columns if c.startswith("rt_")])


def stop_features(q: DataFrame, obs: DataFrame) -> DataFrame:
    """Per row: windows of the stop and of the segment from the previous stop, and the previous vehicle at the stop."""
    f = q.select(*TRIP, "seq", "line", "direction", "stop", "prev_stop", "T")
    f = stored(windowed_sums(f, series(obs, "stop"), ["stop"], [60], "stop"))
    f = stored(windowed_sums(f, series(obs, "seg"), ["prev_stop", "stop"], [30, 90], "seg"))
    f = asof_join(f, last_by_stop(obs), ["line", "direction", "stop"], "T", "obs_ts", ["anom", "obs_ts"], "p_")
    f = f.withColumns({"rt_prev_anom": F.col("p_anom"), "rt_prev_age_min": minutes("p_obs_ts", "T")})
    return f.select(*TRIP, "seq", *[c for c in f.columns if c.startswith("rt_")])


def along_trip(rows: DataFrame) -> DataFrame:
    """Running sum of the segment growth and running share of observed segments along each trip."""
    w = Window.partitionBy(*TRIP).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cols = {}
    for m in (30, 90):
        cols[f"rt_segcum{m}"] = F.sum(F.coalesce(F.col(f"rt_seg_anom{m}"), F.lit(0.0))).over(w)
        cols[f"rt_segcov{m}"] = F.avg((F.col(f"rt_seg_n{m}") > 0).cast("int")).over(w)
    return rows.withColumns(cols)


def live_dataset(visits: DataFrame, rows: DataFrame, plan: DataFrame, histories: Histories, split: str, any_line: bool = False) -> DataFrame:
    """One of the real-time sets: static and history columns, lead, horizon and everything known at T."""
    setup = histories.setup
    times = stored(trip_times(visits, plan))
    obs = stored(observations(rows, times, histories))
    base = rows.drop("stop_name", "origin_name", "dest_name")
    q = stored(query_rows(base, times, setup, split))
    static = histories.past(split).baseline(q, histories.key, among=q)
    for h, key, prefix in histories.plan(split):
        static = h.features(static, key, prefix, q)
    per_stop, per_trip = stored(stop_features(q, obs)), stored(trip_features(q, obs, times, setup, any_line))
    out = static.join(per_stop, [*TRIP, "seq"]).join(per_trip, TRIP)
    out = along_trip(out).withColumn("horizon_min", F.col("lead_min") + F.col("sched_min_from_start"))
    drop = ["month", "bucket", "T", "trip_start_ts", "origin_stopname", "prev_stop"] + ([] if split == "test" else ["journey_id"])
    return out.drop(*drop)


def live_window(rows: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """The rows of a date-bounded run: the day before the start stays, as windows reach over midnight."""
    return rows.filter(F.col(date).between(F.date_sub(F.lit(start).cast("date"), 1), F.lit(end).cast("date")))
