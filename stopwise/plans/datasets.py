"""Composite jobs: cleaned visits, train/valid/test sets, rolling and variant sets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.scalars import fold, hash_bucket, minute_of_day, month_start, seconds_between
from ..operators import history
from ..schema import DELAY_RANGE, Setup
from ..sources.scratch import stored

WEATHER_NAMES = {"temperature_2m": "temp", "precipitation": "precip", "snowfall": "snowfall", "snow_depth": "snow_depth", "wind_speed_10m": "wind", "precip_3h": "precip_3h"}
IDS = ["journey_id", "stop_name", "origin_name", "dest_name"]
NOT_FEATURES = ["y", "date", "baseline", "baseline_recent", *IDS]


def credible(df: DataFrame, delay: str = "arrival_delay_s") -> DataFrame:
    return df.filter(F.col(delay).between(*DELAY_RANGE))


def trip_windows(visits: DataFrame) -> DataFrame:
    """Visits with their journey's start and first and last stop name, over all its rows."""
    j = Window.partitionBy("journey_id")
    js = j.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return visits.withColumns({"trip_start": F.min("aimed_arrival_local").over(j), "origin_name": F.first("stopPointName").over(js), "dest_name": F.last("stopPointName").over(js)})


def clean(visits: DataFrame, plan: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Credible visits with planned structure, clock, calendar, daylight and weather columns.

    Journey windows and the plan's join share one distribution by journey; the filter comes
    after them, as a journey's start and ends are those of all its rows.
    """
    rows = trip_windows(visits.join(plan.select("journey_id", "n_stops"), "journey_id", "left"))
    f = credible(rows)
    d, t = F.col("operatingDate"), F.col("aimed_arrival_local")
    extra: list[Column] = []
    if weather is not None:  # a few thousand hours a year; Spark broadcasts it by its size
        w = weather.select(F.col("time").alias("_hour"), *[F.col(c).alias(n) for c, n in WEATHER_NAMES.items() if c in weather.columns])
        f = f.join(w, F.date_trunc("hour", t).cast("timestamp_ntz") == F.col("_hour"), "left")
        extra = [F.col(n) for c, n in WEATHER_NAMES.items() if c in weather.columns]
    return f.select(
        F.col("arrival_delay_s").cast("int").alias("y"), d.alias("date"), month_start(d).alias("month"), F.col("lineRef").alias("line"), F.col("stopPointRef").alias("stop"), F.col("directionRef").alias("direction"), "seq", "n_stops",
        (F.col("seq") / F.nullif(F.col("n_stops").cast("double"), F.lit(0.0))).alias("route_frac"), (seconds_between("trip_start", t) / 60.0).alias("sched_min_from_start"), minute_of_day("trip_start").alias("trip_start_min"),
        minute_of_day(t).alias("minute_of_day"), F.hour(t).alias("hour"), (F.weekday(d) + 1).alias("weekday"), cal.is_holiday(d).cast("int").alias("is_holiday"), cal.daytype(d).alias("daytype"),
        cal.is_school_break(d).cast("int").alias("is_school_break"), cal.daylight_hours(d).alias("daylight_h"), *extra, hash_bucket("journey_id").alias("bucket"), "journey_id", F.col("stopPointName").alias("stop_name"), "origin_name", "dest_name",
    )


def feature_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in NOT_FEATURES and not c.startswith("refit_")]


def without_realtime(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not c.startswith("rt_") and c not in ("lead_min", "horizon_min")]


ROUND_2 = ("rt_prev_", "rt_seg_", "rt_segcum", "rt_segcov", "rt_in_")


def round_one(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not c.startswith(ROUND_2)]


def with_refit(df: DataFrame) -> DataFrame:
    """The history that is to be used for refitting, under the names of the features."""
    refit = [c for c in df.columns if c.startswith("refit_")]
    return df.drop(*[c.removeprefix("refit_") for c in refit]).withColumnsRenamed({c: c.removeprefix("refit_") for c in refit})


def sampled(rows: DataFrame, setup: Setup, split: str) -> DataFrame:
    """The rows of a split: its days, and whole trips of its share."""
    p = setup.period(split)
    return rows.filter((F.col("bucket") < dict(setup.sample_pct)[split]) & F.col("date").between(F.lit(p.start).cast("date"), F.lit(p.end).cast("date")))


class Histories:
    """The history tables that the splits look up. The past of a split is kept for its own months only."""

    def __init__(self, rows: DataFrame, setup: Setup):
        self._rows, self.setup = rows, setup

    @cached_property
    def rows(self) -> DataFrame:
        return history.day_counts(self._rows)

    @cached_property
    def first(self) -> history.History:
        return history.leave_fold_out(self.rows, self.setup.data_start, self.setup.train.end, self.setup.fold_scheme)

    @cached_property
    def second(self) -> history.History:
        return history.leave_fold_out(self.rows, self.setup.data_start, self.setup.valid.end, self.setup.fold_scheme)

    @property
    def key(self) -> Column:
        """The period (its first day) whose past a row looks up."""
        return F.trunc("date", self.setup.past_unit)

    def _periods(self, start: str, end: str) -> list[str]:
        return history.period_starts(start, end, self.setup.past_unit)

    def _of_split(self, split: str) -> list[str]:
        p = self.setup.period(split)
        return self._periods(p.start, p.end)

    @lru_cache(maxsize=None)  # noqa: B019
    def past(self, split: str) -> history.History:
        return history.expanding(self.rows, self._of_split(split), self.setup.past_unit)

    @lru_cache(maxsize=None)  # noqa: B019
    def recent(self, split: str) -> history.History:
        return history.recent(self.rows, self._of_split(split), self.setup.recent_days)

    def whole_past(self) -> history.History:
        """The expanding past for every month of all splits."""
        return history.expanding(self.rows, self._periods(self.setup.train.start, self.setup.test.end), self.setup.past_unit)

    def plan(self, split: str):
        """(history, key, column prefix) of a split: own day's fold left out while fitting, all days of the period after it."""
        own = fold("date", self.setup.fold_scheme, self.setup.data_start)
        everything = F.lit(5)
        if split == "train":
            return [(self.first, own, ""), (self.second, own, "refit_")]
        if self.setup.after == "monthly":
            frozen = (self.past(split), self.key, "")
        else:
            frozen = (self.first if split == "valid" else self.second, everything, "")
        return [frozen, (self.second, own, "refit_")] if split == "valid" else [frozen]


def split_dataset(rows: DataFrame, histories: Histories, split: str) -> DataFrame:
    """One of train, valid, test: features, baselines by month, history by the split's plan; ids only in test."""
    past, recent = ({c: p + c for c in history.BASELINE} for p in ("_b_", "_r_"))
    lookups = [(histories.past(split), histories.key, past), (histories.recent(split), histories.key, recent)]
    lookups += [(h, key, {c: prefix + c for c in history.FEATURES}) for h, key, prefix in histories.plan(split)]
    plain = sampled(rows, histories.setup, split)
    out = history.attached(plain, lookups)
    features = [name for _, _, columns in lookups[2:] for name in columns.values()]
    out = out.select(*plain.columns, F.coalesce(*past.values()).alias("baseline"), F.coalesce(*recent.values()).alias("baseline_recent"), *features)
    drop = ["month", "bucket"] + ([] if split == "test" else IDS)
    out = out.drop(*drop)
    return out.select(*[c for c in out.columns if c not in IDS], *[c for c in IDS if c in out.columns])


def rolling_dataset(rows: DataFrame, month: str, setup: Setup) -> DataFrame:
    """The dataset to judge one month: train up to two months before it, stop early on the month before,
    test on it; history only from before it. part tells train, stop and test rows apart."""
    m = F.lit(month).cast("date")
    before = F.add_months(m, -1)
    past = rows.filter(F.col("date") < m)
    lfo = history.History(history.histogram(past.filter(F.col("date") >= F.lit(setup.data_start).cast("date")), fold("date", setup.fold_scheme, setup.data_start)), history.other_folds())
    part = F.when(F.col("date") < before, "train").when(F.col("date") < m, "stop").when(F.col("month") == m, "test")
    out = rows.filter((F.col("date") >= F.lit(setup.train.start).cast("date")) & (F.col("month") <= m)).withColumn("part", part)
    key = F.when(F.col("part") == "test", F.lit(5)).otherwise(fold("date", setup.fold_scheme, setup.data_start))
    out = lfo.features(out, key)
    return history.expanding(rows, history.months(setup.train.start, month)).baseline(out, F.col("month"))


def cv_datasets(rows: DataFrame, months: Sequence[str], setup: Setup) -> DataFrame:
    """rolling_dataset for several months at once: every row stands once for each cv_month that uses it. A history's key
    is the month and the fold that is left out (5: none), so one histogram serves all months."""
    own = fold("date", setup.fold_scheme, setup.data_start)
    tested = F.array(*[F.lit(m).cast("date") for m in sorted(months)])
    key = lambda m, k: F.concat_ws("/", m.cast("string"), k.cast("string"))
    past = rows.filter(F.col("date") >= F.lit(setup.data_start).cast("date"))
    unit = F.struct(F.trunc("date", "month").alias("month"), own.alias("fold"))
    lfo = history.History(history.histogram(past, unit), history.folds_before(months))
    used = rows.filter(F.col("date") >= F.lit(setup.train.start).cast("date"))
    used = history.expanding(rows, history.months(setup.train.start, max(months))).baseline(used, F.col("month"))
    used = used.withColumn("cv_month", F.explode(F.filter(tested, lambda m: m >= F.col("month"))))
    part = F.when(F.col("month") == F.col("cv_month"), "test").when(F.col("month") == F.add_months("cv_month", -1), "stop").otherwise("train")
    used = used.withColumn("part", part)
    return lfo.features(used, key(F.col("cv_month"), F.when(F.col("part") == "test", F.lit(5)).otherwise(own)))


#: Rows of a range of hashes that one task may put in order, and the digits of a hash that are looked at.
SMALL, DIGITS = 50_000, 30


def fixed_samples(rows: DataFrame, group: Column, size: Column, key: Sequence[str], seed: Column) -> DataFrame:
    """`size` rows of each group, the same at every run: those with the smallest hash of key and seed; all rows of a group
    whose size is null or larger than the group.

    size is the same for all rows of a group; groups are few (months, parts), as each keeps a line in the driver.  The hash
    below which a group's rows lie is found digit by digit: counts by the next two digits tell in which of 256 ranges the
    last row is.  Only that range, of SMALL rows at most (unless they share all of DIGITS), is put in order; the rows before
    it are taken as they lie.
    """
    spark, columns = rows.sparkSession, rows.columns
    hashed = rows.withColumns({"_group": F.coalesce(group.cast("string"), F.lit("")), "_size": size.cast("long"), "_hash": F.md5(F.concat_ws("|", *key, seed.cast("string")))})
    width, ended = 0, []  # group, the hash's first digits at its end, rows to take from there; without digits all rows
    left: dict[str, int] = {}
    while width == 0 or left:
        inside = hashed.filter(F.col("_size").isNotNull())
        if width:
            looked_at = spark.createDataFrame([(g, prefix) for g, (prefix, _) in left.items()], "_g string, _prefix string")
            inside = inside.join(F.broadcast(looked_at), (F.col("_group") == F.col("_g")) & F.col("_hash").startswith(F.col("_prefix")))
        digits = F.substring("_hash", width + 1, 2).alias("digits")
        found: dict[str, list] = {}
        for g, d, n, most in inside.groupBy("_group", digits).agg(F.count("*"), F.max("_size")).collect():
            found.setdefault(g, []).append((d, n, most))
        width, before, left = width + 2, left, {}
        for g, counts in found.items():
            prefix, rest = before.get(g, ("", counts[0][2]))
            for d, n, _ in sorted(counts):
                if rest <= n:
                    end = (prefix + d, rest)
                    if n <= SMALL or width >= DIGITS:
                        ended.append((g, *end))
                    else:
                        left[g] = end
                    break
                rest -= n  # a group with fewer rows than its size comes to no end
    ends = spark.createDataFrame(ended, "_g string, _end string, _left long")
    marked = hashed.join(F.broadcast(ends), F.col("_group") == F.col("_g"), "left").withColumn("_head", F.expr("substring(_hash, 1, length(_end))"))
    last = marked.filter("_head = _end").withColumn("_n", F.row_number().over(Window.partitionBy("_group").orderBy("_hash", *key)))
    return marked.filter("_end is null or _head < _end").select(columns).unionByName(last.filter("_n <= _left").select(columns))


def fixed_sample(rows: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """n rows, the same at every run: those with the smallest hash of key and seed.

    The hash below which n rows lie is found digit by digit: counts by the next three digits tell in which of 4096 ranges
    the n-th row is.  Only the last range, of SMALL rows at most (unless they share all of DIGITS), is put in order; all
    rows before it are taken as they lie.
    """
    rows = rows.withColumn("_hash", F.md5(F.concat_ws("|", *key, F.lit(str(seed)))))
    prefix, left = "", n
    while True:
        inside = rows.filter(F.col("_hash").startswith(prefix)) if prefix else rows
        counts = sorted(tuple(r) for r in inside.groupBy(F.substring("_hash", len(prefix) + 1, 3).alias("digits")).count().collect())
        for digits, count in counts:  # noqa: B007
            if left <= count:
                break
            left -= count
        else:
            taken = rows.filter(F.substring("_hash", 1, len(prefix)) <= prefix) if prefix else rows  # there are fewer
            return taken.drop("_hash")
        prefix += digits
        if count <= SMALL or len(prefix) >= DIGITS:
            break
    head = F.substring("_hash", 1, len(prefix))
    last = rows.filter(head == prefix).orderBy("_hash", *key).limit(left)
    return rows.filter(head < prefix).unionByName(last).drop("_hash")


def other_calendar(rows: DataFrame, holidays: Sequence[str]) -> DataFrame:
    """Rows with is_holiday and daytype made anew from another list of holidays."""
    flag = cal.is_in("date", holidays)
    return rows.withColumns({"is_holiday": flag.cast("int"), "daytype": cal.daytype("date", flag)})


def source_rows(rows: DataFrame, setup: Setup, all_rows: bool, period_end: str, share: int | None = None) -> DataFrame:
    """The rows that history is built on: all of them, or only those of the splits' samples (share: another percentage
    of the train rows)."""
    if all_rows:
        return rows
    pct = dict(setup.sample_pct)
    pct["train"] = pct["train"] if share is None else share
    return rows.filter(
        ((F.col("bucket") < pct["train"]) & (F.col("date") <= F.lit(setup.train.end).cast("date"))) | ((F.col("bucket") < pct["valid"]) & F.col("date").between(F.lit(setup.valid.start).cast("date"), F.lit(period_end).cast("date")))
    )


def variant(rows: DataFrame, setup: Setup, split: str, holidays: Sequence[str] | None = None, all_rows: bool = True, scheme: str = "folds", counted: bool = False, aged: bool = False) -> DataFrame:
    """A dataset of one variant: calendar, rows behind the history, history scheme (folds, week, month),
    and optionally the number of rows behind the finest median and the age of the history in months."""
    rows = rows if holidays is None else other_calendar(rows, holidays)
    basis = source_rows(rows, setup, all_rows, setup.valid.end)
    out = sampled(rows, setup, split)
    if scheme == "folds":
        end = setup.train.end if split != "test" else setup.valid.end
        h = history.leave_fold_out(basis, setup.data_start, end, setup.fold_scheme)
        key = fold("date", setup.fold_scheme, setup.data_start) if split == "train" else F.lit(5)
    else:
        starts = [str(r[0]) for r in out.select(F.trunc("date", scheme).alias("p")).distinct().orderBy("p").collect()]  # one per week or month
        h, key = history.expanding(basis, starts, scheme), F.trunc("date", scheme)
    out = h.features(out, key)
    if counted:
        keys = history.SPECS["lsdhd"][0]
        p = setup.period(split)
        counts = history.with_counts(basis, history.months(p.start, p.end))
        counts = counts.select(F.col("hkey").alias("month"), *keys, "hist_n_lsdhd")
        out = out.join(counts, ["month", *keys], "left")
    if aged:
        end = F.lit(setup.train.end if split != "test" else setup.valid.end).cast("date")
        months = (F.year("date") - F.year(end)) * 12 + F.month("date") - F.month(end)
        out = out.withColumn("hist_age_months", F.greatest(F.lit(0), months))
    return out


@dataclass(frozen=True)
class Variant:
    """One way to build the datasets: calendar (None: the rows' own), rows behind the history, its scheme (folds, week,
    month) and kind of folds, share in percent and first day of the train rows (None: the setup's), and the extra columns
    hist_n_lsdhd (rows behind the finest median) and hist_months (months that the history spans)."""

    holidays: tuple[str, ...] | None = None
    all_rows: bool = True
    scheme: str = "folds"
    folds: str = "day"
    share: int | None = None
    start: str | None = None
    counted: bool = False
    aged: bool = False


#: Share of the train rows in the first setup.
FIRST_SHARE = 12


def variants(setup: Setup, holidays: Sequence[str]) -> dict[str, Variant]:
    """The variants that are compared, by name: each step changes one thing; V6 is the reference."""
    old = {"share": FIRST_SHARE, "start": setup.data_start}
    later = history.months(setup.train.start, setup.train.end)[2]  # training from the third month on
    return {
        "V0": Variant(tuple(holidays), all_rows=False, counted=True, **old),
        "V1": Variant(tuple(holidays), counted=True, **old),
        "V2": Variant(counted=True, **old),
        "V3": Variant(**old),
        "V4": Variant(),
        "V4u": Variant(folds="week"),
        "V5": Variant(scheme="week"),
        "V6": Variant(scheme="month"),
        "C": Variant(scheme="month", start=later),
        "C2": Variant(scheme="week", start=later),
        "D": Variant(scheme="month", aged=True),
    }


#: Rows of each part at most: of a month that is judged, and of one that variants are compared on.
ROLLING_ROWS = (("train", 4_000_000), ("stop", 500_000), ("test", None))
VARIANT_ROWS = (("train", 1_000_000), ("stop", 150_000), ("test", 300_000))


def month_parts(rows: DataFrame, months: Sequence[str], setup: Setup, most: Sequence[tuple], share: int | None = None, start: str | None = None, seed: int = 0) -> DataFrame:
    """The rows of several months' datasets, each row once for every cv_month that uses it, with its part: train up to two
    months before, stop the month before, test the month itself.

    A part has whole trips of its share, and of these `most` rows (None: all), chosen by a hash; only the choice of train
    rows depends on the seed.  Rows without a date are in no part.
    """
    pct = dict(setup.sample_pct)
    by_part = lambda train, stop, test: F.when(F.col("part") == "train", train).when(F.col("part") == "stop", stop).otherwise(test)
    tested = F.array(*[F.lit(m).cast("date") for m in sorted(months)])
    month = F.trunc("date", "month")
    shares = [F.lit(pct["train"] if share is None else share), F.lit(pct["valid"]), F.lit(pct["test"])]
    used = rows.filter(F.col("bucket") < F.greatest(*shares)).withColumn("cv_month", F.explode(F.filter(tested, lambda m: m >= month)))
    used = used.withColumn("part", F.when(month == F.col("cv_month"), "test").when(month == F.add_months("cv_month", -1), "stop").otherwise("train"))
    first = F.lit(start or setup.train.start).cast("date")
    used = used.filter((F.col("bucket") < by_part(*shares)) & ((F.col("part") != "train") | (F.col("date") >= first)))
    sizes = [F.lit(dict(most)[p]).cast("long") for p in ("train", "stop", "test")]
    return fixed_samples(used, F.concat_ws("/", "cv_month", "part"), by_part(*sizes), ["journey_id", "seq"], by_part(F.lit(seed), F.lit(0), F.lit(0)))


def _month_folds(rows: DataFrame, months: Sequence[str], setup: Setup, folds: str, specs: dict) -> tuple[history.History, Column]:
    """History by folds from before each cv_month, and its key for rows with cv_month and part: test rows have all folds."""
    own = fold("date", folds, setup.data_start)
    unit = F.struct(F.trunc("date", "month").alias("month"), own.alias("fold"))
    past = rows.filter(F.col("date") >= F.lit(setup.data_start).cast("date"))
    key = F.concat_ws("/", F.col("cv_month").cast("string"), F.when(F.col("part") == "test", F.lit(5)).otherwise(own).cast("string"))
    return history.History(history.histogram(past, unit), history.folds_before(months), specs), key


def rolling_samples(rows: DataFrame, months: Sequence[str], setup: Setup, most: Sequence[tuple] = ROLLING_ROWS, seed: int = 0) -> DataFrame:
    """rolling_dataset for several months at once with parts of bounded size; the baseline is from before a row's month."""
    used = stored(month_parts(rows, months, setup, most, seed=seed))
    lfo, key = _month_folds(rows, months, setup, setup.fold_scheme, history.SPECS)
    out = lfo.features(used, key)
    return history.expanding(rows, history.months(setup.train.start, max(months))).baseline(out, F.trunc("date", "month"), among=used)


def variant_samples(rows: DataFrame, months: Sequence[str], setup: Setup, v: Variant, most: Sequence[tuple] = VARIANT_ROWS, seed: int = 0) -> DataFrame:
    """The datasets of one variant for several months at once, with parts of bounded size.

    The baseline is that of the variant's own history.  A history of a sample's rows has those up to the end of valid.
    """
    return Variants(rows, months, setup, most, seed).samples(v)


class Variants:
    """The datasets of several variants. What two of them have in common is made once: the choice of rows, the counts
    behind the histories, and a history's tables. Rows after the last month are in no part and in no history."""

    def __init__(self, rows: DataFrame, months: Sequence[str], setup: Setup, most: Sequence[tuple] = VARIANT_ROWS, seed: int = 0):
        self.months, self.setup, self.most, self.seed = months, setup, most, seed
        self.rows = stored(rows.filter(F.col("date") < F.add_months(F.lit(max(months)).cast("date"), 1)))

    @lru_cache(maxsize=None)  # noqa: B019
    def _parts(self, share: int | None, start: str | None) -> DataFrame:
        return stored(month_parts(self.rows, self.months, self.setup, self.most, share, start, self.seed))

    @lru_cache(maxsize=None)  # noqa: B019
    def _counts(self, all_rows: bool, share: int | None) -> DataFrame:
        return history.day_counts(source_rows(self.rows, self.setup, all_rows, self.setup.valid.end, share))

    @lru_cache(maxsize=None)  # noqa: B019
    def _history(self, holidays: tuple[str, ...] | None, all_rows: bool, share: int | None, scheme: str, folds: str, start: str | None) -> tuple[history.History, Column]:
        """A history and the period that a row looks up."""
        basis = self._counts(all_rows, share)
        basis = basis if holidays is None else other_calendar(basis, holidays)
        if scheme == "folds":
            return _month_folds(basis, self.months, self.setup, folds, history.COUNTED)
        key = F.trunc("date", scheme)
        stop = str(dt.date.fromisoformat(min(self.months)) - dt.timedelta(days=31))  # stop rows are older than the first month
        last = str(dt.date.fromisoformat(max(self.months)) + dt.timedelta(days=31))
        starts = history.period_starts(min(start or self.setup.train.start, stop), last, scheme)
        return history.History(history.histogram(basis, key), history.all_before(starts), history.COUNTED), key

    def samples(self, v: Variant) -> DataFrame:
        used = self._parts(v.share, v.start)
        used = used if v.holidays is None else other_calendar(used, v.holidays)
        by_folds = v.scheme == "folds"
        h, key = self._history(v.holidays, v.all_rows, None if v.all_rows else v.share, v.scheme, v.folds, None if by_folds else v.start)
        counted = ["hist_n_lsdhd"] if v.counted else []
        extra = {c: "_b_" + c for c in history.BASELINE if c not in history.FEATURES}
        out = h.attach(used, key, {c: c for c in [*history.FEATURES, *counted]} | extra)
        out = out.withColumn("baseline", F.coalesce(*[F.col(extra.get(c, c)) for c in history.BASELINE])).drop(*extra.values())
        if v.aged:
            start = dt.date.fromisoformat(self.setup.data_start)
            ends = F.col("cv_month") if by_folds else key
            out = out.withColumn("hist_months", (F.year(ends) - start.year) * 12 + F.month(ends) - start.month)
        return out
