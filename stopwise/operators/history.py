"""Historical delay statistics that never see the row's own day: folds, expanding past, recent past.

y is a whole number of seconds in a narrow range, so counts per (keys, time unit, y) hold everything.  Counts of all
groupings are made in one pass; a scheme says in which spans of its periods a unit counts, and `running` goes through each
key's periods once, with values that come and go.  Lookups ask for the (period, keys) that occur among the rows, so
neither values nor statistics are spread over periods that nobody asks for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold
from ..sources.scratch import stored
from .running import along

ALL_KEYS = ["line", "stop", "direction", "hour", "daytype"]
#: Groupings: keys and statistics.
SPECS: dict[str, tuple[list[str], dict[str, str]]] = {
    "lsdhd": (ALL_KEYS, {"hist_med_lsdhd": "median"}),
    "lsd": (["line", "stop", "direction"], {"hist_mean_lsd": "mean", "hist_std_lsd": "std", "med_lsd": "median"}),
    "lhd": (["line", "hour", "daytype"], {"hist_mean_lhd": "mean", "med_lhd": "median"}),
    "sh": (["stop", "hour"], {"hist_mean_sh": "mean"}),
    "l": (["line"], {"med_l": "median"}),
    "g": ([], {"med_g": "median"}),
}
FEATURES = ["hist_med_lsdhd", "hist_mean_lsd", "hist_std_lsd", "hist_mean_lhd", "hist_mean_sh"]
#: The same with the number of rows behind the finest median; groups without rows have null.
COUNTED = SPECS | {"lsdhd": (ALL_KEYS, {"hist_med_lsdhd": "median", "hist_n_lsdhd": "n"})}
BASELINE = ["hist_med_lsdhd", "med_lsd", "med_lhd", "med_l", "med_g"]


#: For how many rows a row of day_counts stands.
COUNT = "_n"


def day_counts(rows: DataFrame) -> DataFrame:
    """Rows counted per keys, day and delay, and written: several histories are made from these as from the rows."""
    return stored(rows.groupBy(*ALL_KEYS, "date", "y").agg(F.count("*").alias(COUNT)))


def histogram(rows: DataFrame, unit: Column, keys: Sequence[str] = ALL_KEYS) -> DataFrame:
    """Counts per keys, time unit and delay, of rows or of day_counts."""
    return rows.groupBy(*keys, unit.alias("unit"), "y").agg((F.sum(COUNT) if COUNT in rows.columns else F.count("*")).alias("n"))


def fold_keys(folds: int = 5) -> Column:
    """A fold's rows belong to the history of every other fold, and to key `folds`, which has all."""
    return F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda k: k != F.col("unit"))


@dataclass(frozen=True)
class Scheme:
    """Periods (keys of the history, in order) and the spans of them, [first, end) by number, in which a unit counts.

    spans is an array of numbers over the column unit: the first span's two ends, then the next one's.
    """

    periods: tuple
    spans: Column

    @property
    def array(self) -> Column:
        return F.array(*[F.lit(p).cast("date") if isinstance(p, dt.date) else F.lit(p) for p in self.periods])

    def step(self, hkey: Column) -> Column:
        """The number of a period; null where it is none."""
        return F.nullif(F.array_position(self.array, hkey), F.lit(0)).cast("int") - 1


def _days(periods: Sequence[str]) -> tuple[dt.date, ...]:
    return tuple(sorted({dt.date.fromisoformat(p) for p in periods}))


def _begun(days: Sequence[dt.date], unit: Column) -> Column:
    """How many of the days have come with the unit."""
    starts = F.array(*[F.lit(p) for p in days])
    return F.size(F.filter(starts, lambda p: p <= unit))


def whole() -> Scheme:
    """One period, 0, that has everything."""
    return Scheme((0,), F.array(F.lit(0), F.lit(1)))


def other_folds(folds: int = 5) -> Scheme:
    """A fold's rows belong to the history of every other fold, and to key `folds`, which has all."""
    own = F.col("unit")
    return Scheme(tuple(range(folds + 1)), F.array(F.lit(0), own, own + 1, F.lit(folds + 1)))


def all_before(periods: Sequence[str]) -> Scheme:
    """Each period has all units that begin before its first day."""
    days = _days(periods)
    return Scheme(days, F.array(_begun(days, F.col("unit")), F.lit(len(days))))


def days_before(periods: Sequence[str], days: int) -> Scheme:
    """Each period has the days before its first one, `days` of them: a day comes, and goes when it is too old."""
    starts = _days(periods)
    return Scheme(starts, F.array(_begun(starts, F.col("unit")), _begun(starts, F.date_add("unit", days))))


def folds_before(periods: Sequence[str], folds: int = 5) -> Scheme:
    """Period "day/k": the units (month, fold) before the day, but for fold k; k = `folds` has all."""
    days = _days(periods)
    n, begun = len(days), _begun(days, F.col("unit.month"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda k: k != F.col("unit.fold"))
    spans = F.flatten(F.transform(others, lambda k: F.array((k * n + begun).cast("int"), ((k + 1) * n).cast("int"))))
    return Scheme(tuple(f"{d}/{k}" for k in range(folds + 1) for d in days), spans)


class History:
    """The statistics of one scheme in several groupings: whole tables, or what rows look up."""

    def __init__(self, counts: DataFrame, scheme: Scheme, specs=SPECS):
        self.counts, self.scheme, self.specs = counts, scheme, specs
        self.keys = list(dict.fromkeys(k for keys, _ in specs.values() for k in keys))

    def _id(self, name: str) -> int:
        """What grouping_id() says of a grouping: a bit for each key that it leaves out."""
        return sum(1 << i for i, k in enumerate(reversed(self.keys)) if k not in self.specs[name][0])

    def _grouped(self, rows: DataFrame, names: Sequence[str], *more: str) -> DataFrame:
        """Sums of n in the groupings, in one pass; coarser ones have nulls in the keys that they leave out."""
        sets = [[F.col(c) for c in (*self.specs[name][0], *more)] for name in names]
        # The last columns are in all sets, so their bits are 0.
        spec = (F.grouping_id() / (1 << len(more))).cast("int").alias("spec")
        return rows.groupingSets(sets, *[F.col(c) for c in (*self.keys, *more)]).agg(spec, F.sum("n").alias("n"))

    @cached_property
    def sums(self) -> DataFrame:
        """Counts per grouping, keys, spans and y. Units that count in the same periods are one."""
        counts = stored(self.counts.filter("y is not null"))
        # Spans are made once for each unit: made for each row, they would take longer than all else.
        units = stored(counts.select("unit").distinct().withColumn("spans", self.scheme.spans))
        ever = F.exists(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.get("spans", i) < F.get("spans", i + 1))
        units = units.filter(ever).withColumnRenamed("unit", "_unit")
        rows = counts.join(F.broadcast(units), F.col("unit") == F.col("_unit"))  # a row per day, month or fold
        rows = rows.groupBy(*self.keys, "spans", "y").agg(F.sum("n").alias("n"))
        return stored(self._grouped(rows, list(self.specs), "spans", "y"))

    def _statistics(self, sums: DataFrame, asks: DataFrame | None) -> DataFrame:
        """spec, keys, step, n, median, mean, std: of the asked steps, or of all."""
        names = ["spec", *self.keys]
        rows = sums.select(*names, "spans", "y", "n", F.lit(None).cast("int").alias("step"))
        if asks is not None:
            rows = rows.unionByName(asks.select(*names, "step"), allowMissingColumns=True)
        rows = rows.repartition(*names).sortWithinPartitions(*names)
        kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*names).dtypes)
        return rows.mapInArrow(along(names, len(self.scheme.periods), asks is not None), f"{kinds}, step int, n long, median double, mean double, std double")

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        """hkey, keys, statistics and the number of rows behind them, of all periods."""
        return {name: self._table(name) for name in self.specs}

    def _table(self, name: str) -> DataFrame:
        keys, stats = self.specs[name]
        t = self._statistics(self.sums.filter(F.col("spec") == self._id(name)), None)
        return t.select(F.element_at(self.scheme.array, F.col("step") + 1).alias("hkey"), *keys, *[F.col(how).alias(c) for c, how in stats.items()], F.col("n").alias("hist_n"))

    def attach(self, rows: DataFrame, hkey: Column, columns: dict[str, str], among: DataFrame | None = None) -> DataFrame:
        """rows with history columns: {column of a table: name in the result}. Null keys match nothing.

        The distinct (period, keys) of the rows ask; these cells are joined with the answers of all groupings, and the rows
        themselves go through one join.  among: a frame with the same cells, where rows has come a long way from it.
        """
        wanted = [name for name, (_, stats) in self.specs.items() if any(c in columns for c in stats)]
        out = rows.withColumn("_step", self.scheme.step(hkey))
        source = out if among is None else among.withColumn("_step", self.scheme.step(hkey))
        cells = stored(source.select(F.col("_step").alias("step"), *self.keys).filter("step is not null").distinct())
        asks = self._grouped(cells.withColumn("n", F.lit(1)), wanted, "step")
        found = stored(self._statistics(self.sums.filter(F.col("spec").isin([self._id(name) for name in wanted])), asks))
        for name in wanted:
            keys, stats = self.specs[name]
            mine = [F.col(how).alias("_v_" + c) for c, how in stats.items() if c in columns]
            t = found.filter(F.col("spec") == self._id(name)).select(F.col("step").alias("_s"), *[F.col(k).alias("_k_" + k) for k in keys], *mine)
            on = cells["step"] == t["_s"]
            for k in keys:
                on = on & (cells[k] == t["_k_" + k])
            cells = cells.join(t, on, "left").drop("_s", *["_k_" + k for k in keys])
        cells = cells.withColumnsRenamed({"step": "_s"} | {k: "_k_" + k for k in self.keys})
        on = out["_step"] == cells["_s"]
        for k in self.keys:
            on = on & out[k].eqNullSafe(cells["_k_" + k])
        out = out.join(cells, on, "left")
        return out.select(*[F.col(c) for c in rows.columns], *[F.col("_v_" + c).alias(n) for c, n in columns.items()])

    def baseline(self, rows: DataFrame, hkey: Column, name: str = "baseline", among: DataFrame | None = None) -> DataFrame:
        """rows with the median of the finest grouping that has one."""
        temp = {c: "_b_" + c for c in BASELINE}
        out = self.attach(rows, hkey, temp, among)
        return out.select(*rows.columns, F.coalesce(*temp.values()).alias(name))

    def features(self, rows: DataFrame, hkey: Column, prefix: str = "", among: DataFrame | None = None) -> DataFrame:
        return self.attach(rows, hkey, {c: prefix + c for c in FEATURES}, among)


def attached(rows: DataFrame, lookups: Sequence[tuple[History, Column, dict[str, str]]]) -> DataFrame:
    """rows with the columns of several histories: (history, period, {column of a table: name in the result}).

    The distinct (periods, keys) of the rows look up all of them, so the rows themselves go through one join."""
    periods = {f"_h{i}": hkey for i, (_, hkey, _) in enumerate(lookups)}
    cells = found = stored(rows.select(*[hkey.alias(h) for h, hkey in periods.items()], *ALL_KEYS).distinct())
    for h, (of, _, columns) in zip(periods, lookups):
        found = of.attach(found, F.col(h), columns, cells)
    found = found.withColumnsRenamed({k: "_k_" + k for k in [*periods, *ALL_KEYS]})
    out, on = rows.withColumns(periods), F.lit(True)
    for k in [*periods, *ALL_KEYS]:
        on = on & out[k].eqNullSafe(found["_k_" + k])
    return out.join(found, on, "left").select(*rows.columns, *[c for _, _, columns in lookups for c in columns.values()])


def leave_fold_out(clean: DataFrame, start: str, end: str, scheme: str = "day") -> History:
    """Key k: all rows from start to end but those of fold k; key 5: all of them."""
    rows = clean.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return History(histogram(rows, fold("date", scheme, start)), other_folds())


def expanding(clean: DataFrame, periods: Sequence[str], unit: str = "month") -> History:
    """Key p: all rows before day p. Periods start at months or weeks, so that unit is counted whole."""
    return History(histogram(clean, F.trunc("date", unit)), all_before(periods))


def recent(clean: DataFrame, periods: Sequence[str], days: int = 56) -> History:
    """Key p: the rows of the `days` days before day p. Days that no period includes are left out before counting."""
    first = F.date_sub(F.lit(min(periods)).cast("date"), days)
    rows = clean.filter((F.col("date") >= first) & (F.col("date") < F.lit(max(periods)).cast("date")))
    return History(histogram(rows, F.col("date")), days_before(periods, days))


def with_counts(clean: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Expanding monthly past of the finest grouping with its number of rows."""
    h = History(histogram(clean, F.trunc("date", "month")), all_before(periods), {"lsdhd": SPECS["lsdhd"]})
    return h.tables["lsdhd"].withColumnRenamed("hist_n", "hist_n_lsdhd")


def months(start: str, end: str) -> list[str]:
    """First days of the months from start's to end's."""
    y, m = int(start[:4]), int(start[5:7])
    out = []
    while f"{y:04d}-{m:02d}" <= end[:7]:
        out.append(f"{y:04d}-{m:02d}-01")
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out


def period_starts(start: str, end: str, unit: str = "month") -> list[str]:
    """First days of the months or weeks (from Monday) from start's to end's."""
    if unit == "month":
        return months(start, end)
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    first -= dt.timedelta(days=first.weekday())
    return [str(first + dt.timedelta(days=7 * i)) for i in range((last - first).days // 7 + 1)]


def global_median(clean: DataFrame) -> DataFrame:
    """The constant baseline, from counts per delay."""
    return clean.groupBy("y").agg(F.count("*").alias("n")).agg(F.expr("percentile(y, 0.5, n)").alias("median_y"))


def dense_trip_ids(rows: DataFrame) -> DataFrame:
    """Journeys numbered from 0 in order of date and id: a running number inside each day plus what earlier days have."""
    trips = rows.select("date", "journey_id").distinct()
    per_day = trips.groupBy("date").agg(F.count("*").alias("n"))
    before = per_day.select("date", F.coalesce(F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return trips.join(before, "date").select("date", "journey_id", (F.col("before") + F.row_number().over(Window.partitionBy("date").orderBy("journey_id")) - 1).alias("trip"))
