"""As-of lookups and windowed sums by differences of running sums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: From here on lie the days of rows that have no key or time to look up.
_NO_DAY = "9000-01-01"


@dataclass(frozen=True)
class Series:
    """Rows of which a lookup finds the last one, with at most one row per key and time (see latest_per).

    The found values are called prefix + value.  strict: rows of the very time asked for are not
    seen.  lags: how many minutes after its time a row is seen; where there are several, each finds
    a row of its own, and its values are called prefix + value + "_" + lag.
    """

    rows: DataFrame
    time: str
    values: Sequence[str]
    prefix: str = ""
    strict: bool = False
    lags: Sequence[int] = (0,)

    def found(self, lag: int) -> list[str]:
        end = f"_{lag}" if len(self.lags) > 1 else ""
        return [f"{self.prefix}{v}{end}" for v in self.values]

    def seen(self, on: Sequence[str], slots: dict[int, str]) -> DataFrame:
        """Keys, the time from which a row is seen, and its values in the column of its lag."""
        rows = self.rows.filter(" and ".join(f"`{c}` is not null" for c in (*on, self.time)))
        at = F.col(self.time)
        if tuple(self.lags) != (0,):
            rows = rows.withColumn("_lag", F.explode(F.array(*[F.lit(x) for x in self.lags])))
            at = F.timestamp_add("MINUTE", F.col("_lag"), at)
        one = {lag: F.struct(*[F.col(v).alias(n) for v, n in zip(self.values, self.found(lag))]) for lag in self.lags}
        cols = [(F.when(F.col("_lag") == lag, one[lag]) if "_lag" in rows.columns else one[lag]).alias(slot) for lag, slot in slots.items()]
        return rows.select(*on, at.alias("_t"), F.to_date(at).alias("_day"), F.lit(2 if self.strict else 0).alias("_side"), *cols)


def asof_lookups(left: DataFrame, on: Sequence[str], left_time: str, series: Sequence[Series]) -> DataFrame:
    """Every left row with the values of the last row of its keys at or before its time (a timestamp), of each series.

    All series that share the keys go through one exchange: left rows and series are one tagged
    union, a key's rows are cut into days, and inside a day one window carries what each series was
    last.  What an earlier day ended with comes from a window over one row per key and day.  So no
    pairs are made, left rows stay single however many series and lags there are, and a key with a
    third of all rows is spread over its days.  Rows with a null key or time find nothing, and are
    spread over days of their own; null values of the found row stay null.
    """
    slots = [{lag: f"_found_{n}_{lag}" for lag in s.lags} for n, s in enumerate(series)]
    names = {slot: s.found(lag) for s, mine in zip(series, slots) for lag, slot in mine.items()}
    usable = " and ".join(f"`{c}` is not null" for c in (*on, "_t"))
    hashed = [F.col(c) for c, t in left.dtypes if "map<" not in t and "variant" not in t]
    nowhere = F.date_add(F.lit(_NO_DAY).cast("date"), F.pmod(F.xxhash64(*hashed), F.lit(1024)).cast("int"))
    probe = left.select(*[F.col(k).alias(k) for k in on], F.col(left_time).alias("_t"), nowhere.alias("_day"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    both = probe.withColumn("_day", F.when(F.expr(usable), F.to_date("_t")).otherwise(F.col("_day")))
    for s, mine in zip(series, slots):
        both = both.unionByName(s.seen(on, mine), allowMissingColumns=True)
    last = [F.max_by(slot, F.when(F.col(slot).isNotNull(), F.col("_t"))).alias(slot) for slot in names]
    ends = both.filter(usable).groupBy(*on, "_day").agg(*last)
    former = Window.partitionBy(*on).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(
        *[F.col(k).alias("_k_" + k) for k in on], F.col("_day").alias("_k_day"), *[F.last(slot, ignorenulls=True).over(former).alias("_before" + slot) for slot in names]
    )
    inside = Window.partitionBy(*on, "_day").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    asked = both.withColumns({slot: F.last(slot, ignorenulls=True).over(inside) for slot in names}).filter("_row is not null")
    same = asked["_day"] == before["_k_day"]
    for k in on:
        same = same & (asked[k] == before["_k_" + k])
    out = asked.join(before, same, "left")
    return out.select("_row.*", *[F.coalesce(slot, "_before" + slot)[name].alias(name) for slot, found in names.items() for name in found])


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], prefix: str = "", strict: bool = False) -> DataFrame:
    """asof_lookups of one series; strict: before the left row's time."""
    return asof_lookups(left, on, left_time, [Series(right, right_time, values, prefix, strict)])


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per keys: the one that is highest in the order columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def bucket_end(t: str, minutes: int):
    """The end of the time bucket that t falls in; a bucket that is still open at T is not seen at T."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", epoch, F.col(t).cast("timestamp_ntz"))
    start = F.floor(seconds / (60 * minutes)) * (60 * minutes)
    return F.timestamp_add("MINUTE", (start / 60 + minutes).cast("int"), epoch)


def bucket_sums(obs: DataFrame, keys: Sequence[str], minutes: int, value: str, time: str = "obs_ts") -> DataFrame:
    """Rows, non-null values and their sum per key and bucket."""
    return obs.groupBy(*keys, bucket_end(time, minutes).alias("t")).agg(F.count("*").alias("n"), F.count(value).alias("na"), F.sum(value).alias("sa"))


def running_sums(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums up to and with each bucket. Without keys the window has one row per bucket of time, not per observation."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.select(*keys, "t", F.sum("n").over(w).alias("cn"), F.sum("na").over(w).alias("cna"), F.sum("sa").over(w).alias("csa"))


SUMS = ("cn", "cna", "csa")


def on_grid(probes: DataFrame, sums: Series, time: str, minutes: int = 5) -> DataFrame:
    """asof_lookups where there is no key: the running sums filled up to every `minutes` of their span (about
    105,000 rows a year), beside those of each lag, then one equality join on the grid time at or before each probe."""
    if any(lag % minutes for lag in sums.lags):
        raise ValueError(f"lags must be multiples of {minutes} minutes")
    last = F.timestamp_add("MINUTE", F.lit(max(sums.lags)), F.max(sums.time))
    span = sums.rows.agg(F.min(sums.time).alias("_first"), last.alias("_last"))
    grid = span.select(F.explode(F.sequence("_first", "_last", F.expr(f"interval {minutes} minutes"))).alias("_grid"))
    order = Window.orderBy("_grid")
    fill = order.rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(sums.rows.select(F.col(sums.time).alias("_grid"), *sums.values), "_grid", "left")
    full = full.select("_grid", *[F.last(c, ignorenulls=True).over(fill).alias(c) for c in sums.values])
    full = full.select("_grid", *[F.lag(c, lag // minutes).over(order).alias(n) for lag in sums.lags for c, n in zip(sums.values, sums.found(lag))])
    at = F.timestamp_add("MINUTE", F.lit(-minutes), bucket_end(time, minutes))
    p = probes.crossJoin(F.broadcast(span)).withColumn("_grid", F.least(at, "_last")).drop("_first", "_last")  # span is one row
    return p.join(full, "_grid", "left").drop("_grid")


def window_series(cum: DataFrame, windows: Sequence[int], prefix: str) -> Series:
    """The running sums as they are now and as they were each look-back of minutes ago, for with_windows."""
    return Series(cum, "t", SUMS, f"_{prefix}_", lags=(0, *windows))


def with_windows(found: DataFrame, sums: Series, windows: Sequence[int], prefix: str) -> DataFrame:
    """The looked-up sums replaced by the count and mean of what lies in (T - w, T], for each look-back w."""
    at = {lag: dict(zip(sums.values, sums.found(lag))) for lag in sums.lags}
    total = lambda c, lag: F.coalesce(F.col(at[lag][c]), F.lit(0))
    cols = {}
    for w in windows:
        inside = {c: total(c, 0) - total(c, w) for c in sums.values}
        cols[f"rt_{prefix}_n{w}"] = inside["cn"].cast("int")
        cols[f"rt_{prefix}_anom{w}"] = inside["csa"] / F.nullif(inside["cna"], F.lit(0))
    return found.withColumns(cols).drop(*[n for names in at.values() for n in names.values()])


def windowed_sums(probes: DataFrame, cum: DataFrame, keys: Sequence[str], windows: Sequence[int], prefix: str, time: str = "T") -> DataFrame:
    """The probes with, for each look-back of `windows` minutes, the count and mean of what lies in (T - w, T].

    A look-back is the running sums seen w minutes later, so all of a row's look-backs come from one
    lookup and rows are neither repeated nor grouped.  Rows with a null key see nothing: count 0, mean null.
    """
    sums = window_series(cum, windows, prefix)
    found = asof_lookups(probes, keys, time, [sums]) if keys else on_grid(probes, sums, time)
    return with_windows(found, sums, windows, prefix)
