"""Sources and sinks: feed ingest, month loads, audits, weather, dataset writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_zone

WEATHER = ("temperature_2m", "precipitation", "snowfall", "snow_depth", "wind_speed_10m")


def ingest(feed: DataFrame, start: str | None = None, end: str | None = None, agency: str = "ATB", mode: str = "bus", zone: str = "Europe/Oslo") -> DataFrame:
    """Recorded arrivals of a feed: one agency and mode, nothing cancelled, extra or estimated, both times present."""
    f = feed.filter((F.col("dataSource") == agency) & (F.col("vehicleMode") == mode))
    for flag in ("journeyCancellation", "stopCancellation", "extraJourney", "estimated"):
        f = f.filter(F.col(flag).cast("string") == "false")
    f = f.filter(F.col("arrivalTime").isNotNull() & F.col("aimedArrivalTime").isNotNull())
    if start:
        f = f.filter(F.col("operatingDate").between(F.lit(start).cast("date"), F.lit(end or start).cast("date")))
    return f.select(
        F.col("datedServiceJourneyId").alias("journey_id"), "operatingDate", "lineRef", "directionRef", "stopPointRef", "stopPointName", F.col("sequenceNr").cast("long").alias("seq"),
        in_zone(f, "aimedArrivalTime", zone).alias("aimed_arrival_local"), F.timestamp_diff("SECOND", F.date_trunc("second", in_zone(f, "aimedArrivalTime", "UTC")), F.date_trunc("second", in_zone(f, "arrivalTime", "UTC"))).alias("arrival_delay_s"),
    )


def month_of(col: str = "operatingDate"):
    return F.trunc(col, "month")


def audit_months(df: DataFrame, first: str, last: str, date_col: str = "operatingDate") -> DataFrame:
    """Every month from first to last with its rows, newest date, and whether it is empty or complete
    (its newest date is at most a day before the month's end)."""
    spark = df.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    got = df.groupBy(month_of(date_col).alias("month")).agg(F.count("*").alias("n_rows"), F.max(date_col).alias("newest"))
    out = wanted.join(got, "month", "left")
    return out.select("month", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "newest", F.col("n_rows").isNull().alias("empty"), F.coalesce(F.col("newest") >= F.date_sub(F.last_day("month"), 1), F.lit(False)).alias("complete"))


def months_to_load(source: DataFrame, stored_months: DataFrame, today: str, date_col: str = "operatingDate") -> DataFrame:
    """Rows of complete past months that are not stored yet; unfinished and empty months stay out."""
    rows = source.withColumn("month", month_of(date_col)).filter(F.last_day("month") < F.lit(today).cast("date"))
    ends = rows.groupBy("month").agg(F.max(date_col).alias("newest")).filter(F.col("newest") >= F.date_sub(F.last_day("month"), 1))
    ready = ends.join(stored_months, "month", "left_anti").select("month")
    return rows.join(ready, "month", "left_semi")


_PUBLISHED = "month date, load string, n_rows long, newest date"


def published_months(spark: SparkSession, path: str) -> DataFrame:
    """What readers may see at path: month, the load that brought it, its rows and newest date."""
    try:
        there = spark.read.schema(_PUBLISHED).parquet(f"{path}/published")
    except Exception as e:  # nothing published yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _PUBLISHED)
    # Two loads that ran at the same time may both have a month: the first name counts.
    return there.groupBy("month").agg(F.min_by(F.struct("load", "n_rows", "newest"), "load").alias("x")).select("month", "x.*")


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the published months. What a load wrote before it was stopped is not among them."""
    rows = spark.read.parquet(f"{path}/loads").withColumns({"month": F.col("month").cast("date"), "load": F.col("load").cast("string")})
    return rows.join(published_months(spark, path).select("month", "load"), ["month", "load"], "left_semi").drop("load")


def _by_month(rows: DataFrame, date_col: str) -> DataFrame:
    return rows.groupBy("month").agg(F.count("*").alias("n_rows"), F.max(date_col).cast("date").alias("newest"))


def stage_months(new: DataFrame, path: str, load: str, date_col: str) -> DataFrame:
    """Writes a load where no reader looks, and compares what is there then with what was to be written."""
    staged = f"{path}/loads/load={load}"
    new.repartition("month").write.mode("overwrite").partitionBy("month").parquet(staged)
    found = new.sparkSession.read.parquet(staged).withColumn("month", F.col("month").cast("date"))
    want, got = _by_month(new, date_col), _by_month(found, date_col)
    differs = want.join(got.withColumnsRenamed({"n_rows": "n", "newest": "d"}), "month", "full").filter(~(F.col("n_rows").eqNullSafe(F.col("n")) & F.col("newest").eqNullSafe(F.col("d"))))
    if not differs.isEmpty():
        raise RuntimeError(f"months of load {load} are not what was read: {differs.limit(12).collect()}")
    return got.withColumn("load", F.lit(load)).select("month", "load", "n_rows", "newest")


def publish_months(months: DataFrame, path: str) -> None:
    """One file names all months of the load, so readers see all of them or none."""
    months.coalesce(1).write.mode("append").parquet(f"{path}/published")


def load_months(source: DataFrame, path: str, today: str, date_col: str = "operatingDate") -> DataFrame:
    """Brings the months that are missing at path; a rerun adds nothing, and completes what a stopped load left undone.

    Rows are staged, verified (rows and newest date of each month) and published by a manifest that readers resolve.
    """
    spark = source.sparkSession
    new = months_to_load(source, published_months(spark, path).select("month"), today, date_col)
    if not new.isEmpty():
        publish_months(stage_months(new, path, f"load-{uuid.uuid4().hex}", date_col), path)
    return read_months(spark, path)


def read_raw(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several files as one table, columns by name; a column that a file lacks is null there."""
    out = None
    for p in paths:
        part = spark.read.parquet(p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def chosen_files(names: Sequence[tuple[str, int]], least_bytes: int = 1000) -> list[str]:
    """Of (name, bytes) of yearly and monthly files: a year's file replaces its months; tiny files are left out.
    Names end in _YYYY.parquet or _YYYY_MM.parquet."""
    big = [n for n, size in names if size >= least_bytes]
    stem = lambda n: n.removesuffix(".parquet").split("_")
    years = {stem(n)[-1] for n in big if len(stem(n)[-1]) == 4}
    return sorted(n for n in big if len(stem(n)[-1]) == 4 or stem(n)[-2] not in years)


def read_optional(spark: SparkSession, path: str, columns: Sequence[str], optional: dict[str, str]) -> DataFrame:
    """The columns and, null where the file lacks them, the optional ones with their types."""
    df = spark.read.parquet(path)
    return with_optional(df, columns, optional)


def with_optional(df: DataFrame, columns: Sequence[str], optional: dict[str, str]) -> DataFrame:
    return df.select(*columns, *[F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()])


def prepare_weather(df: DataFrame, source: str = "measured") -> DataFrame:
    """Hourly weather: one row per hour, missing columns added, precipitation of the last three rows.

    The window runs over one row per hour of the series, a few thousand a year.
    """
    df = df.select("time", *[F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double").alias(c) for c in WEATHER])
    missing = sum((F.col(c).isNull().cast("int") for c in WEATHER[1:]), F.col(WEATHER[0]).isNull().cast("int"))
    best = F.min(F.struct(missing.alias("missing"), *WEATHER)).alias("best")  # of an hour's rows the fullest, then the smallest
    df = df.groupBy("time").agg(best).select("time", *[F.col("best")[c].alias(c) for c in WEATHER])
    last3 = Window.orderBy("time").rowsBetween(-2, 0)
    return df.withColumns({"precip_3h": F.sum("precipitation").over(last3), "source": F.lit(source)})


def missing_share(df: DataFrame, columns: Sequence[str] = WEATHER) -> DataFrame:
    """Per column the share of missing values, and whether it is over half."""
    shares = df.select(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "column_name", "missing").withColumn("mostly_missing", F.col("missing") > 0.5)


def write_split(df: DataFrame, path: str, keys: Sequence[str] = ("date", "journey_id", "seq")) -> None:
    """A dataset in a fixed order: ranges of its first key, sorted inside."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def read_in_order(spark: SparkSession, path: str, name: str = "place") -> DataFrame:
    """A written dataset with the place of each row, from 1, in the order of its files and of the rows inside them."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # one row per file
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("_file", before.alias("_before"))
    return rows.join(files, "_file").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def compact(df: DataFrame, shorts: Sequence[str] = (), rounded: Sequence[str] = ()) -> DataFrame:
    """Narrow types for export: predictions rounded, whole numbers as 16-bit."""
    return df.withColumns({**{c: F.col(c).cast("short") for c in shorts}, **{c: F.rint(c).cast("short") for c in rounded}})


def export_predictions(df: DataFrame, path: str, shorts: Sequence[str] = (), rounded: Sequence[str] = ()) -> None:
    compact(df, shorts, rounded).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
