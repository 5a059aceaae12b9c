"""Months are published whole or not at all; samples of any size; errors averaged over seeds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stopwise.operators import evaluate as ev
from stopwise.plans import datasets
from stopwise.sources import io


def days(spark, first, last, value=1):
    n = (last - first).days + 1
    return spark.createDataFrame([(first + dt.timedelta(days=i), value) for i in range(n) for _ in range(3)], "operatingDate date, v int")


def held(spark, path):
    return {str(r["month"]): r["n"] for r in io.read_months(spark, path).groupBy("month").agg(F.count("*").alias("n")).collect()}


def test_a_load_that_is_stopped_leaves_the_table_unchanged(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/months"
    rows = days(spark, dt.date(2024, 1, 1), dt.date(2024, 4, 12))
    io.load_months(rows.filter("operatingDate < '2024-02-01'"), path, "2024-04-12")
    assert held(spark, path) == {"2024-01-01": 93}

    def stopped(months, path):
        raise KeyboardInterrupt

    monkeypatch.setattr(io, "publish_months", stopped)
    with pytest.raises(KeyboardInterrupt):
        io.load_months(rows, path, "2024-04-12")
    assert held(spark, path) == {"2024-01-01": 93}
    monkeypatch.undo()
    for _ in range(2):  # the second run adds nothing
        got = io.load_months(rows, path, "2024-04-12")
        assert held(spark, path) == {"2024-01-01": 93, "2024-02-01": 87, "2024-03-01": 93}
    assert got.columns == ["operatingDate", "v", "month"] or set(got.columns) == {"operatingDate", "v", "month"}
    assert io.published_months(spark, path).count() == 3


def test_what_was_written_is_verified(spark, tmp_path, monkeypatch):
    path, real, seen = f"{tmp_path}/months", io._by_month, []

    def short(rows, date_col):
        """Of what is read back some rows are missing."""
        seen.append(rows)
        return real(rows if len(seen) == 1 else rows.limit(90), date_col)

    monkeypatch.setattr(io, "_by_month", short)
    with pytest.raises(RuntimeError, match="not what was read"):
        io.load_months(days(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 31)), path, "2024-04-12")
    assert len(seen) == 2 and io.published_months(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 17, 2500, 4999, 5000, 9000])
def test_samples_of_any_size(spark, monkeypatch, n):
    import hashlib

    monkeypatch.setattr(datasets, "SMALL", 3)
    rows = spark.range(5000, numPartitions=7).select(F.col("id").cast("string").alias("k"))
    got = sorted(r["k"] for r in datasets.fixed_sample(rows, n, ["k"], 7).collect())
    order = sorted((hashlib.md5(f"{i}|7".encode()).hexdigest(), str(i)) for i in range(5000))
    assert got == sorted(k for _, k in order[:n])


def test_large_samples_are_not_put_in_order(spark):
    rows = spark.range(1_000_000, numPartitions=8).select(F.col("id").cast("string").alias("k"))
    out = datasets.fixed_sample(rows, 400_000, ["k"], 1)
    assert out.count() == 400_000 and out.distinct().count() == 400_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    limit = int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0])
    assert limit <= datasets.SMALL


def test_repeated_keys_are_sampled_too(spark, monkeypatch):
    monkeypatch.setattr(datasets, "SMALL", 10)
    rows = spark.range(300).select(F.lit("same").alias("k"))
    assert datasets.fixed_sample(rows, 120, ["k"], 1).count() == 120


def test_errors_are_averaged_over_seeds_not_predictions(spark):
    month, day = dt.date(2024, 3, 1), dt.date(2024, 3, 5)
    rows = [("v", 1, 10.0), ("v", 2, -10.0), ("ref", 1, 4.0), ("ref", 2, 4.0)]
    both = [(v, s, "J", i, 0.0, p, d, m) for v, s, p in rows for i, d, m in ((1, day, month), (2, day + dt.timedelta(days=1), month), (3, dt.date(2024, 4, 2), dt.date(2024, 4, 1)))]
    both += [("v", 1, "J", 9, 0.0, 500.0, dt.date(2024, 5, 2), dt.date(2024, 5, 1))]  # a month that the reference lacks
    df = spark.createDataFrame(both, "variant string, seed int, journey_id string, seq int, y double, pred double, date date, month date")
    got = {r["variant"]: r for r in ev.variant_summary(df, "ref", ["journey_id", "seq"]).collect()}
    assert (got["v"]["mean_mae_s"], got["v"]["difference_s"], got["v"]["months"], got["v"]["seeds"], got["v"]["months_better"]) == (10.0, 6.0, 2, 2, 0)
    interval = ev.variant_intervals(df, "ref", ["journey_id", "seq"]).collect()
    assert len(interval) == 1 and abs(interval[0]["low"]) == abs(interval[0]["high"]) == 6.0
