"""What the datasets of several variants share, and rows that belong to no month."""

from pyspark.sql import functions as F

from stopwise.operators import history
from stopwise.plans import datasets
from stopwise.sources import adapters

MONTHS, MOST = ["1995-03-01", "1995-04-01"], (("train", 30), ("stop", 10), ("test", 20))


def _rows(spark):
    """Two journeys a day from 1995-01-01 on, a year long; every fifth row has no date."""
    df = spark.range(730).selectExpr("id", "date_add(DATE '1995-01-01', CAST(id / 2 AS INT)) AS date", "CAST(id * 37 % 900 AS INT) AS y").withColumn("date", F.when(F.col("id") % 5 < 4, F.col("date")))
    return df.selectExpr("y", "date", "trunc(date, 'month') AS month", "concat('L', id % 2) AS line", "'S' AS stop", "'Outbound' AS direction", "1L AS seq", "8 AS hour", "0 AS daytype", "480 AS minute_of_day", "CAST(id % 30 AS INT) AS bucket", "concat('J', id) AS journey_id")


def test_rows_without_a_date_are_in_no_history(spark):
    rows, v = _rows(spark), datasets.Variant(scheme="month")
    get = lambda r: sorted(map(tuple, datasets.variant_samples(r, MONTHS, adapters.DAILY, v, MOST).collect()), key=str)
    assert get(rows) == get(rows.filter("date is not null")) != []


def test_variants_share_parts_and_counts(spark, monkeypatch):
    calls = {"parts": 0, "counts": []}
    month_parts, day_counts = datasets.month_parts, history.day_counts

    def parts(*args, **options):
        calls["parts"] += 1
        return month_parts(*args, **options)

    def counts(rows):
        out = day_counts(rows)
        calls["counts"].append(str(out.agg(F.max("date")).first()[0]))
        return out

    monkeypatch.setattr(datasets, "month_parts", parts)
    monkeypatch.setattr(history, "day_counts", counts)
    made, all_variants = datasets.Variants(_rows(spark), MONTHS, adapters.DAILY, MOST), datasets.variants(adapters.DAILY, ["1995-02-06"])
    for name in ("V0", "V1", "V2", "V3", "V4", "V4u"):
        got, alone = (sorted(map(tuple, df.collect()), key=str) for df in (made.samples(all_variants[name]), datasets.Variants(_rows(spark), MONTHS, adapters.DAILY, MOST).samples(all_variants[name])))
        assert got == alone != []
    # The shared ones have 2 and 2, those made alone one of each.
    assert calls["parts"] == 2 + 6 and len(calls["counts"]) == 2 + 6
    assert max(calls["counts"]) <= "1995-04-30"  # nothing after the last month is counted


def test_spans_are_made_for_units_and_rows_without_a_date_have_none(spark):
    rows = _rows(spark)
    get = lambda r: sorted(map(tuple, history.expanding(r, MONTHS).tables["l"].collect()))
    assert get(rows) == get(rows.filter("date is not null")) == get(history.day_counts(rows)) != []
