"""Column names and fixed parameters of the delay data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: One row per (journey, stop), as a feed delivers it.
RAW = T.StructType(
    [
        T.StructField("journey_id", T.StringType()),
        T.StructField("operatingDate", T.DateType()),
        T.StructField("lineRef", T.StringType()),
        T.StructField("directionRef", T.StringType()),
        T.StructField("stopPointRef", T.StringType()),
        T.StructField("stopPointName", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("aimed_arrival_local", T.TimestampNTZType()),
        T.StructField("arrival_delay_s", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Period:
    """First and last day of a dataset, both included."""

    start: str
    end: str


@dataclass(frozen=True)
class Setup:
    """Splits, sampling and look-back lengths of a dataset build."""

    train: Period = Period("2025-01-01", "2025-08-31")
    valid: Period = Period("2025-09-01", "2025-10-31")
    test: Period = Period("2025-11-01", "2025-12-31")
    data_start: str = "2024-12-03"
    sample_pct: tuple = (("train", 20), ("valid", 25), ("test", 25))
    recent_days: int = 56
    plan_days: int = 28
    buffer_min: int = 2
    incoming_max_gap: int = 90
    lead_min: int = 5
    lead_max: int = 90
    test_leads: tuple = (10, 30, 60)
    fold_scheme: str = "day"
    #: Rows look up the past of their month, or of their week where the data are short.
    past_unit: str = "month"
    after: str = "frozen"

    def period(self, split: str) -> Period:
        return getattr(self, split)


#: Arrivals outside this range of seconds are faulty records.
DELAY_RANGE = (-1800, 3600)
#: Deviation from the baseline, and its growth from stop to stop, are clipped to these seconds.
DEVIATION_RANGE, GROWTH_RANGE = (-600, 900), (-300, 600)
FOLDS = 5
