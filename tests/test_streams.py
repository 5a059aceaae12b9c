"""Streams over several micro-batches, with late and tied rows, and a stop between them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stopwise.streaming import feed, latest

T0 = dt.datetime(2024, 1, 1, 8)
SCHEMA = "line string, direction string, journey_id string, seq int, obs_ts timestamp_ntz, anom int"


def arrive(spark, folder, rows):
    """One file, whose rows the next micro-batch reads."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def some(rnd, n, hours=30):
    at = lambda: T0 + dt.timedelta(minutes=rnd.randrange(hours * 60) // 7 * 7)
    return [(rnd.choice(["A", "B", None]), rnd.choice("io"), f"J{rnd.randrange(9)}", rnd.randrange(5), at(), rnd.choice([None, *range(-50, 50)])) for _ in range(n)]


def best(rows):
    out = {}
    for line, direction, journey, seq, at, anom in rows:
        if line is not None and anom is not None:
            out[line, direction] = max(out.get((line, direction), ()), (at, journey, seq, anom))
    return {k: (v[3], v[0]) for k, v in out.items()}


def table(spark, folder, obs):
    t = latest.latest_table(spark, folder, latest.latest_changes(obs).schema)
    return {(r["line"], r["direction"]): (r["anom"], r["obs_ts"]) for r in t.collect()}


def test_latest_state_over_batches_and_a_stop(spark, tmp_path):
    rnd, rows = random.Random(3), []
    path, folder = f"{tmp_path}/feed", f"{tmp_path}/out"
    for _ in range(3):
        part = list({r[:5]: r for r in some(rnd, 40)}.values())
        rows += [r for r in part if r[:5] not in {x[:5] for x in rows}]
        arrive(spark, path, [r for r in part if r in rows])
    obs = source(spark, path)
    latest.upsert_latest(obs, folder, late_minutes=48 * 60)
    assert table(spark, folder, obs) == best(rows)
    batches = {p.name for p in (tmp_path / "out" / "changes").iterdir()}
    assert len(batches) >= 3
    # After a stop the stream goes on from its checkpoint: an older row changes nothing, a newer one does.
    late = [("A", "i", "J0", 0, T0 - dt.timedelta(hours=1), 77), ("B", "o", "J1", 1, T0 + dt.timedelta(hours=40), 5)]
    arrive(spark, path, late)
    latest.upsert_latest(source(spark, path), folder, late_minutes=48 * 60)
    assert table(spark, folder, obs) == best(rows + late)
    latest.upsert_latest(source(spark, path), folder, late_minutes=48 * 60)
    assert table(spark, folder, obs) == best(rows + late)


def test_silent_keys_are_forgotten_and_come_back(spark, tmp_path):
    path, folder = f"{tmp_path}/feed", f"{tmp_path}/out"
    at = lambda h: T0 + dt.timedelta(hours=h)
    parts = [[("A", "i", "J1", 1, at(0), 1), ("B", "i", "J2", 1, at(0), 2)], [("B", "i", "J2", 2, at(10), 3)], [("B", "i", "J2", 3, at(20), 4)], [("A", "i", "J3", 1, at(21), 9)]]
    for p in parts:
        arrive(spark, path, p)
    obs = source(spark, path)
    latest.upsert_latest(obs, folder, late_minutes=60, silence_minutes=120)
    assert table(spark, folder, obs) == best([r for p in parts for r in p])
    with pytest.raises(ValueError):
        latest.latest_changes(obs, 10, 5)


def test_buckets_drop_what_is_later_than_the_buffer(spark, tmp_path):
    path = f"{tmp_path}/feed"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    first = [("A", "i", "J1", 1, at(1), 10), ("A", "i", "J1", 2, at(20), 20)]
    inside = [("A", "i", "J2", 1, at(19), 5)]  # behind the newest by less than the buffer of 2 minutes
    beyond = [("A", "i", "J2", 1, at(2), 99)]  # its bucket was closed long ago
    arrive(spark, path, first)
    stream = lambda: feed.bucket_stream(source(spark, path))
    feed.replay(stream(), f"{tmp_path}/out")
    arrive(spark, path, inside)
    arrive(spark, path, beyond)
    arrive(spark, path, [("A", "i", "J3", 1, at(60), 1)])
    out = feed.replay(stream(), f"{tmp_path}/out")  # goes on with the state and watermark of the first run
    assert sorted((r["t"], r["n"], r["sa"]) for r in out.collect()) == [(at(5), 1, 10), (at(20), 1, 5), (at(25), 1, 20)]
