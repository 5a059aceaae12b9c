"""The latest observation of each line and direction, as keyed state that a stream carries from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

KEYS = ["line", "direction"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "obs_ts timestamp_ntz, journey_id string, seq long, anom double"
_EPOCH = pd.Timestamp("1970-01-01")


class _Latest(StatefulProcessor):
    """One value per key. A timer clears it when the key has been silent for `silence` milliseconds of event time."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.best.get()) if self.best.exists() else None
        best = known
        for pdf in rows:
            top = pdf.sort_values(["obs_ts", "journey_id", "seq"]).iloc[-1]
            mine = (top["obs_ts"].to_pydatetime(), str(top["journey_id"]), int(top["seq"]), float(top["anom"]))
            if best is None or mine[:3] > best[:3]:
                best = mine
        if best is not None and best != known:
            self.best.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((pd.Timestamp(best[0]) - _EPOCH).total_seconds() * 1000) + self.silence)
            yield pd.DataFrame({"line": [key[0]], "direction": [key[1]], "anom": [best[3]], "obs_ts": [best[0]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_changes(obs: DataFrame, late_minutes: int = 24 * 60, silence_minutes: int = 48 * 60) -> DataFrame:
    """In update mode, the keys whose latest observation (by time, then journey and stop number) has changed.

    Observations without a deviation or a key are none.  Rows later than late_minutes are dropped.  silence_minutes must not
    be less: what comes after a key's state was cleared is newer then than what the state had.
    """
    if silence_minutes < late_minutes:
        raise ValueError("a key's state must be kept for as long as late rows are taken")
    rows = obs.filter(" and ".join(f"{c} is not null" for c in ("anom", "obs_ts", "journey_id", "seq", *KEYS)))
    rows = rows.select(*KEYS, F.col("journey_id").cast("string"), F.col("seq").cast("long"), F.col("anom").cast("double"), "obs_ts", F.col("obs_ts").cast("timestamp").alias("_t"))
    kinds = dict(rows.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in KEYS) + ", anom double, obs_ts timestamp_ntz"
    keyed = rows.withWatermark("_t", f"{late_minutes} minutes").groupBy(*KEYS)
    return keyed.transformWithStateInPandas(_Latest(silence_minutes * 60_000), out, "Update", "EventTime")


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state with timers needs this store; the setting is read when a stream starts."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


def upsert_latest(obs: DataFrame, folder: str, **options) -> None:
    """Runs the stream over all that is there now; changes of batch n are folder/changes/batch=n.

    A batch writes changed keys only, over its own folder, so a batch that runs again after a failure changes nothing.
    A later call with the same folder goes on from the checkpoint.
    """
    changes = latest_changes(obs, **options)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    with _rocks(obs.sparkSession):
        run = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()


def latest_table(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The table that the changes amount to: of each key the row of the last batch."""
    schema = StructType(schema.fields).add("batch", "long")
    found = spark.read.schema(schema).parquet(f"{folder}/changes")
    w = Window.partitionBy(*KEYS).orderBy(F.desc("batch"))
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "batch")
