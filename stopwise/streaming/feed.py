"""The live feed: open time buckets, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_feed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def bucket_stream(obs: DataFrame, minutes: int = 5, late_minutes: int = 2, time: str = "obs_ts") -> DataFrame:
    """Count and sum of the deviation per line and direction in tumbling buckets, named by their end.
    Rows later than the reporting buffer are dropped; a bucket is emitted once, when it is closed."""
    g = obs.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", f"{late_minutes} minutes")
    g = g.groupBy(F.window("_t", f"{minutes} minutes"), "line", "direction").agg(F.count("*").alias("n"), F.count("anom").alias("na"), F.sum("anom").alias("sa"))
    return g.select("line", "direction", F.col("window.end").cast("timestamp_ntz").alias("t"), "n", "na", "sa")


def replay(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its appended rows, written as Parquet below folder.

    Each micro-batch has a folder of its own, so a batch that
    runs again after a failure writes the same files, and nothing is gathered in the driver.  Called again for the same
    folder it goes on from the checkpoint: state and watermark are those of the last batch.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/none")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    run: StreamingQuery = (
        stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
