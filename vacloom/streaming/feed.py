"""The change feed as a stream: deduplicated intake, day movements and trailing deltas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder
from .seen import KeyedLog


def event_stream(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def append_new(events: DataFrame, key: str, folder: str) -> DataFrame:
    """Run what is available of a stream into a table with one row per key, however late a repeat comes.

    Each batch drops its own repeats and those that the index of stored keys knows. A batch that is run again
    after a failure writes to its own part of the table again, so nothing is stored twice.
    """
    spark, schema = events.sparkSession, events.schema
    kind = dict(events.dtypes)[key]

    def store(batch: DataFrame, number: int) -> None:
        seen = KeyedLog(batch.sparkSession, f"{folder}/seen", [key], f"{key} {kind}")
        path = f"{folder}/table/batch={number}"
        seen.unseen(batch.dropDuplicates([key]), number).write.mode("overwrite").parquet(path)
        seen.add(batch.sparkSession.read.schema(schema).parquet(path).select(key), number)

    started = events.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/table")


def day_movements(events: DataFrame, keys: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Opened and closed roles per key and UTC day; rows later than the delay are left out."""
    kind = F.col("change_type")
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("w"), *keys).agg(
        F.count_if(kind == "job_opened").alias("opened"), F.count_if(kind == "job_closed").alias("closed"),
    ).select(F.col("w.start").alias("day"), *keys, "opened", "closed")


def trailing_deltas(events: DataFrame, keys: list[str], at: str, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Net movement per key in every window of so many days, one per day."""
    net = F.when(F.col("change_type") == "job_opened", 1).when(F.col("change_type") == "job_closed", -1).otherwise(0)
    return events.withWatermark(at, delay).groupBy(F.window(at, f"{days} days", "1 day").alias("w"), *keys).agg(
        F.sum(net).alias("delta")
    ).select(F.col("w.end").alias("until"), *keys, "delta")


def enriched(events: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Events of a stream with the company of their job, from static tables."""
    return events.join(jobs.select("job_id", "company_id"), "job_id", "left").join(
        companies.select("company_id", "name", "sector"), "company_id", "left"
    )


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run below the shared folder the session names."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame) -> DataFrame:
    """Process what is available into Parquet with a checkpoint, and read the result."""
    spark, folder = stream.sparkSession, run_folder(stream.sparkSession)
    started = stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
