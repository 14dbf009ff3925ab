"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacloom.session import durable

#: Fixed values of the contracts: what separates words, and what makes one up.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

__all__ = ["SPACE", "SPACE_CHARS", "WORD", "discard", "durable", "numbered", "running_sums", "shared_folder", "table", "word_array", "word_count", "written", "written_at"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    ``durable`` sets a folder of its own only where the session names none, as in tests.
    """
    if spark.sparkContext.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None:
        durable(spark.range(1))
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and keeps column pruning."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the table's folder, for ``discard`` once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table whose readers' results are checkpointed or written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def word_array(text: Column) -> Column:
    """Words of a text in order; an empty array for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, slices: int = 64) -> DataFrame:
    """Number the rows of each key from 0, gapless, so that a key with most rows is numbered in parts.

    Rows fall into slices by a hash of ``order``; each slice is numbered by itself and shifted by the sizes
    of the slices before it. The order has to be total for reruns to agree.
    """
    # Rows that a join has dealt by the keys would stay together: they are dealt by slice as well.
    rows = df.withColumn("_n_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")).repartition(*keys, "_n_slice")
    sizes = rows.groupBy(*keys, "_n_slice").agg(F.count(F.lit(1)).alias("_n_size"))
    before = Window.partitionBy(*keys).orderBy("_n_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_n_shift", F.coalesce(F.sum("_n_size").over(before), F.lit(0))).drop("_n_size")
    own = Window.partitionBy(*keys, "_n_slice").orderBy(*order)
    local = rows.withColumn("_n_local", F.row_number().over(own) - 1)
    joined = local.join(shift, [*keys, "_n_slice"])
    return joined.withColumn(out, (F.col("_n_local") + F.col("_n_shift")).cast("long")).drop("_n_slice", "_n_local", "_n_shift")


def running_sums(df: DataFrame, values: list[str], order: list[str], slices: int = 256) -> DataFrame:
    """For each value, ``<value>_before``: the sum over all rows before this one, in the order of slices."""
    rows = df.withColumn("_r_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    totals = rows.groupBy("_r_slice").agg(*[F.sum(v).alias(f"_r_{v}") for v in values])
    earlier = Window.orderBy("_r_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_r_slice", *[F.coalesce(F.sum(f"_r_{v}").over(earlier), F.lit(0)).alias(f"_r_{v}") for v in values])
    before = Window.partitionBy("_r_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values})
    joined = local.join(shift, "_r_slice")
    return joined.withColumns({f"{v}_before": (F.col(f"{v}_before") + F.col(f"_r_{v}")).cast("long") for v in values}).drop(
        "_r_slice", *[f"_r_{v}" for v in values])
