"""Rows of earlier batches, found by key without opening every batch.

A batch's rows are stored in hash buckets, with a summary of each bucket: the least and largest first key and
bitmaps of key hashes. A later batch looks its keys up in the summaries and opens only the buckets that may
hold one of them. Every ``FOLD`` generations are folded into one of the next level, so that the number of
generations that count grows with the logarithm of the number of batches. Which generations count before a
batch follows from its number alone: a batch that is run again finds what it found, and writes what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD = 8
BUCKETS = 32
PER_BITMAP = 4096  # keys aimed at for each bitmap of 32,768 bits
BITS = 32_768


class KeyedLog:
    """Rows with key columns under ``folder``, appended by numbered batches."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str):
        self.spark, self.folder, self.keys, self.schema = spark, folder, keys, schema
        self.opened: list[str] = []  # by the last look-up

    @staticmethod
    def generations(number: int) -> list[tuple[int, int]]:
        """(level, index) of the generations that hold batches 0 to ``number`` - 1."""
        out, level, upto = [], 0, number
        while upto:
            out += [(level, i) for i in range(upto - upto % FOLD, upto)]
            upto, level = upto // FOLD, level + 1
        return out

    def _path(self, kind: str, level: int, index: int) -> str:
        return f"{self.folder}/{kind}/level={level}/index={index}"

    def _hashed(self, rows: DataFrame) -> DataFrame:
        hashed = rows.withColumn("_h", F.xxhash64(*self.keys))
        return hashed.withColumns({"bucket": F.pmod("_h", F.lit(BUCKETS)).cast("int"), "_bit": F.pmod(F.shiftrightunsigned("_h", 24), F.lit(BITS)).cast("int")})

    def _write(self, rows: DataFrame, level: int, index: int) -> None:
        path = self._path("rows", level, index)
        columns = rows.columns
        hashed = self._hashed(rows)
        hashed.select(*columns, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        stored = self._hashed(self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).select(*columns))
        count = stored.count()
        slots = max(1, -(-count // (BUCKETS * PER_BITMAP)))
        first = self.keys[0]
        summary = stored.withColumn("slot", F.pmod(F.shiftright("_h", 8), F.lit(slots)).cast("int")).groupBy("bucket", "slot").agg(
            F.min(first).alias("low"), F.max(first).alias("high"), F.bitmap_construct_agg("_bit").alias("bits"))
        summary.withColumn("slots", F.lit(slots)).write.mode("overwrite").parquet(self._path("summary", level, index))

    def _summaries(self, number: int) -> DataFrame | None:
        found = self.generations(number)
        if not found:
            return None
        kind = dict(self.spark.createDataFrame([], self.schema).dtypes)[self.keys[0]]
        schema = f"bucket int, slot int, low {kind}, high {kind}, bits binary, slots int, level int, index int"
        paths = [self._path("summary", *g) for g in found]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/summary").parquet(*paths)

    def matching(self, rows: DataFrame, number: int) -> DataFrame:
        """Stored rows of batches before ``number`` that share a key with ``rows``."""
        summaries = self._summaries(number)
        self.opened = []
        if summaries is not None:
            asked = self._hashed(rows.select(*self.keys).distinct())
            near = asked.join(summaries, "bucket").filter(
                (F.col("slot") == F.pmod(F.shiftright("_h", 8), F.col("slots"))) & F.col(self.keys[0]).between(F.col("low"), F.col("high")))
            byte = F.conv(F.hex(F.substring("bits", F.expr("_bit div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
            held = near.filter(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1)
            buckets = held.select("level", "index", "bucket").distinct().collect()  # of live generations, at most
            self.opened = sorted(f"{self._path('rows', r['level'], r['index'])}/bucket={r['bucket']}" for r in buckets)
        if not self.opened:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.opened).join(rows.select(*self.keys).distinct(), self.keys, "left_semi")

    def unseen(self, rows: DataFrame, number: int) -> DataFrame:
        """``rows`` whose key no earlier batch brought. Keys are not null."""
        known = self.matching(rows, number)
        return rows.join(known.select(*self.keys), self.keys, "left_anti") if self.opened else rows

    def add(self, rows: DataFrame, number: int) -> None:
        """Store a batch's rows, and fold the generations that it completes."""
        self._write(rows, 0, number)
        level, upto = 1, number + 1
        while upto % FOLD == 0:
            upto //= FOLD
            parts = [self._path("rows", level - 1, i) for i in range((upto - 1) * FOLD, upto * FOLD)]
            columns = rows.columns
            self._write(self.spark.read.schema(f"{self.schema}, bucket int").option("recursiveFileLookup", "true").parquet(*parts).select(*columns), level, upto - 1)
            level += 1
