"""Reading columns of tables, JSON-lines exports and append-only receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Role columns from SQL expressions over a table's own columns."""
    return df.select(*[F.expr(expression).alias(name) for name, expression in mapping.items()])


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a Parquet table."""
    return spark.read.parquet(path).select(*columns)


def export_lines(df: DataFrame, path: str, day: str | None = None) -> None:
    """JSON lines, one folder per day where a time column is given."""
    if day is None:
        df.write.mode("overwrite").json(path)
        return
    df.withColumn("day", F.to_date(day)).write.mode("overwrite").partitionBy("day").json(path)


def append_receipts(receipts: DataFrame, path: str) -> None:
    receipts.write.mode("append").json(path)


def load_receipts(spark: SparkSession, path: str, schema: str, cohort: dict[str, str]) -> DataFrame:
    """Stored receipts; rows of another input, configuration or schema are an error."""
    rows = spark.read.schema(schema).json(path)
    fits = [F.col(column).eqNullSafe(F.lit(value)) for column, value in cohort.items()]
    other = rows
    for fit in fits:
        rows = rows.filter(fit)
    if not other.exceptAll(rows).isEmpty():
        raise ValueError("receipts belong to a different input, configuration or schema")
    return rows
