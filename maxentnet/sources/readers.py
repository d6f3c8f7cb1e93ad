"""Files as vertex or edge tables: any format that Spark reads, with the schema given rather than inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """parquet, orc, csv, json, avro, jdbc, ...; filters and column choices on the result reach the scan where the format allows."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error", **options) -> None:
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
