"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A file source by name. Text formats need a schema: inferring one reads the data twice."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """A file sink; rows of one partition value meet in few files, a hot value is split by AQE."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out.write.format(kind).mode(mode).partitionBy(*partition_by).save(path)
