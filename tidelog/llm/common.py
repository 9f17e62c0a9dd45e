"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.work import file_system, new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends there, and a lost executor costs nothing. drop: written tables that nothing reads from now on; their files go. The rest goes when the session's JVM ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    for old in drop:
        fs, at = file_system(spark, old._written_at)
        fs.delete(at, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    """Count of white-space-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0)).cast("long")
