"""Reading of the given tables, and the canonical mutation log over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SET, DELETE = 0, 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutation_log(events: DataFrame) -> DataFrame:
    """(idx, op, k, v): the ordered set/delete records that the events stand for. A delete has an empty value, not null, so that folds by max_by keep it."""
    deleted = F.col("event_type") == "error"
    return events.select(
        (F.col("event_id") + 1).alias("idx"),
        F.when(deleted, DELETE).otherwise(SET).alias("op"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("k"),
        F.when(deleted, "").otherwise(F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k"))).alias("v"),
    )


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutation log of a folder of tables."""
    return mutation_log(read(spark, sf_dir, "events"))
