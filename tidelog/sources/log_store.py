"""The log and its sorted runs as tables in storage: append, rotate, scan, open what may be absent, remove what a run covers, and the run catalog."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import work

LOG_SCHEMA = "idx long, op int, k string, v string"
CATALOG_SCHEMA = "file_id long, min_k string, max_k string, size_in_bytes long, n long"
NODE_STATE_SCHEMA = "node string, current_term long, voted_for string, entries array<struct<term: long, command: string>>, commit_index long, snapshot_last_index long, snapshot_last_term long"


def append(log: DataFrame, path: str, generation: int = 1) -> None:
    """Append records to a generation of the log; the write's commit makes them durable together."""
    log.select("idx", "op", "k", "v", F.lit(generation).alias("generation")).write.mode("append").partitionBy("generation").parquet(path)


def scan(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The log, or one generation of it. A log that was never written is empty; other errors are raised."""
    try:
        log = spark.read.schema(LOG_SCHEMA + ", generation int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], LOG_SCHEMA + ", generation int")
    return log if generation is None else log.where(F.col("generation") == generation)


def rotate(spark: SparkSession, path: str) -> int:
    """The generation to write to from now on."""
    return int(scan(spark, path).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]) + 1


def union_batches(*batches: DataFrame) -> DataFrame:
    """The log after the batches were appended in turn."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def with_generation(log: DataFrame, stride: int) -> DataFrame:
    """The log with the generation of each record, when it is rotated every `stride` records."""
    return log.withColumn("generation", F.expr(f"(idx - 1) div {int(stride)} + 1"))


def unflushed(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Records of generations that no run covers: the others' logs may be removed."""
    return log.join(runs.select(F.col("file_id").alias("generation")).distinct(), "generation", "left_anti")


RUN_SCHEMA = "k string, idx long, op int, v string, file_id long"


def write_runs(runs: DataFrame, path: str) -> None:
    """Runs as Parquet, a folder for each, sorted by key, with Bloom filters on the key besides the row groups' ranges.

    Only folders of the runs written are replaced, each when the write commits; runs are seen through the catalog, which is published after them.
    """
    out = runs.select("k", "idx", "op", "v", "file_id").repartition("file_id").sortWithinPartitions("file_id", "k").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.option("parquet.bloom.filter.enabled#k", "true").partitionBy("file_id").parquet(path)


def read_runs(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """(file_id, k, idx, op, v) of the stored runs that the catalog names; others, such as those of a flush that didn't end, are not seen. A filter of the catalog prunes the other runs' folders at run time."""
    return spark.read.schema(RUN_SCHEMA).parquet(path).join(catalog.select("file_id"), "file_id", "left_semi").select("file_id", "k", "idx", "op", "v")


def save_catalog(catalog: DataFrame, path: str) -> int:
    """Publish the run catalog, as JSON lines, in one step: readers see the version before until then. The version's number."""
    rows = catalog.select(*[c.split()[0] for c in CATALOG_SCHEMA.split(", ")])
    return work.publish(catalog.sparkSession, path, lambda folder: rows.write.json(folder))


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The last published run catalog; where there is none, or what is there can't be read as JSON, it is empty."""
    there = work.versions(spark, path)
    try:
        lines = spark.read.text(f"{path}/v{there[-1]}" if there else path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CATALOG_SCHEMA)
    parsed = lines.select(F.from_json("value", CATALOG_SCHEMA, {"mode": "PERMISSIVE"}).alias("x")).select("x.*").where("file_id is not null")
    return parsed


def catalog_roundtrip(catalog: DataFrame) -> DataFrame:
    """The catalog through its JSON form."""
    return catalog.select(F.to_json(F.struct("file_id", "min_k", "max_k", "size_in_bytes", "n")).alias("j")).select(F.from_json("j", CATALOG_SCHEMA).alias("x")).select("x.*")


def state_to_json(states: DataFrame) -> DataFrame:
    """(node, state): each node's persistent state as JSON."""
    return states.select("node", F.to_json(F.struct("current_term", "voted_for", "entries", "commit_index", "snapshot_last_index", "snapshot_last_term")).alias("state"))


def state_from_json(lines: DataFrame) -> DataFrame:
    """The states back from (node, state). A node without a state starts from zeros and an empty log; a state that isn't a JSON object with term, entries and commit index is an error, which fails the job: a node that started afresh instead could vote twice."""
    inner = NODE_STATE_SCHEMA.removeprefix("node string, ")
    x = lines.select("node", "state", F.from_json("state", inner, {"mode": "PERMISSIVE"}).alias("x"))
    whole = F.col("x.current_term").isNotNull() & F.col("x.entries").isNotNull() & F.col("x.commit_index").isNotNull()
    x = x.where(F.when(F.col("state").isNull() | whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("corrupt state of node "), F.coalesce("node", F.lit("null")))).cast("boolean")))
    zero = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(0).cast("long")).alias(c)
    return x.select("node", zero("current_term"), F.col("x.voted_for").alias("voted_for"), F.coalesce("x.entries", F.array().cast("array<struct<term: long, command: string>>")).alias("entries"), zero("commit_index"), zero("snapshot_last_index"), zero("snapshot_last_term"))
