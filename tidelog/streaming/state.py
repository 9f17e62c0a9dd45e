"""The state kept incrementally by Structured Streaming: each batch adds a run of what it changed, and runs are merged in tiers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import work
from tidelog.sources.tables import mutation_log

STATE_SCHEMA = "k string, idx long, op int, v string"
#: So many runs of one tier are merged into one of the next.
FAN = 8


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """One of the given tables as a stream; a table may be a file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs, p = work.file_system(spark, path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if fs.getFileStatus(p).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def folded(log: DataFrame) -> DataFrame:
    """(k, idx, op, v): the last record of each key, by idx and not by arrival."""
    last = log.groupBy("k").agg(F.max_by(F.struct("idx", "op", "v"), "idx").alias("x"))
    return last.select("k", "x.idx", "x.op", "x.v")


def _manifest(spark: SparkSession, out: str, before: int | None = None) -> tuple[int, list[list]]:
    """(number, [[run, tier], ...]) of the last published manifest, or of the last one below `before`; (-1, []) where there is none."""
    there = [n for n in work.versions(spark, f"{out}/manifest") if before is None or n < before]
    if not there:
        return -1, []
    return there[-1], json.loads(spark.read.text(f"{out}/manifest/v{there[-1]}").first()[0])


def read_state(spark: SparkSession, out: str) -> DataFrame:
    """(k, idx, op, v): the state that the runs of the last manifest hold; empty before the first batch."""
    runs = _manifest(spark, out)[1]
    if not runs:
        return spark.createDataFrame([], STATE_SCHEMA)
    return folded(spark.read.schema(STATE_SCHEMA).parquet(*[f"{out}/runs/{name}" for name, _ in runs]))


def maintain(log: DataFrame, out: str, fan: int = FAN) -> int:
    """Run a stream of records to its end, keeping the state in out; the number of the last batch that changed it, over all runs of this function (-1 before any).

    A batch writes only the last record of each key that it holds, as one run; `fan` runs of a tier become one run of the next, so a record is rewritten once a tier, not once
    a batch. The runs that make up the state are named in a manifest, which is published in one step; a batch that is run again after a failure starts from the manifest before it and
    writes the same. Runs that neither of the last two manifests names are deleted.
    """
    spark = log.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        runs = _manifest(session, out, number)[1]
        before = {name for name, _ in runs}

        def add(rows: DataFrame, name: str, tier: int) -> None:
            folded(rows).write.mode("overwrite").parquet(f"{out}/runs/{name}")
            runs.append([name, tier])

        add(batch.select("k", "idx", "op", "v"), f"b{number}-0", 0)
        tier = 0
        while len(full := [name for name, t in runs if t == tier]) >= fan:
            runs[:] = [r for r in runs if r[1] != tier]
            tier += 1
            add(session.read.schema(STATE_SCHEMA).parquet(*[f"{out}/runs/{name}" for name in full]), f"b{number}-{tier}", tier)
        work.publish(session, f"{out}/manifest", lambda folder: session.createDataFrame([(json.dumps(runs),)], "value string").coalesce(1).write.text(folder), number)
        fs, folder = work.file_system(session, f"{out}/runs")
        live = before | {name for name, _ in runs}
        for name in [s.getPath().getName() for s in fs.listStatus(folder)]:
            if name not in live:
                fs.delete(work.file_system(session, f"{out}/runs/{name}")[1], True)

    log.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _manifest(spark, out)[0]


def state_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the whole log, got by streaming it."""
    out = work.new_folder(spark, "stream")
    maintain(mutation_log(read_stream(spark, sf_dir, "events")), out)
    return read_state(spark, out)
