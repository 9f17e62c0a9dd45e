"""Sorted runs: building, catalog, sparse index, layered reads, pruning, flush boundaries, compaction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import bloom
from tidelog.functions.codec import encoded_size

#: Fixed values of the format: bytes at which a memtable is flushed, and every how many records a run is indexed.
FLUSH_BYTES, INDEX_INTERVAL = 500, 2


def runs_by_stride(log: DataFrame, stride: int) -> DataFrame:
    """(file_id, k, idx, op, v): a run for each `stride` records, folded by key."""
    x = log.withColumn("file_id", F.expr(f"(idx - 1) div {int(stride)} + 1"))
    return x.groupBy("file_id", "k").agg(F.max_by(F.struct("idx", "op", "v"), "idx").alias("x")).select("file_id", "k", "x.idx", "x.op", "x.v")


def positions(runs: DataFrame) -> DataFrame:
    """The runs with pos and off: a record's number and byte offset in its run's key order. A run's size is bounded by its flush threshold, so each is one window group."""
    w = Window.partitionBy("file_id").orderBy("k")
    before = F.sum(encoded_size(F.col("k"), F.col("v"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.select("*", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.coalesce(before, F.lit(0)).cast("long").alias("off"))


def sparse_index(runs: DataFrame, interval: int = INDEX_INTERVAL) -> DataFrame:
    """(file_id, k, off) of every `interval`-th record."""
    return positions(runs).where(F.col("pos") % interval == 0).select("file_id", "k", "off")


def catalog(runs: DataFrame) -> DataFrame:
    """(file_id, min_k, max_k, size_in_bytes, n) of each run."""
    return runs.groupBy("file_id").agg(F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.sum(encoded_size(F.col("k"), F.col("v"))).cast("long").alias("size_in_bytes"), F.count(F.lit(1)).alias("n"))


def next_file_id(runs: DataFrame) -> DataFrame:
    """One row: the id of the next run."""
    return runs.agg((F.coalesce(F.max("file_id"), F.lit(0)) + 1).cast("long").alias("next_file_id"))


def read_newest(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """(k, file_id, op, v) for each probe: the newest run that has it; nulls where none has. Probes are joined before the aggregate, so only matching records are shuffled."""
    hit = runs.join(probes, "k").groupBy("k").agg(F.max_by(F.struct("file_id", "op", "v"), "file_id").alias("x")).select("k", "x.*")
    return probes.join(hit, "k", "left").select("k", "file_id", "op", "v")


def get(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """(k, status, v): value, tombstone or not_found, by the newest run."""
    return _outcome(read_newest(runs, probes))


def get_raw(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """As get, but a tombstone in a run reads as an empty value: what a reader that ignores op sees."""
    x = read_newest(runs, probes)
    return x.select("k", F.when(F.col("op").isNull(), "not_found").otherwise("value").alias("status"), "v")


def _outcome(x: DataFrame) -> DataFrame:
    return x.select("k", F.when(F.col("op").isNull(), "not_found").when(F.col("op") == 1, "tombstone").otherwise("value").alias("status"), F.when(F.col("op") == 0, F.col("v")).alias("v"))


def layers(log: DataFrame, stride: int, last: int) -> DataFrame:
    """(layer, k, op, v): the last stride as memtable, the one before as flushing memtable, the others as runs; a higher layer is newer. last: the log's last index."""
    top = (last - 1) // stride + 1
    runs = runs_by_stride(log, stride)
    tagged = runs.withColumn("layer", F.when(F.col("file_id") == top, F.lit(top + 1)).when(F.col("file_id") == top - 1, F.lit(top)).otherwise(F.col("file_id")).cast("long"))
    return tagged.select("layer", "k", "op", "v")


def get_layered(layered: DataFrame, probes: DataFrame) -> DataFrame:
    """(k, status, v) by the newest layer that has the key."""
    hit = layered.join(probes, "k").groupBy("k").agg(F.max_by(F.struct("op", "v"), "layer").alias("x")).select("k", "x.*")
    return _outcome(probes.join(hit, "k", "left").select("k", "op", "v"))


def get_stored(stored: DataFrame, cat: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(k, status, v) of the given keys from stored runs: only folders of runs whose range holds one of them are read, and the keys reach the scan, where row groups' ranges and Bloom filters skip what has none of them."""
    held = reduce(lambda a, b: a | b, [(F.col("min_k") <= k) & (F.col("max_k") >= k) for k in keys])
    within = cat.where(held).select("file_id")
    hit = stored.where(F.col("k").isin(*keys)).join(within, "file_id", "left_semi")
    return get(hit, cat.sparkSession.createDataFrame([(k,) for k in keys], "k string"))


def candidate_runs(cat: DataFrame, probes: DataFrame) -> DataFrame:
    """(file_id, k): the runs whose key range holds the probe. Probes are a stated, small set; they are the side that a range join repeats."""
    return cat.join(probes, (F.col("k") >= F.col("min_k")) & (F.col("k") <= F.col("max_k"))).select("file_id", "k")


def prune_by_range(cat: DataFrame, probes: DataFrame) -> DataFrame:
    """(k, kept): how many runs are left for a probe after the key-range test; the others are skipped unread."""
    kept = candidate_runs(cat, probes).groupBy("k").agg(F.count(F.lit(1)).alias("kept"))
    return probes.join(kept, "k", "left").select("k", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def prune_by_bloom(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """(file_id, k) for each run whose Bloom filter may hold the probe."""
    return bloom.passes(bloom.probed_bits(runs, probes), probes)


def sparse_seek(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """(file_id, k, start, found): for each run whose range holds the probe, the offset of the greatest indexed key up to it (0 if none), and whether a scan from there finds it."""
    wanted = candidate_runs(catalog(runs), probes).withColumnRenamed("k", "probe")
    x = positions(runs).join(wanted, "file_id").groupBy("file_id", "probe").agg(
        F.coalesce(F.max(F.when((F.col("pos") % INDEX_INTERVAL == 0) & (F.col("k") <= F.col("probe")), F.col("off"))), F.lit(0)).cast("long").alias("start"),
        F.max(F.when(F.col("k") == F.col("probe"), F.col("off"))).alias("off"),
    )
    return x.select("file_id", F.col("probe").alias("k"), "start", F.coalesce(F.col("off") >= F.col("start"), F.lit(False)).alias("found"))


def compact(runs: DataFrame) -> DataFrame:
    """(k, idx, v): all runs merged into one bottom level: the newest record of each key, without tombstones."""
    return runs.groupBy("k").agg(F.max_by(F.struct("idx", "op", "v"), "file_id").alias("x")).where("x.op = 0").select("k", "x.idx", "x.v")


def flush_generations(log: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """(shard, idx, generation) of (shard, idx, k, v): a memtable that reaches threshold bytes is flushed at once, and the next record starts an empty one.

    The boundary depends on all records since the last, so a shard is folded in order: streamed in sorted batches, with only the open
    memtable's sizes held, whatever the shard's length. Shards run in parallel; a shard is one task, some million records a second and core, so a hot
    one is to be split into more shards where they are assigned, as the data model has it.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, sizes, total, generation = None, {}, 0, 1
        for b in batches:
            out = []
            for s, k, n in zip(b["shard"], b["k"], b["n"], strict=True):
                if s != shard:
                    shard, sizes, total, generation = s, {}, 0, 1
                out.append(generation)
                total += n - sizes.get(k, 0)
                sizes[k] = n
                if total >= threshold:
                    sizes, total, generation = {}, 0, generation + 1
            yield b[["shard", "idx"]].assign(generation=out)

    x = log.select("shard", "idx", "k", (F.octet_length("k") + F.octet_length("v") + 9).cast("long").alias("n"))
    return x.repartition("shard").sortWithinPartitions("shard", "idx").mapInPandas(fold, "shard long, idx long, generation long")


def recovered(runs: DataFrame, stale: DataFrame, current: DataFrame) -> DataFrame:
    """(k, idx, op, v): the state after a restart, from the runs, the log whose flush had not ended, and the live log."""
    x = runs.select("k", "idx", "op", "v").unionByName(stale.select("k", "idx", "op", "v")).unionByName(current.select("k", "idx", "op", "v"))
    return x.groupBy("k").agg(F.max_by(F.struct("idx", "op", "v"), "idx").alias("x")).select("k", "x.idx", "x.op", "x.v")
