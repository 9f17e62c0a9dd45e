"""Last-writer-wins state over the mutation log, and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.bloom import small
from tidelog.functions.ordering import global_rank, running_sum, versions


def fold(log: DataFrame) -> DataFrame:
    """(k, idx, op, v): the last record of each key. One partial aggregate by key, no sort; a record met twice changes nothing."""
    last = log.groupBy("k").agg(F.max_by(F.struct("idx", "op", "v"), "idx").alias("x"))
    return last.select("k", "x.idx", "x.op", "x.v")


def of_keys(log: DataFrame, probes: DataFrame) -> DataFrame:
    """The records of the probed keys, found before anything is shuffled where the probes are few."""
    return log.join(small(probes.select("k").distinct()), "k", "left_semi")


def live(log: DataFrame) -> DataFrame:
    """(k, idx, v) of the keys whose last record sets them."""
    return fold(log).where("op = 0").select("k", "idx", "v")


def tombstones(log: DataFrame) -> DataFrame:
    """(k, idx) of the keys whose last record deletes them, keys that were never set included."""
    return fold(log).where("op = 1").select("k", "idx")


def as_of(log: DataFrame, index: int | Column) -> DataFrame:
    """The state when records up to an index were applied."""
    return fold(log.where(F.col("idx") <= index))


def multi_get(state: DataFrame, probes: DataFrame) -> DataFrame:
    """(k, status, v) for each probe: value, tombstone or not_found."""
    got = probes.join(state.select("k", "op", "v"), "k", "left")
    return got.select("k", F.when(F.col("op").isNull(), "not_found").when(F.col("op") == 1, "tombstone").otherwise("value").alias("status"), F.when(F.col("op") == 0, F.col("v")).alias("v"))


def rpc_get(state: DataFrame, probes: DataFrame) -> DataFrame:
    """(k, v) as a client sees it: an empty string for what is missing or deleted."""
    return multi_get(state, probes).select("k", F.coalesce("v", F.lit("")).alias("v"))


def entry_size(k: Column, v: Column) -> Column:
    """Bytes that an entry counts for: key, value, index and op."""
    return (F.octet_length(k) + F.octet_length(v) + 9).cast("long")


def size(log: DataFrame) -> DataFrame:
    """One row: size_in_bytes and number of the folded entries."""
    return fold(log).agg(F.coalesce(F.sum(entry_size(F.col("k"), F.col("v"))), F.lit(0)).cast("long").alias("size_in_bytes"), F.count(F.lit(1)).alias("n"))


def running_size(log: DataFrame) -> DataFrame:
    """(idx, size_in_bytes) after each record: an overwrite counts the difference to the key's record before."""
    x = versions(log.withColumn("_s", entry_size(F.col("k"), F.col("v"))), "k", "idx", F.col("_s"))
    return running_sum(x, F.col("_s") - F.coalesce("before", F.lit(0)), "idx", "size_in_bytes").select("idx", "size_in_bytes")


def sorted_entries(log: DataFrame) -> DataFrame:
    """(pos, k, idx, op, v): the entries in key order, with their position."""
    return global_rank(fold(log), "k", "pos").select("pos", "k", "idx", "op", "v")


def history(log: DataFrame) -> DataFrame:
    """(k, version, idx, op, v, before): every version of every key, with the value before it."""
    return versions(log, "k", "idx", F.col("v")).select("k", "version", "idx", "op", "v", "before")


def range_scan(state: DataFrame, low: str, high: str) -> DataFrame:
    """(k, v) of live keys with low <= k < high. The bounds reach a Parquet scan as pushed filters."""
    return state.where((F.col("k") >= low) & (F.col("k") < high) & (F.col("op") == 0)).select("k", "v")


def prefix_scan(state: DataFrame, prefix: str) -> DataFrame:
    """(k, v) of live keys that start with prefix."""
    return state.where(F.col("k").startswith(prefix) & (F.col("op") == 0)).select("k", "v")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(k, change, old, new): keys whose live value differs between two states."""
    a = before.where("op = 0").select("k", F.col("v").alias("old"))
    b = after.where("op = 0").select("k", F.col("v").alias("new"))
    return a.join(b, "k", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("k", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"), "old", "new")


def stale_get(log: DataFrame, replicas: DataFrame, block: int = 32) -> DataFrame:
    """(node, k, idx, op, v): each replica's state, which holds the records up to its last_applied. replicas: (node, last_applied).

    Replicas are numbered by last_applied. Their indices cut the log into segments, and each segment is folded by key once. A key's record in one segment is what all replicas
    see that stand between it and the key's next one, so it is sent once to each `block` of replicas that has such, and meets the block's few replicas there. What is sent
    is held small by no estimate: Spark takes its size from before it is repeated, and would send all of it through the driver; so that join is merged.
    """
    at = replicas.select("node", F.col("last_applied").cast("long").alias("last_applied")).where("last_applied is not null")
    ends = at.groupBy("last_applied").agg(F.count(F.lit(1)).alias("_e"))
    # a record's segment is the number of replicas below it; an end's first number follows from the same running sum
    points = log.select((F.col("idx") * 2).alias("_o"), "k", "idx", "op", "v", F.lit(0).cast("long").alias("_e")).unionByName(ends.select((F.col("last_applied") * 2 + 1).alias("_o"), "_e"), allowMissingColumns=True)
    points = running_sum(points, F.col("_e"), "_o", "_seg")
    first = points.where("_e > 0").select(F.expr("(_o - 1) div 2").alias("last_applied"), (F.col("_seg") - F.col("_e")).alias("_first"))
    same = F.row_number().over(Window.partitionBy("last_applied").orderBy("node")) - 1
    numbered = at.withColumn("_r", same).join(first, "last_applied").select("node", (F.col("_first") + F.col("_r")).alias("_at")).withColumn("_b", F.expr(f"_at div {int(block)}"))
    held = points.where("_e = 0").groupBy("k", "_seg").agg(F.max_by(F.struct("idx", "op", "v"), "idx").alias("x"))
    upto = F.lead("_seg").over(Window.partitionBy("k").orderBy("_seg"))
    seen = held.withColumn("_to", F.coalesce(upto, F.lit(at.count())) - 1).where("_to >= _seg").withColumn("_b", F.explode(F.expr(f"sequence(_seg div {int(block)}, _to div {int(block)})")))
    return seen.hint("merge").join(numbered, "_b").where("_at between _seg and _to").select("node", "k", "x.idx", "x.op", "x.v")


def heartbeat_gaps(beats: DataFrame, limit_us: int) -> DataFrame:
    """(source, ts_us, gap_us): the beats of (source, ts_us) that came more than limit_us after the one before."""
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("source").orderBy("ts_us"))
    return beats.withColumn("gap_us", gap).where(F.col("gap_us") > limit_us).select("source", "ts_us", "gap_us")
