"""Packing into length buckets whose boundaries a dynamic program chooses over the global length histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import n_words, table, written


def best_boundaries(tops: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """The bucket tops, at most `buckets`, that minimise the padding sum(top - length), over histogram bins given by their greatest length, count and total length."""
    m = len(tops)
    if m == 0:
        return []
    n, s = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(sums)]).astype(float)
    tops = np.asarray(tops, dtype=float)
    best = np.concatenate([[0.0], np.full(m, np.inf)])
    cut = np.zeros((min(buckets, m) + 1, m + 1), dtype=np.int64)
    costs, used = [best], 0
    for k in range(1, min(buckets, m) + 1):
        now = np.full(m + 1, np.inf)
        now[0] = 0.0
        for j in range(1, m + 1):
            pad = costs[-1][:j] + tops[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            cut[k, j] = int(np.argmin(pad))
            now[j] = pad[cut[k, j]]
        costs.append(now)
        used = k
    out, j = [], m
    while j > 0 and used > 0:
        out.append(int(tops[j - 1]))
        j, used = int(cut[used, j]), used - 1
    return sorted(out)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens", exact: int = 512, per_doubling: int = 32) -> DataFrame:
    """(bin, n, total, top) of all rows: a bin for each length up to `exact`, above that `per_doubling` bins to each doubling, so 512 + 32 * 54 bins at most for any input."""
    x = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    bin_ = F.when(x <= exact, x).otherwise(F.lit(exact) + F.ceil(F.log2(x / F.lit(float(exact))) * F.lit(per_doubling)).cast("long"))
    return lengths.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.max(x).alias("top"))


def pack(docs: DataFrame, buckets: int = 12, batch_tokens: int = 1 << 16, salts: int = 1024, seed: int = 17, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """Per row: id, length, bucket (its top length), batch, slot in the batch, batch_rows (the bucket's full batch) and padding.

    A batch holds floor(batch_tokens / top) rows, one at least, so that its padded size keeps to the budget. Rows are
    numbered within a bucket by a count per (bucket, salt) and a running sum over those buckets * salts counts, so a bucket that holds most rows is
    spread over `salts` groups and only its very last batch is short. A null length is 0. Repeated rows, and rows with null
    ids, are packed each by itself. Nothing is split or cut. An empty table gives an empty result.
    """
    x = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    bins = sorted((r["bin"], r["n"], r["total"], r["top"]) for r in length_histogram(docs, length_col).collect())  # bounded: see length_histogram
    tops = best_boundaries(*(np.array([b[i] for b in bins], dtype=np.int64) for i in (3, 1, 2)), buckets)
    if not tops:
        tops = [0]
    bucket = F.lit(tops[-1])
    for t in reversed(tops[:-1]):
        bucket = F.when(F.col("_len") <= t, F.lit(t)).otherwise(bucket)
    rows = docs.select(F.col(id_col).alias("_id"), x.alias("_len")).withColumn("bucket", bucket.cast("long")).withColumn("salt", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(salts)))
    counts = rows.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("_len", "_id"))
    out = rows.withColumn("_rn", local - 1).join(F.broadcast(before), ["bucket", "salt"])  # at most buckets * salts rows
    full = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    at = F.col("before") + F.col("_rn")
    return out.select(F.col("_id").alias(id_col), F.col("_len").alias(length_col), "bucket", F.floor(at / full).cast("long").alias("batch"), (at % full).cast("long").alias("slot"), full.alias("batch_rows"), (F.col("bucket") - F.col("_len")).alias("padding"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of all documents by their number of words, which are counted once, into a written table."""
    return pack(written(table(spark, sf_dir, "documents").select("doc_id", n_words(F.col("text")).alias("n_tokens"))))
