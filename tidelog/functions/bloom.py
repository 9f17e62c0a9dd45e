"""Bloom filters by double hashing with the two big-endian halves of SHA-256, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: bits of a run's filter, and probes of a key.
BITS, PROBES = 640_000, 7


def positions(k: Column, bits: int = BITS) -> Column:
    """The array of a key's bit positions, (h1 + i * h2 mod 2^64) mod bits for i = 1..PROBES.

    The unsigned 64-bit halves of the digest are kept as pairs of 32-bit numbers in longs, so sums carry by shifts and no decimal is needed; the digest is taken once a key.
    """
    digest = F.sha2(k, 256)
    word = lambda d, at: F.conv(F.substring(d, at, 8), 16, 10).cast("long")
    low32, rest = (1 << 32) - 1, (1 << 32) % bits

    def probes(w: Column) -> Column:
        def one(i: Column) -> Column:
            low = w["b1"] + i * w["b2"]
            high = (w["a1"] + i * w["a2"] + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(low32))
            return (((high % bits) * F.lit(rest) + low.bitwiseAND(F.lit(low32))) % bits).cast("int")

        return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(PROBES).cast("long")), one)

    words = F.transform(F.array(digest), lambda d: F.struct(word(d, 1).alias("a1"), word(d, 9).alias("b1"), word(d, 17).alias("a2"), word(d, 25).alias("b2")))
    return F.element_at(F.transform(words, probes), 1)


def probe_rows(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(k, i, bit_pos) for each key and probe."""
    return keys.select("k", F.posexplode(positions(F.col("k"), bits)).alias("i", "bit_pos")).select("k", (F.col("i") + 1).alias("i"), "bit_pos")


def build(runs: DataFrame, bits: int = BITS) -> DataFrame:
    """(file_id, bit_pos): the set bits of each run's filter."""
    return runs.select("file_id", F.explode(positions(F.col("k"), bits)).alias("bit_pos")).distinct()


def chunks(bits: DataFrame) -> DataFrame:
    """(file_id, chunk, mask): the filters packed into 64-bit words."""
    return bits.groupBy("file_id", F.expr("bit_pos div 64").alias("chunk")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit_pos % 64 as int))")).alias("mask"))


def probed_bits(runs: DataFrame, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(file_id, bit_pos): of the runs' filters only the bits that some key probes, so that what is made distinct grows with the keys."""
    wanted = probe_rows(keys, bits).select("bit_pos").distinct()
    return runs.select("file_id", F.explode(positions(F.col("k"), bits)).alias("bit_pos")).join(small(wanted), "bit_pos", "left_semi").distinct().select("file_id", "bit_pos")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def passes(filters: DataFrame, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(file_id, k) for each run whose filter has all bits of the key."""
    probes = probe_rows(keys, bits).select("k", "bit_pos").distinct()
    need = probes.groupBy("k").agg(F.count(F.lit(1)).alias("need"))
    hit = filters.join(probes, "bit_pos").groupBy("file_id", "k").agg(F.count(F.lit(1)).alias("hit"))
    return hit.join(need, "k").where("hit = need").select("file_id", "k")
