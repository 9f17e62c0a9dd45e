"""Temperature mixing of sources. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import n_words, table, written

#: The columns that mix() adds; columns of these names that the input has are replaced.
ADDED = ("epoch", "block", "weight", "passes", "mix_key")


def source_stats(docs: DataFrame, source_col: str = "source", tokens_col: str = "n_tokens") -> DataFrame:
    """(source, n_docs, tokens) over all rows. A null source is a source of its own. An empty document counts as one token, so that each has a share."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.greatest(F.col(tokens_col), F.lit(1))).cast("long").alias("tokens"))


def solve_exponent(stats: DataFrame, target_entropy: float | None, max_repeats: float, digits: int = 4, ways: int = 64) -> float:
    """The exponent t in 0..1 of the token shares, each round keeping one of `ways` equal parts of the bracket (bisection, many points at a time).

    Wanted is the largest t whose weights p^t / sum(p^t) have an entropy of at least target_entropy times that of equal
    weights; then t is raised, if need be, to the least one at which no source is passed more than max_repeats times
    while the source that is passed least is passed once. t = 1 keeps the shares; 0 makes all alike. The stats stay distributed; a round returns `ways` rows.
    """
    total = stats.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.max("tokens").alias("hi"), F.min("tokens").alias("lo")).first()
    if not total["k"] or total["k"] == 1:
        return 1.0
    t = 1.0
    if target_entropy is not None:
        goal, lo, hi = target_entropy * math.log(total["k"]), 0.0, 1.0
        p = F.col("tokens") / F.lit(float(total["t"]))
        for _ in range(digits):
            step = (hi - lo) / ways
            grid = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ways)))).withColumn("w", F.pow(p, F.lit(lo) + F.col("i") * F.lit(step)))
            met = grid.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("s")).where(F.log("z") - F.col("s") / F.col("z") >= goal).agg(F.max("i").alias("i")).first()["i"]
            at = 0 if met is None else met
            lo, hi = lo + at * step, min(1.0, lo + (at + 1) * step) if at < ways else hi
        t = lo
    # Passes go as p^(t-1): the rarest source is passed (hi/lo)^(1-t) times as often as the commonest.
    ratio = total["hi"] / total["lo"]
    if ratio > 1 and ratio ** (1 - t) > max_repeats:
        lo, hi = t, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ratio ** (1 - mid) <= max_repeats else (mid, hi)
        t = hi
    return t


def mix(docs: DataFrame, target_entropy: float | None = 0.98, max_repeats: float = 2.0, block_tokens: int = 1 << 16, seed: int = 13, source_col: str = "source", tokens_col: str = "n_tokens", chunks: int = 1024) -> DataFrame:
    """docs, a row for each pass in which a document is drawn, with epoch (from 1), block, weight, passes and mix_key; ordered by mix_key they are the mixture.

    The budget is the least at which no source loses a document: the commonest source is passed once, any other between
    once and max_repeats times. A source is dealt by a hash of the row into blocks of about block_tokens; each epoch permutes them
    anew, full epochs take all blocks, and the last takes blocks in permuted order while its budget lasts. Null ids and null sources take part like others;
    rows that are equal in all columns share a block; an empty table gives an empty result; columns named as those added are replaced. Tokens are read once, into a written table of
    sources, row hashes and counts. A source's blocks are put in order by `chunks` ranges of their hash, so no task sorts all blocks of a source.
    """
    names = docs.columns
    hashed = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if "map<" not in kind and c != tokens_col], F.lit(seed))
    slim = written(docs.select(F.col(source_col).alias("_src"), hashed.alias("_h"), F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(1)).cast("long").alias("_n")))
    stats = written(source_stats(slim, "_src", "_n"))
    t = solve_exponent(stats, target_entropy, max_repeats)
    norm = stats.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(t))).alias("z"), F.max("tokens").alias("hi")).first()
    z, hi = norm["z"] or 1.0, float(norm["hi"] or 1)
    plan = stats.select(
        F.col("source").alias("_source"), "tokens",
        (F.pow(F.col("tokens").cast("double"), F.lit(t)) / F.lit(z)).alias("weight"),
        F.round(F.pow(F.lit(hi) / F.col("tokens"), F.lit(1 - t)), 9).alias("passes"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).alias("n_blocks"),
    )
    block = F.pmod("_h", F.col("n_blocks")).alias("block")
    blocks = slim.join(plan, slim["_src"].eqNullSafe(plan["_source"])).groupBy("_source", block).agg(F.sum("_n").alias("block_size"), F.first("tokens").alias("tokens"), F.first("passes").alias("passes"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil("passes").cast("int")))).withColumn("at", F.xxhash64("_source", "block", "epoch", F.lit(seed)))
    blocks = written(blocks.withColumn("chunk", F.floor((F.col("at") / F.lit(2.0**64) + F.lit(0.5)) * chunks).cast("int")))
    earlier = Window.partitionBy("_source", "epoch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    below = blocks.groupBy("_source", "epoch", "chunk").agg(F.sum("block_size").alias("_c")).select(F.col("_source").alias("_s"), F.col("epoch").alias("_e"), F.col("chunk").alias("_k"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("below"))
    order = Window.partitionBy("_source", "epoch", "chunk").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("block_size").over(order), F.lit(0)))
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("chunk") == F.col("_k"))
    blocks = blocks.join(below, same).select("_s", F.col("block").alias("_b"), "epoch", "block_size", "tokens", "passes", (F.col("below") + F.col("inside")).alias("before"))
    blocks = blocks.where(F.col("before") < (F.col("passes") - F.col("epoch") + 1) * F.col("tokens"))
    blocks = blocks.select("_s", "_b", "epoch", ((F.col("epoch") - 1 + (F.col("before") + F.col("block_size") / 2) / F.col("tokens")) / F.col("passes")).alias("mix_key"))
    blocks = blocks.groupBy("_s", "_b").agg(F.array_sort(F.collect_list(F.struct("epoch", "mix_key"))).alias("_drawn"))
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col(source_col).alias("_src"), hashed.alias("_h"))
    dealt = whole.join(plan, whole["_src"].eqNullSafe(plan["_source"])).withColumn("block", F.pmod("_h", F.col("n_blocks")))
    out = dealt.join(blocks, dealt["_source"].eqNullSafe(F.col("_s")) & (dealt["block"] == F.col("_b"))).withColumn("_d", F.explode("_drawn"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names if c not in ADDED], F.col("_d.epoch").alias("epoch"), "block", "weight", "passes", F.round("_d.mix_key", 9).alias("mix_key"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source, one row per document and pass. Words are counted once, into a written table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n_tokens"))
    return mix(written(docs))
