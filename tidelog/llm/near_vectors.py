"""Embedding near-dedup by spherical-cap filters: random product codes, list decoding, a join on filters, exact verification (Becker et al., 2016)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, written
from tidelog.llm.components import components
from tidelog.llm.vectors import cosines, matrix, rotation, unit, valid_vectors


def codes(dim: int, m: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation of the space, and for each half of the rotated coordinates m random unit codewords. A filter is a pair of codewords."""
    rng = np.random.default_rng(seed + 1)
    parts = [rng.normal(size=(d, m)) for d in (dim - dim // 2, dim // 2) if d]
    return rotation(dim, seed), [p / np.linalg.norm(p, axis=0) for p in parts]


def list_decode(x: np.ndarray, rot: np.ndarray, parts: list[np.ndarray], tau: float, least: int) -> list[np.ndarray]:
    """For each unit row the sorted ids of all filters whose direction it exceeds tau with, and of its `least` best ones in any case."""
    y, m = x @ rot, parts[0].shape[1]
    cut = parts[0].shape[0]
    a = y[:, :cut] @ parts[0]
    b = y[:, cut:] @ parts[1] if len(parts) > 1 else np.zeros((len(y), 1))
    out = []
    for p, q in zip(a, b, strict=True):
        # the least-th best sum lies among the best codewords of either half
        k = min(least, len(p)), min(least, len(q))
        top = np.add.outer(np.partition(p, -k[0])[-k[0] :], np.partition(q, -k[1])[-k[1] :]).ravel()
        t = min(tau, np.partition(top, -min(least, len(top)))[-min(least, len(top))] - 1e-12)
        i, j = np.flatnonzero(p >= t - q.max() - 1e-12), np.flatnonzero(q >= t - p.max() - 1e-12)
        u, v = np.nonzero(np.add.outer(p[i], q[j]) >= t)
        out.append(np.sort((i[u] * m + j[v]).astype(np.int32)))
    return out


def code_books(n: int, dim: int, threshold: float, m: int, tau: float, least: int, per_filter: int, filters_per_vector: int, shared: float, seed: int) -> list | None:
    """So many independent code books that two vectors at a cosine of threshold share `shared` filters on average, measured on 600 drawn pairs.

    A book's share falls as m grows, so the number of books grows with the rows. None when comparing all pairs costs no more than the books.
    """
    rng = np.random.default_rng(seed)
    x, e = rng.normal(size=(600, dim)), rng.normal(size=(600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * e
    books, mean = [], 0.0
    while mean < shared:
        if (len(books) + 1) * filters_per_vector * filters_per_vector * per_filter >= n:
            return None
        books.append(codes(dim, m, seed + 1000 * len(books)))
        lists = zip(list_decode(x, *books[-1], tau, least), list_decode(y, *books[-1], tau, least), strict=True)
        mean += sum(len(np.intersect1d(a, b)) for a, b in lists) / len(x)
    return books


def decode_all(x: np.ndarray, books: list | None, m: int, tau: float, least: int) -> list[np.ndarray]:
    """For each unit row the sorted ids of its filters in all books; one filter for all rows where there are no books."""
    if books is None:
        return [np.zeros(1, dtype=np.int32)] * len(x)
    lists = [[f + np.int32(k * m * m) for f in list_decode(x, *book, tau, least)] for k, book in enumerate(books)]
    return [np.concatenate(each) for each in zip(*lists, strict=True)]


def _block(threshold: float, kind: str):
    """The links of one filter's block or pair of blocks for which this filter is the least that both vectors share: so each link counts once."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        here, c1, c2 = (int(k) for k in key)
        x = unit(pdf["v"], kind)
        sims = x @ x.T
        linked = sims >= threshold
        # rounding decides nothing: pairs at the threshold are taken again on the vectors as they were given
        i, j = np.nonzero(np.triu(np.abs(sims - threshold) <= 1e-9, 1))
        if len(i):
            linked[i, j] = linked[j, i] = cosines(matrix(pdf["v"], kind), i, j) >= threshold
        np.fill_diagonal(linked, False)
        if c1 != c2:
            side = pdf["c"].to_numpy()
            linked &= side[:, None] != side[None, :]
        at = np.flatnonzero(linked.any(axis=1))
        if not len(at):
            return pd.DataFrame({"id": [], "links": [], "root": []})
        linked = linked[np.ix_(at, at)]
        lists = [np.frombuffer(b, dtype="<i4") for b in pdf["filters"].to_numpy()[at]]
        lists = [f[f < here] for f in lists]
        kinds, which, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        place = np.where(n > 1, np.cumsum(n > 1) - 1, -1)
        row = np.repeat(np.arange(len(at)), [len(f) for f in lists])
        column = place[which] if len(kinds) else np.zeros(0, dtype=np.int64)
        for first in range(0, int((n > 1).sum()), 4096):
            keep = (column >= first) & (column < first + 4096)
            shared = np.zeros((len(at), 4096), dtype=np.float32)
            shared[row[keep], column[keep] - first] = 1
            linked &= ~(shared @ shared.T > 0)
        ids, weight = pdf["id"].to_numpy()[at], pdf["w"].to_numpy()[at]
        root = ids.copy()
        while True:
            low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (low == root).all():
                break
            root = low
        some = linked.any(axis=1)
        return pd.DataFrame({"id": ids[some], "links": (linked @ weight)[some], "root": root[some]})

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", per_filter: int = 8, filters_per_vector: int = 24, least_filters: int = 12, block: int = 1024, seed: int = 29, shared: float = 15) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two vectors link at a cosine of at least threshold, computed in doubles. Vectors that take no part (see
    valid_vectors) and rows with a null id have 0 links and are their own component. Equal vectors are one node with a
    weight, so exact copies are never compared. Rows that repeat an id repeat its result; if their vectors differ, the id's
    vector is the least in byte order. The number of filters grows with the rows, so a filter's expected share stays at
    about per_filter * filters_per_vector vectors; a larger one is dealt into blocks, and pairs of blocks are compared.
    The number of code books grows with the rows too, so two vectors at the threshold share `shared` filters on average at
    any size; where the books would compare as much as all pairs do, all pairs are compared.
    """
    spark = vectors.sparkSession
    valid, dim, kind = valid_vectors(vectors, id_col, vec_col)
    valid = written(valid.groupBy("id").agg(F.min("v").alias("v")))
    nodes = written(valid.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")))
    n = nodes.count()
    m = max(8, math.ceil(math.sqrt(n / per_filter)))
    tau = NormalDist().inv_cdf(1 - min(0.5, filters_per_vector / (m * m))) / math.sqrt(max(dim, 1)) * math.sqrt(2)
    books = code_books(n, dim, threshold, m, tau, least_filters, per_filter, filters_per_vector, shared, seed) if n else None
    book = spark.sparkContext.broadcast(books)  # dim * m doubles a book: the square root of the rows

    def assign(batches):
        for b in batches:
            lists = decode_all(unit(b["v"], kind), book.value, m, tau, least_filters) if len(b) else []
            yield pd.DataFrame({"id": b["rep"], "w": b["w"], "v": b["v"], "filters": [f.tobytes() for f in lists], "f": [f.tolist() for f in lists]})

    if n:
        found = written(nodes.repartition("rep").mapInPandas(assign, "id long, w long, v binary, filters binary, f array<int>"))
        each = found.select("id", "w", "v", "filters", F.explode("f").alias("f"))
        large = written(found.select(F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("f", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
        side = F.broadcast(large) if large.count() <= 100_000 else large
        each = each.join(side, "f", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        each = each.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.withColumn("c1", F.least("c", "o")).withColumn("c2", F.greatest("c", "o"))
        pairs = written(each.groupBy("f", "c1", "c2").applyInPandas(_block(threshold, kind), "id long, links long, root long"))
    else:
        pairs = spark.createDataFrame([], "id long, links long, root long")
    degree = pairs.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(pairs.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    of = nodes.join(degree, "rep", "left").join(joined, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    of = valid.join(of, "v").select(F.col("id").alias("_id"), "links", "component")
    rows = vectors.select(F.col(id_col).cast("long").alias("_vid"))
    out = rows.join(of, rows["_vid"] == of["_id"], "left").select(F.col("_vid").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_vid").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_vectors over all embeddings at a cosine of 0.9."""
    return link_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
lk as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, r) as (select a, a from lk union select reach.vec_id, lk.b from reach join lk on lk.a = reach.r),
n as (select a as vec_id, count(*) as n from lk group by a), c as (select vec_id, min(r) as r from reach group by vec_id)
select vec_id, coalesce(n, 0) as n_links, coalesce(r, vec_id) as component_id, vec_id = coalesce(r, vec_id) as kept
from embeddings left join n using (vec_id) left join c using (vec_id)"""
