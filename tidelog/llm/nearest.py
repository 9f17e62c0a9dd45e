"""Approximate nearest neighbours by multiprobe p-stable hashing (Datar et al., 2004; Lv et al., 2007)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import table, written
from tidelog.llm.vectors import matrix, unit, valid_vectors


def family(dim: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian (2-stable) directions, and offsets, for every table."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(tables, dim, projections)), rng.uniform(0, width, size=(tables, projections))


def probe_order(low: np.ndarray, probes: int) -> list[tuple]:
    """Perturbations of a bucket in order of estimated success, the bucket itself first. low: how far the point lies into its cell, 0..1, by projection.

    The estimate is the sum of squared distances to the boundaries that are crossed; sets are drawn from a heap by shifting or extending the last element.
    """
    k = len(low)
    steps = sorted([(float(x) ** 2, i, -1) for i, x in enumerate(low)] + [((1 - float(x)) ** 2, i, 1) for i, x in enumerate(low)])
    out, heap = [()], [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
        if len({steps[i][1] for i in chosen}) == len(chosen):
            out.append(tuple((steps[i][1], steps[i][2]) for i in chosen))
    return out


def _code(cells: np.ndarray) -> np.ndarray:
    """One long for each row of cell numbers."""
    out = np.zeros(len(cells), dtype=np.int64)
    for c in cells.T:
        out = out * 1_000_003 + c
    return out


def _rank(k: int, kind: str):
    """A bucket's k best candidates of each query by exact cosine, ties to the smaller id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["q"].to_numpy()
        q, x = pdf[ask], pdf[~ask]
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(q["id"].to_numpy(), matrix(q["v"], kind), x["id"].to_numpy(), matrix(x["v"], kind), k)

    return run


def _best(qi: np.ndarray, a: np.ndarray, xi: np.ndarray, b: np.ndarray, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): of the rows xi, b the k best of each of the queries qi, a but the query's own id."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    out = []
    for s in range(0, len(a), 256):
        sims = (a[s : s + 256] @ b.T) / np.outer(na[s : s + 256], nb)
        sims[qi[s : s + 256, None] == xi[None, :]] = -np.inf
        edge = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -2.0)
        r, c = np.nonzero(sims >= np.maximum(edge, -2.0)[:, None] - 1e-12)
        exact = np.clip((a[s + r] * b[c]).sum(axis=1) / (na[s + r] * nb[c]), -1.0, 1.0)
        best = pd.DataFrame({"query_id": qi[s + r], "vec_id": xi[c], "score": exact}).drop_duplicates(["query_id", "vec_id"])
        out.append(best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k))
    return pd.concat(out)


#: The index shapes that fitting chooses from: projections of a table, width of a cell, most probes.
PROJECTIONS, WIDTHS, PROBES = (3, 4, 6, 8, 10, 12, 16), (1.2, 2.0), 128
#: Rows of the samples that the index is fitted on: queries, and rows.
FIT_QUERIES, FIT_ROWS = 48, 3000


def probed(f: np.ndarray, probes: int) -> np.ndarray:
    """The codes of the cells that a point, in units of cells, probes in a table."""
    home = np.floor(f).astype(np.int64)
    moves = probe_order(f - home, probes)
    cells = np.tile(home, (len(moves), 1))
    for row, m in zip(cells, moves, strict=True):
        for axis, step in m:
            row[axis] += step
    return _code(cells)


def fit_shape(asked: np.ndarray, near: list[np.ndarray], rows: np.ndarray, n: int, n_asked: int, tables: int, recall: float, seed: int) -> tuple[int, float, int]:
    """(projections, width, probes): of the shapes above the cheapest at which the sampled queries' true neighbours are found with the wanted recall; without any, the one that finds most.

    The cost of a shape is what a row costs at this n: the queries that meet it, by the share of the sampled rows that are met, and the rows and probes to move, one of which costs about as
    much as forty distances. So the more rows there are, the finer are the cells and the more of them are probed.
    """
    found, fallback = None, None
    for projections in PROJECTIONS:
        for width in WIDTHS:
            dirs, off = family(asked.shape[1], tables, projections, width, seed)
            hit = [np.full(len(y), PROBES) for y in near]
            met = np.zeros(PROBES + 1)
            for t in range(tables):
                into = lambda x: (x @ dirs[t] + off[t]) / width  # noqa: E731, B023
                of_rows = _code(np.floor(into(rows)).astype(np.int64))
                for i, f in enumerate(into(asked)):
                    codes = probed(f, PROBES)
                    order = np.argsort(codes, kind="stable")
                    place = lambda c: np.where(codes[order][k := np.minimum(np.searchsorted(codes[order], c), len(codes) - 1)] == c, order[k], PROBES)  # noqa: E731, B023
                    met += np.bincount(place(of_rows), minlength=PROBES + 1)
                    if len(near[i]):
                        hit[i] = np.minimum(hit[i], place(_code(np.floor(into(near[i])).astype(np.int64))))
            first = np.concatenate(hit)
            for probes in (2**i for i in range(PROBES.bit_length())):
                got = float((first < probes).mean()) if len(first) else 1.0
                share = met[:probes].sum() / (len(asked) * len(rows))
                cost = n_asked * share + 40 * tables * (1 + probes * n_asked / n)
                fallback = max(fallback or (-1.0,), (got, -cost, projections, width, probes))
                if got >= recall:
                    found = min(found or (np.inf,), (cost, projections, width, probes))
                    break
    return found[1:] if found else fallback[2:]


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 4, shape: tuple[int, float, int] | None = None, recall: float = 0.95, block: int = 2048, seed: int = 31) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query(id column) marks, its k nearest found by cosine among all other ids, nearest first, ties to the smaller id.

    Every row is indexed in every table, at unit length. A query probes buckets of each table and is ranked inside each bucket against all
    of it, in doubles on the original vectors; the best of all are merged. shape: projections, width and probes; without it they are fitted (fit_shape) on FIT_QUERIES queries, whose true neighbours
    among all rows are found by comparing them with all, and FIT_ROWS rows, both drawn by hash. A bucket of over `block` rows is dealt into blocks, each of which is
    searched. A query that fewer than k candidates were found for is searched against all rows, in blocks. Vectors that take no part
    (see valid_vectors) are neither queries nor candidates. Rows that repeat an id count once, with the least vector in byte order.
    """
    spark = vectors.sparkSession
    valid, dim, kind = valid_vectors(vectors, id_col, vec_col)
    valid = written(valid.groupBy("id").agg(F.min("v").alias("v")))
    queries = valid.where(is_query(F.col("id")))
    n, n_asked = valid.count(), queries.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        drawn = queries.orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES).collect()
        rows = valid.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()
        qi, qv = np.array([r["id"] for r in drawn]), matrix([r["v"] for r in drawn], kind)

        def compare(batches):
            for b in batches:
                if len(b):
                    yield _best(qi, qv, b["id"].to_numpy(), matrix(b["v"], kind), k).merge(b, left_on="vec_id", right_on="id")[["query_id", "vec_id", "score", "v"]]

        best = valid.mapInPandas(compare, "query_id long, vec_id long, score double, v binary")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).collect()  # FIT_QUERIES * k rows
        near = [unit(v, kind) if (v := [r["v"] for r in best if r["query_id"] == i]) else np.zeros((0, dim)) for i in qi]
        shape = fit_shape(unit([r["v"] for r in drawn], kind), near, unit([r["v"] for r in rows], kind), n, n_asked, tables, recall, seed)
    projections, width, probes = shape
    hashes = spark.sparkContext.broadcast(family(dim, tables, projections, width, seed))

    def index(batches):
        for b in batches:
            x, (dirs, off) = unit(b["v"], kind) if len(b) else np.zeros((0, dim)), hashes.value
            for t in range(tables):
                yield pd.DataFrame({"t": t, "cell": _code(np.floor((x @ dirs[t] + off[t]) / width).astype(np.int64)), "id": b["id"], "v": b["v"], "q": False})

    def ask(batches):
        for b in batches:
            x, (dirs, off) = unit(b["v"], kind) if len(b) else np.zeros((0, dim)), hashes.value
            for t in range(tables):
                cells = [probed(f, probes) for f in (x @ dirs[t] + off[t]) / width]
                if cells:
                    rows = np.repeat(np.arange(len(x)), [len(c) for c in cells])
                    yield pd.DataFrame({"t": t, "cell": np.concatenate(cells), "id": b["id"].to_numpy()[rows], "v": b["v"].to_numpy()[rows], "q": True})

    schema = "t int, cell long, id long, v binary, q boolean"
    indexed = valid.mapInPandas(index, schema)
    asked = queries.repartition("id").mapInPandas(ask, schema)
    sizes = written(indexed.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")).select("t", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    side = F.broadcast(sizes) if sizes.count() <= 200_000 else sizes
    x = indexed.join(side, ["t", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    q = asked.join(side, ["t", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["t", "cell", "block", "id", "v", "q"]
    hits = x.select(*cols).unionByName(q.select(*cols)).groupBy("t", "cell", "block").applyInPandas(_rank(k, kind), "query_id long, vec_id long, score double")
    hits = written(hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    found = hits.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    short = queries.join(found, "id", "left").where(F.coalesce("n", F.lit(0)) < min(k, n - 1)).select("id", "v")
    parts = max(1, -(-n // block))
    rest_q = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("q", F.lit(True))
    rest_x = valid.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("q", F.lit(False))
    if short.limit(1).count():
        more = rest_q.unionByName(rest_x).groupBy("block").applyInPandas(_rank(k, kind), "query_id long, vec_id long, score double")
        hits = hits.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all."""
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
