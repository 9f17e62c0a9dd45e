"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators (Wang & Manning, 2012), fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, written

#: Hashed features: BYTES for runs of raw bytes, as many for runs of byte classes, SHAPES for counts of repeated words.
BYTES, SHAPES = 1 << 16, 64
DIM = 2 * BYTES + SHAPES
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Byte to class: lower and non-ASCII letters as a, capitals as A, digits as 0, all else itself."""
    out = np.arange(256, dtype=np.uint64)
    out[[*range(97, 123), *range(128, 256)]] = 97
    out[65:91] = 65
    out[48:58] = 48
    return out


_CLASS = _classes()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _slots(x: np.ndarray, n: int) -> np.ndarray:
    """The hash slot of each run of n symbols."""
    if len(x) < n:
        return np.zeros(0, dtype=np.int64)
    code = x[: len(x) - n + 1].astype(np.uint64)
    for k in range(1, n):
        code = code << np.uint64(8) | x[k : len(x) - n + 1 + k].astype(np.uint64)
    return ((code + np.uint64(n) * np.uint64(1 << 40)) * _MIX >> np.uint64(48)).astype(np.int64)


def _repeats(raw: np.ndarray) -> int:
    """Which of SHAPES grades of the share of words equal to the word before; 0 where there are none."""
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(start) < 2:
        return 0
    with np.errstate(over="ignore"):
        weight = np.where(space, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * (_MIX | np.uint64(1)))
        place = np.arange(len(raw), dtype=np.int64) - np.repeat(start, np.diff(np.append(start, len(raw)))) if start[0] == 0 else np.arange(len(raw), dtype=np.int64) - start[np.maximum(np.searchsorted(start, np.arange(len(raw)), side="right") - 1, 0)]
        h = np.add.reduceat(weight * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) ** np.uint64(3), start)
    same = float(np.mean(h[1:] == h[:-1]))
    return min(SHAPES - 1, int(np.ceil(same * (SHAPES - 1))))


def indicators(text: str | None) -> np.ndarray:
    """The distinct feature ids of a whole text: byte 3-grams, class 4-grams and class 2-grams, and its grade of repeated words. Null is as empty."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    cls = _CLASS[raw]
    ids = np.concatenate([_slots(raw, 3), BYTES + _slots(cls, 4), BYTES + _slots(cls, 2)])
    seen = _scratch()
    order = np.arange(len(ids), dtype=np.int64)
    seen[ids] = order
    ids = ids[seen[ids] == order]
    return np.append(ids, 2 * BYTES + _repeats(raw))


_SEEN: list[np.ndarray] = []


def _scratch() -> np.ndarray:
    """A work array over all features, kept per process."""
    if not _SEEN:
        _SEEN.append(np.zeros(DIM, dtype=np.int64))
    return _SEEN[0]


_CHUNK = 4096


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the partition's labelled texts, in how many of either label each feature occurs, in chunks of _CHUNK features."""
    counts, rows = np.zeros((2, -(-DIM // _CHUNK) * _CHUNK), dtype=np.int64), 0
    for b in batches:
        for text, y in zip(b["text"], b["label"], strict=True):
            counts[int(y), indicators(text)] += 1
            rows += 1
    if rows:
        c = counts.reshape(2, -1, _CHUNK)
        yield pd.DataFrame({"chunk": range(c.shape[1]), "neg": [x.tobytes() for x in c[0]], "pos": [x.tobytes() for x in c[1]]})


def _sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = [np.sum([np.frombuffer(x, dtype=np.int64) for x in pdf[k]], axis=0).tobytes() for k in ("neg", "pos")]
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "neg": [total[0]], "pos": [total[1]]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"label": b["label"], "ids": [np.sort(indicators(t)).astype(np.int32).tobytes() for t in b["text"]]})


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 20, seed: int = 5) -> np.ndarray:
    """Weights of the linear hinge-loss SVM with box `cost` per row, by dual coordinate descent (Hsieh et al., 2008). The last weight is the bias."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[dim]) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]
                w[dim] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a m + b))), fitted by Newton steps on Platt's smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        e, v = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([e @ margin, e.sum()])
        h = np.array([[v @ (margin * margin) + 1e-6, v @ margin], [v @ margin, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def drawn_rows(labelled: DataFrame, sample: int, most_bytes: int) -> DataFrame:
    """(text, label): at most sample / 2 different rows of each label, those with the least hashes of id and text, as far as their features keep to most_bytes in all; one of each label at least.

    The draw is by row, so copies of one text under many ids count as any other rows; rows equal in id and text are one.
    """
    hashed = labelled.select("text", "label", F.xxhash64("id", "text", F.lit(3)).alias("h"))
    size = F.lit(4) * F.least(F.octet_length("text") * 3 + 1, F.lit(DIM)).cast("long")
    kinds = written(hashed.groupBy("label", "h").agg(F.min(size).alias("size")))
    bounds = []
    for y in (0, 1):
        top = kinds.where(F.col("label") == y).orderBy("h").limit(max(1, sample // 2)).select("h", "size").collect()  # sample / 2 pairs of numbers
        within = np.cumsum([r["size"] for r in top]) <= most_bytes // 2
        if top:
            bounds.append((F.col("label") == y) & (F.col("h") <= top[max(0, int(within.sum()) - 1)]["h"]))
    return hashed.where(reduce(lambda a, b: a | b, bounds, F.lit(False))).dropDuplicates(["label", "h"]).select("text", "label")


def fit(labelled: DataFrame, sample: int = 6000, most_bytes: int = 400_000_000, smooth: float = 1.0, blend: float = 0.25, cost: float = 1.0) -> dict:
    """A model from (id, text, label 0/1) rows.

    Log-count ratios are taken over every labelled row; the support vectors from the rows of drawn_rows: `sample` and `most_bytes` are the documented bounds of the training set,
    whatever the size of the table. With labels of one kind only, or none, the model is the constant share of ones (1 without any).
    """
    sizes = {int(r["label"]): int(r["n"]) for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, ones = sum(sizes.values()), sizes.get(1, 0)
    if not n or ones in (0, n):
        return {"constant": 1.0 if not n else (ones + 1) / (n + 2)}
    part = labelled.select("text", "label").mapInPandas(_partial_counts, "chunk int, neg binary, pos binary")
    chunks = part.groupBy("chunk").applyInPandas(_sum_counts, "chunk int, neg binary, pos binary").orderBy("chunk").collect()  # one row for each _CHUNK features
    neg, pos = (np.concatenate([np.frombuffer(r[k], dtype=np.int64) for r in chunks])[:DIM] + smooth for k in ("neg", "pos"))
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    drawn = drawn_rows(labelled, sample, most_bytes).mapInPandas(_packed, "label int, ids binary").collect()  # bounded by sample and most_bytes
    drawn = sorted((r["label"], bytes(r["ids"])) for r in drawn)
    y = np.array([1.0 if a else -1.0 for a, _ in drawn])
    rows = [np.frombuffer(b, dtype=np.int32) for _, b in drawn]
    values = [ratio[r] / np.sqrt(len(r)) for r in rows]
    box = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    w = dual_descent(rows, values, y, box, DIM)
    w[:DIM] = (1 - blend) * np.abs(w[:DIM]).mean() + blend * w[:DIM]
    coef = (w[:DIM] * ratio).astype(np.float64)
    raw = np.array([coef[r].sum() / np.sqrt(len(r)) for r in rows])
    scale = raw.std() or 1.0
    a, b = _calibrate(raw / scale, y)
    return {"coef": coef, "a": a / scale, "b": b}


def score_texts(model: dict, texts) -> np.ndarray:
    """Scores in 0..1 of whole texts."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        ids = indicators(t)
        out[i] = model["a"] * model["coef"][ids].sum() / np.sqrt(len(ids)) + model["b"]
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def score(docs: DataFrame, model: dict, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a double column `into`. The model, DIM doubles, is broadcast. Null and empty texts are scored too; every row is kept once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(shared.value, texts))

    return docs.withColumn(into, of(F.col(text_col)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, text, label) of labelled documents outside the held-out fold (crc32 of the id as text, mod 4, is 2). Conflicting labels of an id count as 0; null ids and labels are left out.

    The labels' ids are broadcast only up to broadcast_rows of them, counted here; beyond that both sides are shuffled.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) > 0).cast("int").alias("label"))
    known = F.broadcast(known) if labels.count() <= broadcast_rows else known
    return docs.select(F.col(id_col).alias("_id"), "text").join(known, "_id").select(F.col("_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "label")


def held_out(doc_id):
    """Whether a document is in the fold that no label is learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fitted(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of the registered query and of the pipeline."""
    return fit(training_rows(docs, labels))


def op5_quality(spark: SparkSession, sf_dir: str, least: float = 0.7) -> DataFrame:
    """Per document: held_out, score and predicted (score of at least 0.7)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
