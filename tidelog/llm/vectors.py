"""Reading of vector columns, shared by the two vector operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, str]:
    """((id, v), dimension, kind): rows with an id whose vector takes part, v its components in bytes: floats (kind <f4) where the column has floats, else doubles (<f8).

    Left out are null vectors, those of zeros only, those with null or non-finite components, and those not of the commonest length (at a tie the greater).
    """
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    x = F.col(vec_col) if kind == "<f4" else F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim = int(top[0]["d"]) if top else 0

    def to_bytes(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "v": [np.asarray(v, dtype=kind).tobytes() for v in b["x"]]})

    return rows.where(F.size("x") == dim).mapInPandas(to_bytes, "id long, v binary"), dim, kind


def matrix(column, kind: str) -> np.ndarray:
    """The rows of a v column as doubles, each scaled by a power of two so that no square overflows or vanishes: digits, and so cosines, stay as they are."""
    x = np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(column, kind: str) -> np.ndarray:
    """The rows of a v column at length 1."""
    x = matrix(column, kind)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of rows i and j of x, pair by pair, as dot product over the product of lengths, each sum rounded once."""
    length = {int(r): math.sqrt(math.fsum(x[r] * x[r])) for r in np.unique(np.concatenate([i, j]))}
    return np.array([math.fsum(x[a] * x[b]) / (length[a] * length[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, alike in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))
