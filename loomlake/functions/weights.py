"""Weights of layers: initialisers, and loading and saving as a table (name, k, m, w)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights that a model may have altogether: they are held in the driver and shipped to workers.
MOST = 50_000_000


def xavier_uniform(rows: int, cols: int, seed: int = 0) -> list[list[float]]:
    """Uniform in +-sqrt(6 / (rows + cols)), the same for a seed."""
    bound = math.sqrt(6 / (rows + cols))
    return np.random.default_rng([seed, rows, cols]).uniform(-bound, bound, (rows, cols)).tolist()


def zeros_bias(cols: int) -> list[float]:
    return [0.0] * cols


@dataclass
class Linear:
    """Weights (in x out) and bias of a dense layer."""

    weights: list[list[float]]
    bias: list[float] | None = None

    @classmethod
    def of(cls, weight, bias=None) -> Linear:
        """From the arrays of an existing dense layer, whose weight is out x in."""
        return cls(np.asarray(weight, np.float64).T.tolist(), None if bias is None else np.asarray(bias, np.float64).tolist())


def save(spark: SparkSession, named: dict[str, list], path: str) -> None:
    """Matrices and vectors by name, as rows (name, rows, k, m, w); a vector has no rows."""
    rows = []
    for name, values in named.items():
        a = np.asarray(values, np.float64)
        flat = a.reshape(1, -1) if a.ndim == 1 else a
        rows += [(name, 0 if a.ndim == 1 else len(a), int(k), int(m), float(flat[k, m])) for k in range(flat.shape[0]) for m in range(flat.shape[1])]
    spark.createDataFrame(rows, "name string, rows int, k int, m int, w double").coalesce(1).write.mode("overwrite").parquet(path)


def load(table: DataFrame) -> dict[str, list]:
    """What ``save`` wrote; its size is checked before it comes to the driver."""
    n = table.count()
    if n > MOST:
        raise ValueError(f"{n} weights; at most {MOST} are held in the driver")
    out: dict[str, list] = {}
    for name, rows, ws in table.groupBy("name").agg(F.max("rows"), F.array_sort(F.collect_list(F.struct("k", "m", "w")))).collect():
        cols = max(x.m for x in ws) + 1
        a = np.array([x.w for x in ws]).reshape(-1, cols)
        out[name] = a.tolist() if rows else a[0].tolist()
    return out
