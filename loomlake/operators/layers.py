"""Layers of graph networks as joins, grouped sums and vector expressions.

features: (id, x array<double>); edges: (src, dst, dup[, weight]); nodes: (id). Every node of ``nodes`` comes
out, with zeros where it receives nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, inverse_degree, leaky_relu, literal, plus, product, relu, scaled, zeros
from ..sources.scratch import written

Matrix = Sequence[Sequence[float]]

#: Components up to which sums are a column each; generated code grows with them, so wider vectors are summed whole.
COLUMNS = 48
#: Weights up to which a product is an expression; larger ones are shipped to workers and multiplied batch by batch.
LITERALS = 512


def vector_sum(column: str, width: int, factor: Column | None = None) -> list[Column]:
    """One sum a component: partial sums run in generated code before the exchange, with no list of rows."""
    part = lambda i: F.col(column)[i] if factor is None else F.col(column)[i] * factor
    return [F.sum(part(i)).alias(f"__{i}") for i in range(width)]


def gathered(width: int) -> Column:
    return F.array(*(F.coalesce(F.col(f"__{i}"), F.lit(0.0)) for i in range(width)))


def summed(rows: DataFrame, key: str, column: str, width: int, extra: Sequence[Column] = ()) -> DataFrame:
    """(key, x, extra...): sums of the vectors of each key, null vectors left out, with partial sums before the exchange."""
    if width <= COLUMNS:
        sums = rows.groupBy(key).agg(*vector_sum(column, width), *extra)
        return sums.withColumn("x", gathered(width)).drop(*(f"__{i}" for i in range(width)))
    vector = array_to_vector(F.coalesce(F.col(column), zeros(width)))
    sums = rows.groupBy(key).agg(Summarizer.metrics("sum").summary(vector).alias("__s"), *extra)
    return sums.withColumn("x", vector_to_array("__s.sum")).drop("__s")


def spmm(edges: DataFrame, features: DataFrame, nodes: DataFrame, width: int, weight: str | None = None) -> DataFrame:
    """(id, x, degree): for each node the (weighted) sum of its in-neighbours' vectors and their number, in one
    aggregate. A source without a vector counts in the degree and adds nothing."""
    x = features.select(F.col("id").alias("src"), F.col("x").alias("__x"))
    joined = edges.join(x, "src", "left")
    if weight:
        joined = joined.withColumn("__x", scaled(F.col("__x"), F.col(weight)))
    sums = summed(joined.withColumnRenamed("dst", "id"), "id", "__x", width, [F.count("*").alias("degree")])
    out = nodes.select("id").join(sums, "id", "left")
    return out.select("id", F.coalesce("x", zeros(width)).alias("x"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def spmm_mean(edges: DataFrame, features: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, x, degree): mean of the in-neighbours' vectors."""
    s = spmm(edges, features, nodes, width)
    return s.withColumn("x", F.transform("x", lambda v: v / F.greatest(F.col("degree"), F.lit(1)).cast("double")))


def _products(weights: np.ndarray, bias: np.ndarray, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(column)
            x = batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, weights.shape[0])
            y = (x @ weights + bias).ravel()
            ends = pa.array(np.arange(batch.num_rows + 1) * weights.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.ListArray.from_arrays(ends, pa.array(y)), *batch.columns[k + 1 :]], batch.schema.names)

    return run


def linear(features: DataFrame, weights: Matrix, bias: Sequence[float] | None = None, literals: int = LITERALS) -> DataFrame:
    """(id, x W + b). Up to ``literals`` weights are an expression; more are one matrix product a batch, and the same up
    to the order of sums. No x may be null or of another width then."""
    rows, cols = len(weights), len(weights[0])
    if rows * cols <= literals:
        y = product(F.col("x"), weights)
        return features.withColumn("x", plus(y, literal(bias)) if bias is not None else y)
    w, b = np.array(weights, np.float64), np.zeros(cols) if bias is None else np.array(bias, np.float64)
    return features.mapInArrow(_products(w, b, "x"), features.schema)


def graph_conv(
    edges: DataFrame,
    features: DataFrame,
    nodes: DataFrame,
    weights: Matrix | None,
    bias: Sequence[float] | None = None,
    norm: str = "right",
    activation: Callable[[Column], Column] | None = None,
    weight: str | None = None,
    width: int | None = None,
) -> DataFrame:
    """Graph convolution: sum the neighbours, multiply, normalise, add the bias, activate.

    norm: none; right divides by the in-degree; left divides each source by its out-degree first; both uses
    the square roots of both. Degrees are those of ``edges``, at least 1. ``weight`` names a column of the edges that
    their messages are multiplied by. Without ``weights`` the sums stay as they are, of ``width`` components.
    """
    if norm not in ("none", "right", "left", "both"):
        raise ValueError(f"unknown norm {norm}")
    if weights is None and width is None:
        raise ValueError("a layer without weights needs a width")
    width = len(weights) if weights is not None else width
    if norm in ("left", "both"):
        outs = edges.groupBy("src").agg(F.count("*").alias("__n")).withColumnRenamed("src", "id")
        factor = inverse_degree(F.col("__n"), 1.0 if norm == "left" else 0.5)
        features = features.join(outs, "id", "left").select("id", scaled(F.col("x"), factor).alias("x"))
    s = spmm(edges, features, nodes, width, weight)
    if weights is not None:
        s = linear(s, weights)
    x = F.col("x")
    if norm == "right":
        x = F.transform(x, lambda v: v / F.greatest(F.col("degree"), F.lit(1)).cast("double"))
    elif norm == "both":
        x = scaled(x, inverse_degree(F.col("degree"), 0.5))
    if bias is not None:
        x = plus(x, literal(bias))
    if activation:
        x = F.transform(x, activation)
    return s.select("id", x.alias("x"))


def heads_of(z: Column, heads: int, size: int) -> list[Column]:
    return [F.slice(z, h * size + 1, size) for h in range(heads)]


def gat_nodes(features: DataFrame, weights: Matrix, left: Matrix, right: Matrix) -> DataFrame:
    """(id, z, el, er): projected vectors and both halves of the attention logits, a number for each head."""
    heads, size = len(left), len(left[0])
    z = linear(features.select("id", "x"), weights).withColumnRenamed("x", "z")
    logits = lambda a: F.array(*(dot(s, literal(v)) for s, v in zip(heads_of(F.col("z"), heads, size), a, strict=True)))
    return z.withColumns({"el": logits(left), "er": logits(right)})


def edge_logits(edges: DataFrame, nodes: DataFrame, heads: int, slope: float = 0.2) -> DataFrame:
    """Edges with e: the leaky sum of both ends' halves, by head. Only 2 * heads numbers a node move."""
    a = nodes.select(F.col("id").alias("src"), "el")
    b = nodes.select(F.col("id").alias("dst"), "er")
    e = F.zip_with("el", "er", lambda x, y: leaky_relu(x + y, slope))
    return edges.join(a, "src").join(b, "dst").withColumn("e", e).drop("el", "er")


def softmax_bounds(edges: DataFrame, nodes: DataFrame, heads: int, slope: float = 0.2) -> DataFrame:
    """(dst, er, top): the largest logit into each target. The logit grows with the source's half, so the largest
    half decides: one partial aggregate, no window over a target's edges."""
    a = nodes.select(F.col("id").alias("src"), "el")
    most = edges.join(a, "src").groupBy("dst").agg(*(F.max(F.col("el")[h]).alias(f"__{h}") for h in range(heads)))
    b = nodes.select(F.col("id").alias("dst"), "er")
    top = F.array(*(leaky_relu(F.col(f"__{h}") + F.col("er")[h], slope) for h in range(heads)))
    return most.join(b, "dst").select("dst", "er", top.alias("top"))


def edge_softmax(edges: DataFrame, nodes: DataFrame, heads: int, slope: float = 0.2) -> DataFrame:
    """Edges with a: exp(e - max) over its sum among the target's in-edges, by head."""
    bounds = softmax_bounds(edges, nodes, heads, slope)
    p = edge_powers(edges, nodes, bounds, slope)
    total = p.groupBy("dst").agg(*(F.sum(F.col("p")[h]).alias(f"__{h}") for h in range(heads)))
    total = total.select("dst", F.array(*(F.col(f"__{h}") for h in range(heads))).alias("total"))
    return p.join(total, "dst").withColumn("a", F.zip_with("p", "total", lambda x, t: x / t)).drop("p", "total")


def edge_powers(edges: DataFrame, nodes: DataFrame, bounds: DataFrame, slope: float) -> DataFrame:
    a = nodes.select(F.col("id").alias("src"), "el")
    e = F.zip_with("el", "er", lambda x, y: leaky_relu(x + y, slope))
    p = F.zip_with(e, F.col("top"), lambda x, t: F.exp(x - t))
    return edges.join(a, "src").join(bounds, "dst").withColumn("p", p).drop("el", "er", "top")


def gat_conv(
    edges: DataFrame,
    features: DataFrame,
    nodes: DataFrame,
    weights: Matrix,
    left: Matrix,
    right: Matrix,
    slope: float = 0.2,
    residual: Matrix | None = None,
    activation: Callable[[Column], Column] | None = None,
    head_mean: bool = False,
) -> DataFrame:
    """Graph attention: (id, x) with the heads one after the other, or their mean.

    Numerators and denominators of the softmax are summed together, so coefficients never become rows. A
    node without in-edges gets zeros (plus the residual of its own input). The projected vectors are written once.
    """
    heads, size = len(left), len(left[0])
    width = heads * size
    z = written(gat_nodes(features, weights, left, right))  # once, for its three readers
    bounds = softmax_bounds(edges, z, heads, slope)
    e = F.zip_with("el", "er", lambda x, y: leaky_relu(x + y, slope))
    p = F.zip_with(e, F.col("top"), lambda x, t: F.exp(x - t))
    rows = edges.join(z.select(F.col("id").alias("src"), "el", "z"), "src").join(bounds, "dst").withColumn("p", p)
    parts = [scaled(z, F.col("p")[h]) for h, z in enumerate(heads_of(F.col("z"), heads, size))]
    rows = rows.select(F.col("dst").alias("id"), "p", F.concat(*parts).alias("v"))
    sums = summed(rows, "id", "v", width, [F.sum(F.col("p")[h]).alias(f"__s{h}") for h in range(heads)])
    totals = F.array(*(F.col(f"__s{h}") for h in range(heads)))
    x = F.transform("x", lambda v, i: v / F.get(totals, F.floor(i / size).cast("int")))
    out = nodes.select("id").join(sums, "id", "left").select("id", F.coalesce(x, zeros(width)).alias("x"))
    if residual is not None:
        own = linear(features, residual).withColumnRenamed("x", "__r")
        out = out.join(own, "id", "left").select("id", plus(F.col("x"), F.coalesce("__r", zeros(width))).alias("x"))
    x = F.col("x")
    if activation:
        x = F.transform(x, activation)
    if head_mean:
        x = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: sum((F.element_at("x", d + h * size + 1) for h in range(heads)), F.lit(0.0)) / heads)
    return out.select("id", x.alias("x"))


def sage_mean(
    edges: DataFrame,
    features: DataFrame,
    nodes: DataFrame,
    self_weights: Matrix,
    weights: Matrix,
    bias: Sequence[float] | None = None,
    activation: Callable[[Column], Column] | None = None,
    multiply_first: bool | None = None,
) -> DataFrame:
    """x_self W_self + mean(x_neighbours) W + b. Where the output is narrower than the input the product comes
    first, so narrower vectors cross the exchange; both orders give the same result."""
    width, out_width = len(weights), len(weights[0])
    first = width > out_width if multiply_first is None else multiply_first
    if first:
        mean = spmm_mean(edges, linear(features, weights), nodes, out_width)
    else:
        mean = linear(spmm_mean(edges, features, nodes, width), weights)
    own = linear(features, self_weights).withColumnRenamed("x", "__own")
    x = plus(F.col("x"), F.coalesce("__own", zeros(out_width)))
    if bias is not None:
        x = plus(x, literal(bias))
    if activation:
        x = F.transform(x, activation)
    return mean.join(own, "id", "left").select("id", x.alias("x"))


def sage_pool(
    edges: DataFrame, features: DataFrame, nodes: DataFrame, pool_weights: Matrix, pool_bias: Sequence[float], self_weights: Matrix, weights: Matrix
) -> DataFrame:
    """x_self W_self + max over neighbours of relu(x W_pool + b_pool) W; the largest is taken by component, and a
    node without in-edges pools zeros."""
    width = len(pool_weights[0])
    pooled = linear(features, pool_weights, pool_bias).select(F.col("id").alias("src"), F.transform("x", lambda v: relu(v)).alias("x"))
    most = edges.join(pooled, "src").groupBy("dst").agg(*(F.max(F.col("x")[i]).alias(f"__{i}") for i in range(width)))
    out = nodes.select("id").join(most.withColumnRenamed("dst", "id"), "id", "left").select("id", gathered(width).alias("x"))
    own = linear(features, self_weights).withColumnRenamed("x", "__own")
    x = plus(F.col("x"), F.coalesce("__own", zeros(len(weights[0]))))
    return linear(out, weights).join(own, "id", "left").select("id", x.alias("x"))


def sage_gcn(edges: DataFrame, features: DataFrame, nodes: DataFrame, weights: Matrix, bias: Sequence[float] | None = None) -> DataFrame:
    """(x_self + sum of the neighbours) / (degree + 1) W + b: the node counts as one of its neighbours."""
    width = len(weights)
    own = features.select("id", F.col("x").alias("__own"))
    s = spmm(edges, features, nodes, width).join(own, "id", "left")
    x = F.transform(plus(F.col("x"), F.coalesce("__own", zeros(width))), lambda v: v / (F.col("degree") + 1))
    return linear(s.select("id", x.alias("x")), weights, bias)
