"""Stacks of layers, each on its own neighbour sample, with the layer's output written between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import weights as W
from ..functions.vectors import elu, relu
from ..operators.layers import Matrix, gat_conv, graph_conv, sage_mean
from ..operators.partition import require_rows
from ..operators.sampling import sample_in_edges
from ..sources.scratch import dropped, written


def widths(layers: int, inputs: int, hidden: int, outputs: int) -> list[tuple[int, int]]:
    """(in, out) of each layer: inputs, hidden between, outputs."""
    ends = [inputs] + [hidden] * (layers - 1) + [outputs]
    return list(zip(ends, ends[1:], strict=False))


@dataclass
class GraphData:
    edges: DataFrame
    nodes: DataFrame
    features: DataFrame


@dataclass
class Layer:
    weights: Matrix | None
    bias: list[float] | None = None
    left: Matrix | None = None
    right: Matrix | None = None
    own: Matrix | None = None
    width: int | None = None

    def named(self, i: int) -> dict[str, list]:
        return {f"{i}.{k}": v for k in NAMES if (v := getattr(self, k)) is not None}


NAMES = ("weights", "bias", "left", "right", "own")


class Model:
    """A layer's ``apply`` sees the whole graph's sample; ``infer`` walks the layers over all nodes."""

    def __init__(self, layers: list[Layer], fanout: int = 50, seed: int = 42):
        self.layers, self.fanout, self.seed = layers, fanout, seed

    def save(self, spark: SparkSession, path: str) -> None:
        """The weights of all layers as a table."""
        W.save(spark, {k: v for i, layer in enumerate(self.layers) for k, v in layer.named(i).items()}, path)

    def load(self, spark: SparkSession, path: str) -> None:
        """The weights of ``save`` in place of the model's own."""
        found = W.load(spark.read.parquet(path))
        for i, layer in enumerate(self.layers):
            for k in NAMES:
                setattr(layer, k, found.get(f"{i}.{k}"))

    def apply(self, i: int, edges: DataFrame, x: DataFrame, nodes: DataFrame) -> DataFrame:
        raise NotImplementedError

    def infer(self, graph: GraphData) -> DataFrame:
        """(id, x) of every node after the last layer. What a layer alone has read goes when its output is written."""
        edges, nodes, x = written(graph.edges), written(graph.nodes), graph.features
        require_rows(nodes, "nodes"), require_rows(edges, "edges")
        for i in range(len(self.layers)):
            sampled = sample_in_edges(edges, self.fanout, i, self.seed)
            if self.fanout >= 0:
                sampled = written(sampled)
            out = self.apply(i, sampled, x, nodes)
            if i < len(self.layers) - 1:
                out = written(out)
                if self.fanout >= 0:
                    dropped(sampled)
                if i:
                    dropped(x)
            x = out
        return x


class GCN(Model):
    """Graph convolutions, all activated, the last one too."""

    def __init__(self, layers: list[Layer], fanout: int = 50, seed: int = 42, norm: str = "right", activation: Callable[[Column], Column] | None = relu):
        super().__init__(layers, fanout, seed)
        self.norm, self.activation = norm, activation

    def apply(self, i, edges, x, nodes):
        layer = self.layers[i]
        return graph_conv(edges, x, nodes, layer.weights, layer.bias, self.norm, self.activation, width=layer.width)

    @classmethod
    def build(cls, layers: int, inputs: int, hidden: int, outputs: int, norm: str = "both", weight: bool = True, bias: bool = True, seed: int = 0, **more) -> GCN:
        """Layers of the usual widths with uniform weights and no bias at first. Without weights a layer keeps its width,
        so all widths must be equal."""
        dims = widths(layers, inputs, hidden, outputs)
        if not weight and len({w for d in dims for w in d}) > 1:
            raise ValueError("layers without weights cannot change the width")
        made = [Layer(W.xavier_uniform(a, b, seed + i) if weight else None, W.zeros_bias(b) if bias else None, width=a) for i, (a, b) in enumerate(dims)]
        return cls(made, norm=norm, **more)


class GAT(Model):
    """Graph attention: heads side by side and elu between layers, their mean without activation at the end."""

    def apply(self, i, edges, x, nodes):
        layer, last = self.layers[i], i == len(self.layers) - 1
        return gat_conv(edges, x, nodes, layer.weights, layer.left, layer.right, activation=None if last else elu, head_mean=last)


    @classmethod
    def build(cls, layers: int, inputs: int, hidden: int, outputs: int, heads: list[int], seed: int = 0, **more) -> GAT:
        """Hidden layers share ``hidden`` components among their heads; each head of the last has ``outputs``."""
        made = []
        for i, (a, b) in enumerate(widths(layers, inputs, hidden, outputs)):
            if i < layers - 1 and b % heads[i]:
                raise ValueError(f"{heads[i]} heads cannot share {b} components")
            size = b // heads[i] if i < layers - 1 else b
            left, right = (W.xavier_uniform(heads[i], size, seed + 100 * k + i) for k in (1, 2))
            made.append(Layer(W.xavier_uniform(a, heads[i] * size, seed + i), None, left, right))
        return cls(made, **more)


class SAGE(Model):
    """Mean aggregation with a product of its own for the node itself; relu between layers."""

    def apply(self, i, edges, x, nodes):
        layer, last = self.layers[i], i == len(self.layers) - 1
        return sage_mean(edges, x, nodes, layer.own, layer.weights, layer.bias, None if last else relu)

    @classmethod
    def build(cls, layers: int, inputs: int, hidden: int, outputs: int, seed: int = 0, **more) -> SAGE:
        made = [Layer(W.xavier_uniform(a, b, seed + i), W.zeros_bias(b), own=W.xavier_uniform(a, b, seed + 100 + i)) for i, (a, b) in enumerate(widths(layers, inputs, hidden, outputs))]
        return cls(made, **more)
