"""Batches of sampled edges, hop by hop, with what each batch needs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import schedule as H
from ..operators.partition import SEED, require_rows
from ..operators.sampling import sample_in_edges
from ..sources.scratch import dropped, written


class BatchLoader:
    """One independent sample a hop, dealt to batches by a schedule (base, src, ring or pair).

    ``hop(i)`` is all of a hop as one table (layer, dst_part, [round,] batch_id, src, dst, dup, ...); iterating gives the
    hops in order, and drops a hop's table when the next one is asked for.
    """

    def __init__(self, edges: DataFrame, placed: DataFrame, fanouts: list[int], size: int, parts: int, scheduler: str = "src", seed: int = SEED):
        if scheduler not in H.SCHEDULES:
            raise ValueError(f"unknown scheduler {scheduler}; there are {sorted(H.SCHEDULES)}")
        self.edges, self.placed, self.fanouts, self.size, self.parts, self.scheduler, self.seed = edges, placed, fanouts, size, parts, scheduler, seed

    def hop(self, i: int) -> DataFrame:
        sampled = sample_in_edges(self.edges, self.fanouts[i], i, self.seed)
        return H.SCHEDULES[self.scheduler](sampled, self.size, self.parts).withColumn("layer", F.lit(i))

    def __iter__(self) -> Iterator[DataFrame]:
        for i in range(len(self.fanouts)):
            now = require_rows(written(self.hop(i)), f"sampled edges of hop {i}")
            yield now
            dropped(now)

    def graphs(self, hop: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of every batch of a hop, numbered within the batch."""
        nodes = H.batch_nodes(hop, self.placed)
        return nodes, H.batch_edges(hop, nodes)
