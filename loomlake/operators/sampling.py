"""Neighbour sampling, one independent draw a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partition import SEED


def numbered(edges: DataFrame) -> DataFrame:
    """(src, dst, dup): copies of an edge in the bag are numbered from 0, so each is a draw of its own."""
    return edges.select("src", "dst", F.expr("cast(row_number() over (partition by src, dst order by src) - 1 as int)").alias("dup"))


def sample_in_edges(edges: DataFrame, fanout: int, layer: int = 0, seed: int = SEED) -> DataFrame:
    """At most ``fanout`` in-edges of each target, drawn without replacement by the order of
    md5(seed|layer|src|dst|dup); all of them if there are fewer or fanout is negative.

    The rank limit is pushed below the exchange (a window group limit), so a hot target sends at most
    ``fanout`` rows from each task.
    """
    if fanout < 0:
        return edges
    text = [F.lit(str(seed)), F.lit(str(layer)), *(F.col(c).cast("string") for c in ("src", "dst", "dup"))]
    keyed = edges.withColumn("h", F.md5(F.concat_ws("|", *text)))
    rank = F.expr("row_number() over (partition by dst order by h, src, dup)")
    return keyed.withColumn("rank", rank).where(F.col("rank") <= fanout).drop("h", "rank")
