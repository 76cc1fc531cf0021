"""Batch and round assignments of edges. Layers do not depend on them; loaders and diagnostics do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered_in_order

BASE, BY_SOURCE = ["dst", "src", "dup"], ["src", "dst", "dup"]


def split_of(position: Column, n: Column, parts: Column) -> Column:
    """Number of the near-equal contiguous piece (the first n % parts are one larger) that holds a position."""
    q, r = F.floor(n / parts), n % parts
    low, high = F.floor(position / (q + 1)), r + F.floor((position - r * (q + 1)) / F.greatest(q, F.lit(1)))
    return F.when(position < r * (q + 1), low).otherwise(high).cast("long")


def batch_counts(edges: DataFrame, size: int, groups: list[str], shared: list[str] | None = None) -> DataFrame:
    """(groups..., edges, batches): ``ceil(edges / size)`` batches for each group. With ``shared`` every group has as many
    as the smallest of those that agree in these columns (of all, if it is empty), so that parts keep step."""
    n = edges.groupBy(*groups).agg(F.count("*").alias("edges"), F.ceil(F.count("*") / F.lit(size)).cast("long").alias("batches"))
    if shared is None:
        return n
    return n.withColumn("batches", F.expr(f"min(batches) over ({'partition by ' + ', '.join(shared) if shared else ''})"))  # one row a group


def batches(edges: DataFrame, size: int, part_col: str = "dst_part", order: list[str] | None = None, groups: list[str] | None = None, shared: list[str] | None = None) -> DataFrame:
    """Edges with batch_id: near-equal contiguous batches of each part (or of each of ``groups``) in the order of
    ``order``; ``shared`` as in ``batch_counts``."""
    groups = groups or [part_col]
    n = batch_counts(edges, size, groups, shared)
    placed = numbered_in_order(edges, order or BASE, groups, "__p").join(F.broadcast(n), groups)  # one row a group
    return placed.withColumn("batch_id", split_of(F.col("__p"), F.col("edges"), F.col("batches"))).drop("__p", "edges", "batches")


def by_source(edges: DataFrame, size: int, shared: list[str] | None = None) -> DataFrame:
    """Batches over edges sorted by source, so that a batch fetches few distinct sources."""
    return batches(edges, size, order=BY_SOURCE, shared=shared)


def in_step(edges: DataFrame, size: int, sort_by_source: bool = False) -> DataFrame:
    """Batches of every part in step: each part has as many as the one with the fewest, so batches may be larger."""
    return batches(edges, size, order=BY_SOURCE if sort_by_source else BASE, shared=[])


def ring_round(edges: DataFrame, parts: int) -> DataFrame:
    """Round of each edge: parts talk to their b-th predecessor in round b, to themselves in the last."""
    return edges.withColumn("round", F.pmod(F.col("dst_part") - F.col("src_part") - 1, F.lit(parts)).cast("int"))


def pair_round(edges: DataFrame, parts: int) -> DataFrame:
    """Round of each edge in a tournament of disjoint pairs (4, 8 or 16 parts); own edges come last."""
    if parts not in (4, 8, 16):
        raise ValueError("pairing works for 4, 8 or 16 parts")
    met = F.col("dst_part").bitwiseXOR(F.col("src_part"))
    return edges.withColumn("round", F.when(met == 0, parts - 1).otherwise(met - 1).cast("int"))


def round_batches(rounds: DataFrame, size: int) -> DataFrame:
    """Edges with a round also get batch_id: source-sorted batches within a part's round. All parts have as many in a
    round as the one with the fewest."""
    return batches(rounds, size, order=BY_SOURCE, groups=["dst_part", "round"], shared=["round"])


SCHEDULES = {
    "base": lambda edges, size, parts: in_step(edges, size),
    "src": lambda edges, size, parts: in_step(edges, size, sort_by_source=True),
    "ring": lambda edges, size, parts: round_batches(ring_round(edges, parts), size),
    "pair": lambda edges, size, parts: round_batches(pair_round(edges, parts), size),
}


def halo_per_batch(batched: DataFrame) -> DataFrame:
    """(dst_part, batch_id, nodes): distinct remote sources of each batch, its communication volume."""
    remote = batched.where("src_part <> dst_part")
    return remote.groupBy("dst_part", "batch_id").agg(F.count_distinct("src").alias("nodes"))


def batch_key(batched: DataFrame) -> list[str]:
    return [c for c in ("layer", "dst_part", "round", "batch_id") if c in batched.columns]


def batch_nodes(batched: DataFrame, placed: DataFrame) -> DataFrame:
    """(batch..., local, id, gid, part_id, inner_node): the distinct ends of each batch's edges, numbered in order of id.

    A batch is bounded by its size, so its nodes are ranked in one task.
    """
    key = batch_key(batched)
    nodes = batched.select(*key, F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = nodes.join(placed.select("id", "gid", "part_id"), "id")
    local = F.expr(f"row_number() over (partition by {', '.join(key)} order by id) - 1")
    return nodes.select(*key, local.alias("local"), "id", "gid", "part_id", (F.col("part_id") == F.col("dst_part")).alias("inner_node"))


def batch_edges(batched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the batches with both ends' local numbers (src_local, dst_local)."""
    key = batch_key(batched)
    end = lambda name: nodes.select(*key, F.col("id").alias(name), F.col("local").alias(f"{name}_local"))
    return batched.join(end("src"), [*key, "src"]).join(end("dst"), [*key, "dst"])


def batch_features(batched: DataFrame, features: DataFrame) -> DataFrame:
    """(batch..., id, x): the vectors that each batch's part must fetch from others, each once a batch."""
    key = batch_key(batched)
    remote = batched.where("src_part <> dst_part").select(*key, F.col("src").alias("id")).distinct()
    return remote.join(features, "id").select(*key, "id", "x")
