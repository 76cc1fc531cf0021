"""Graph generation: placed nodes, and the edges of each part laid out by owner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graph_files import read_edges_with_ids
from ..sources.scratch import written
from . import partition as P

#: Pieces that a part's edges are laid out in at least, so that no part is one task.
PIECES = 8


@dataclass
class Graph:
    """nodes: (id, gid, part_id). edges: (owner, eid, src, dst, src_gid, dst_gid, src_part, dst_part), laid out by owner.
    local_nodes: (owner, id, gid, part_id, inner_node), what a part knows. isolated: (id) of nodes without edges."""

    nodes: DataFrame
    edges: DataFrame
    local_nodes: DataFrame
    isolated: DataFrame

    def of(self, part: int) -> tuple[DataFrame, DataFrame]:
        """(local nodes, edges) of one part; the others' edge files are not read."""
        return self.local_nodes.where(F.col("owner") == part), self.edges.where(F.col("owner") == part)


#: A partition strategy: (session, placed nodes, whether a part also keeps the edges that leave it) -> edges by owner.
Partitioner = Callable[[SparkSession, DataFrame, bool], DataFrame]


def edges_by_owner(edges: DataFrame, placed: DataFrame, include_out_edge: bool = False) -> DataFrame:
    """Edges with ``owner``: the part of the target, and, with ``include_out_edge``, that of the source as well (an edge
    within a part has one owner). Ends that are no nodes drop the edge."""
    a = placed.select(F.col("id").alias("src"), F.col("gid").alias("src_gid"), F.col("part_id").alias("src_part"))
    b = placed.select(F.col("id").alias("dst"), F.col("gid").alias("dst_gid"), F.col("part_id").alias("dst_part"))
    both = edges.join(a, "src").join(b, "dst")
    if not include_out_edge:
        return both.withColumn("owner", F.col("dst_part"))
    return both.withColumn("owner", F.explode(F.array_distinct(F.array("dst_part", "src_part"))))


@dataclass
class Files:
    """Strategy over one edge file, or many with ids that go on from file to file."""

    paths: str | list[str]
    src_col: str = "src"
    dst_col: str = "dst"

    def __call__(self, spark: SparkSession, placed: DataFrame, include_out_edge: bool = False) -> DataFrame:
        return edges_by_owner(read_edges_with_ids(spark, self.paths, self.src_col, self.dst_col), placed, include_out_edge)


@dataclass
class Table:
    """Strategy over a table (eid, src, dst)."""

    edges: DataFrame

    def __call__(self, spark: SparkSession, placed: DataFrame, include_out_edge: bool = False) -> DataFrame:
        return edges_by_owner(self.edges, placed, include_out_edge)


def laid_out(edges: DataFrame, parts: int) -> DataFrame:
    """The edges in files by owner, each owner's in its share of the shuffle's partitions, so neither a part nor a hot
    target is one task."""
    pieces = max(PIECES, -(-int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts))
    return written(edges.repartition("owner", F.pmod(F.xxhash64("eid"), F.lit(pieces))), partition_by="owner")


def generate_graph(nodes: DataFrame, partitioner: Partitioner, parts: int, seed: int = P.SEED, include_out_edge: bool = False) -> Graph:
    """Nodes in a random balanced partition and the edges each part owns (those into it; with ``include_out_edge`` those
    out of it too), with both ends' positions and parts, laid out by owner.

    An empty node table gives an empty graph. Nodes must be distinct; edges may repeat.
    """
    spark = nodes.sparkSession
    placed = written(P.partition_nodes(nodes, parts, seed))
    edges = laid_out(partitioner(spark, placed, include_out_edge), parts)
    ends = edges.select("owner", F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("src_gid").alias("gid"), F.col("src_part").alias("part_id")), F.struct(F.col("dst").alias("id"), F.col("dst_gid").alias("gid"), F.col("dst_part").alias("part_id")))).alias("n"))
    local = ends.select("owner", "n.*").unionByName(placed.select(F.col("part_id").alias("owner"), "id", "gid", "part_id")).distinct()
    local = local.withColumn("inner_node", F.col("owner") == F.col("part_id"))
    return Graph(placed, edges, local, P.isolated_nodes(placed.select("id"), edges))


def halo_features(graph: Graph, features: DataFrame) -> DataFrame:
    """(owner, id, inner_node, x): the vectors of all nodes a part knows, its own and its halo's; a node without vector
    is left out. Each part and node is one row, so a node that many parts know is a key of as many rows at most."""
    return graph.local_nodes.select("owner", "id", "inner_node").join(features, "id").select("owner", "id", "inner_node", "x")
