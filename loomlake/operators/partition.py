"""Random balanced node partitioning and the edge and node sets of its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def balanced_offsets(parts: int, n: int) -> list[int]:
    """Boundaries of ``parts`` contiguous ranges over n elements whose sizes differ by one at most, larger ones first."""
    q, r = divmod(n, parts)
    return [i * q + min(i, r) for i in range(parts + 1)]


def part_of(gid: Column, n: int, parts: int) -> Column:
    """Range number of a position, in closed form."""
    q, r = divmod(n, parts)
    head = r * (q + 1)
    low = F.floor(gid / F.lit(q + 1))
    high = F.lit(r) + F.floor((gid - head) / F.lit(max(q, 1)))
    return F.when(gid < head, low).otherwise(high).cast("int")


def random_positions(nodes: DataFrame, seed: int = SEED, digits: int = 3) -> DataFrame:
    """(id, gid): a permutation 0..n-1 in order of md5(seed|id).

    Ids are ranked within 16^digits buckets of the hash's first digits; only the buckets' counts, a fixed
    number of rows, are summed in one task.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    keyed = nodes.select("id", key.alias("h")).withColumn("bucket", F.substring("h", 1, digits))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = "coalesce(sum(n) over (order by bucket rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.select("bucket", F.expr(f"cast({before} as bigint)").alias("offset"))
    ranked = keyed.withColumn("rank", F.expr("row_number() over (partition by bucket order by h, id) - 1"))
    return ranked.join(F.broadcast(offsets), "bucket").select("id", (F.col("offset") + F.col("rank")).alias("gid"))


def hash_digits(n: int, bucket: int = 1_000_000) -> int:
    """Digits that leave about ``bucket`` of n ids in a bucket; positions do not depend on them."""
    digits = 3
    while n > bucket * 16**digits:
        digits += 1
    return digits


def partition_nodes(nodes: DataFrame, parts: int, seed: int = SEED) -> DataFrame:
    """(id, gid, part_id) of a random balanced partition."""
    n = nodes.count()
    placed = random_positions(nodes, seed, hash_digits(n))
    return placed.withColumn("part_id", part_of(F.col("gid"), n, parts))


def in_edges(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """Edges whose target is inner."""
    return edges.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi")


def incident_edges(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """Edges with an inner node at either end, each once."""
    a = inner.select(F.col("id").alias("src"), F.lit(True).alias("s"))
    b = inner.select(F.col("id").alias("dst"), F.lit(True).alias("d"))
    return edges.join(a, "src", "left").join(b, "dst", "left").where("s or d").drop("s", "d")


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct nodes of the edges; each end is reduced by a partial aggregate before the exchange."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def halo_nodes(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """Sources of in-edges of inner nodes that are not inner themselves."""
    sources = in_edges(edges, inner).select(F.col("src").alias("id")).distinct()
    return sources.join(inner.select("id"), "id", "left_anti")


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    return nodes.join(endpoints(edges), "id", "left_anti")


def relabel(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their positions; an unknown end drops the edge."""
    a = positions.select(F.col("id").alias("src"), F.col("gid").alias("src_gid"))
    b = positions.select(F.col("id").alias("dst"), F.col("gid").alias("dst_gid"))
    return edges.join(a, "src").join(b, "dst")


def edge_parts(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges with the parts of both ends."""
    a = placed.select(F.col("id").alias("src"), F.col("part_id").alias("src_part"))
    b = placed.select(F.col("id").alias("dst"), F.col("part_id").alias("dst_part"))
    return edges.join(a, "src").join(b, "dst")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node, 0 without edges."""
    ins = edges.groupBy("dst").agg(F.count("*").alias("in_degree")).withColumnRenamed("dst", "id")
    outs = edges.groupBy("src").agg(F.count("*").alias("out_degree")).withColumnRenamed("src", "id")
    out = nodes.select("id").join(ins, "id", "left").join(outs, "id", "left")
    return out.fillna(0, ["in_degree", "out_degree"])


def count_targets(content: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """(id, n): how often each target occurs in a column, 0 if never."""
    n = content.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
    return targets.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def count_in_space(content: DataFrame, targets: DataFrame, column: str, space: int) -> DataFrame:
    """(id, n) for every id from 0 to space - 1: how often it occurs in a column if it is a target, else 0."""
    n = count_targets(content, targets, column).withColumnRenamed("n", "__n")
    ids = content.sparkSession.range(space)
    return ids.join(n, "id", "left").select("id", F.coalesce("__n", F.lit(0)).alias("n"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"there are no {what}")
    return df
