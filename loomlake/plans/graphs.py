"""Graphs and parameters made from the driver tables, in DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import numbered

FANOUT, PARTS, SEED, WIDTH = 25, 4, 42, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, and suppliers moved behind them."""
    part, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "part").count()
    sup = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + n).alias("id"))
    return part.select(F.col("p_partkey").alias("id")).unionByName(sup)


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag supplier -> part of all line items, copies numbered."""
    n = table(spark, sf_dir, "part").count()
    li = table(spark, sf_dir, "lineitem")
    return numbered(li.select((F.col("l_suppkey") + n).alias("src"), F.col("l_partkey").alias("dst")))


def supply2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs as edges both ways, for models of several layers."""
    n = table(spark, sf_dir, "part").count()
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    ends = F.array(F.struct((F.col("l_suppkey") + n).alias("src"), F.col("l_partkey").alias("dst")), F.struct(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst")))
    return li.select(F.explode(ends).alias("e")).select("e.src", "e.dst", F.lit(0).alias("dup"))


def supply_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers a node with few binary digits, so that single-layer sums are exact in any order."""
    part, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "part").count()
    p = part.select(
        F.col("p_partkey").alias("id"),
        F.array(F.col("p_size") / F.lit(8.0), (F.col("p_partkey") % 7) / F.lit(4.0), (F.col("p_size") % 5 - 2) / F.lit(2.0), F.lit(1.0)).alias("x"),
    )
    s = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + n).alias("id"),
        F.array((F.col("s_suppkey") % 11) / F.lit(8.0), F.col("s_nationkey") / F.lit(4.0), (F.col("s_suppkey") % 5 - 2) / F.lit(2.0), F.lit(0.5)).alias("x"),
    )
    return p.unionByName(s)


def vec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, and half of each component behind them."""
    return vec_features(spark, sf_dir).select("id", F.concat("x", F.transform("x", lambda v: v / 2)).alias("x"))


def vec_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select((F.col("l_orderkey") % n).alias("src"), (F.col("l_partkey") % n).alias("dst")).distinct()
    return pairs.withColumn("dup", F.lit(0))


def weights(rows: int, cols: int, layer: int = 0) -> list[list[float]]:
    return [[((k * 31 + m * 17 + layer * 7) % 13 - 6) / 8 for m in range(cols)] for k in range(rows)]


def bias(cols: int, layer: int = 0) -> list[float]:
    return [((m * 5 + layer * 3) % 7 - 3) / 16 for m in range(cols)]


def attention(heads: int, size: int, layer: int = 0) -> tuple[list[list[float]], list[list[float]]]:
    left = [[((h * 5 + d * 3 + layer) % 7 - 3) / 8 for d in range(size)] for h in range(heads)]
    right = [[((h * 3 + d * 5 + layer) % 5 - 2) / 8 for d in range(size)] for h in range(heads)]
    return left, right


# -- the same as SQL ------------------------------------------------------------------------------------

CTES = {
    "np": "np as (select count(*)::bigint as n from part)",
    "nodes": "nodes as (select p_partkey as id from part union all select s_suppkey + n from supplier, np)",
    "edges": "edges as (select l_suppkey + n as src, l_partkey as dst, (row_number() over (partition by l_suppkey, l_partkey) - 1)::int as dup from lineitem, np)",
    "edges2": (
        "edges2 as (select distinct l_suppkey + n as src, l_partkey as dst, 0 as dup from lineitem, np "
        "union all select distinct l_partkey, l_suppkey + n, 0 from lineitem, np)"
    ),
    "feats": (
        "feats as (select p_partkey as id, unnest([0, 1, 2, 3]) as k, unnest([p_size / 8.0::double, (p_partkey % 7) / 4.0::double, (p_size % 5 - 2) / 2.0::double, 1.0::double]) as v from part "
        "union all select s_suppkey + n, unnest([0, 1, 2, 3]), unnest([(s_suppkey % 11) / 8.0::double, s_nationkey / 4.0::double, (s_suppkey % 5 - 2) / 2.0::double, 0.5::double]) from supplier, np)"
    ),
    "placed0": "placed0 as (select id, row_number() over (order by md5('42|' || id), id) - 1 as gid, count(*) over () as n from nodes)",
    "placed": (
        "placed as (select id, gid, (case when gid < (n % 4) * (n // 4 + 1) then gid // (n // 4 + 1) else n % 4 + (gid - (n % 4) * (n // 4 + 1)) // (n // 4) end)::int as part_id from placed0)"
    ),
    "parted": "parted as (select e.*, a.part_id as src_part, b.part_id as dst_part from edges e join placed a on e.src = a.id join placed b on e.dst = b.id)",
    "vec": "vec as (select vec_id as id, unnest(range(len(embedding))) as k, unnest(embedding)::double as v from embeddings)",
    "wide": "wide as (select id, k, v from vec union all select id, k + 64, v / 2 from vec)",
    "vedges": "vedges as (select distinct l_orderkey % n as src, l_partkey % n as dst, 0 as dup from lineitem, (select count(*)::bigint as n from embeddings))",
}
NEEDS = {
    "nodes": ["np"], "edges": ["np"], "edges2": ["np"], "feats": ["np"], "placed0": ["nodes"], "placed": ["placed0"],
    "parted": ["edges", "placed"], "wide": ["vec"],
}


def with_ctes(names: list[str], rest: str, extra: list[str] = ()) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "with " + ", ".join([CTES[n] for n in done] + list(extra)) + " " + rest


def binned_sql(x: str) -> str:
    return f"floor(({x}) * 1e6::double + 0.3183098861837907::double)::double / 1e6::double + 0.0::double"


def sampled_sql(name: str, edges: str, layer: int, fanout: int = FANOUT) -> str:
    return (
        f"{name} as (select src, dst, dup from (select *, row_number() over (partition by dst order by "
        f"md5('{SEED}|{layer}|' || src || '|' || dst || '|' || dup), src, dup) as r from {edges}) where r <= {fanout})"
    )


def weight_sql(k: str, m: str, layer: int = 0) -> str:
    return f"((({k}) * 31 + ({m}) * 17 + {layer * 7}) % 13 - 6) / 8.0::double"


def bias_sql(m: str, layer: int = 0) -> str:
    return f"((({m}) * 5 + {layer * 3}) % 7 - 3) / 16.0::double"
