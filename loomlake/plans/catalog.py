"""Queries over the driver tables and the equivalent SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions import weights as W
from ..operators import features as R
from ..operators import generation as N
from ..operators import layers as L
from ..operators import partition as P
from ..operators import schedule as H
from ..operators.numbering import numbered_in_order, sorted_with_positions
from ..operators.sampling import sample_in_edges
from ..sources import graph_files as S
from ..sources.scratch import shared_folder, written
from . import export as X
from . import graphs as G
from .graphs import FANOUT, PARTS, WIDTH, bias_sql, binned_sql, sampled_sql, table, weight_sql, with_ctes
from .loader import BatchLoader
from .models import GAT, GCN, SAGE, GraphData, Layer
from .timing import Timings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def long(df: DataFrame, *keep: str, column: str = "x") -> DataFrame:
    """One row a component: keep..., k, v, with v in hash-safe steps."""
    rows = df.select(*keep, F.posexplode(column).alias("k", "v"))
    return rows.select(*keep, "k", V.binned(F.col("v")).alias("v"))


# -- sources --------------------------------------------------------------------------------------------


@query("select l_suppkey as src, l_partkey as dst, count(*) as n from lineitem group by all")
def scan_edges(spark, d):
    edges = S.read_edges(spark, f"{d}/lineitem.parquet", "l_suppkey", "l_partkey")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(with_ctes(["vec"], f"select id, k::int as k, {binned_sql('v')} as v from vec"))
def scan_features(spark, d):
    return long(G.vec_features(spark, d), "id")


@query(
    "select s_suppkey as id, unnest([0, 1]) as k, unnest([s_nationkey::double, floor(s_acctbal * 1e6::double + 0.3183098861837907::double)::double / 1e6::double + 0.0::double]) "
    "as v from supplier".replace("s_nationkey::double", binned_sql("s_nationkey::double"))
)
def pack_features(spark, d):
    """Scalar feature columns become one vector, in numeric order."""
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("feat1"), F.col("s_nationkey").alias("feat0"))
    names, arrays = S.feature_columns(t.schema)
    return long(t.select("id", V.pack(names, arrays).alias("x")), "id")


@query(
    "with c as (select l_orderkey % 8 as file, count(*) as n from lineitem group by all) "
    "select file, n, coalesce(sum(n) over (order by file rows between unbounded preceding and 1 preceding), 0)::bigint as rows_before from c"
)
def edge_id_offsets(spark, d):
    counts = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("file")).agg(F.count("*").alias("n"))
    return S.file_offsets(counts).withColumnRenamed("offset", "rows_before")


@query("select count(*) as n, count(*) as ids, 0::bigint as lo, count(*) - 1 as hi from lineitem")
def edge_ids(spark, d):
    """Edge ids by file row are dense: as many distinct ones as rows, from 0."""
    e = S.read_edges_with_ids(spark, f"{d}/lineitem.parquet", "l_suppkey", "l_partkey")
    return e.agg(F.count("*").alias("n"), F.count_distinct("eid").alias("ids"), F.min("eid").alias("lo"), F.max("eid").alias("hi"))


@query(with_ctes(["edges"], "select src, dst, count(*) as n from edges group by all"))
def export_chunks(spark, d):
    """Edges written in four contiguous chunks and read back."""
    path = f"{shared_folder(spark)}/chunks-{abs(hash(d))}"
    S.write_chunks(G.supply_edges(spark, d).select("src", "dst"), path, 4, ["dst", "src"])
    return S.read_edges(spark, path).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(with_ctes(["feats"], f"select id, k::int as k, {binned_sql('v')} as v from feats"))
def export_features(spark, d):
    """Vectors written as one scalar column a dimension, and packed again by the reader."""
    path = f"{shared_folder(spark)}/features-{abs(hash(d))}"
    S.write_features(G.supply_features(spark, d), path, WIDTH, 4)
    return long(S.read_features(spark, path, "id"), "id")


def chunked(spark, d, name: str, chunks: int) -> tuple[str, list[str]]:
    path = f"{shared_folder(spark)}/{name}-{abs(hash(d))}"
    return path, S.write_chunks(G.supply_edges(spark, d).select("src", "dst"), path, chunks, ["dst", "src"])


_CHUNK = "c as (select *, least(r // (n // {0}), {0} - 1) as chunk from (select src, dst, row_number() over (order by dst, src) - 1 as r, count(*) over () as n from edges))"


@query(with_ctes(["edges"], "select 'edge_list_' || chunk::int || '.parquet' as file, count(*) as n, min(dst) as first_dst, max(dst) as last_dst from c group by all", [_CHUNK.format(7)]))
def export_chunk_sizes(spark, d):
    """Chunk files hold n // 7 rows each, the last one the remainder too."""
    _, paths = chunked(spark, d, "sizes", 7)
    rows = spark.read.parquet(*paths).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "dst")
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.min("dst").alias("first_dst"), F.max("dst").alias("last_dst"))


@query(with_ctes(["edges"], "select count(*) as n, min(dst) as first_dst, max(dst) as last_dst from c where chunk in (3, 4)", [_CHUNK.format(7)]))
def chunk_discovery(spark, d):
    """The second of three parts reads the chunk files 3 and 4 of 7."""
    path, _ = chunked(spark, d, "discovery", 7)
    e = S.read_edges(spark, S.chunk_files(f"{path}/edge_list", 7, part=1, parts=3))
    return e.agg(F.count("*").alias("n"), F.min("dst").alias("first_dst"), F.max("dst").alias("last_dst"))


@query(with_ctes(["edges", "feats"], "select (select count(*) from edges) as edges, (select count(distinct id) from feats) as nodes, 3 as edge_files, 2 as feature_files"))
def export_entry(spark, d):
    """The export's entry point on an edge table and a node table."""
    path = f"{shared_folder(spark)}/entry-{abs(hash(d))}"
    G.supply_edges(spark, d).select("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    G.supply_features(spark, d).select("id", F.col("x").alias("feat0")).write.mode("overwrite").parquet(f"{path}/nodes")
    edges, feats = X.export(spark, f"{path}/edges", f"{path}/nodes", 3, 2, f"{path}/out")
    e = spark.read.parquet(*edges).select(F.lit(1).alias("e"), F.lit(0).alias("n"))
    f = S.read_features(spark, feats, "id").select(F.lit(0).alias("e"), F.lit(1).alias("n"))
    counts = e.unionByName(f).agg(F.sum("e").alias("edges"), F.sum("n").alias("nodes"))
    return counts.withColumns({"edge_files": F.lit(len(edges)), "feature_files": F.lit(len(feats))})


@query(with_ctes(["feats"], f"select id, (k - 2)::int as k, {binned_sql('v')} as v from feats where k >= 2"))
def feature_share(spark, d):
    """The second half of the feature columns; the first is not read."""
    path = f"{shared_folder(spark)}/share-{abs(hash(d))}"
    S.write_features(G.supply_features(spark, d), path, WIDTH, 2)
    return long(S.read_features(spark, path, "id", part=1, parts=2), "id")


@query(with_ctes(["feats"], "select count(distinct k)::bigint as width from feats"))
def total_width(spark, d):
    """Widths of three shares of the feature columns, summed."""
    path = f"{shared_folder(spark)}/width-{abs(hash(d))}"
    S.write_features(G.supply_features(spark, d), path, WIDTH, 2)
    parts = [S.read_features(spark, path, "id", part=i, parts=3).agg(F.max(F.size("x")).alias("n")) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.sum("n").alias("width"))


@query("select * from (values (0, 'scan', 'gcn'), (1, 'count', 'gcn')) t(position, stage, model)")
def timing_table(spark, d):
    """Stages timed in order; their seconds differ from run to run and are left out."""
    t = Timings(model="gcn")
    with t("scan"):
        e = G.supply_edges(spark, d)
    with t("count"):
        e.count()
    return t.table(spark).drop("seconds")


@query("select count(*) as n, count(*) as in_order from lineitem")
def edge_id_order(spark, d):
    """Sorted by edge id, each edge is at the place that its id says."""
    e = S.read_edges_with_ids(spark, f"{d}/lineitem.parquet", "l_suppkey", "l_partkey")
    e = numbered_in_order(e, ["eid"])
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("position") == F.col("eid")).alias("in_order"))


@query(with_ctes(["nodes"], "select md5(id::varchar) as value, id as position from nodes"))
def sort_with_positions(spark, d):
    """Values in order with the places they had."""
    n = G.supply_nodes(spark, d)
    return sorted_with_positions(n.select(F.md5(F.col("id").cast("string")).alias("v"), F.col("id").alias("position")), "v")


@query(with_ctes(["edges"], "select src, dst, dup, row_number() over (order by src, dst, dup) - 1 as position from edges"))
def sort_by_source(spark, d):
    return numbered_in_order(G.supply_edges(spark, d), ["src", "dst", "dup"]).select("src", "dst", "dup", "position")


# -- partitioning ---------------------------------------------------------------------------------------


def placed(spark, d):
    return P.partition_nodes(G.supply_nodes(spark, d), PARTS)


def inner(spark, d):
    return placed(spark, d).where("part_id = 0")


_INNER = "inner_ as (select id from placed where part_id = 0)"


@query(with_ctes(["placed"], "select id, gid from placed"))
def random_permutation(spark, d):
    return P.random_positions(G.supply_nodes(spark, d))


@query(with_ctes(["placed"], "select id, gid, part_id from placed"))
def balanced_partition(spark, d):
    return placed(spark, d)


@query(with_ctes(["placed"], "select part_id, count(*) as n, min(gid) as first_gid, max(gid) as last_gid from placed group by all"))
def partition_sizes(spark, d):
    return placed(spark, d).groupBy("part_id").agg(F.count("*").alias("n"), F.min("gid").alias("first_gid"), F.max("gid").alias("last_gid"))


@query(with_ctes(["edges", "placed"], "select src, dst, dup from edges where dst in (select id from inner_)", [_INNER]))
def in_edge_filter(spark, d):
    return P.in_edges(G.supply_edges(spark, d), inner(spark, d)).select("src", "dst", "dup")


@query(with_ctes(["edges", "placed"], "select src, dst, dup from edges where dst in (select id from inner_) or src in (select id from inner_)", [_INNER]))
def incident_edge_filter(spark, d):
    return P.incident_edges(G.supply_edges(spark, d), inner(spark, d)).select("src", "dst", "dup")


@query(with_ctes(["edges", "placed"], "select distinct src as id from edges where dst in (select id from inner_) and src not in (select id from inner_)", [_INNER]))
def halo_nodes(spark, d):
    return P.halo_nodes(G.supply_edges(spark, d), inner(spark, d))


@query(with_ctes(["nodes", "edges", "placed"], "select id from nodes where id not in (select src from e union select dst from e)", [_INNER, "e as (select src, dst from edges where dst in (select id from inner_))"]))
def isolated_nodes(spark, d):
    """Nodes that no in-edge of part 0 touches."""
    return P.isolated_nodes(G.supply_nodes(spark, d), P.in_edges(G.supply_edges(spark, d), inner(spark, d)))


@query(with_ctes(["edges", "placed"], "select src, dst, dup, a.gid as src_gid, b.gid as dst_gid from edges join placed a on a.id = src join placed b on b.id = dst"))
def relabel_nodes(spark, d):
    return P.relabel(G.supply_edges(spark, d), placed(spark, d)).select("src", "dst", "dup", "src_gid", "dst_gid")


@query(with_ctes(["parted"], "select src_part, dst_part, count(*) as n from parted group by all"))
def edge_cut_by_partition(spark, d):
    e = P.edge_parts(G.supply_edges(spark, d), placed(spark, d))
    return e.groupBy("src_part", "dst_part").agg(F.count("*").alias("n"))


@query(with_ctes(["parted"], "select dst_part, count(*) as edges, count(distinct src) as sources, count(*) filter (src_part <> dst_part) as remote from parted group by all"))
def edge_exchange_volume(spark, d):
    e = P.edge_parts(G.supply_edges(spark, d), placed(spark, d))
    return e.groupBy("dst_part").agg(
        F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_if(F.col("src_part") != F.col("dst_part")).alias("remote")
    )


_DEGREES = (
    "select id, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree from nodes "
    "left join (select dst, count(*) as n from edges group by all) i on i.dst = id left join (select src, count(*) as n from edges group by all) o on o.src = id"
)


@query(with_ctes(["nodes", "edges"], _DEGREES))
def degree_both(spark, d):
    return P.degrees(G.supply_edges(spark, d), G.supply_nodes(spark, d))


@query(with_ctes(["edges"], "select dst as id, count(*) as n from edges group by all"))
def in_degree(spark, d):
    return G.supply_edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


@query(with_ctes(["edges"], "select src as id, count(*) as n from edges group by all"))
def out_degree(spark, d):
    return G.supply_edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


@query(with_ctes(["edges2"], "select src as id from edges2 union select dst from edges2"))
def unique_endpoints(spark, d):
    return P.endpoints(G.supply2_edges(spark, d))


@query(with_ctes(["edges2"], "select src as id from edges2 intersect select dst from edges2"))
def both_ways(spark, d):
    """Nodes that are a source and a target."""
    e = G.supply2_edges(spark, d)
    return e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))


@query(with_ctes(["nodes", "edges2"], "select id, count(src) as n from nodes left join edges2 on src = id group by id"))
def count_targets(spark, d):
    """How often each node is a source, 0 included."""
    return P.count_targets(G.supply2_edges(spark, d), G.supply_nodes(spark, d), "src")


@query(with_ctes(["nodes", "edges2"], "select (select count(*) from nodes) as nodes, (select min(id) from nodes) as first_id, (select count(*) from edges2) as edges"))
def graph_totals(spark, d):
    n = G.supply_nodes(spark, d).select("id", F.lit(1).alias("n"), F.lit(0).alias("e"))
    e = G.supply2_edges(spark, d).select(F.lit(None).cast("long").alias("id"), F.lit(0).alias("n"), F.lit(1).alias("e"))
    return n.unionByName(e).agg(F.sum("n").alias("nodes"), F.min("id").alias("first_id"), F.sum("e").alias("edges"))


@query(
    "with l as (select l_orderkey, list(l_quantity order by l_quantity) as l from lineitem group by l_orderkey), w as (select max(len(l)) as w from l) "
    "select l_orderkey as id, k::int as k, case when k = w then len(l)::double else coalesce(l[k + 1], 0) end as v from l, w, (select unnest(range((select w + 1 from w))) as k)"
)
def pad_vectors(spark, d):
    """Ragged lists (the sorted quantities of an order) filled up to the longest one's width, their length behind."""
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("x"))
    width = lists.agg(F.max(F.size("x"))).first()[0] or 0
    return lists.select(F.col("l_orderkey").alias("id"), F.posexplode(V.padded(F.col("x"), width)).alias("k", "v"))


@query(with_ctes(["edges2", "nodes"], "select id, case when id in (select id from nodes where id % 3 <> 1) then coalesce(c.n, 0) else 0 end as n from (select unnest(range((select max(id) + 6 from nodes))) as id) left join (select src, count(*) as n from edges2 group by all) c on c.src = id"))
def count_in_space(spark, d):
    """Counts of every id of a space; those that are no targets have 0."""
    n = G.supply_nodes(spark, d)
    space = n.agg(F.max("id")).first()[0] + 6
    return P.count_in_space(G.supply2_edges(spark, d), n.where("id % 3 <> 1"), "src", space)


def generated(spark, d, out_edges: bool = False) -> N.Graph:
    edges = G.supply_edges(spark, d)
    eid = F.xxhash64("src", "dst", "dup")
    return N.generate_graph(G.supply_nodes(spark, d), N.Table(edges.select(eid.alias("eid"), "src", "dst", "dup")), PARTS, include_out_edge=out_edges)


_OWNED = "select {} as owner, src, dst, dup, a.gid as src_gid, b.gid as dst_gid, a.part_id as src_part, b.part_id as dst_part from edges join placed a on a.id = src join placed b on b.id = dst"
_OWNED_OUT = f"{_OWNED.format('b.part_id')} union all {_OWNED.format('a.part_id')} where a.part_id <> b.part_id"


@query(with_ctes(["edges", "placed"], _OWNED.format("b.part_id")))
def generate_graph(spark, d):
    """Edges laid out by the part of their target, with both ends' positions and parts."""
    return generated(spark, d).edges.select("owner", "src", "dst", "dup", "src_gid", "dst_gid", "src_part", "dst_part")


@query(with_ctes(["edges", "placed"], _OWNED_OUT))
def generate_graph_out_edges(spark, d):
    """Parts also keep the edges that leave them."""
    return generated(spark, d, True).edges.select("owner", "src", "dst", "dup", "src_gid", "dst_gid", "src_part", "dst_part")


_LOCAL = "l as (select dst_part as owner, src as id from parted union select dst_part, dst from parted union select part_id, id from placed)"


@query(with_ctes(["parted"], "select owner, id, gid, part_id, owner = part_id as inner_node from l join placed using (id)", [_LOCAL]))
def generate_graph_nodes(spark, d):
    return generated(spark, d).local_nodes.select("owner", "id", "gid", "part_id", "inner_node")


@query(with_ctes(["parted", "feats"], f"select owner, id, owner = part_id as inner_node, k::int as k, {binned_sql('v')} as v from l join placed using (id) join feats using (id)", [_LOCAL]))
def halo_features(spark, d):
    """Vectors of all nodes that a part knows."""
    return long(N.halo_features(generated(spark, d), G.supply_features(spark, d)), "owner", "id", "inner_node")


# -- features -------------------------------------------------------------------------------------------

_OWN = with_ctes(["feats", "placed"], f"select id, k::int as k, {binned_sql('v')} as v from feats where id in (select id from inner_)", [_INNER])


@query(_OWN)
def feature_redistribute_shuffle(spark, d):
    return long(R.redistribute(G.supply_features(spark, d), inner(spark, d)), "id")


@query(_OWN)
def feature_redistribute_broadcast(spark, d):
    return long(R.scan_through(G.supply_features(spark, d), inner(spark, d)), "id")


@query(_OWN)
def feature_checked(spark, d):
    """The same behind guards: an error if there are no targets, or one without features."""
    own = P.require_rows(inner(spark, d), "targets")
    return long(R.checked(G.supply_features(spark, d), own), "id")


@query(with_ctes(["vec"], "select count(distinct id) as nodes, count(*) as n from vec"))
def feature_scan_only(spark, d):
    f = G.vec_features(spark, d)
    return f.agg(F.count_distinct("id").alias("nodes"), F.sum(F.size("x")).cast("long").alias("n"))


@query(with_ctes(["nodes"], "select id from nodes where id not in (select vec_id from embeddings)"))
def missing_feature_ids(spark, d):
    return R.missing(G.vec_features(spark, d), G.supply_nodes(spark, d))


# -- sampling -------------------------------------------------------------------------------------------


@query(with_ctes(["edges"], "select src, dst, dup from s0", [sampled_sql("s0", "edges", 0)]))
def sample_neighbors(spark, d):
    return sample_in_edges(G.supply_edges(spark, d), FANOUT).select("src", "dst", "dup")


@query(
    with_ctes(
        ["edges2"], "select 0 as layer, src, dst, dup from s0 union all select 1, src, dst, dup from s1", [sampled_sql("s0", "edges2", 0), sampled_sql("s1", "edges2", 1)]
    )
)
def sample_per_layer(spark, d):
    e = G.supply2_edges(spark, d)
    parts = [sample_in_edges(e, FANOUT, i).select(F.lit(i).alias("layer"), "src", "dst", "dup") for i in range(2)]
    return parts[0].unionByName(parts[1])


@query(with_ctes(["edges"], "select dst as id, count(*) as n from s0 group by all", [sampled_sql("s0", "edges", 0)]))
def sampled_degree(spark, d):
    return sample_in_edges(G.supply_edges(spark, d), FANOUT).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


# -- sums and products ----------------------------------------------------------------------------------


def spmm_sql(edges: str, value: str = "sum(f.v)", nodes: str = "nodes", feats: str = "feats", dims: int = WIDTH) -> str:
    return (
        f"select n.id, d.k::int as k, coalesce(s.v, 0) as v from {nodes} n cross join (select unnest(range({dims})) as k) d "
        f"left join (select e.dst, f.k, {value} as v from {edges} e join {feats} f on f.id = e.src group by all) s on s.dst = n.id and s.k = d.k"
    )


def final_sql(x: str, names: list[str], extra: list[str] = ()) -> str:
    return with_ctes(names, f"select id, k::int as k, {binned_sql('v')} as v from ({x})", extra)


def supply(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return G.supply_edges(spark, d), G.supply_features(spark, d), G.supply_nodes(spark, d)


@query(final_sql(spmm_sql("edges"), ["edges", "feats", "nodes"]))
def spmm_sum(spark, d):
    return long(L.spmm(*supply(spark, d), WIDTH), "id")


@query(final_sql(spmm_sql("edges", "sum(f.v * ((e.src + e.dst) % 5 - 2))"), ["edges", "feats", "nodes"]))
def spmm_weighted(spark, d):
    e, f, n = supply(spark, d)
    e = e.withColumn("w", ((F.col("src") + F.col("dst")) % 5 - 2).cast("double"))
    return long(L.spmm(e, f, n, WIDTH, "w"), "id")


@query(final_sql(spmm_sql("s0", "sum(f.v) / count(*)"), ["edges", "feats", "nodes"], [sampled_sql("s0", "edges", 0)]))
def spmm_mean(spark, d):
    """For every part the mean vector of at most 25 sampled suppliers."""
    e, f, n = supply(spark, d)
    return long(L.spmm_mean(sample_in_edges(e, FANOUT), f, n, WIDTH), "id")


@query(
    with_ctes(
        ["vec", "vedges"],
        f"select dst as id, k::int as k, {binned_sql('sum(v) / count(*)')} as v from (select s.dst, f.k, f.v from s0 s join vec f on f.id = s.src) group by dst, k",
        [sampled_sql("s0", "vedges", 0, 10)],
    )
)
def spmm_mean_wide(spark, d):
    """Means of 64-wide vectors over 10 sampled neighbours."""
    f = G.vec_features(spark, d)
    e = sample_in_edges(G.vec_edges(spark, d), 10)
    targets = e.select(F.col("dst").alias("id")).distinct()
    return long(L.spmm_mean(e, f, targets, 64), "id")


def matmul_sql(rows: str, ins: str, outs: int, layer: int = 0, bias: bool = False) -> str:
    b = f" + {bias_sql('m.m', layer)}" if bias else ""
    return f"select f.id, m.m as k, sum(f.v * {weight_sql('f.k', 'm.m', layer)}){b} as v from {rows} f cross join (select unnest(range({outs})) as m) m group by f.id, m.m"


@query(final_sql(matmul_sql("vec", "64", 8), ["vec"]))
def dense_matmul(spark, d):
    return long(L.linear(G.vec_features(spark, d), G.weights(64, 8)), "id")


@query(final_sql(matmul_sql("feats", "4", 6, bias=True), ["feats"]))
def linear_bias(spark, d):
    return long(L.linear(G.supply_features(spark, d), G.weights(WIDTH, 6), G.bias(6)), "id")


def _activation(name: str, f, sql: str) -> None:
    def run(spark, d):
        return long(G.vec_features(spark, d).select("id", F.transform("x", lambda v: f(v)).alias("x")), "id")

    run.__name__ = name
    query(final_sql(f"select id, k, {sql} as v from vec", ["vec"]))(run)


_activation("relu_act", V.relu, "case when v > 0 then v else 0.0 end")
_activation("elu_act", V.elu, "case when v > 0 then v else exp(v) - 1 end")
_activation("leaky_relu_act", V.leaky_relu, "case when v > 0 then v else 0.2::double * v end")


@query(with_ctes(["vec"], f"select id, k::int as k, {binned_sql('v')} as v from vec"))
def dropout_act(spark, d):
    """Inference drops nothing."""
    return long(G.vec_features(spark, d).select("id", V.dropout(F.col("x"), 0.6).alias("x")), "id")


@query(final_sql(matmul_sql("wide", "128", 128, bias=True), ["wide"]))
def dense_matmul_wide(spark, d):
    """128 x 128 weights: one matrix product a batch."""
    return long(L.linear(G.wide_features(spark, d), G.weights(128, 128), G.bias(128)), "id")


@query(final_sql(matmul_sql("vec", "64", 8, bias=True), ["vec"]))
def linear_loaded(spark, d):
    """Weights of an existing dense layer (out x in), saved as a table and loaded."""
    given = W.Linear.of(list(zip(*G.weights(64, 8), strict=True)), G.bias(8))
    path = f"{shared_folder(spark)}/weights-{abs(hash(d))}"
    W.save(spark, {"weights": given.weights, "bias": given.bias}, path)
    found = W.load(spark.read.parquet(path))
    return long(L.linear(G.vec_features(spark, d), found["weights"], found["bias"]), "id")


@query(with_ctes(["wide", "vedges"], f"select dst as id, k::int as k, {binned_sql('sum(v)')} as v from (select s.dst, f.k, f.v from s0 s join wide f on f.id = s.src) group by dst, k", [sampled_sql("s0", "vedges", 0, 10)]))
def spmm_sum_wide(spark, d):
    """Sums of 128-wide vectors."""
    e = sample_in_edges(G.vec_edges(spark, d), 10)
    targets = e.select(F.col("dst").alias("id")).distinct()
    return long(L.spmm(e, G.wide_features(spark, d), targets, 128), "id")


@query(final_sql(f"select m.id, m.k, m.v from ({spmm_sql('edges', 'sum(f.v) / count(*)')}) m", ["edges", "feats", "nodes"]))
def embedding_sink(spark, d):
    """Vectors of all nodes written as the last step of inference, and read again."""
    e, f, n = supply(spark, d)
    path = f"{shared_folder(spark)}/embeddings-{abs(hash(d))}"
    S.write_embeddings(L.spmm_mean(e, f, n, WIDTH), path)
    return long(spark.read.parquet(path), "id")


# -- graph convolution ----------------------------------------------------------------------------------


def _gcn(norm: str) -> None:
    def run(spark, d):
        e, f, n = G.supply2_edges(spark, d), G.supply_features(spark, d), G.supply_nodes(spark, d)
        return long(L.graph_conv(written(e), f, n, G.weights(WIDTH, 3), G.bias(3), norm, V.relu), "id")

    run.__name__ = f"gcn_norm_{norm}"
    ins = "ind as (select dst as id, count(*)::double as n from edges2 group by all)"
    outs = "outd as (select src as id, count(*)::double as n from edges2 group by all)"
    before = {"left": "f.v * (1 / coalesce(o.n, 1))", "both": "f.v * (1 / sqrt(coalesce(o.n, 1)))"}.get(norm, "f.v")
    after = {"right": "y.v / coalesce(i.n, 1)", "both": "y.v * (1 / sqrt(coalesce(i.n, 1)))"}.get(norm, "y.v")
    scaled = f"g as (select f.id, f.k, {before} as v from feats f left join outd o on o.id = f.id)"
    sums = f"s as ({spmm_sql('edges2', feats='g')})"
    y = f"y as ({matmul_sql('s', '4', 3)})"
    z = f"select y.id, y.k, greatest({after} + {bias_sql('y.k')}, 0.0) as v from y left join ind i on i.id = y.id"
    query(final_sql(z, ["edges2", "feats", "nodes"], [ins, outs, scaled, sums, y]))(run)


for _norm in ("none", "right", "left", "both"):
    _gcn(_norm)


_IN = "ind as (select dst as id, count(*)::double as n from edges2 group by all)"


@query(final_sql("select s.id, s.k, s.v / coalesce(i.n, 1) as v from s left join ind i on i.id = s.id", ["edges2", "feats", "nodes"], [_IN, f"s as ({spmm_sql('edges2')})"]))
def gcn_weightless(spark, d):
    """A convolution without weights, bias or activation."""
    e, f, n = G.supply2_edges(spark, d), G.supply_features(spark, d), G.supply_nodes(spark, d)
    return long(L.graph_conv(written(e), f, n, None, norm="right", width=WIDTH), "id")


@query(
    final_sql(
        f"select y.id, y.k, greatest(y.v / coalesce(i.n, 1) + {bias_sql('y.k')}, 0.0) as v from y left join ind i on i.id = y.id", ["edges2", "feats", "nodes"],
        [_IN, f"s as ({spmm_sql('edges2', 'sum(f.v * ((e.src + e.dst) % 5 - 2))')})", f"y as ({matmul_sql('s', '4', 3)})"],
    )
)
def gcn_edge_weights(spark, d):
    """Messages multiplied by a weight of their edge."""
    e, f, n = G.supply2_edges(spark, d), G.supply_features(spark, d), G.supply_nodes(spark, d)
    e = written(e.withColumn("w", ((F.col("src") + F.col("dst")) % 5 - 2).cast("double")))
    return long(L.graph_conv(e, f, n, G.weights(WIDTH, 3), G.bias(3), "right", V.relu, "w"), "id")


def gcn_layer_sql(i: int, x: str, ins: int, outs: int) -> list[str]:
    return [
        sampled_sql(f"s{i}", "edges2", i),
        f"a{i} as ({spmm_sql(f's{i}', feats=x, dims=ins)})",
        f"y{i} as ({matmul_sql(f'a{i}', str(ins), outs, i)})",
        f"x{i} as (select y.id, y.k, greatest(y.v / coalesce(c.n, 1) + {bias_sql('y.k', i)}, 0.0) as v from y{i} y left join (select dst, count(*)::double as n from s{i} group by all) c on c.dst = y.id)",
    ]


def supply2(spark, d) -> GraphData:
    return GraphData(G.supply2_edges(spark, d), G.supply_nodes(spark, d), G.supply_features(spark, d))


@query(final_sql("select * from x1", ["edges2", "feats", "nodes"], gcn_layer_sql(0, "feats", 4, 4) + gcn_layer_sql(1, "x0", 4, 4)))
def gcn_2layer_sampled(spark, d):
    layers = [Layer(G.weights(WIDTH, WIDTH, i), G.bias(WIDTH, i)) for i in range(2)]
    return long(GCN(layers, FANOUT).infer(supply2(spark, d)), "id")


_BUILT = GCN.build(2, WIDTH, 5, 3, norm="right", seed=7, fanout=FANOUT)


def built_sql() -> str:
    """The model's weights as a table, since they are random."""
    rows = ", ".join(f"({i}, {k}, {m}, {w!r}::double)" for i, layer in enumerate(_BUILT.layers) for k, ws in enumerate(layer.weights) for m, w in enumerate(ws))
    ctes, x = [f"w(layer, k, m, w) as (values {rows})"], "feats"
    for i, ins in enumerate((WIDTH, 5)):
        ctes += [
            sampled_sql(f"s{i}", "edges2", i), f"a{i} as ({spmm_sql(f's{i}', feats=x, dims=ins)})",
            f"y{i} as (select a.id, w.m as k, sum(a.v * w.w) as v from a{i} a join w on w.layer = {i} and w.k = a.k group by all)",
            f"x{i} as (select y.id, y.k, greatest(y.v / coalesce(c.n, 1), 0.0) as v from y{i} y left join (select dst, count(*)::double as n from s{i} group by all) c on c.dst = y.id)",
        ]
        x = f"x{i}"
    return final_sql("select * from x1", ["edges2", "feats", "nodes"], ctes)


@query(built_sql())
def gcn_built(spark, d):
    """A model from its constructor: widths 4, 5 and 3, uniform weights of a seed, no bias at first."""
    return long(_BUILT.infer(supply2(spark, d)), "id")


# -- graph attention ------------------------------------------------------------------------------------

HEADS, SIZE = 2, 3


def gat_sql(i: int, edges: str, x: str, ins: int, slope: str = "0.2::double") -> list[str]:
    """z, logits, coefficients and sums of an attention layer; h is the head, k the place in all heads."""
    left = f"(((k // {SIZE}) * 5 + (k % {SIZE}) * 3 + {i}) % 7 - 3) / 8.0::double"
    right = f"(((k // {SIZE}) * 3 + (k % {SIZE}) * 5 + {i}) % 5 - 2) / 8.0::double"
    e = f"a.el + b.er"
    return [
        f"z{i} as ({matmul_sql(x, str(ins), HEADS * SIZE, i)})",
        f"l{i} as (select id, (k // {SIZE})::int as h, sum(v * {left}) as el, sum(v * {right}) as er from z{i} group by all)",
        f"e{i} as (select s.src, s.dst, s.dup, a.h, case when {e} > 0 then {e} else {slope} * ({e}) end as e from {edges} s join l{i} a on a.id = s.src join l{i} b on b.id = s.dst and b.h = a.h)",
        f"c{i} as (select src, dst, dup, h, exp(e - max(e) over (partition by dst, h)) as p from e{i})",
        f"w{i} as (select src, dst, dup, h, p / sum(p) over (partition by dst, h) as a from c{i})",
        f"g{i} as (select n.id, d.k, coalesce(s.v, 0) as v from nodes n cross join (select unnest(range({HEADS * SIZE})) as k) d left join "
        f"(select w.dst, z.k, sum(w.a * z.v) as v from w{i} w join z{i} z on z.id = w.src and z.k // {SIZE} = w.h group by all) s on s.dst = n.id and s.k = d.k)",
    ]


def attention_nodes(spark, d) -> DataFrame:
    return written(L.gat_nodes(G.supply_features(spark, d), G.weights(WIDTH, HEADS * SIZE), *G.attention(HEADS, SIZE)))


_GAT = ["edges2", "feats", "nodes"]


@query(with_ctes(_GAT, f"select id, h as head, {binned_sql('el')} as el, {binned_sql('er')} as er from l0", gat_sql(0, "edges2", "feats", 4)))
def gat_logits(spark, d):
    z = attention_nodes(spark, d).select("id", F.posexplode(F.arrays_zip("el", "er")).alias("head", "p"))
    return z.select("id", "head", V.binned(F.col("p.el")).alias("el"), V.binned(F.col("p.er")).alias("er"))


@query(with_ctes(_GAT, f"select src, dst, dup, h as head, {binned_sql('e')} as e from e0", gat_sql(0, "edges2", "feats", 4)))
def sddmm(spark, d):
    e = L.edge_logits(G.supply2_edges(spark, d), attention_nodes(spark, d), HEADS)
    return e.select("src", "dst", "dup", F.posexplode("e").alias("head", "e")).withColumn("e", V.binned(F.col("e")))


@query(with_ctes(_GAT, f"select src, dst, dup, h as head, {binned_sql('a')} as a from w0", gat_sql(0, "edges2", "feats", 4)))
def edge_softmax(spark, d):
    e = L.edge_softmax(written(G.supply2_edges(spark, d)), attention_nodes(spark, d), HEADS)
    return e.select("src", "dst", "dup", F.posexplode("a").alias("head", "a")).withColumn("a", V.binned(F.col("a")))


def gat_layer_of(spark, d, **more) -> DataFrame:
    e = written(G.supply2_edges(spark, d))
    return L.gat_conv(e, G.supply_features(spark, d), G.supply_nodes(spark, d), G.weights(WIDTH, HEADS * SIZE), *G.attention(HEADS, SIZE), **more)


@query(final_sql("select id, k, case when v > 0 then v else exp(v) - 1 end as v from g0", _GAT, gat_sql(0, "edges2", "feats", 4)))
def gat_layer(spark, d):
    return long(gat_layer_of(spark, d, activation=V.elu), "id")


@query(final_sql(f"select id, k % {SIZE} as k, sum(v) / {HEADS} as v from g0 group by id, k % {SIZE}", _GAT, gat_sql(0, "edges2", "feats", 4)))
def gat_head_mean(spark, d):
    return long(gat_layer_of(spark, d, head_mean=True), "id")


@query(
    final_sql(
        "select g0.id, g0.k, g0.v + r.v as v from g0 join r on r.id = g0.id and r.k = g0.k", _GAT,
        gat_sql(0, "edges2", "feats", 4) + [f"r as ({matmul_sql('feats', '4', HEADS * SIZE, 5)})"],
    )
)
def gat_residual(spark, d):
    return long(gat_layer_of(spark, d, residual=G.weights(WIDTH, HEADS * SIZE, 5)), "id")


@query(
    final_sql(
        f"select id, k % {SIZE} as k, sum(v) / {HEADS} as v from g1 group by id, k % {SIZE}", _GAT,
        [sampled_sql("s0", "edges2", 0), sampled_sql("s1", "edges2", 1), *gat_sql(0, "s0", "feats", 4),
         "h0 as (select id, k, case when v > 0 then v else exp(v) - 1 end as v from g0)", *gat_sql(1, "s1", "h0", HEADS * SIZE)],
    )
)
def gat_2layer_sampled(spark, d):
    dims = [WIDTH, HEADS * SIZE]
    layers = []
    for i in range(2):
        left, right = G.attention(HEADS, SIZE, i)
        layers.append(Layer(G.weights(dims[i], HEADS * SIZE, i), None, left, right))
    return long(GAT(layers, FANOUT).infer(supply2(spark, d)), "id")


# -- mean aggregation -----------------------------------------------------------------------------------


def sage_sql(i: int, edges: str, x: str, ins: int, outs: int, relu: bool) -> list[str]:
    y = f"m.v + coalesce(o.v, 0) + {bias_sql('m.k', i)}"
    return [
        f"a{i} as ({spmm_sql(edges, 'sum(f.v) / count(*)', feats=x, dims=ins)})",
        f"m{i} as ({matmul_sql(f'a{i}', str(ins), outs, i)})",
        f"o{i} as ({matmul_sql(x, str(ins), outs, i + 10)})",
        f"x{i} as (select m.id, m.k, {f'greatest({y}, 0.0)' if relu else y} as v from m{i} m left join o{i} o on o.id = m.id and o.k = m.k)",
    ]


def sage_of(spark, d, **more) -> DataFrame:
    e = written(G.supply2_edges(spark, d))
    return L.sage_mean(e, G.supply_features(spark, d), G.supply_nodes(spark, d), G.weights(WIDTH, 2, 10), G.weights(WIDTH, 2), G.bias(2), **more)


_SAGE = final_sql("select * from x0", ["edges2", "feats", "nodes"], sage_sql(0, "edges2", "feats", 4, 2, False))


@query(_SAGE)
def sage_mean(spark, d):
    return long(sage_of(spark, d, multiply_first=False), "id")


@query(_SAGE)
def sage_multiply_first(spark, d):
    return long(sage_of(spark, d, multiply_first=True), "id")


@query(
    final_sql(
        "select * from x1", ["edges2", "feats", "nodes"],
        [sampled_sql("s0", "edges2", 0), sampled_sql("s1", "edges2", 1), *sage_sql(0, "s0", "feats", 4, 4, True), *sage_sql(1, "s1", "x0", 4, 3, False)],
    )
)
def sage_2layer_sampled(spark, d):
    layers = [Layer(G.weights(WIDTH, w, i), G.bias(w, i), own=G.weights(WIDTH, w, i + 10)) for i, w in ((0, 4), (1, 3))]
    return long(SAGE(layers, FANOUT).infer(supply2(spark, d)), "id")


@query(
    final_sql(
        "select m.id, m.k, m.v + coalesce(o.v, 0) as v from m left join o on o.id = m.id and o.k = m.k", ["edges2", "feats", "nodes"],
        [f"p as (select id, k, greatest(v, 0.0) as v from ({matmul_sql('feats', '4', 4, 3, bias=True)}))",
         f"a as ({spmm_sql('edges2', 'max(f.v)', feats='p')})", f"m as ({matmul_sql('a', '4', 2)})", f"o as ({matmul_sql('feats', '4', 2, 10)})"],
    )
)
def sage_pool(spark, d):
    """Mean aggregation's sibling: the largest projected neighbour by component."""
    e, f, n = written(G.supply2_edges(spark, d)), G.supply_features(spark, d), G.supply_nodes(spark, d)
    return long(L.sage_pool(e, f, n, G.weights(WIDTH, WIDTH, 3), G.bias(WIDTH, 3), G.weights(WIDTH, 2, 10), G.weights(WIDTH, 2)), "id")


@query(
    final_sql(
        f"select y.id, y.k, y.v from ({matmul_sql('h', '4', 2, bias=True)}) y", ["edges2", "feats", "nodes"],
        [_IN, f"s as ({spmm_sql('edges2')})", "h as (select s.id, s.k, (s.v + coalesce(f.v, 0)) / (coalesce(i.n, 0) + 1) as v from s left join feats f on f.id = s.id and f.k = s.k left join ind i on i.id = s.id)"],
    )
)
def sage_gcn(spark, d):
    """Mean aggregation with the node among its neighbours."""
    e, f, n = written(G.supply2_edges(spark, d)), G.supply_features(spark, d), G.supply_nodes(spark, d)
    return long(L.sage_gcn(e, f, n, G.weights(WIDTH, 2), G.bias(2)), "id")


# -- schedules ------------------------------------------------------------------------------------------

BATCH = 1000


def batch_sql(order: str) -> str:
    return (
        f"select src, dst, dup, dst_part, (case when r < n % b * (n // b + 1) then r // (n // b + 1) else n % b + (r - n % b * (n // b + 1)) // (n // b) end)::bigint as batch_id "
        f"from (select *, row_number() over (partition by dst_part order by {order}) - 1 as r, count(*) over (partition by dst_part) as n, "
        f"ceil(count(*) over (partition by dst_part) / {BATCH}.0)::bigint as b from parted)"
    )


def parted(spark, d) -> DataFrame:
    return P.edge_parts(G.supply_edges(spark, d), placed(spark, d))


@query(with_ctes(["parted"], batch_sql("dst, src, dup")))
def batch_base(spark, d):
    return H.batches(parted(spark, d), BATCH).select("src", "dst", "dup", "dst_part", "batch_id")


@query(with_ctes(["parted"], batch_sql("src, dst, dup")))
def batch_src_sorted(spark, d):
    return H.by_source(parted(spark, d), BATCH).select("src", "dst", "dup", "dst_part", "batch_id")


@query(with_ctes(["parted"], "select src, dst, dup, ((dst_part - src_part + 3) % 4)::int as round from parted"))
def batch_ring(spark, d):
    return H.ring_round(parted(spark, d), PARTS).select("src", "dst", "dup", "round")


@query(with_ctes(["parted"], "select src, dst, dup, case when src_part = dst_part then 3 else xor(src_part, dst_part) - 1 end as round from parted"))
def batch_pair(spark, d):
    return H.pair_round(parted(spark, d), PARTS).select("src", "dst", "dup", "round")


_SPLIT = "(case when r < n % b * (n // b + 1) then r // (n // b + 1) else n % b + (r - n % b * (n // b + 1)) // (n // b) end)::bigint"


def in_step_sql(rounds: str, order: str) -> str:
    """Batches of each part and round; all parts have as many in a round as the one with the fewest."""
    return (
        f"select src, dst, dup, dst_part, round, {_SPLIT} as batch_id from (select p.*, row_number() over (partition by dst_part, round order by {order}) - 1 as r, "
        f"count(*) over (partition by dst_part, round) as n, b from (select *, {rounds} as round from parted) p join (select round, min(b) as b from "
        f"(select dst_part, {rounds} as round, ceil(count(*) / {BATCH}.0)::bigint as b from parted group by all) group by all) using (round))"
    )


_STEP, _RING, _PAIR = "0", "((dst_part - src_part + 3) % 4)::int", "(case when src_part = dst_part then 3 else xor(src_part, dst_part) - 1 end)::int"


@query(with_ctes(["parted"], f"select dst_part, count(*) as edges, min(ceil(count(*) / {BATCH}.0)::bigint) over () as batches from parted group by all"))
def batch_counts(spark, d):
    """Batches of each part, as many as the part with the fewest has."""
    return H.batch_counts(parted(spark, d), BATCH, ["dst_part"], shared=[])


@query(with_ctes(["parted"], f"select * exclude (round) from ({in_step_sql(_STEP, 'dst, src, dup')})"))
def batch_in_step(spark, d):
    return H.in_step(parted(spark, d), BATCH).select("src", "dst", "dup", "dst_part", "batch_id")


@query(with_ctes(["parted"], f"select * exclude (round) from ({in_step_sql(_STEP, 'src, dst, dup')})"))
def batch_in_step_src_sorted(spark, d):
    return H.in_step(parted(spark, d), BATCH, sort_by_source=True).select("src", "dst", "dup", "dst_part", "batch_id")


@query(with_ctes(["parted"], in_step_sql(_RING, "src, dst, dup")))
def batch_ring_rounds(spark, d):
    """Source-sorted batches within each ring round."""
    return H.round_batches(H.ring_round(parted(spark, d), PARTS), BATCH).select("src", "dst", "dup", "dst_part", "round", "batch_id")


@query(with_ctes(["parted"], in_step_sql(_PAIR, "src, dst, dup")))
def batch_pair_rounds(spark, d):
    """Source-sorted batches within each round of the tournament."""
    return H.round_batches(H.pair_round(parted(spark, d), PARTS), BATCH).select("src", "dst", "dup", "dst_part", "round", "batch_id")


_BATCHES = f"b as ({batch_sql('src, dst, dup')})"
_BATCH_NODES = "bn as (select dst_part, batch_id, id, row_number() over (partition by dst_part, batch_id order by id) - 1 as local from (select dst_part, batch_id, src as id from b union select dst_part, batch_id, dst from b))"


@query(with_ctes(["parted"], "select dst_part, batch_id, local::int as local, id, gid, part_id, part_id = dst_part as inner_node from bn join placed using (id)", [_BATCHES, _BATCH_NODES]))
def batch_graph_nodes(spark, d):
    """Nodes of each batch's own graph."""
    return H.batch_nodes(H.by_source(parted(spark, d), BATCH), placed(spark, d))


@query(
    with_ctes(
        ["parted"], "select b.dst_part, b.batch_id, src, dst, dup, s.local::int as src_local, t.local::int as dst_local from b join bn s on s.dst_part = b.dst_part and s.batch_id = b.batch_id and s.id = src "
        "join bn t on t.dst_part = b.dst_part and t.batch_id = b.batch_id and t.id = dst", [_BATCHES, _BATCH_NODES],
    )
)
def batch_graph_edges(spark, d):
    b = written(H.by_source(parted(spark, d), BATCH))
    return H.batch_edges(b, H.batch_nodes(b, placed(spark, d))).select("dst_part", "batch_id", "src", "dst", "dup", "src_local", "dst_local")


@query(
    with_ctes(
        ["parted", "feats"], f"select dst_part, batch_id, id, k::int as k, {binned_sql('v')} as v from (select distinct b.dst_part, b.batch_id, b.src as id from b join placed p on p.id = b.src where p.part_id <> b.dst_part) join feats using (id)",
        [_BATCHES],
    )
)
def batch_halo_features(spark, d):
    """Vectors that each batch fetches from other parts."""
    return long(H.batch_features(H.by_source(parted(spark, d), BATCH), G.supply_features(spark, d)), "dst_part", "batch_id", "id")


def loader_sql() -> str:
    hops = []
    for i in range(2):
        hops.append(in_step_sql(_RING, "src, dst, dup").replace("parted", f"p{i}").replace("select src,", f"select {i} as layer, src,", 1))
    return with_ctes(["parted"], " union all ".join(hops), [sampled_sql("p0", "parted", 0).replace("select src, dst, dup from", "select src, dst, dup, src_part, dst_part from"), sampled_sql("p1", "parted", 1).replace("select src, dst, dup from", "select src, dst, dup, src_part, dst_part from")])


@query(loader_sql())
def loader_hops(spark, d):
    """The batches of two hops of a loader with ring rounds."""
    loader = BatchLoader(parted(spark, d), placed(spark, d), [FANOUT, FANOUT], BATCH, PARTS, "ring")
    hops = [loader.hop(i).select("layer", "src", "dst", "dup", "dst_part", "round", "batch_id") for i in range(2)]
    return hops[0].unionByName(hops[1])


@query(
    with_ctes(
        ["parted"], "select dst_part, batch_id, count(distinct src) as nodes from (select b.*, p.part_id as src_part from b join placed p on p.id = b.src) where src_part <> dst_part group by all",
        [f"b as ({batch_sql('src, dst, dup')})"],
    )
)
def halo_per_batch(spark, d):
    return H.halo_per_batch(H.by_source(parted(spark, d), BATCH))
