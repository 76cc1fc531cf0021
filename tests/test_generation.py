import math

import numpy as np
import pytest

from loomlake.functions import weights as W
from loomlake.operators import generation as N
from loomlake.operators import layers as L
from loomlake.operators import partition as P
from loomlake.operators import schedule as H
from loomlake.operators.numbering import numbered_in_order
from loomlake.operators.sampling import numbered
from loomlake.plans import export
from loomlake.plans.loader import BatchLoader
from loomlake.plans.models import GAT, GCN, SAGE, GraphData
from loomlake.sources import graph_files as S


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.range(40).selectExpr("id * 3 as id")
    pairs = spark.range(900).selectExpr("(id * 7 % 37) * 3 as src", "case when id % 3 = 0 then 6 else (id * 11 % 36) * 3 end as dst")
    return nodes.cache(), pairs.cache()


def test_positions_in_order_with_a_hot_group(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', 'g' || id % 5) as g", "id * 31 % 101 as a", "id as b", "cast(null as int) as n")
    got = numbered_in_order(rows, ["a", "b"], ["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.position, r.a, r.b))
    assert len(got) == 4000
    for found in by.values():
        found.sort()
        assert [p for p, *_ in found] == list(range(len(found)))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
    whole = numbered_in_order(rows, ["b"], ["n"]).collect()
    assert all(r.position == r.b for r in whole)
    assert numbered_in_order(rows.limit(0), ["a"]).collect() == []


def test_positions_do_not_depend_on_the_buckets(spark):
    nodes = spark.range(500)
    one = {r.id: r.gid for r in P.random_positions(nodes, digits=3).collect()}
    assert one == {r.id: r.gid for r in P.random_positions(nodes, digits=1).collect()} == {r.id: r.gid for r in P.random_positions(nodes, digits=5).collect()}
    assert [P.hash_digits(n) for n in (0, 10**9, 10**10, 10**11)] == [3, 3, 4, 5]


def test_generated_graph(spark, small, tmp_path):
    nodes, pairs = small
    pairs.coalesce(1).write.parquet(str(tmp_path / "e"))
    g = N.generate_graph(nodes, N.Files(str(tmp_path / "e")), 4)
    part = {r.id: (r.gid, r.part_id) for r in g.nodes.collect()}
    assert sorted(x for x, _ in part.values()) == list(range(40))
    edges = g.edges.collect()
    assert len(edges) == 900 and len({r.eid for r in edges}) == 900
    for r in edges:
        assert (r.src_gid, r.src_part, r.dst_gid, r.owner) == (*part[r.src], part[r.dst][0], part[r.dst][1]) and r.owner == r.dst_part
    for p in range(4):
        local, mine = (x.collect() for x in g.of(p))
        assert len(mine) == sum(r.owner == p for r in edges)
        known = {r.src for r in mine} | {r.dst for r in mine} | {i for i, (_, q) in part.items() if q == p}
        assert {r.id for r in local} == known and all(r.inner_node == (part[r.id][1] == p) for r in local)
    assert {r.id for r in g.isolated.collect()} == set(part) - {r.src for r in edges} - {r.dst for r in edges}
    both = N.generate_graph(nodes, N.Files(str(tmp_path / "e")), 4, include_out_edge=True).edges.collect()
    assert len(both) == sum(1 + (r.src_part != r.dst_part) for r in edges)
    assert "owner" in g.of(1)[1]._jdf.queryExecution().toString().split("PartitionFilters")[1][:60]
    x = nodes.selectExpr("id", "array(cast(id as double)) as x")
    halo = N.halo_features(g, x).collect()
    assert len(halo) == g.local_nodes.count() and all(r.x == [r.id] for r in halo)
    assert N.generate_graph(nodes.limit(0), N.Table(spark.createDataFrame([], "eid long, src long, dst long")), 2).edges.collect() == []


@pytest.mark.parametrize("scheduler", ["base", "src", "ring", "pair"])
def test_loader_keeps_step_and_every_edge(spark, small, scheduler):
    nodes, pairs = small
    placed = P.partition_nodes(nodes, 4).cache()
    edges = P.edge_parts(numbered(pairs), placed).cache()
    loader = BatchLoader(edges, placed, [-1, 5], 60, 4, scheduler)
    for i, hop in enumerate(loader):
        rows = hop.collect()
        if i == 0:
            assert sorted((r.src, r.dst, r.dup) for r in rows) == sorted((r.src, r.dst, r.dup) for r in edges.collect())
        count, size = {}, {}
        for r in rows:
            key = (r["round"] if scheduler in ("ring", "pair") else 0, r.dst_part)
            count.setdefault(key, set()).add(r.batch_id)
            size[*key, r.batch_id] = size.get((*key, r.batch_id), 0) + 1
        for one in {k[0] for k in count}:
            n = {p: sum(v for k, v in size.items() if k[:2] == (one, p)) for q, p in count if q == one}
            assert {len(v) for k, v in count.items() if k[0] == one} == {min(math.ceil(v / 60) for v in n.values())}
        for key in count:
            sizes = [v for k, v in size.items() if k[:2] == key]
            assert max(sizes) - min(sizes) <= 1
        node, edge = loader.graphs(hop)
        local = {(*(r[k] for k in H.batch_key(hop)), r.id): r.local for r in node.collect()}
        for r in edge.collect():
            key = tuple(r[k] for k in H.batch_key(hop))
            assert (local[*key, r.src], local[*key, r.dst]) == (r.src_local, r.dst_local)
    with pytest.raises(ValueError):
        BatchLoader(edges, placed, [1], 60, 4, "other")
    with pytest.raises(ValueError):
        list(BatchLoader(edges.limit(0), placed, [1], 60, 4))


def test_weights_are_uniform_saved_and_loaded(spark, tmp_path):
    w = np.array(W.xavier_uniform(60, 40, 3))
    bound = math.sqrt(6 / 100)
    assert w.shape == (60, 40) and abs(w).max() <= bound and abs(w.mean()) < bound / 20 and w.std() == pytest.approx(bound / math.sqrt(3), rel=0.05)
    assert (w == W.xavier_uniform(60, 40, 3)).all() and (w != W.xavier_uniform(60, 40, 4)).any()
    for model in (GCN.build(3, 8, 6, 4), GAT.build(2, 8, 6, 4, [3, 2]), SAGE.build(2, 8, 6, 4)):
        path = str(tmp_path / type(model).__name__)
        model.save(spark, path)
        other = type(model)([type(x)(None) for x in model.layers])
        other.load(spark, path)
        assert [x.named(0) for x in other.layers] == [x.named(0) for x in model.layers]
    assert W.Linear.of([[1, 2], [3, 4], [5, 6]], [7, 8, 9]) == W.Linear([[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]], [7.0, 8.0, 9.0])


def test_built_models(spark, small):
    nodes, pairs = small
    x = nodes.selectExpr("id", "transform(sequence(1, 8), k -> cast((id * k) % 7 - 3 as double)) as x")
    graph = GraphData(numbered(pairs), nodes, x)
    ids = [r.id for r in nodes.orderBy("id").collect()]
    a = np.zeros((40, 40))
    for r in pairs.collect():
        a[ids.index(r.dst), ids.index(r.src)] += 1
    dense = np.array([r.x for r in x.orderBy("id").collect()])
    model = GCN.build(2, 8, 6, 4, seed=5, fanout=-1)
    for layer in model.layers:
        h = dense / np.sqrt(np.maximum(a.sum(0), 1))[:, None]
        dense = np.maximum(a @ h @ np.array(layer.weights) / np.sqrt(np.maximum(a.sum(1), 1))[:, None], 0)
    got = {r.id: r.x for r in model.infer(graph).collect()}
    assert all(got[i] == pytest.approx(v, abs=1e-9) for i, v in zip(ids, dense, strict=True))
    assert all(len(r.x) == 4 for r in GAT.build(2, 8, 6, 4, [3, 2]).infer(graph).collect())
    assert all(len(r.x) == 4 for r in SAGE.build(2, 8, 6, 4).infer(graph).collect())
    plain = GCN.build(1, 8, 8, 8, weight=False, bias=False, fanout=-1, activation=None, norm="none")
    want = a @ np.array([r.x for r in x.orderBy("id").collect()])
    got = {r.id: r.x for r in plain.infer(graph).collect()}
    assert all(got[i] == pytest.approx(v, abs=1e-9) for i, v in zip(ids, want, strict=True))
    for wrong in (lambda: GCN.build(2, 8, 6, 4, weight=False), lambda: GAT.build(2, 8, 6, 4, [4, 1]), lambda: L.graph_conv(pairs, x, nodes, None), lambda: L.graph_conv(pairs, x, nodes, [[1.0]], norm="x")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        model.infer(GraphData(numbered(pairs).limit(0), nodes, x))


def test_wide_layers_equal_dense_ones(spark, small):
    """128 components: products by the batch, sums as whole vectors."""
    nodes, pairs = small
    rnd = np.random.default_rng(1)
    ids = [r.id for r in nodes.orderBy("id").collect()]
    dense = rnd.standard_normal((40, 128))
    x = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids[:-1], dense[:-1], strict=True)], "id long, x array<double>")  # the last node has none
    dense[-1] = 0
    edges, w = numbered(pairs).cache(), W.xavier_uniform(128, 128, 2)
    a = np.zeros((40, 40))
    for r in pairs.collect():
        a[ids.index(r.dst), ids.index(r.src)] += 1
    same = lambda df, want: [np.testing.assert_allclose(r.x, want[ids.index(r.id)], atol=1e-9) for r in df.collect()]
    same(L.spmm(edges, x, nodes, 128), a @ dense)
    same(L.graph_conv(edges, x, nodes, w, [0.5] * 128, "none"), a @ dense @ np.array(w) + 0.5)
    full = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, dense, strict=True)], "id long, x array<double>")
    left, right = (W.xavier_uniform(4, 32, k) for k in (5, 6))
    z = (dense @ np.array(w)).reshape(40, 4, 32)
    el, er = (z * left).sum(2), (z * right).sum(2)
    e = el[None] + er[:, None]
    e = np.where(e > 0, e, 0.2 * e)
    p = a[:, :, None] * np.exp(e - e.max())
    out = np.einsum("vuh,uhd->vhd", p / np.maximum(p.sum(1, keepdims=True), 1e-300), z)
    same(L.gat_conv(edges, full, nodes, w, left, right), out.reshape(40, 128))
    same(L.linear(full, w, [1.0] * 128), dense @ np.array(w) + 1)
    assert L.linear(full.limit(0), w).collect() == []


def test_exact_chunks_and_their_discovery(spark, tmp_path):
    e = spark.range(103).selectExpr("id % 9 as src", "id as dst")
    paths = S.write_chunks(e, str(tmp_path), 5, ["src", "dst"])
    sizes = [spark.read.parquet(p).count() for p in paths]
    assert sizes == [20, 20, 20, 20, 23]
    rows = [tuple(r) for p in paths for r in spark.read.parquet(p).orderBy("src", "dst").collect()]
    assert rows == sorted(map(tuple, e.collect()))
    found = [S.chunk_files(f"{tmp_path}/edge_list.parquet", 5, part=i, parts=2) for i in range(2)]
    assert found == [paths[:3], paths[3:]]
    assert S.chunk_files("n", 2, split=True) == ["n_0_split.parquet", "n_1_split.parquet"]
    paths = S.write_chunks(e.limit(2), str(tmp_path), 4, "dst")
    assert [spark.read.parquet(p).count() for p in paths] == [1, 1, 0, 0]
    assert S.read_edges(spark, str(tmp_path)).count() == 2


def test_export_entry_point(spark, tmp_path, capsys):
    spark.range(10).selectExpr("id as src", "id + 1 as dst").write.parquet(str(tmp_path / "e"))
    spark.range(5).selectExpr("id", "cast(id as double) as feat0", "1.5 as feat1").selectExpr("id", "feat0", "cast(feat1 as double) as feat1").write.parquet(str(tmp_path / "n"))
    export.main(["--edges", str(tmp_path / "e"), "--features", str(tmp_path / "n"), "--edge_files", "3", "--output_dir", str(tmp_path / "out")])
    assert len(capsys.readouterr().out.split()) == 4
    back = S.read_features(spark, str(tmp_path / "out" / "features_0_split.parquet")).collect()
    assert sorted((r.id, r.x) for r in back) == [(i, [float(i), 1.5]) for i in range(5)]


def test_counts_over_a_space(spark):
    content = spark.createDataFrame([(1,), (1,), (3,), (9,)], "c long")
    got = P.count_in_space(content, spark.createDataFrame([(1,), (2,), (9,)], "id long"), "c", 5).orderBy("id").collect()
    assert [r.n for r in got] == [0, 2, 0, 0, 0]
