import numpy as np
import pytest

from loomlake.functions import vectors as V
from loomlake.operators import features as R
from loomlake.operators import layers as L
from loomlake.operators import partition as P
from loomlake.operators import schedule as H
from loomlake.operators.sampling import numbered, sample_in_edges
from loomlake.plans.models import GAT, GCN, SAGE, GraphData, Layer, widths

IDS = [10, 20, 30, 40, 50, 60]
X = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [2.0, -1.0], [0.0, 0.0], [-3.0, 2.0]]
PAIRS = [(10, 20), (10, 20), (30, 20), (20, 30), (40, 40), (40, 10)]
W = [[0.5, -1.0, 0.25], [1.0, 0.5, -0.5]]


@pytest.fixture(scope="module")
def hand(spark):
    nodes = spark.createDataFrame([(i,) for i in IDS], "id long")
    edges = numbered(spark.createDataFrame(PAIRS, "src long, dst long"))
    feats = spark.createDataFrame(list(zip(IDS, X, strict=True)), "id long, x array<double>")
    return GraphData(edges.cache(), nodes, feats)


def dense():
    a = np.zeros((6, 6))
    for s, d in PAIRS:
        a[IDS.index(d), IDS.index(s)] += 1
    return a


def rows(df):
    return {r.id: np.array(r.x) for r in df.collect()}


def same(df, expected):
    got = rows(df)
    assert set(got) == set(IDS)
    for i, v in zip(IDS, expected, strict=True):
        assert got[i] == pytest.approx(v, abs=1e-12)


def test_degrees_halo_isolated(hand):
    got = {r.id: (r.in_degree, r.out_degree) for r in P.degrees(hand.edges, hand.nodes).collect()}
    assert got == {10: (1, 2), 20: (3, 0 + 1), 30: (1, 1), 40: (1, 2), 50: (0, 0), 60: (0, 0)}
    inner = hand.nodes.where("id in (20, 50)")
    assert {r.id for r in P.halo_nodes(hand.edges, inner).collect()} == {10, 30}
    assert {r.id for r in P.isolated_nodes(hand.nodes, hand.edges).collect()} == {50, 60}
    assert P.in_edges(hand.edges, inner).count() == 3
    assert P.incident_edges(hand.edges, inner).count() == 4


def test_sums_and_means(hand):
    a, x = dense(), np.array(X)
    same(L.spmm(hand.edges, hand.features, hand.nodes, 2), a @ x)
    same(L.spmm_mean(hand.edges, hand.features, hand.nodes, 2), (a @ x) / np.maximum(a.sum(1), 1)[:, None])


@pytest.mark.parametrize("norm", ["none", "right", "left", "both"])
def test_graph_convolution(hand, norm):
    a, x, b = dense(), np.array(X), [0.1, 0.2, 0.3]
    i, o = np.maximum(a.sum(1), 1)[:, None], np.maximum(a.sum(0), 1)[:, None]
    h = x / o if norm == "left" else x / np.sqrt(o) if norm == "both" else x
    y = a @ h @ np.array(W)
    y = y / i if norm == "right" else y / np.sqrt(i) if norm == "both" else y
    same(L.graph_conv(hand.edges, hand.features, hand.nodes, W, b, norm, V.relu), np.maximum(y + b, 0))


def attention(x, w, left, right, residual=None):
    heads, size = np.array(left).shape
    z = (x @ w).reshape(len(x), heads, size)
    el, er = (z * left).sum(2), (z * right).sum(2)
    out = np.zeros_like(z)
    for v in range(len(x)):
        edges = [IDS.index(s) for s, d in PAIRS if d == IDS[v]]
        for h in range(heads):
            e = np.array([el[u, h] + er[v, h] for u in edges])
            e = np.where(e > 0, e, 0.2 * e)
            p = np.exp(e - e.max()) if len(e) else e
            for u, q in zip(edges, p / p.sum() if len(e) else [], strict=True):
                out[v, h] += q * z[u, h]
    return out


LEFT, RIGHT, WIDE = [[0.5, -1.0], [1.0, 0.25]], [[-0.5, 0.5], [0.75, 1.0]], [[0.5, -1.0, 0.25, 1.0], [1.0, 0.5, -0.5, 2.0]]


def test_attention(hand):
    z = attention(np.array(X), np.array(WIDE), LEFT, RIGHT)
    same(L.gat_conv(hand.edges, hand.features, hand.nodes, WIDE, LEFT, RIGHT), z.reshape(6, 4))
    same(L.gat_conv(hand.edges, hand.features, hand.nodes, WIDE, LEFT, RIGHT, head_mean=True), z.mean(1))
    same(L.gat_conv(hand.edges, hand.features, hand.nodes, WIDE, LEFT, RIGHT, residual=WIDE), z.reshape(6, 4) + np.array(X) @ WIDE)
    a = L.edge_softmax(hand.edges, L.gat_nodes(hand.features, WIDE, LEFT, RIGHT), 2).collect()
    assert len(a) == 6
    for d in {r.dst for r in a}:
        assert np.sum([r.a for r in a if r.dst == d], axis=0) == pytest.approx([1, 1])


def test_mean_aggregation_in_either_order(hand):
    a, x = dense(), np.array(X)
    mean = (a @ x) / np.maximum(a.sum(1), 1)[:, None]
    expected = x @ W + mean @ W + [1, 2, 3]
    for first in (True, False):
        same(L.sage_mean(hand.edges, hand.features, hand.nodes, W, W, [1.0, 2.0, 3.0], multiply_first=first), expected)


def test_models_without_sampling(hand):
    sq = [[0.5, -1.0], [1.0, 0.5]]
    a, x = dense(), np.array(X)
    for _ in range(2):
        x = np.maximum((a @ x @ sq) / np.maximum(a.sum(1), 1)[:, None], 0)
    same(GCN([Layer(sq), Layer(sq)], fanout=-1).infer(hand), x)
    z = attention(np.array(X), np.array(WIDE), LEFT, RIGHT).reshape(6, 4)
    z = np.where(z > 0, z, np.exp(np.minimum(z, 0)) - 1)
    last = attention(z, np.array([[1.0, 0.5, 0, 0.5]] * 4), LEFT, RIGHT).mean(1)
    same(GAT([Layer(WIDE, None, LEFT, RIGHT), Layer([[1.0, 0.5, 0, 0.5]] * 4, None, LEFT, RIGHT)], fanout=-1).infer(hand), last)
    assert len(rows(SAGE([Layer(sq, own=sq)], fanout=2).infer(hand))) == 6
    assert widths(3, 8, 16, 4) == [(8, 16), (16, 16), (16, 4)]


def test_sampling_contract(spark, hand):
    s = sample_in_edges(hand.edges, 2).collect()
    assert sum(r.dst == 20 for r in s) == 2 and len(s) == 5
    assert len({(r.src, r.dst, r.dup) for r in s}) == 5
    assert sample_in_edges(hand.edges, -1).count() == 6
    big = numbered(spark.range(2000).selectExpr("id % 97 as src", "id % 5 as dst"))
    one, two = (set(map(tuple, sample_in_edges(big, 10, layer).select("src", "dst", "dup").collect())) for layer in (0, 1))
    assert len(one) == len(two) == 50 and one != two
    assert one == set(map(tuple, sample_in_edges(big.repartition(7), 10, 0).select("src", "dst", "dup").collect()))


@pytest.mark.parametrize(("n", "parts"), [(10, 4), (7, 3), (3, 4), (0, 2), (100, 7)])
def test_balanced_parts(spark, n, parts):
    offsets = P.balanced_offsets(parts, n)
    placed = P.partition_nodes(spark.range(n), parts).collect()
    assert sorted(r.gid for r in placed) == list(range(n))
    for r in placed:
        assert offsets[r.part_id] <= r.gid < offsets[r.part_id + 1]


def test_schedules_keep_every_edge(spark):
    nodes = P.partition_nodes(spark.range(40), 4)
    edges = numbered(spark.range(1000).selectExpr("id % 37 as src", "(id * 7) % 40 as dst"))
    e = P.edge_parts(edges, nodes).cache()
    for b in (H.batches(e, 100), H.by_source(e, 100)):
        sizes = {}
        for r in b.collect():
            sizes[r.dst_part, r.batch_id] = sizes.get((r.dst_part, r.batch_id), 0) + 1
        assert sum(sizes.values()) == 1000 and max(sizes.values()) <= 100
    assert {r["round"] for r in H.ring_round(e, 4).where("src_part = dst_part").collect()} == {3}
    assert H.pair_round(e, 4).select("src_part", "dst_part", "round").distinct().groupBy("dst_part", "round").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError):
        H.pair_round(e, 6)


def test_redistribution_agrees_and_checks(spark, hand):
    want = spark.createDataFrame([(10,), (60,)], "id long")
    a, b = rows(R.redistribute(hand.features, want)), rows(R.scan_through(hand.features, want))
    assert a.keys() == b.keys() == {10, 60}
    assert rows(R.scan_through(hand.features, want, limit=1)).keys() == {10, 60}
    with pytest.raises(ValueError):
        R.checked(hand.features, spark.createDataFrame([(99,)], "id long"))
