import pytest

from loomlake.sources import graph_files as S
from loomlake.streaming.degrees import edge_stream, streaming_degrees


def test_edges_round_trip_with_dense_ids(spark, tmp_path):
    edges = spark.range(100).selectExpr("id * 3 % 17 as a", "id as b")
    S.write_chunks(edges, str(tmp_path / "e"), 4, "b")
    back = S.read_edges_with_ids(spark, str(tmp_path / "e"), "A", "b").collect()
    assert sorted(r.eid for r in back) == list(range(100))
    assert sorted((r.src, r.dst) for r in back) == sorted((r.a, r.b) for r in edges.collect())
    assert S.read_edges(spark, [str(tmp_path / "e")], "a", "b").count() == 100


def test_features_as_scalars_or_lists(spark, tmp_path):
    x = spark.createDataFrame([(i, [i + 0.5, float(-i), 2.0]) for i in range(9)], "id long, x array<double>")
    S.write_features(x, str(tmp_path / "f"), 3, 2)
    assert sorted(map(tuple, S.read_features(spark, str(tmp_path / "f")).collect())) == sorted(map(tuple, x.collect()))
    part = S.read_features(spark, str(tmp_path / "f"), part=1, parts=2)
    assert {tuple(r.x) for r in part.collect()} == {(2.0,)}
    plan = part._jdf.queryExecution().toString()
    assert "feat0" not in plan.split("ReadSchema")[-1]
    lists = x.selectExpr("id", "slice(x, 1, 2) as feat0", "slice(x, 3, 1) as feat1")
    lists.write.parquet(str(tmp_path / "l"))
    assert sorted(map(tuple, S.read_features(spark, str(tmp_path / "l")).collect())) == sorted(map(tuple, x.collect()))
    S.write_embeddings(x, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_column_shares():
    assert [S.column_slice(list("abcde"), i, 3) for i in range(3)] == [["a", "b"], ["c", "d"], ["e"]]
    with pytest.raises(ValueError):
        S.column_slice(["a"], 0, 2)


def test_streaming_degrees(spark, tmp_path):
    folder = str(tmp_path / "edges")
    spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src long, dst long").write.parquet(folder)
    q = streaming_degrees(edge_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    spark.createDataFrame([(3, 2)], "src long, dst long").write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    got = {r.id: (r.in_degree, r.out_degree) for r in spark.table("deg").collect()}
    assert got == {1: (0, 2), 2: (3, 1), 3: (1, 1)}


def test_timings(spark):
    from loomlake.plans.timing import Timings

    t = Timings(model="gcn")
    with t("scan"):
        pass
    with t("layer 0"):
        pass
    assert [(r.position, r.stage, r.model) for r in t.table(spark).orderBy("position").collect()] == [(0, "scan", "gcn"), (1, "layer 0", "gcn")]
