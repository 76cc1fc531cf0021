import pytest
from pyspark.sql import functions as F

from loomlake.llm import common
from loomlake.llm.common import Workspace, connected_components, lookup

SPLIT = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def split(spark):
    old = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark):
    return spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("x")).repartition(4)


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    out = df.withColumn("y", F.length("x"))
    out.collect()
    return out._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_broadcast_to_or_split(spark, split, monkeypatch):
    rows, work = hot(spark), Workspace(spark, "skew")
    small = work.save(rows.groupBy("k").agg(F.min("x").alias("least")))
    assert "BroadcastHashJoin" in plan_of(lookup(rows, small, "k"))
    monkeypatch.setattr(common, "LOOKUP_ROWS", 10)
    shuffled = lookup(rows, small, "k", most=10)
    assert "skew=true" in plan_of(shuffled)
    want = {r.k: r.least for r in rows.groupBy("k").agg(F.min("x").alias("least")).collect()}
    got = shuffled.select("k", "least").distinct().collect()
    assert {r.k: r.least for r in got} == want and shuffled.count() == 60_000
    # The other way round, with an aggregate beside the hot rows, Spark splits nothing.
    assert "skew=true" not in plan_of(rows.join(rows.groupBy("k").agg(F.min("x").alias("least")), "k"))


@pytest.mark.parametrize("most", [0, 200_000])
def test_components_of_a_star_and_a_path(spark, monkeypatch, most):
    monkeypatch.setattr(common.lookup, "__defaults__", ("inner", most, None))
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (2000, 1030)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "components")).collect()
    want = {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(61)} | {2000: 1000}
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
