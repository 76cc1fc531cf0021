from loomlake.plans import catalog


def test_padding_keeps_every_value(spark, tmp_path):
    """The longest order sets the width, and no value or length is cut."""
    lists = {1: [5.0], 2: [float(v) for v in range(7, 0, -1)], 3: [2.0] * 9, 4: [float(v % 4) for v in range(30)]}
    rows = [(i, v) for i, x in lists.items() for v in x]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.id, r.k): r.v for r in catalog.QUERIES["pad_vectors"](spark, str(tmp_path)).collect()}
    want = {(i, k): v for i, x in lists.items() for k, v in enumerate(sorted(x) + [0.0] * (30 - len(x)) + [float(len(x))])}
    assert got == want


def test_padding_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalog.QUERIES["pad_vectors"](spark, str(tmp_path)).collect() == []
