"""In- and out-degrees of a growing edge table.

Edge files that arrive in a folder are read as a stream; the counts are a stateful aggregate keyed by node, so
a new file only touches the nodes it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


def edge_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EDGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of the nodes seen so far; rows with a null end count for the other one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    rows = ends.select("e.*").where("id is not null")
    return rows.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
