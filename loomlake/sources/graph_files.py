"""Readers and writers of edge and node-feature files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import pack
from ..operators.numbering import numbered_in_order
from .scratch import moved_file, remove, remove_all


def read_edges(spark: SparkSession, paths: str | list[str], src_col: str = "src", dst_col: str = "dst") -> DataFrame:
    """(src, dst) of one or many files, directories or globs; only these two columns are scanned."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(F.col(src_col).cast("long").alias("src"), F.col(dst_col).cast("long").alias("dst"))


def read_edges_with_ids(spark: SparkSession, paths: str | list[str], src_col: str = "src", dst_col: str = "dst") -> DataFrame:
    """(eid, src, dst) with globally unique, dense ids: the row's index in its file plus the rows of all files before it.

    The offsets come from a count for each file, so only one row a file meets in one task.
    """
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    rows = df.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        F.col(src_col).cast("long").alias("src"), F.col(dst_col).cast("long").alias("dst"),
    )
    offsets = file_offsets(rows.groupBy("file").agg(F.count("*").alias("n")))
    return rows.join(F.broadcast(offsets), "file").select((F.col("row") + F.col("offset")).alias("eid"), "src", "dst")


def file_offsets(counts: DataFrame, file_col: str = "file", count_col: str = "n") -> DataFrame:
    """Exclusive running sum of the files' row counts in order of the file."""
    before = f"coalesce(sum({count_col}) over (order by {file_col} rows between unbounded preceding and 1 preceding), 0)"
    return counts.select(file_col, count_col, F.expr(f"cast({before} as bigint)").alias("offset"))


def feature_columns(schema: T.StructType, prefix: str = "feat") -> tuple[list[str], bool]:
    """Feature segments in numeric order, and whether they are lists; names match without regard to case."""
    found = [f for f in schema.fields if f.name.lower().startswith(prefix.lower()) and f.name[len(prefix) :].isdigit()]
    if not found:
        raise ValueError(f"no column {prefix}<number> among {schema.names}")
    found.sort(key=lambda f: int(f.name[len(prefix) :]))
    kinds = {isinstance(f.dataType, T.ArrayType) for f in found}
    if len(kinds) > 1:
        raise ValueError("feature columns must be all lists or all scalars")
    return [f.name for f in found], kinds.pop()


def column_slice(columns: list[str], part: int, parts: int) -> list[str]:
    """The contiguous, balanced share ``part`` of ``parts``; the first shares get one more."""
    if parts > len(columns):
        raise ValueError(f"{parts} feature partitions need as many columns; there are {len(columns)}")
    begin, end = balanced_range(len(columns), part, parts)
    return columns[begin:end]


def read_features(
    spark: SparkSession, paths: str | list[str], id_col: str = "id", feat_col: str = "feat", part: int = 0, parts: int = 1
) -> DataFrame:
    """(id, x) where x concatenates the chosen share of the feature columns, lists or scalars; the others are not read."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    names, arrays = feature_columns(df.schema, feat_col)
    return df.select(F.col(id_col).cast("long").alias("id"), pack(column_slice(names, part, parts), arrays).alias("x"))


def chunk_files(base: str, count: int, split: bool = False, part: int = 0, parts: int = 1) -> list[str]:
    """Names ``{base}_{i}.parquet`` (``{base}_{i}_split.parquet``) of the contiguous, balanced share of ``count`` files that
    belongs to ``part``; an extension of ``base`` is left out."""
    begin, end = balanced_range(count, part, parts)
    base = base.removesuffix(".parquet")
    return [f"{base}_{i}{'_split' if split else ''}.parquet" for i in range(begin, end)]


def balanced_range(n: int, part: int, parts: int) -> tuple[int, int]:
    q, r = divmod(n, parts)
    begin = part * q + min(part, r)
    return begin, begin + q + (part < r)


def write_chunks(df: DataFrame, path: str, chunks: int, order: str | list[str], name: str = "edge_list_{}.parquet") -> list[str]:
    """``chunks`` files of exactly n // chunks rows in order, the last with the remainder too; their paths are returned,
    and earlier files of such names go. The rows are numbered in parallel; a chunk, which is one file, is one task."""
    spark, order = df.sparkSession, [order] if isinstance(order, str) else order
    placed = numbered_in_order(df, order)
    size = max(placed.count() // chunks, 1)
    chunk = F.least(F.floor(F.col("position") / size), F.lit(chunks - 1)).cast("int")
    placed = placed.withColumn("__chunk", chunk).repartition(chunks, "__chunk").sortWithinPartitions("__chunk", "position").drop("position")
    work = f"{path}/_{uuid.uuid4().hex}"
    placed.write.partitionBy("__chunk").parquet(work)
    remove_all(spark, f"{path}/{name.format('*')}")
    paths = [f"{path}/{name.format(i)}" for i in range(chunks)]
    for i, at in enumerate(paths):
        if not moved_file(spark, f"{work}/__chunk={i}", at):  # more chunks than rows
            df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{work}/__chunk={i}")
            moved_file(spark, f"{work}/__chunk={i}", at)
    remove(spark, work)
    return paths


def write_features(features: DataFrame, path: str, width: int, chunks: int) -> list[str]:
    """Export layout: ID and one scalar column for each dimension, in exact chunks."""
    flat = features.select(F.col("id").alias("ID"), *(F.col("x")[i].alias(f"feat{i}") for i in range(width)))
    return write_chunks(flat, path, chunks, ["ID"], "features_{}_split.parquet")


def write_embeddings(nodes: DataFrame, path: str) -> None:
    """One row (id, x) a node."""
    nodes.select("id", "x").write.mode("overwrite").parquet(path)
