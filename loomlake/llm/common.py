"""Shared folders, materialised steps, sorted-group streaming and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a lookup table (of some tens of bytes each) that may be broadcast.
LOOKUP_ROWS = 200_000
#: Rows of an Arrow batch at most: texts have any length, so Spark's default of 10,000 rows bounds no memory.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


#: Input batches after which a worker gives memory back.
TIDY = 8


def give_back() -> None:
    """Memory that Arrow and the C library hold for later goes back to the system, where they can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """The same function of batches, which gives memory back now and then and at the end: workers are used again, and
    what one stage has freed would count beside what the next one needs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches, 1):
            yield batch
            if n % TIDY == 0:
                del batch
                give_back()

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(counted(batches))
        finally:
            give_back()

    return tidied


class Workspace:
    """Named intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage, survives lost executors and keeps true sizes for later planning.
    ``drop`` removes tables that nothing reads any more; what the returned DataFrame reads stays, as a
    reliable checkpoint would, until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        with self._freed():
            df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        self._keep = getattr(self, "_keep", []) + [back]
        return back

    @contextlib.contextmanager
    def _freed(self):
        """Shuffle files of the write go when it ends, where this Spark can do that."""
        old = self.spark.conf.get(_CLEANUP, None)
        try:
            self.spark.conf.set(_CLEANUP, "true")
        except Exception:  # another Spark version: its files go with the driver's garbage
            yield
            return
        try:
            yield
        finally:
            if old is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, old)

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                remove(self.spark, path)


def lookup(rows: DataFrame, small: DataFrame, on, how: str = "inner", most: int = LOOKUP_ROWS, listed: str | None = None) -> DataFrame:
    """``rows`` joined to a table that has been written, of one short row a key: broadcast where its number of rows (or of
    the elements of its column ``listed``) allows, so hot keys do not move; beyond it both sides are scans, and Spark's skew
    handling splits a hot key (it does not where a side is an aggregate on the same key)."""
    n = small.count() if listed is None else small.agg(F.sum(F.greatest(F.size(listed), F.lit(1)))).first()[0] or 0
    return rows.join(F.broadcast(small) if n <= most else small, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns) of each run of equal keys in a partition that is sorted by them; holds one run at a time."""
    key, held = None, None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        marks = list(zip(*(cols[k] for k in keys), strict=True))
        start = 0
        for i in range(1, len(marks) + 1):
            if i < len(marks) and marks[i] == marks[start]:
                continue
            if marks and marks[start] == key and held is not None:
                for n, v in cols.items():
                    held[n].extend(v[start:i])
            else:
                if held is not None:
                    yield key, held
                if marks:
                    key, held = marks[start], {n: v[start:i] for n, v in cols.items()}
            start = i
    if held is not None:
        yield key, held


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, label) for each node of the undirected edges (a, b); label is the smallest node of its component.

    Alternates large-star and small-star steps: each node hands its neighbours the smallest one, so the
    number of edges never grows and a path shrinks to a star in a logarithmic number of rounds. Every
    round is a partial aggregate, written, and a join to that table, so that a hot node's edges are broadcast to or
    split (see ``lookup``). Null ends and loops are ignored. The result is a written table.
    """
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = work.save(pair.where("a < b").distinct())

    def done(df: DataFrame) -> bool:
        """Stars only: each far end has one centre, and no centre is a far end."""
        ends = df.select(F.col("b").alias("x"), F.lit(1).alias("far"), F.lit(0).alias("mid")).unionByName(
            df.select(F.col("a").alias("x"), F.lit(0).alias("far"), F.lit(1).alias("mid"))
        )
        each = ends.groupBy("x").agg(F.sum("far").alias("far"), F.max("mid").alias("mid"))
        return each.where("far > 1 or (far > 0 and mid > 0)").isEmpty()

    while not done(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = lookup(both.where("v > u"), least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = work.save(large.where("a < b").distinct())
        down = work.save(large.groupBy("b").agg(F.min("a").alias("m")))
        small = lookup(large, down, "b").select("m", "a", "b")
        small = small.select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a")).where("a < b")
        new = work.save(small.select("a", "b").distinct())
        work.drop(e, least, large, down)
        e = new
    star = e.select(F.col("b").alias("node"), F.col("a").alias("label"))
    found = work.save(star.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()))
    work.drop(e)
    return found
