"""Dense positions in a sort order, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered_in_order(rows: DataFrame, order: list[str], groups: list[str] | None = None, column: str = "position") -> DataFrame:
    """Rows with their position from 0 in the sort order, within each of the groups (null-safe) if there are any.

    Rows are range-partitioned by groups and order and written with the number of their range; within a range they are
    ranked locally, and only the ranges' counts (ranges times groups) meet in one task. So a group or a first key that
    holds most rows is spread over many tasks. Rows that are equal in the order are numbered in any way.
    """
    groups = groups or []
    ranged = written(rows.repartitionByRange(*groups, *order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy(*groups, "__range").agg(F.count("*").alias("__n"))
    within = f"partition by {', '.join(groups)} " if groups else ""
    before = f"coalesce(sum(__n) over ({within}order by __range rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)), F.col("__range").alias("__r"), F.expr(f"cast({before} as bigint)").alias("__before"))
    rank = F.expr(f"row_number() over (partition by {', '.join([*groups, '__range'])} order by {', '.join(order)}) - 1")
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = ranged.withColumn("__rank", rank).join(F.broadcast(offsets), same)
    return out.select(*rows.columns, (F.col("__before") + F.col("__rank")).cast("long").alias(column))


def sorted_with_positions(rows: DataFrame, column: str) -> DataFrame:
    """(value, position): the values in ascending order with the place each had; rows need a column ``position``."""
    return rows.select(F.col(column).alias("value"), "position").orderBy("value", "position")
