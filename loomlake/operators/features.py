"""Feature redistribution: the rows of wanted nodes from a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that a broadcast join may send to every executor.
BROADCAST_IDS = 1_000_000


def redistribute(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Features of the targets by a shuffle join."""
    return targets.select("id").join(features.hint("merge"), "id")


def scan_through(features: DataFrame, targets: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """The same rows from one scan of the features with the targets at hand; more than ``limit`` targets shuffle."""
    ids = targets.select("id")
    if ids.limit(limit + 1).count() > limit:
        return redistribute(features, targets)
    return features.join(F.broadcast(ids), "id")


def missing(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets without features."""
    return targets.select("id").join(features.select("id"), "id", "left_anti")


def checked(features: DataFrame, targets: DataFrame) -> DataFrame:
    """``redistribute``, but an error if a target has no features."""
    if not missing(features, targets).isEmpty():
        raise ValueError("some target nodes have no features")
    return redistribute(features, targets)
