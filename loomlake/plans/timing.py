"""Stage timings as a table."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Timings:
    """``with timings("sample"): ...`` around each stage; ``table`` gives (position, stage, seconds, labels...)."""

    def __init__(self, **labels: str):
        self.labels, self.rows = labels, []

    @contextmanager
    def __call__(self, stage: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((len(self.rows), stage, time.perf_counter() - began, *self.labels.values()))

    def table(self, spark: SparkSession) -> DataFrame:
        more = "".join(f", `{k}` string" for k in self.labels)
        return spark.createDataFrame(self.rows, "position int, stage string, seconds double" + more)
