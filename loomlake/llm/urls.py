"""URL filtering by nested host and path rules (operator 9)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, lookup, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys drawn for each range boundary, as a range partitioner draws them.
DRAWN = 60


def host_path(url) -> tuple:
    """Columns (host, path) of a url column: host after the first ``://`` up to / ? # or the end, A-Z
    lower-cased; path from there up to ? # or the end. Null, or without ``://``: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _canonical(host, path, depth=None):
    """Reversed labels of the host, a separator below any character, and the path: a rule's key is a prefix
    of exactly the keys that it fits."""
    labels = F.reverse(F.split(host, r"\."))
    return F.concat(F.concat_ws(".", labels if depth is None else F.slice(labels, F.lit(1), depth)), F.lit("\0"), path)


def _ranges(bounds: list[str]):
    """Range number of each key; a rule goes to every range that its interval [key, key + last char] meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, pid = [], []
            keys, rules = batch.column("key").to_pylist(), batch.column("rule").to_pylist()
            for n, (key, rule) in enumerate(zip(keys, rules, strict=True)):
                first = bisect_right(bounds, key)
                last = first if rule is None else bisect_right(bounds, key + "\U0010ffff")
                take.extend([n] * (last - first + 1))
                pid.extend(range(first, last + 1))
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), *out.columns], ["pid", *out.schema.names])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys in order, rules before urls: the stack holds the rules that are prefixes of the current key."""
    at, stack = None, []
    for batch in batches:
        host, path, rule, verdict, size, labels = [], [], [], [], [], []
        names = ("pid", "key", "rule", "verdict", "host", "path")
        for p, k, r, v, h, q in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if p != at:
                at, stack = p, []
            while stack and not k.startswith(stack[-1][0]):
                stack.pop()
            if r is not None:
                stack.append((k, r, v))
            elif stack:
                host.append(h), path.append(q), rule.append(stack[-1][1]), verdict.append(stack[-1][2]), size.append(len(stack[-1][0])), labels.append(stack[-1][0].index("\0"))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip((host, path, rule, verdict, size, labels), kinds, strict=True)],
            ["host", "path", "rule", "verdict", "size", "labels"],
        )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict for each row of ``pages``.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains where the url's path starts
    with the rule's path; the longest rule (host and path together, then host) wins. Without a rule the
    verdict is ``default`` and rule is null.

    Rules and urls get canonical keys (reversed host, separator, path), under which a rule is an interval.
    Each distinct (host, path) probes once for each of its domain suffixes that is no deeper than the
    deepest rule. Keys are dealt into ranges by boundaries drawn from them, each rule to all ranges it
    meets, then every range is sorted and swept once with a stack of the rules still open. Repeated urls
    collapse before the exchange, so a hot url is one probe; a hot host spreads over ranges by its paths. What is found
    is written and joined back to the rows (see ``lookup``).

    Null urls and urls without ``://`` have empty host and path. Of rules equal in host and path the one
    with the smallest verdict text holds; rules with a null column are ignored. Repeated and null ids are
    returned as they are. Other columns of either table are ignored. Empty tables are allowed.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = host_path(F.col(url_col))
    src = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    law = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
    law = law.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    deepest = law.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    law = law.select(
        _canonical(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    urls = src.select("host", "path").distinct()
    labels = F.size(F.split("host", r"\."))
    urls = urls.withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(labels, F.lit(deepest)))))
    none = F.lit(None).cast("string")
    urls = urls.select(_canonical(F.col("host"), F.col("path"), F.col("depth")).alias("key"), none.alias("rule"), none.alias("verdict"), "host", "path")

    # Boundaries: the DRAWN * parts keys of smallest hash, a fixed number however many there are.
    drawn = urls.select("key", F.xxhash64("key").alias("x")).orderBy("x").limit(DRAWN * parts)
    keys = sorted(r.key for r in drawn.collect())
    bounds = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []

    schema = "pid int, key string, rule string, verdict string, host string, path string"
    dealt = urls.unionByName(law).mapInArrow(tidy(_ranges(bounds)), schema)
    swept = dealt.repartitionById(len(bounds) + 1, "pid").sortWithinPartitions("pid", "key", F.col("rule").isNull())
    hits = swept.mapInArrow(tidy(_sweep), "host string, path string, rule string, verdict string, size int, labels int")
    order = F.struct("size", "labels", "rule", "verdict")
    best = Workspace(spark, "urls").save(hits.groupBy("host", "path").agg(F.max(order).alias("best")))
    out = lookup(src, best, ["host", "path"], "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
