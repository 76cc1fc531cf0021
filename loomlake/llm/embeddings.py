"""Near-duplicate vectors by random-hyperplane sign hashing (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Workspace, connected_components, groups, lookup, tidy

SEED = 7_919
#: A pair at the threshold may be missed by all tables with this probability at most.
MISS = 1e-6
#: Vectors that a bucket of the largest label should hold about, from which the bits of a key follow; at least BITS.
TARGET, BITS = 8192, 2
#: Vectors on either side of one comparison block: each member of a larger bucket goes to as many blocks as it has parts.
BLOCK = 8192
#: Cosines held at once.
CELLS = 1_000_000


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables): longer keys as the largest label grows, and the tables that then keep MISS."""
    bits = min(30, max(BITS, math.ceil(math.log2(n / TARGET)) if n > TARGET else BITS))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def width_of(bits: int) -> str:
    """Type of a packed key."""
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def _valid(label, vec, kind) -> np.ndarray | None:
    if label is None or not vec.is_valid or vec.values.null_count:
        return None
    v = vec.values.to_numpy(zero_copy_only=False).astype(kind)
    return v + kind(0) if len(v) and np.isfinite(v).all() and v.any() else None  # one zero


def _keys(bits: int, tables: int, kind):
    """Validates each vector; class digest, dimension, its bytes and the packed sign keys of all tables, by one matrix
    product for the vectors of a batch that have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            vecs = [_valid(label, v, kind) for label, v in zip(labels, batch.column(2), strict=True)]
            cs: list = [None] * len(vecs)
            keys: list = [None] * len(vecs)
            for dim in {len(v) for v in vecs if v is not None}:
                at = [k for k, v in enumerate(vecs) if v is not None and len(v) == dim]
                v = np.stack([vecs[k] for k in at]).astype(np.float64)
                v /= np.abs(v).max(1)[:, None]  # norms of very large or tiny components stay finite, multiples are equal
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))
                packed = ((v @ planes[dim] >= 0).reshape(len(at), tables, bits) * weights).sum(2).astype(width_of(bits))
                for k, row, own in zip(at, v, packed, strict=True):
                    cs[k], keys[k] = xxh3_128_digest(f"{labels[k]}:".encode() + row.tobytes()), own.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cs, pa.binary()), pa.array([0 if v is None else len(v) for v in vecs], pa.int32()),
                 pa.array([None if v is None else v.tobytes() for v in vecs], pa.binary()), pa.array(keys, pa.binary())],
                ["id", "label", "c", "dim", "v", "keys"],
            )

    return run


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest label that each one reaches when x and y are joined."""
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = np.minimum(new[label], label)
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, kind, bits: int):
    """Blocks of a bucket: exact cosines; link counts of members, and for members of one component their first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), g in groups(batches, ["bucket", "i", "j"]):
            c, mult, part, t = g["c"], np.array(g["mult"], np.int64), np.array(g["p"]), g["t"][0]
            v = np.frombuffer(b"".join(g["v"]), kind).reshape(len(c), -1).astype(np.float64)
            v /= np.abs(v).max(1)[:, None]
            v /= np.sqrt((v * v).sum(1))[:, None]
            keys = np.frombuffer(b"".join(g["keys"]), width_of(bits)).reshape(len(c), -1)[:, :t]
            links, label = np.zeros(len(c), np.int64), np.arange(len(c))
            step = max(1, CELLS // len(c))
            for at in range(0, len(c), step):
                x, y = np.nonzero(v[at : at + step] @ v.T >= threshold)
                x = x + at
                real = x < y
                if i != j:
                    real &= part[x] != part[y]
                x, y = x[real], y[real]
                if not len(x):
                    continue
                label = joined(label, x, y)
                first = ~(keys[x] == keys[y]).any(1)  # a pair counts in the first table in which it meets
                np.add.at(links, x[first], mult[y[first]])
                np.add.at(links, y[first], mult[x[first]])
            one = [c[k] for k in np.flatnonzero(links)]
            far = np.flatnonzero(label != np.arange(len(c)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one + [c[k] for k in far], pa.binary()), pa.array([None] * len(one) + [c[k] for k in label[far]], pa.binary()),
                 pa.array(links[links > 0].tolist() + [None] * len(far), pa.int64())],
                ["a", "b", "links"],
            )

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93
) -> DataFrame:
    """id, n_links, component_id, kept for each row: vectors of equal label linked at cosine >= threshold.

    Equal vectors of a label, and multiples of them, form one class with a multiplicity, so copies are never compared.
    Classes get a sign key in each of several tables of random hyperplanes; those that share label, dimension and key
    in a table are compared by exact cosine in double precision, large buckets in blocks of 2 x 8192. A vector moves once
    a table, as it was given, with its packed keys. A pair that meets in several tables counts in the first only; a block
    returns counts and a forest, not its pairs. Components come from a distributed star contraction.

    Null, empty or zero vectors, vectors with null or non-finite components and rows of null label have
    n_links 0 and are their own component. Vectors of different lengths never link. Repeated rows link with
    each other. A null id never is the smallest one; kept compares null-safely. Other columns are ignored;
    an empty input gives an empty result.
    """
    work = Workspace(vectors.sparkSession, "vectors")
    kind, sql = (np.float32, "array<float>") if dict(vectors.dtypes)[vec_col] == "array<float>" else (np.float64, "array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast(sql).alias("v"))
    most = src.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(most, threshold)
    d = work.save(src.mapInArrow(tidy(_keys(bits, tables, kind)), "id long, label long, c binary, dim int, v binary, keys binary"))
    classes = d.where("c is not null").groupBy("c").agg(
        F.count("*").alias("mult"), *(F.min(x).alias(x) for x in ("label", "dim", "v", "keys"))
    )
    classes = work.save(classes)
    size = np.dtype(width_of(bits)).itemsize
    met = classes.select("c", "label", "dim", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substr("keys", t * size + 1, F.lit(size)))).alias("t", "key"))
    bucket = ["t", "key", "label", "dim"]
    large = met.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1")
    large = work.save(large.select(*bucket, F.expr(f"cast(ceil(m / {BLOCK}) as int)").alias("parts"), F.monotonically_increasing_id().alias("bucket")))
    dealt = lookup(met, large, bucket).withColumn("p", F.expr("cast(pmod(xxhash64(c), parts) as int)"))
    dealt = dealt.withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
    by = ["bucket", "i", "j"]
    dealt = dealt.select("bucket", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "t", "p", "c")
    full = dealt.join(classes.select("c", "mult", "v", "keys"), "c").select(*by, "t", "p", "c", "mult", "v", "keys")
    found = work.save(
        full.repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(_compare(threshold, kind, bits)), "a binary, b binary, links long")
    )
    counts = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    counts = classes.select("c", "mult").join(counts, F.col("c") == F.col("a"), "left").select("c", F.expr("mult - 1 + coalesce(links, 0)").alias("n"))
    comp = connected_components(found.where("b is not null").select("a", "b"), work)
    # The smallest id of each component, by way of the classes: only then do rows move, once.
    each = d.where("c is not null").groupBy("c").agg(F.min("id").alias("id")).join(comp, F.col("c") == F.col("node"), "left")
    each = work.save(each.select("c", "id", F.coalesce("label", "c").alias("comp")).join(counts, "c"))
    least = work.save(each.groupBy("comp").agg(F.min("id").alias("least")))
    whose = work.save(lookup(each, least, "comp").select("c", "n", "least"))
    out = lookup(d.where("c is not null").select("id", "c"), whose, "c").select("id", "n", "least")
    out = out.unionByName(d.where("c is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("least")))
    work.drop(classes, large, found, comp, each, least)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("least").alias("component_id"),
        F.col("id").eqNullSafe(F.col("least")).alias("kept"),
    )
