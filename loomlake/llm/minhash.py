"""Near-duplicate documents by min-max hashing (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Workspace, connected_components, groups, lookup, tidy
from .words import mix, shingle_set

#: 80 permutations give 160 signature values (both ends of each); 40 bands of 4 miss a pair at
#: similarity 0.75 with probability (1 - 0.75^4)^40 < 3e-7.
PERMUTATIONS, ROWS = 80, 4
SEED = 20_240_501
#: Members of one comparison block, and shingles in it.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Members that one task holds against their centre.
CHUNK = 256
#: Ids that may be broadcast at once (16 MB); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


class MinMaxHasher:
    """Signatures of a set under ``n`` permutations x -> a*x + b (a odd) of the 64-bit integers.

    The minimum and the maximum of each permutation are both kept: either agrees between two sets with
    probability equal to their Jaccard similarity, so n evaluations give 2n unbiased values.
    """

    def __init__(self, n: int = PERMUTATIONS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.order = rng.permutation(2 * n)[: 2 * n // rows * rows].reshape(-1, rows)

    def signature(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 2**64 - 1, np.uint64)
        high = np.zeros(len(self.a), np.uint64)
        for i in range(0, len(s), 1024):
            z = s[i : i + 1024, None] * self.a + self.b
            low, high = np.minimum(low, z.min(0)), np.maximum(high, z.max(0))
        return np.concatenate([low, high])

    def bands(self, s: np.ndarray) -> np.ndarray:
        """One 64-bit key a band; the band's number is part of the key."""
        sig = self.signature(s)[self.order]
        key = mix(np.arange(1, len(self.order) + 1, dtype=np.uint64))
        for j in range(sig.shape[1]):
            key = mix(key ^ sig[:, j])
        return key.view(np.int64)


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMaxHasher()
        for batch in batches:
            ns, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                ns.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(hasher.bands(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n", "c", "keys"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["c", "s"]
            )

    return run


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def _stars(percent: int):
    """Sorted runs of (centre, chunk): the centre's own row comes first, each member is held against it."""
    return lambda batches: _star_batches(batches, percent)


def _star_batches(batches, percent):
    key, mid = None, np.empty(0, np.uint64)
    for batch in batches:
        a, b = [], []
        cols = [batch.column(n).to_pylist() for n in ("a", "chunk", "b", "s")]
        for ca, chunk, cb, s in zip(*cols, strict=True):
            if cb is None:
                key, mid = (ca, chunk), np.frombuffer(s, np.uint64)
                continue
            assert key == (ca, chunk), "a centre's row is missing"
            got = np.frombuffer(s, np.uint64)
            inter = len(np.intersect1d(mid, got, assume_unique=True))
            if 100 * inter >= percent * (len(mid) + len(got) - inter):
                a.append(ca)
                b.append(cb)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs; only shingles that two sets share enter the product."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    ids = np.cumsum(new) - 1
    count = np.bincount(ids) if len(ids) else np.empty(0, int)
    shared = count[ids] > 1 if len(ids) else np.empty(0, bool)
    rows, ids = rows[shared], ids[shared]
    ids = np.cumsum(np.concatenate([[False], ids[1:] != ids[:-1]])) if len(ids) else ids
    inter = np.zeros((n, n), np.float32)
    width, total = 8192, int(ids[-1]) + 1 if len(ids) else 0
    for lo in range(0, total, width):
        i, j = np.searchsorted(ids, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[rows[i:j], ids[i:j] - lo] = 1
        inter += m @ m.T
    return inter.astype(np.int64)


def _blocks(percent: int):
    """Each run is a block of a bucket: all pairs of different labels, out as a forest of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in groups(batches, ["key", "i", "j"]):
            c, label = g["c"], g["label"]
            sets = [np.frombuffer(s, np.uint64) for s in g["s"]]
            n = np.array([len(s) for s in sets], np.int64)
            _, lab = np.unique(np.array([x.hex() for x in label]), return_inverse=True)
            inter = _overlaps(sets)
            linked = similar(inter, n[:, None], n[None, :], percent) & (lab[:, None] != lab[None, :])
            parent = list(range(int(lab.max()) + 1))

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            a, b = [], []
            for x, y in np.argwhere(np.triu(linked, 1)):
                rx, ry = root(lab[x]), root(lab[y])
                if rx != ry:
                    parent[rx] = ry
                    a.append(c[x])
                    b.append(c[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 75
) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of ``docs``.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct word
    shingles; component_id is the smallest id reachable by links and kept tells whether it is the own id.

    1. One scan gives each row the size and 128-bit digest of its set and its band keys (min-max hashing).
       Rows of equal digest are one class: copies are linked without ever being compared.
    2. Classes that share a band key form a bucket. Each is held against the bucket's first class on full
       sets, hot centres in chunks, and the links found are closed to components.
    3. Buckets in which several components are left are compared completely, in blocks, by an exact matrix
       product over the shingles their members share; a block returns a forest of links, never its pairs.

    So every pair that shares a band is either verified or already in one component: no cap on bucket or
    group size. Rows without words, or with null text, have n_shingles 0 and are linked with nothing.
    Repeated rows are all returned and share their component. A null id never is the smallest one; kept
    compares null-safely, so an unlinked row of null id is kept. Other columns are ignored. An empty input
    gives an empty result. Ids are numbers (as long), strings or bytes.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    key = F.col(id_col)
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("string", "binary"):
        key, kind = key.cast("long"), "long"
    src = docs.select(key.alias("id"), F.col(text_col).alias("t"))
    d = work.save(src.mapInArrow(tidy(_digests(shingle_words)), f"id {kind}, n long, c binary, keys array<long>"))

    classes = d.where("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    banded = work.save(classes.select("c", "n", F.explode("keys").alias("key")))
    shared = banded.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("c", "n")).alias("centre")).where("m > 1")
    shared = work.save(shared.select("key", "m", F.col("centre.c").alias("centre"), F.col("centre.n").alias("n0")))
    buckets = work.save(lookup(banded, shared, "key").select("key", "centre", "n0", "m", "c", "n"))
    work.drop(banded, shared)

    # Members far from the centre in size cannot reach the threshold with it.
    near = f"100 * least(n, n0) >= {percent} * greatest(n, n0)"
    pairs = work.save(buckets.where("c > centre").where(near).select(F.col("centre").alias("a"), F.col("c").alias("b")).distinct())
    large = work.save(pairs.groupBy("a").agg(F.count("*").alias("many")).where(F.col("many") > CHUNK))
    chunk = F.expr(f"pmod(xxhash64(b), cast(ceil(coalesce(many, 1) / {CHUNK}) as int))")
    chunked = work.save(lookup(pairs, large, "a", "left").select("a", "b", chunk.alias("chunk")))
    work.drop(pairs, large)

    # Full sets of the classes that take part, from one row of each.
    wanted = buckets.select("c").distinct()
    first_ids = d.where("n > 0").groupBy("c").agg(F.min("id").alias("id"))
    rows = work.save(first_ids.join(wanted, "c"))
    ids = rows.select("id").where("id is not null").distinct()
    few = ids.count() <= BROADCAST_ROWS
    picked = src.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("t")
    if not rows.where("id is null").isEmpty():
        picked = picked.unionByName(src.where("id is null").select("t"))
    sets = picked.mapInArrow(tidy(_sets(shingle_words)), "c binary, s binary").join(rows.select("c"), "c", "left_semi")
    sets = work.save(sets.dropDuplicates(["c"]))

    members = chunked.join(sets, chunked.b == sets.c).select("a", "chunk", "b", "s")
    centres = chunked.select("a", "chunk").distinct().join(sets, F.col("a") == sets.c)
    centres = centres.select("a", "chunk", F.lit(None).cast("binary").alias("b"), "s")
    stream = members.unionByName(centres).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    links = work.save(stream.mapInArrow(tidy(_stars(percent)), "a binary, b binary"))
    first = connected_components(links, work)

    # Buckets that still hold more than one component; equal member lists in several bands count once.
    labelled = buckets.where("m > 2").join(first, F.col("c") == F.col("node"), "left")
    labelled = work.save(labelled.select("key", "c", "n", F.coalesce("label", "c").alias("label")))
    mixed = labelled.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("total"),
        F.expr("bit_xor(xxhash64(c))").alias("mark"), F.expr("bit_xor(xxhash64(c, 5))").alias("mark2"),
    )
    mixed = mixed.where("lo < hi").groupBy("mark", "mark2", "m").agg(F.min("key").alias("key"), F.first("total").alias("total"))
    mixed = mixed.select("key", F.expr(f"cast(ceil(greatest(m / {BLOCK}, total / {BLOCK_SHINGLES})) as int)").alias("parts"))
    mixed = work.save(mixed)
    dealt = lookup(labelled, mixed, "key").withColumn("p", F.expr("cast(pmod(xxhash64(c, 3), parts) as int)"))
    dealt = dealt.withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "c", "label")
    full = dealt.join(sets, "c").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = work.save(full.select("key", "i", "j", "c", "label", "s").mapInArrow(tidy(_blocks(percent)), "a binary, b binary"))

    final = first
    if not more.isEmpty():
        star = first.select(F.col("label").alias("a"), F.col("node").alias("b"))
        final = connected_components(star.unionByName(more), work)
    # The smallest id of each component, by way of the classes: only then do rows move, once.
    members = d.where("n > 0").groupBy("c").agg(F.min("id").alias("id"))
    members = work.save(members.join(final, F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("label", "c").alias("label")))
    least = work.save(members.groupBy("label").agg(F.min("id").alias("least")))
    whose = work.save(lookup(members, least, "label").select("c", "least"))
    out = lookup(d.where("n > 0").select("id", "n", "c"), whose, "c").select("id", "n", "least")
    out = out.unionByName(d.where("n = 0").select("id", "n", F.col("id").alias("least")))
    work.drop(buckets, chunked, sets, rows, links, labelled, mixed, more, first, final, members, least)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("least").alias("component_id"),
        F.col("id").eqNullSafe(F.col("least")).alias("kept"),
    )
