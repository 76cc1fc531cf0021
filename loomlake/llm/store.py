"""Token ids in a content-addressed store (operator 8).

Layout of a store's folder: ``packs`` (bucketed by digest: unique chunks, and the raw recipes), ``recipes`` (one row a
document in ascending id order: start, number of ids, chunk digests), ``manifests`` (one row a recipe file range:
documents, ids, Merkle root). A chunk body is the ids as little-endian unsigned integers, of 2 bytes if the vocabulary
allows, else 4.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, encoder, steps
from .common import Workspace, groups, tidy
from .words import mix

#: A chunk ends where the low bits of the rolling hash are zero, after MIN ids at least and MAX at most.
MASK, MIN, MAX = np.uint64(1023), 128, 8192
#: Ids that the rolling hash sees; fewer than MIN, so what precedes a document never decides its cuts.
SEEN = 32
#: Digests a worker remembers, whose bodies it need not send again.
SENT = 200_000
DIGEST = 16
#: A chunk with more than one in so many references is hot. There are at most so many hot ones, of at most 4 * MAX
#: bytes each (33 MB in all), so they are broadcast.
HOT = 1_000
#: The mixed values of small ids, ready made.
_GEAR = mix(np.arange(1, 65_537, dtype=np.uint64))


def marks(ids: np.ndarray) -> np.ndarray:
    """Places where a chunk may end: a shifted sum over the last SEEN ids decides, so equal passages cut alike."""
    h = _GEAR[ids] if len(ids) and ids.max() < len(_GEAR) else mix(ids.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < SEEN:
        h[size:] += h[:-size] << np.uint64(size)
        size *= 2
    return np.flatnonzero((h >> np.uint64(32)) & MASK == 0)


def ends_of(marked: list[int], at: int, stop: int) -> list[int]:
    """Ends of the chunks of the ids from ``at`` to ``stop``."""
    ends = []
    for k in marked:
        while k + 1 - at > MAX:
            at += MAX
            ends.append(at)
        if k + 1 - at >= MIN:
            at = k + 1
            ends.append(at)
    while stop - at > MAX:
        at += MAX
        ends.append(at)
    if at < stop:
        ends.append(stop)
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks."""
    return ends_of(marks(ids).tolist(), 0, len(ids))


def digest(body: bytes) -> bytes:
    return sha256(body).digest()[:DIGEST]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids with the end id behind each, and their new offsets."""
    ends = ends + np.arange(len(ends))
    out, own = np.full(int(ends[-1]), end_id, np.uint32), np.ones(int(ends[-1]), bool)
    own[ends[1:] - 1] = False
    out[own] = ids
    return out, ends


def _chunks(path: str, end_id: int, width: str):
    """One recipe row a document (kind 1), and each chunk body once a worker (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent, wide = encoder(path), set(), np.dtype(width).itemsize
        for batch in batches:
            for a, b in steps(batch.column(1)):
                part = batch.slice(a, b - a)
                tokens, ends = with_end(*enc.encode(part.column(1)), end_id)
                marked = marks(tokens)
                near = np.searchsorted(marked, ends)
                marked = marked.tolist()
                body = tokens.astype(width).tobytes()
                bounds, names, fresh, keys, recipes = [0], [], [], [], []
                for k, doc in enumerate(part.column(0).to_pylist()):
                    at, recipe = bounds[-1], []
                    for end in ends_of(marked[near[k] : near[k + 1]], int(ends[k]), int(ends[k + 1])):
                        name = digest(body[wide * at : wide * end])
                        recipe.append(name)
                        fresh.append(name not in sent)
                        sent.add(name)
                        bounds.append(end)
                        at = end
                    names += recipe
                    recipes.append(b"".join(recipe))
                    keys.append(digest(f"{doc}:".encode() + recipes[-1]))
                if len(sent) >= SENT:
                    sent.clear()
                bodies = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.array(bounds, np.int32) * np.int32(wide)), pa.py_buffer(body)])
                bodies = bodies.filter(pa.array(fresh, pa.bool_()))
                new, docs = len(bodies), len(keys)
                names = [x for x, f in zip(names, fresh, strict=True) if f]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * new + [1] * docs, pa.int32()), pa.array(names + keys, pa.binary()), pa.concat_arrays([pa.nulls(new, pa.int64()), part.column(0)]),
                     pa.concat_arrays([pa.nulls(new, pa.int64()), pa.array(np.diff(ends))]), pa.concat_arrays([bodies, pa.array(recipes, pa.binary())])],
                    ["kind", "key", "id", "n", "body"],
                )

    return run


class Merkle:
    """Root over leaves as they come: a full subtree of each size waits for its twin, so memory is logarithmic."""

    def __init__(self):
        self.open: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (1, sha256(b"\0" + leaf).digest())
        while self.open and self.open[-1][0] == node[0]:
            size, left = self.open.pop()
            node = (2 * size, sha256(b"\1" + left + node[1]).digest())
        self.open.append(node)

    def root(self) -> bytes:
        nodes = [n for _, n in self.open]
        while len(nodes) > 1:
            right = nodes.pop()
            nodes.append(sha256(b"\1" + nodes.pop() + right).digest())
        return nodes[0] if nodes else sha256(b"").digest()


def leaf(doc: int | None, n: int, recipe: bytes) -> bytes:
    return (b"" if doc is None else doc.to_bytes(8, "little", signed=True)) + n.to_bytes(8, "little") + recipe


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted recipes of one range: starts within the range, then the range's manifest as a last row."""
    tree, total, docs, part = Merkle(), 0, 0, None
    schema = ["part", "seq", "id", "start", "n", "recipe"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        seq, starts = [], []
        for i, n, body in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "body")), strict=True):
            seq.append(docs), starts.append(total)
            tree.add(leaf(i, n, body))
            docs, total = docs + 1, total + n
        if docs:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), pa.array(seq, pa.int64()), batch.column("id"), pa.array(starts, pa.int64()), batch.column("n"), batch.column("body")], schema
            )
    if docs:
        row = (part, -1, docs, total, 0, tree.root())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], schema)


class TokenStore:
    """A written store. ``packs``, ``recipes`` and ``manifests`` are its tables, ``root`` the Merkle root over the
    manifests."""

    def __init__(self, spark: SparkSession, work: Workspace, packs: DataFrame, recipes: DataFrame, manifests: DataFrame, width: str, root: bytes):
        self.spark, self.work, self.folder = spark, work, work.root
        self.packs, self.recipes, self.manifests, self.width, self.root = packs, recipes, manifests, width, root

    def read(self) -> DataFrame:
        """id, start, n_tokens, ids (little-endian uint32, binary) rebuilt from the files, every chunk's digest checked.

        The packs are bucketed by digest, so only the recipes' references move to the chunks; bodies move once, to
        their documents. References to hot chunks do not move: these chunks, of a bounded size, are broadcast to them.
        """
        refs = self.recipes.withColumn("i", F.explode(F.expr(f"sequence(0, cast(length(recipe) / {DIGEST} as int) - 1)")))
        refs = refs.select("part", "seq", "id", "start", "n", "i", F.expr(f"substring(recipe, i * {DIGEST} + 1, {DIGEST})").alias("key"))
        chunks = self.packs.where("kind = 0").select("key", "body")
        total = self.recipes.agg(F.sum(F.length("recipe"))).first()[0] or 0
        hot = refs.groupBy("key").count().where(F.col("count") > max(total / DIGEST / HOT, 1)).select("key")
        hot = self.work.save(hot)
        rows = refs.join(F.broadcast(hot), "key", "left_anti").join(chunks, "key", "left")
        held = chunks.join(F.broadcast(hot), "key", "left_semi")
        rows = rows.unionByName(refs.join(F.broadcast(hot), "key", "left_semi").join(F.broadcast(held), "key", "left"))
        rows = rows.repartition("part", "seq").sortWithinPartitions("part", "seq", "i")
        rows = rows.select("part", "seq", "id", "start", "n", "i", "key", "body")
        return rows.mapInArrow(tidy(_rebuild(self.width)), "id long, start long, n_tokens long, ids binary")


def _rebuild(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "start", "n_tokens", "ids"])

        size = 0
        for _, g in groups(batches, ["part", "seq"]):
            for key, body in zip(g["key"], g["body"], strict=True):
                if body is None or digest(body) != key:
                    raise ValueError(f"chunk {key.hex()} of document {g['id'][0]} is missing or damaged")
            ids = np.frombuffer(b"".join(g["body"]), width).astype("<u4").tobytes()
            if len(ids) != 4 * g["n"][0]:
                raise ValueError(f"document {g['id'][0]} has {len(ids) // 4} ids; its recipe says {g['n'][0]}")
            held.append((g["id"][0], g["start"][0], g["n"][0], ids))
            size += len(ids)
            if size > 4_000_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return run


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> TokenStore:
    """Encodes whole texts with the tokenizer at ``path``, adds ``end_id`` to each, and writes a store.

    Ids are cut by a rolling hash into chunks that depend on content only. Workers send each chunk they meet
    once, so a group of copies of any size costs one body a worker before the exchange, which keeps one a
    digest. Recipes are range-partitioned by id, then by their chunks and by a number among equal ones, so that rows of
    one id (or of none) are split too; starts within a range are summed as it is written, and only the ranges' totals,
    one row each, meet in the driver. Keys depend on ids and texts only, so a task may run again on reordered rows.

    Null and empty texts are documents of the end id alone. Null ids come first in the order; rows of equal id
    are all kept, in the order of their recipes. Other columns are ignored; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "store")
    size = Encoder(path).tok.get_vocab_size()
    width = "<u2" if max(size, end_id + 1) <= 65_536 else "<u4"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    rows = src.mapInArrow(tidy(_chunks(path, end_id, width)), "kind int, key binary, id long, n long, body binary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    same = [F.first(c).alias(c) for c in ("kind", "id", "n", "body")]
    rows = rows.repartition(parts, "key").groupBy("key").agg(*same, F.count("*").alias("copies"))
    name = f"packs_{uuid.uuid4().hex}"
    with work._freed():
        rows.write.bucketBy(parts, "key").sortBy("key").option("path", work.folder("packs")).option("compression", "zstd").format("parquet").saveAsTable(name)
    packs = spark.table(name)
    packs.schema  # resolved: its files and buckets are known, and the catalog need not keep the name
    spark.sql(f"drop table {name}")
    raw = packs.where("kind = 1").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("id", "n", "body", "copy")
    order = [F.col("id").asc_nulls_first(), F.col("body"), F.col("copy")]
    ranged = raw.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = work.save(ranged.drop("copy").mapInArrow(tidy(_ordered), "part int, seq long, id long, start long, n long, recipe binary"))
    ends = local.where("seq = -1").select("part", F.col("id").alias("docs"), F.col("start").alias("ids"), F.col("recipe").alias("root")).orderBy("part").collect()
    tree, base, rows = Merkle(), 0, []
    for r in ends:  # one row a range
        tree.add(bytes(r["root"]))
        rows.append((r["part"], base, r["docs"], r["ids"], bytes(r["root"])))
        base += r["ids"]
    manifests = spark.createDataFrame(rows, "part int, base long, docs long, ids long, root binary")
    manifests = work.save(manifests.coalesce(1))
    recipes = local.where("seq >= 0").join(F.broadcast(manifests.select("part", "base")), "part")
    recipes = work.save(recipes.select("part", "seq", "id", (F.col("start") + F.col("base")).alias("start"), "n", "recipe"))
    work.drop(local)
    return TokenStore(spark, work, packs, recipes, manifests, width, tree.root())


def verify(store: TokenStore) -> bool:
    """Recomputes each range's Merkle root from its recipes, in order, and the root over all of them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), g in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([g.root()], pa.binary())], ["part", "root"])

    def _runs(batches):
        at, tree = None, Merkle()
        for batch in batches:
            for p, i, n, r in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "n", "recipe")), strict=True):
                if p != at:
                    if at is not None:
                        yield (at,), tree
                    at, tree = p, Merkle()
                tree.add(leaf(i, n, r))
        if at is not None:
            yield (at,), tree

    rows = store.recipes.repartition("part").sortWithinPartitions("part", "seq").select("part", "id", "n", "recipe")
    found = {r["part"]: bytes(r["root"]) for r in rows.mapInArrow(tidy(check), "part int, root binary").collect()}
    whole = Merkle()
    for r in store.manifests.orderBy("part").collect():
        if found.get(r["part"]) != bytes(r["root"]):
            return False
        whole.add(bytes(r["root"]))
    return whole.root() == store.root


def checksums(store: TokenStore, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of each document, from the files."""
    return store.read().select(F.col("id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
