"""Removal of passages that an earlier document has too, by De Bruijn compaction (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Workspace, lookup, tidy
from .words import mix, rolling, split_words, wide_hashes

#: Words of an anchor, the smallest of whose hashes in a window stands for the window.
ANCHOR = 5
#: Hashes of 8 bytes that may be broadcast.
NODES = 1_000_000
_IN, _OUT = np.uint64(0x632BE59BD9B4E019), np.uint64(0x85157AF5B2A5C3D1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: equal windows have equal anchors, and neighbours mostly share theirs."""
    return sliding_min(rolling(h, ANCHOR), window - ANCHOR + 1)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(anchors(wide_hashes(split_words(t.as_py()))[:, 0], window)) for t in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids, pa.int64())], ["h", "id"])

    return run


def _runs(window: int):
    """Maximal runs of windows whose anchors are repeated: start, the digests of the words they span, and the digest
    of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ks, starts, spans = [], [], [], []
            for i, k, t, hs in zip(*(batch.column(n) for n in ("id", "k", "t", "hs")), strict=True):
                h = wide_hashes(split_words(t.as_py()))
                wanted = np.asarray(hs.values.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
                on = np.isin(anchors(h[:, 0], window), wanted)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    ids.append(i.as_py()), ks.append(k.as_py()), starts.append(a), spans.append(h[a : b + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(starts, pa.int32()), pa.array(spans, pa.binary()),
                 pa.array([xxh3_128_digest(s) for s in spans], pa.binary())],
                ["id", "k", "start", "span", "run"],
            )

    return run


def _nodes(window: int, ways: bool):
    """The nodes ((window - 1)-grams) of each run: with the hash of what precedes and follows, or with places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("span").to_pylist()
            words = np.array([len(s) // 16 for s in spans], np.int64)
            flat = np.frombuffer(b"".join(spans), np.uint64)[::2]
            count = words - window + 2
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(words) - words, count) + place
            node = pa.array(rolling(flat, window - 1)[at].view(np.int64))
            if ways:
                before = np.where(place == 0, np.uint64(0), flat[at - 1])
                last = place == np.repeat(count, count) - 1
                after = np.where(last, np.uint64(0), flat[np.where(last, 0, at + window - 1)])
                way = mix(mix(before + _IN) ^ (after + _OUT))
                yield pa.RecordBatch.from_arrays([node, pa.array(way.view(np.int64))], ["node", "way"])
            else:
                number = np.repeat(batch.column("number").to_numpy(zero_copy_only=False), count)
                yield pa.RecordBatch.from_arrays([node, pa.array(number, pa.int64()), pa.array(place.astype(np.int32))], ["node", "number", "pos"])

    return run


def _paths(window: int):
    """Cuts each run at its branching nodes: the paths with a digest of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, starts, sizes, digests, los, his = [], [], [], [], [], []
            for name, span, cuts, lo, hi in zip(*(batch.column(n).to_pylist() for n in ("run", "span", "cuts", "lo", "hi")), strict=True):
                windows = len(span) // 16 - window + 1
                at = [0, *sorted({c for c in cuts or [] if 0 < c < windows}), windows]
                for a, b in zip(at, at[1:], strict=False):
                    runs.append(name), starts.append(a), sizes.append(b - a + window - 1), los.append(lo), his.append(hi)
                    digests.append(xxh3_128_digest(span[16 * a : 16 * (b + window - 1)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs, pa.binary()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(los, pa.int64()), pa.array(his, pa.int64())],
                ["run", "start", "size", "path", "lo", "hi"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, kept = [], [], []
        for t, spans in zip(batch.column("t"), batch.column("spans").to_pylist(), strict=True):
            words = split_words(t.as_py())
            on = np.ones(len(words), bool)
            for start, size in zip(spans[::2], spans[1::2], strict=True) if spans else ():
                on[start : start + size] = False
            n.append(len(words))
            gone.append(int(len(words) - on.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(on)] if gone[-1] else words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n", "gone", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """id, n_words, n_removed, kept_text for each row: words of repeated passages go, the rest joined by a space.

    A word goes when a window of ``window`` consecutive words covers it whose word sequence also starts in
    a row of smaller id; windows are judged on the input.

    1. Each window is stood for by its anchor, the smallest hash of its 5-word grams; a document has one
       distinct anchor for about five windows. Anchors of one row only are dropped by a partial aggregate.
    2. Runs of windows with repeated anchors are told apart by a 128-bit digest. Equal ones are one run from here on, with
       the smallest and the largest id that has it, so copies and shared passages of any number count once.
    3. Runs become paths of a De Bruijn graph: 13-grams are edges, 12-grams nodes. A node is simple if all its
       occurrences have the same neighbours; a join marks the others.
    4. Runs are cut at the marked nodes. All documents with an edge of such a nonbranching path have the
       whole path, so one row stands for its windows, and its first owner is the smallest id among the runs
       whose words at the path's coordinates agree: the digest of a path is over 128-bit digests of its words.

    Texts move twice: to their repeated anchors, and to their spans. Broadcasting these where they are few would make
    small inputs tell nothing of large ones.

    Null text has no words. Rows of null id are neither cut nor a source. Rows of one id are never sources
    for each other; each is returned. Other columns are ignored; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "substrings")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    known = src.where("id is not null and t is not null")
    a = work.save(known.select("id", "t").mapInArrow(tidy(_anchors(window)), "h long, id long"))
    repeated = work.save(a.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    wanted = work.save(lookup(a, repeated, "h", most=NODES).groupBy("id").agg(F.collect_set("h").alias("hs")))
    work.drop(a, repeated)
    texts = known.withColumn("k", F.xxhash64("t")).join(wanted, "id").select("id", "k", "t", "hs")
    every = work.save(texts.mapInArrow(tidy(_runs(window)), "id long, k long, start int, span binary, run binary"))
    work.drop(wanted)
    runs = every.groupBy("run").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("span").alias("span"))
    runs = work.save(runs.withColumn("number", F.monotonically_increasing_id()))
    nodes = runs.select("span").mapInArrow(tidy(_nodes(window, True)), "node long, way long")
    marked = nodes.groupBy("node").agg(F.min("way").alias("lo"), F.max("way").alias("hi")).where("lo < hi").select("node")
    marked = work.save(marked)
    places = runs.select("number", "span").mapInArrow(tidy(_nodes(window, False)), "node long, number long, pos int")
    cuts = lookup(places, marked, "node", "left_semi", NODES).groupBy("number").agg(F.collect_set("pos").alias("cuts"))
    paths = runs.join(cuts, "number", "left").select("run", "span", "cuts", "lo", "hi")
    paths = work.save(paths.mapInArrow(tidy(_paths(window)), "run binary, start int, size int, path binary, lo long, hi long"))
    work.drop(runs, marked)
    first = work.save(paths.groupBy("path").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last").select("path", "first"))
    owned = lookup(paths, first, "path").where("hi > first")
    owned = work.save(owned.groupBy("run").agg(F.collect_list(F.struct("start", "size", "first")).alias("paths")))
    gone = lookup(every.select("id", "k", "start", "run"), owned, "run", listed="paths")
    mine = F.transform(F.filter("paths", lambda p: p["first"] < F.col("id")), lambda p: F.array(F.col("start") + p["start"], p["size"]))
    gone = gone.select("id", "k", F.flatten(mine).alias("mine")).where(F.size("mine") > 0)
    gone = work.save(gone.groupBy("id", "k").agg(F.flatten(F.collect_set("mine")).alias("spans")))
    work.drop(every, paths, first, owned)
    full = src.withColumn("k", F.xxhash64("t")).join(gone, ["id", "k"], "left").select("id", "t", "spans")
    out = full.mapInArrow(tidy(_cut), "id long, n long, gone long, kept string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("gone").alias("n_removed"), F.col("kept").alias("kept_text"))
