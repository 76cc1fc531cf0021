"""Benchmark decontamination by rare-word seeds and Smith-Waterman alignment (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import raw, steps
from .common import Workspace, bounded_batches, tidy

#: Shorter items are copied only as a whole.
LEAST = 3
#: Places of an item's filter of words, a power of two.
FILTER = 1024
#: Words of benchmark items that one broadcast block may hold, besides those of one item: its words, seeds and items take
#: about 100 MB then.
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: What a cluster of seeds costs, in places of seeds.
LOOKS = 100
#: Cells of a row of alignments at once.
CELLS = 30_000
#: Share of an item's perfect score from which a passage is a copy of it. Items of three in ten replaced words score 0.55
#: on average; the README gives the rates.
THRESHOLD = 0.42

_WORD = np.array([(c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD.tobytes()).split() if text else []


class Vocabulary:
    """Numbers of known words; those of the words of many texts at once."""

    def __init__(self, words: list[bytes]):
        self.size = len(words)
        self.known = pa.array([w + b" " for w in words] + words, pa.binary())

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word of all texts, -1 if unknown; n + 1 offsets of the texts' words)."""
        data, at = raw(texts)
        data = _WORD[data]
        gap = data == 32
        begin = at[:-1][at[1:] > at[:-1]]
        before = np.ones(len(data), bool)
        before[1:] = gap[:-1]
        before[begin] = True
        kept = np.concatenate([[0], np.cumsum(~(gap & before))])  # one space behind a word at most
        first = before & ~gap
        places = kept[np.flatnonzero(first)].astype(np.int32)
        data = np.ascontiguousarray(data[~(gap & before)])
        bounds = np.append(places, np.int32(len(data)))
        words = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        number = pc.fill_null(pc.index_in(words.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        number = np.where(number >= self.size, number - self.size, number).astype(np.int64)
        return number[words.indices.to_numpy(zero_copy_only=False)], np.concatenate([[0], np.cumsum(first)])[at]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """(best local score, its last place in the passage) with linear gaps; one vectorised row an item word."""
    steps = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1)
    best, end = 0.0, -1
    for w in item:
        diagonal = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], diagonal)
        row = np.maximum.accumulate(new + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k - 1
    return best, end


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    """The rows side by side as columns, filled up at their ends."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.full((len(rows), int(size.max())), fill, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(rows)
    return out.T.copy()


def best_scores(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local score of each item with its passage, as ``align`` gives it: a row of all of them at a time, whose
    cells follow each other over the passages' words."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda k: (len(passages[k]), len(items[k])))
    while order:
        n, most = 1, 64 + 2 * len(passages[order[0]])
        while n < len(order) and len(passages[order[n]]) <= most and (n + 1) * len(passages[order[n]]) < CELLS:
            n += 1
        now, order = order[:n], order[n:]
        a, b = padded([items[k] for k in now], -2), padded([passages[k] for k in now], -3)
        steps = (np.arange(len(b) + 1, dtype=np.int32) * -GAP)[:, None]
        row, best = np.zeros((len(b) + 1, n), np.int32), np.zeros(n, np.int32)
        for word in a:
            new = row + GAP
            np.maximum(new[1:], row[:-1] + np.where(b == word, np.int32(MATCH), np.int32(MISMATCH)), out=new[1:])
            np.maximum(new, 0, out=new)
            new += steps
            np.maximum.accumulate(new, axis=0, out=new)
            new -= steps
            row = new
            np.maximum(best, row.max(0), out=best)
        out[now] = best
    return out


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """(least, span): an alignment at the threshold matches at least ``least`` words, in at most ``span`` of the passage.

    With m of n words matched and i put in, 2 m - i >= 2 t n: so m >= t n, and the passage has at most
    n + i <= n (3 - 2 t) words.
    """
    least = min(max(1, math.ceil(threshold * size - 1e-9)), size)
    return least, max(size, math.floor(size * (3 - 2 * threshold) + 1e-9))


def seeds(rates: np.ndarray, threshold: float) -> tuple[int, int]:
    """(number of seeds, hits among them that any alignment at the threshold has) of an item with these rates of its
    words in the documents, rarest first. All but ``least`` words and h more share h with any ``least`` of them; the h
    is taken that costs least: a look at each seed's place, and LOOKS of them where it begins a cluster of h, if words come
    independently."""
    least, span = bounds(len(rates), threshold)
    best = (math.inf, 0, 0)
    for hits in range(1, least + 1):
        n = len(rates) - least + hits
        total = float(rates[:n].sum())
        mean, term, below = span * total, math.exp(-span * total), 0.0
        for k in range(hits - 1):
            below += term
            term *= mean / (k + 1)
        best = min(best, (total * (1 + LOOKS * max(1 - below, 1e-9)), n, hits))
    return best[1], best[2]


def places(item: np.ndarray) -> dict[int, int]:
    """Bits of the places of each word of the item."""
    out: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def in_order(where: dict[int, int], size: int, passage: list[int]) -> int:
    """Words of the item that the passage holds in the item's order (longest common subsequence, a bit a word)."""
    full = (1 << size) - 1
    free = full
    for w in passage:
        if m := where.get(w):
            hit = free & m
            free = ((free + hit) | (free - hit)) & full
    return size - free.bit_count()


def orders(bits: list[list[int]], sizes: list[int]) -> np.ndarray:
    """``in_order`` of many passages, given as the bits of the places of each of their words; items of up to 63 words go
    side by side in machine words."""
    out = np.zeros(len(bits), np.int64)
    long = [k for k, n in enumerate(sizes) if n > 63]
    for k in long:
        out[k] = in_order(dict(enumerate(bits[k])), sizes[k], list(range(len(bits[k]))))
    rest = sorted((k for k, n in enumerate(sizes) if n <= 63), key=lambda k: len(bits[k]))
    for i in range(0, len(rest), 512):
        now = rest[i : i + 512]
        width = len(bits[now[-1]])
        places = np.array([bits[k] + [0] * (width - len(bits[k])) for k in now], np.uint64).T.copy()
        full = np.array([(1 << sizes[k]) - 1 for k in now], np.uint64)
        free = full.copy()
        for m in places:
            hit = free & m
            free = ((free + hit) | (free - hit)) & full
        out[now] = np.array([sizes[k] for k in now]) - np.bitwise_count(free)
    return out


def limit(size: int, threshold: float) -> float:
    return threshold if size >= LEAST else 1.0


def passages(first: np.ndarray, last: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Words (from, to) of all passages of ``span`` words around the hits first..last (ascending), merged where they meet."""
    out, start, stop = [], max(int(last[0]) - span + 1, 0), int(first[0]) + span
    for a, b in zip(first[1:].tolist(), last[1:].tolist(), strict=True):
        if b - span + 1 >= stop:
            out.append((start, stop))
            start = b - span + 1
        stop = a + span
    return [*out, (start, stop)]


def _frequencies(shared):
    """Places of each word of the block, summed over a partition, and of all words (as number -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        count, words = np.zeros(vocabulary.size, np.int64), 0
        for batch in batches:
            for a, b in steps(batch.column(0)):
                number, _ = vocabulary.numbers(batch.column(0).slice(a, b - a))
                count += np.bincount(number[number >= 0], minlength=vocabulary.size)
                words += len(number)
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found], pa.int64()), pa.array([words, *count[found]], pa.int64())], ["g", "n"])

    return run


@dataclass
class Block:
    """Items as word numbers, and for each word the items it is a seed of (``owners[begin[w] : begin[w + 1]]``)."""

    vocabulary: Vocabulary
    names: list[int]
    items: list[np.ndarray]
    begin: np.ndarray
    owners: np.ndarray
    hits: np.ndarray
    threshold: float

    def clusters(self, number: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, item, first and last word of the closest hits) wherever enough seeds of an item lie near each other."""
        spans = np.array([bounds(len(w), limit(len(w), self.threshold))[1] for w in self.items])
        many = np.where(number >= 0, self.begin[number + 1] - self.begin[number], 0)
        place = np.flatnonzero(many)
        many = many[place]
        k = np.repeat(self.begin[number[place]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pos, own = np.repeat(place, many), self.owners[k]
        text = np.repeat(np.searchsorted(at, place, "right") - 1, many)
        key = text * len(self.items) + own
        order = np.argsort(key, kind="stable")  # places ascend already
        pos, key = pos[order], key[order]
        end = np.arange(len(key)) + self.hits[key % len(self.items)] - 1
        first = np.flatnonzero(end < len(key))
        last = end[first]
        close = (key[last] == key[first]) & (pos[last] - pos[first] < spans[key[first] % len(self.items)])
        first, last = first[close], last[close]
        cut = np.flatnonzero(np.diff(key[first])) + 1
        first_at, last_at, owner = pos[first], pos[last], key[first]
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(first)], strict=True):
            if a < b:
                n, item = divmod(int(owner[a]), len(self.items))
                yield n, item, first_at[a:b] - at[n], last_at[a:b] - at[n]


def _score(shared):
    """Passages that hold enough of an item's seeds are aligned with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        where, shares = [places(w) for w in block.items], [limit(len(w), block.threshold) for w in block.items]
        limits = [bounds(len(w), t) for w, t in zip(block.items, shares, strict=True)]
        filters = np.zeros((len(block.items), FILTER), bool)
        for k, w in enumerate(block.items):
            filters[k, w % FILTER] = True
        for batch in batches:
            for a, b in steps(batch.column(1)):
                part = batch.slice(a, b - a)
                number, at = block.vocabulary.numbers(part.column(1))
                slot = number % FILTER
                near, bits = [], []  # (text, item, first word, passage) to be aligned, and the places of their words
                for n, item, first, last in block.clusters(number, at):
                    (least, span), size = limits[item], len(block.items[item])
                    begin, close, mine = int(at[n]), int(at[n + 1]), filters[item]
                    for start, stop in passages(first, last, span):
                        stop = min(stop, close - begin)
                        passage = number[begin + start : begin + stop]
                        like = passage[mine[slot[begin + start : begin + stop]]]  # all words of the item, and few others
                        if len(like) < least:
                            continue  # too few matches for the threshold, as below: counted once a word, then in order
                        like = like.tolist()
                        if len(set(like)) + size - len(where[item]) >= least:
                            near.append((n, item, start, passage))
                            bits.append([where[item].get(w, 0) for w in like])
                enough = orders(bits, [len(block.items[x[1]]) for x in near])
                near = [x for x, m in zip(near, enough.tolist(), strict=True) if m >= limits[x[1]][0]]
                best: dict[tuple[int, int], tuple] = {}
                scores = best_scores([block.items[x[1]] for x in near], [x[3] for x in near])
                for (n, item, start, passage), top in zip(near, scores.tolist(), strict=True):
                    words, name = block.items[item], (n, block.names[item])
                    share = top / (MATCH * len(words))
                    if share >= shares[item] and share > best.get(name, (0.0,))[0]:
                        tail = align(words, passage)[1]
                        back = align(words[::-1], passage[: tail + 1][::-1])[1]
                        best[name] = (share, start + tail - back, start + tail)
                found = sorted((n, item, *x) for (n, item), x in best.items())
                cols = list(zip(*found, strict=True)) or [()] * 5
                ids = part.column(0).take(pa.array(cols[0], pa.int64()))
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], ["id", "item", "score", "first_word", "last_word"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(plain_words(t.as_py())) for t in batch.column("t")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n"])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row (id, item_id, score, first_word, last_word) for each document and item it holds a copy of.

    score is the best Smith-Waterman score (match 2, mismatch and gap -1, on words) over that of the item
    itself, from ``threshold`` to 1; the words are those of the aligned passage. Words are runs of ASCII
    letters, digits and non-ASCII characters, A-Z lower-cased.

    No copy is missed: an alignment at the threshold t matches at least a share t of an item's words, so it
    matches some of any larger share than 1 - t of them. Seeds are the rarest such share, counted over all documents, and
    so many more that several of them must lie close together before a passage is aligned; passages are as
    long as any alignment at the threshold can be. Seeds are joined to the documents where these lie: the benchmark is
    worked through in blocks of a proven size, each broadcast to a scan that counts its words and one that looks its
    seeds up, so nothing of the documents moves but what is found. There is no cap.

    Null or empty texts and items, items without words and items of null id hold nothing. Items of fewer than 3
    words are found only whole (score 1).
    Each distinct text of an item id is aligned; a document's best score counts for the id. Repeated and null document
    ids are returned for each row that is contaminated; ids are numbers (as long), strings or bytes. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    key, kind = F.col(id_col), dict(docs.dtypes)[id_col]
    if kind not in ("string", "binary"):
        key, kind = key.cast("long"), "long"
    src = docs.where(F.col(text_col).isNotNull()).select(key.alias("id"), F.col(text_col).alias("t"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("t")).dropna().distinct()
    sized = items.mapInArrow(tidy(_sizes), "item long, t string, n long").where("n > 0")
    # All texts of an id lie in one block; only the sizes of ids are summed in one task.
    sizes = sized.groupBy("item").agg(F.sum("n").alias("words"))
    before = "coalesce(sum(words) over (order by item rows between unbounded preceding and 1 preceding), 0)"
    sizes = sizes.withColumn("block", F.expr(f"cast({before} div {BLOCK_WORDS} as int)")).select("item", "block")
    sized = Workspace(spark, "items").save(sized.join(sizes, "item"))
    schema = f"id {kind}, item long, score double, first_word long, last_word long"
    out = spark.createDataFrame([], schema)
    for (number,) in sized.select("block").distinct().orderBy("block").collect():
        held = [(r["item"], plain_words(r["t"])) for r in sized.where(F.col("block") == number).orderBy("item", "t").collect()]
        known = sorted({w for _, words in held for w in words})
        place = {w: n for n, w in enumerate(known)}
        words = [np.array([place[w] for w in ws], np.int64) for _, ws in held]
        vocabulary = Vocabulary(known)
        shared = spark.sparkContext.broadcast(vocabulary)
        freq = np.zeros(len(known) + 1, np.int64)  # the last is of all words
        for r in src.select("t").mapInArrow(tidy(_frequencies(shared)), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
            freq[r["g"]] = r["n"]  # a number for each word of the block at most
        rate, owners, hits = freq / max(freq[-1], 1), [], []
        for n, w in enumerate(words):
            w = w[np.argsort(freq[w], kind="stable")]
            many, least = seeds(rate[w], limit(len(w), threshold))
            hits.append(least)
            rare = np.unique(w[:many])
            owners.append(np.stack([rare, np.full(len(rare), n)]))
        seed, own = np.concatenate(owners, axis=1)
        order = np.argsort(seed, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(seed, minlength=len(known)))])
        block = Block(vocabulary, [item for item, _ in held], words, begin, own[order], np.array(hits), threshold)
        out = out.unionByName(src.mapInArrow(tidy(_score(spark.sparkContext.broadcast(block))), schema))
    return out.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "score", "first_word", "last_word")
