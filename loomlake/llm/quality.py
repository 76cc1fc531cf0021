"""Quality classifier: a generalised additive model with pairwise interactions (operator 5)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

#: Labelled rows the model is fitted on at most: those whose ids have the smallest hashes.
TRAIN_ROWS = 20_000
#: Bins of a feature, rounds over all terms, shrinkage, pairs and their bins on either side.
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS = 24, 120, 0.15, 6, 8
THRESHOLD = 0.3
FOLDS = 5

NAMES = [
    "log_chars", "words", "word_length", "upper", "digits", "spaces", "breaks", "stops", "marks", "bars", "quotes",
    "wide", "distinct_words", "top_word", "short_words", "long_words", "repeated_lines", "line_length", "entropy",
    "distinct_pairs", "marked_words", "capital_words", "stop_rate", "largest_byte",
]


def _among(chars: bytes) -> np.ndarray:
    on = np.zeros(256, bool)
    on[list(chars)] = True
    return on


_UPPER, _DIGIT, _SPACE = _among(bytes(range(65, 91))), _among(b"0123456789"), _among(b" \t")
_STOP, _MARK, _QUOTE = _among(b".,;:?"), _among(b"!#$%&*+/<=>@\\^_`{}~"), _among(b"\"'()[]")
_WIDE = np.arange(256) >= 128


def features(text: str | None) -> np.ndarray:
    """One number for each of NAMES from the whole text; null and empty texts give zeros."""
    out = np.zeros(len(NAMES))
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    p = count[count > 0] / n
    out[:12] = [
        np.log1p(n), np.log1p(len(words)), 0, count[_UPPER].sum() / n, count[_DIGIT].sum() / n, count[_SPACE].sum() / n,
        count[10] / n, count[_STOP].sum() / n, count[_MARK].sum() / n, count[124] / n, count[_QUOTE].sum() / n, count[_WIDE].sum() / n,
    ]
    out[18], out[23] = -(p * np.log2(p)).sum(), p.max()
    lines = raw.split(b"\n")
    seen = Counter(lines)
    out[16] = sum(len(x) * (c - 1) for x, c in seen.items()) / n
    out[17] = np.log1p(n / len(lines))
    if words:
        m = len(words)
        sizes = np.fromiter(map(len, words), np.int64, m)
        each = Counter(words)
        out[2], out[12], out[13] = sizes.mean(), len(each) / m, max(each.values()) / m
        out[14], out[15] = (sizes <= 3).mean(), (sizes >= 12).mean()
        out[19] = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
        out[20] = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m
        out[21] = sum(w[:1].isupper() for w in words) / m
        out[22] = count[46] / m
    return out


def _stump(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Step of a tree with up to three leaves over ordered bins, from sums of gradients and curvatures."""

    def cut(a: int, b: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        left, total = hs[:-1], hs[-1]
        ok = (left >= least) & (total - left >= least)
        if not ok.any():
            return 0.0, -1
        gain = gs[:-1] ** 2 / (left + 1) + (gs[-1] - gs[:-1]) ** 2 / (total - left + 1) - gs[-1] ** 2 / (total + 1)
        gain[~ok] = 0
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    parts = [(0, len(g))]
    for _ in range(2):
        options = [(*cut(a, b), a, b) for a, b in parts]
        gain, at, a, b = max(options)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, at), (at, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """(gain, step) of the best tree that cuts both axes once."""
    gs, hs = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best, at = 0.0, None
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quads = [
                (gs[i, j], hs[i, j]), (gs[i, -1] - gs[i, j], hs[i, -1] - hs[i, j]), (gs[-1, j] - gs[i, j], hs[-1, j] - hs[i, j]),
                (gs[-1, -1] - gs[i, -1] - gs[-1, j] + gs[i, j], hs[-1, -1] - hs[i, -1] - hs[-1, j] + hs[i, j]),
            ]
            if sum(q[1] >= least for q in quads) < 2:
                continue
            gain = sum(a * a / (b + 1) for a, b in quads)
            if gain > best:
                best, at = gain, (i, j, quads)
    step = np.zeros_like(g)
    if at:
        i, j, quads = at
        for (a, b), (r, c) in zip(quads, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
            step[r, c] = a / (b + 1)
    return best, step


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; a score is the logistic of the base plus one entry a table."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for b, t in zip(self.bins(x, self.edges), self.tables, strict=True):
            total += t[b]
        if self.pairs:
            coarse = self.bins(x, self.pair_edges)
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                total += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: each round gives every feature's table one small tree on the current residuals; then the
    pairs of largest gain get tables in the same way. Without rows the base is 0; with one class, its prior."""
    n = len(y)
    if not n:
        return AdditiveModel()
    rate = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    quantiles = lambda f, k: np.unique(np.quantile(x[:, f], np.arange(1, k) / k))
    model.edges = [quantiles(f, BINS) for f in range(x.shape[1])]
    model.pair_edges = [quantiles(f, PAIR_BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins, coarse = model.bins(x, model.edges), model.bins(x, model.pair_edges)
    total, least = np.full(n, model.base), max(2.0, n / 2000)
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            step = RATE * _stump(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), least / 4)
            model.tables[f] += step
            total += step[b]

    def sums(i, j, p):
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        grid = lambda w: np.bincount(cell, w, shape[0] * shape[1]).reshape(shape)
        return grid(y - p), grid(p * (1 - p)), cell

    p = 1 / (1 + np.exp(-total))
    gains = [(_quadrants(*sums(i, j, p)[:2], least / 4)[0], i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = [(i, j) for g, i, j in sorted(gains, reverse=True)[:PAIRS] if g > 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(ROUNDS // 4):
        for k, (i, j) in enumerate(model.pairs):
            g, h, cell = sums(i, j, 1 / (1 + np.exp(-total)))
            step = RATE * _quadrants(g, h, least / 4)[1]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).tolist() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])


def _scores(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return run


def held_out(id_col):
    """crc32 of the id's text mod 5 is 0; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits on labelled rows outside the held-out fold: at most ``rows`` of them, those of smallest id hash.

    Rows of null id or label are left out; repeated and contradicting labels all count. Only the text enters.
    """
    bounded_batches(docs.sparkSession)
    fold = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    fold = fold.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    taken = fold.collect()
    ids = docs.sparkSession.createDataFrame([(i,) for i in {r["id"] for r in taken}], "id long")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    src = src.join(F.broadcast(ids), "id", "left_semi")  # at most ``rows`` ids
    found = src.mapInArrow(tidy(_features), "id long, x array<double>").collect() if taken else []
    by: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["id"], r["x"])):
        by.setdefault(r["id"], r["x"])
    pairs = [(by[r["id"]], float(r["y"] > 0)) for r in taken if r["id"] in by]
    x = np.array([p[0] for p in pairs]).reshape(-1, len(NAMES))
    return fit(x, np.array([p[1] for p in pairs]))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row; predicted is 1 from a score of 0.3.

    Null and empty texts are scored as texts of no characters. Repeated and null ids are returned as rows of
    their own; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    out = src.mapInArrow(tidy(_scores(model)), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", column: str = "__score") -> DataFrame:
    """All rows and columns of ``docs`` and the score of each row's text as ``column``; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(text_col)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, column])

    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{column}` double"
    return docs.mapInArrow(tidy(run), schema)
