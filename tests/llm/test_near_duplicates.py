import re

import numpy as np
import pytest
from made import make_docs

from loomlake.llm import minhash
from loomlake.llm.embeddings import near_vectors
from loomlake.llm.minhash import MinMaxHasher, near_duplicates


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(ids, linked):
    label = dict.fromkeys(range(len(ids)))
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        if label[i] is None:
            label[i], todo = ids[i], [i]
            while todo:
                u = todo.pop()
                for v in range(len(ids)):
                    if label[v] is None and linked(u, v):
                        label[v] = ids[i]
                        todo.append(v)
    return label


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    link = lambda u, v: bool(sets[u]) and 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v])
    label = brute_components([i for i, _ in rows], link)
    return sorted((i, len(s), label[n], i == label[n]) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_against_brute_force(spark, corpus):
    got = near_duplicates(make_docs(spark, corpus))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(corpus)


def test_mixed_buckets_are_compared_completely(spark, monkeypatch):
    """A family of edits at similarities around the threshold, in blocks of two."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rnd = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for p in rnd.choice(80, rnd.integers(1, 5), replace=False):
            words[p] = f"e{i}x{p}"
        rows.append((i, " ".join(words)))
    assert sorted(map(tuple, near_duplicates(make_docs(spark, rows)).collect())) == brute(rows)


def test_empty_and_null_ids(spark):
    assert near_duplicates(make_docs(spark, [])).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (None, "lonely words"), (None, None)]
    got = sorted(map(tuple, near_duplicates(make_docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_signature_values_are_unbiased():
    hasher = MinMaxHasher(400)
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = pool[:225], pool[75:]
    same = (hasher.signature(a) == hasher.signature(b)).mean()
    assert same == pytest.approx(0.5, abs=0.07)


VECTORS = "vec_id long, embedding array<float>, label int, id string, c string, n string"


@pytest.mark.parametrize("bits", [2, 12, 18])
def test_vectors_against_brute_force(spark, monkeypatch, bits):
    """With keys of one, two and four bytes, as large inputs have."""
    from loomlake.llm import embeddings

    monkeypatch.setattr(embeddings, "BITS", bits)
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(80):
        v = rnd.standard_normal(8)
        for _ in range(rnd.integers(1, 5)):
            rows.append((len(rows), (v + rnd.standard_normal(8) * 0.15).astype(np.float32).tolist(), int(i % 3)))
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (902, rows[0][1], None), (903, None, 1), (904, [0.0] * 8, 1)]
    rows += [(905, [float("nan")] * 8, 1), (906, [None] + [1.0] * 7, 1), (907, [], 1), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1), (3, rows[3][1], rows[3][2])]
    got = near_vectors(spark.createDataFrame([(*r, "x", "y", None) for r in rows], VECTORS).repartition(4))

    def unit(v, label):
        if label is None or not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v, np.float64)
        return v / np.sqrt(v @ v)

    units = [unit(v, label) for _, v, label in rows]
    ok = lambda u, v: units[u] is not None and units[v] is not None and rows[u][2] == rows[v][2] and len(units[u]) == len(units[v]) and units[u] @ units[v] >= 0.93
    label = brute_components([r[0] for r in rows], ok)
    expected = sorted((r[0], sum(ok(n, m) for m in range(len(rows)) if m != n), label[n], r[0] == label[n]) for n, r in enumerate(rows))
    assert sorted(map(tuple, got.collect())) == expected


def test_double_vectors_and_multiples(spark):
    """Doubles keep their precision; a vector's multiples are links, at any scale."""
    v = [0.1, -0.7, 0.3]
    rows = [(i, [x * s for x in v], 1, None, None, None) for i, s in enumerate((1.0, 2.0, 1e300, 1e-300, 3.7))] + [(9, [0.7, 0.1, 0.0], 1, None, None, None)]
    got = near_vectors(spark.createDataFrame(rows, VECTORS.replace("float", "double"))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [*((i, 4, 0) for i in range(5)), (9, 0, 9)]


def test_vector_blocks_count_each_link_once(spark, monkeypatch):
    from loomlake.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 5)
    rnd = np.random.default_rng(4)
    v = rnd.standard_normal(16)
    rows = [(i, (v + rnd.standard_normal(16) * 0.02).tolist(), 1, None, None, None) for i in range(40)]
    got = near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)}
    assert near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
