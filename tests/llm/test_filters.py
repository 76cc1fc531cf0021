import random

import numpy as np
import pytest
from made import make_docs

from loomlake.llm import quality
from loomlake.llm.contamination import THRESHOLD, align, best_scores, contaminated, orders, places, plain_words
from loomlake.llm.urls import judge_urls

LABELS = "doc_id long, quality int, toxic int, text string"
SCHEMA = "page_id long, url string, html string, host string, rule string, key string"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "a.b.com", ""), ("block", "example.org", "/es/x"), ("allow", None, "/")]


def judge(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, None, "h", "r", None) for i, u in urls], SCHEMA).repartition(3)
    return judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()


def test_urls_against_brute_force(spark):
    rnd = random.Random(3)
    hosts = ["org", "example.org", "www.Example.ORG", "notexample.org", "com", "x.com", "a.b.com", "c.a.b.com", "b.com", "net", "org.", ".org", "user@x.org:80", "é.org"]
    paths = ["", "/", "/es/", "/es/xyz", "/es", "/fr/1", "/fr", "?q=/es/", "#x", "/ES/", "/es/x?a#b"]
    urls = [(i, f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}") for i in range(400)]
    urls += [(900, None), (901, ""), (902, "no scheme/es/"), (903, "://"), (904, "http://example.org/es/"), (904, "http://example.org/es/"), (None, "http://x.org/")]
    got = judge(spark, urls, RULES)
    assert len(got) == len(urls)
    by = {}
    for i, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        by[i] = (host, path, *(max(fits)[2:] if fits else (None, "allow")))
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == by[r.page_id]


def test_ties_between_rules(spark):
    """Of rules of equal length the one of the longer host wins; of equal host and path the smaller verdict."""
    rules = [("block", "b.com", "/xx"), ("allow", "a.b.com", "/"), ("block", "c.org", "/"), ("allow", "c.org", "/"), ("block", "x.net", ""), ("allow", "net", "/a")]
    urls = ["http://a.b.com/xx", "http://b.com/xx", "http://c.org/q", "http://x.net/a", "http://y.net/a"]
    got = {r.url: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame([(u, u) for u in urls], "page_id string, url string"), spark.createDataFrame(rules, "verdict string, host string, path string")).withColumnRenamed("page_id", "url").collect()}
    assert got == {
        urls[0]: ("a.b.com/", "allow"), urls[1]: ("b.com/xx", "block"), urls[2]: ("c.org/", "allow"), urls[3]: ("x.net", "block"), urls[4]: ("net/a", "allow"),
    }


def test_urls_without_rules_or_pages(spark):
    assert [(r.rule, r.verdict) for r in judge(spark, [(1, "http://a.org/")], [])] == [(None, "allow")]
    assert judge(spark, [], RULES) == []


ITEMS = "item_id long, text string, score string"


def test_contamination(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = items[1][1].split()
    edited[4] = edited[13] = edited[22] = "changed"
    del edited[17]
    rows = [(i, noise(200)) for i in range(20)]
    rows += [(100, noise(40) + " " + items[0][1].upper() + "! " + noise(30)), (101, noise(9) + " " + " ".join(edited)), (102, " ".join(items[2][1].split()[:8]) + noise(50)), (None, items[3][1]), (103, None), (104, "")]
    rows += [(200 + i, items[5][1] + " " + noise(5)) for i in range(30)]
    bench = spark.createDataFrame([(*x, None) for x in items] + [(7, None, None), (None, "a b c", None), (8, "x y", None), (0, "short copy", None)], ITEMS)
    got = contaminated(make_docs(spark, rows), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == {(100, 0), (101, 1), (None, 3)} | {(200 + i, 5) for i in range(30)}
    whole = next(r for r in got if r.doc_id == 100)
    assert (whole.score, whole.first_word, whole.last_word) == (1.0, 40, 69)
    assert contaminated(make_docs(spark, []), bench).collect() == []
    assert contaminated(make_docs(spark, rows), spark.createDataFrame([], ITEMS)).collect() == []


def plain_align(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_against_the_plain_recurrence():
    rnd = np.random.default_rng(6)
    for _ in range(60):
        a, b = (rnd.integers(0, 4, rnd.integers(1, 15)) for _ in range(2))
        assert align(a, b)[0] == plain_align(a, b)
    pairs = [[rnd.integers(0, 5, rnd.integers(1, 30)) for _ in range(2)] for _ in range(700)]
    assert best_scores(*map(list, zip(*pairs, strict=True))).tolist() == [align(a, b)[0] for a, b in pairs]
    assert best_scores([], []).tolist() == []
    for size in (1, 30, 63, 64, 90):  # the longest common subsequence of many pairs, and by the textbook
        pairs = [(rnd.integers(0, 9, size), rnd.integers(0, 12, rnd.integers(0, 50))) for _ in range(40)]
        bits = [[places(a).get(w, 0) for w in b.tolist()] for a, b in pairs]
        for got, (a, b) in zip(orders(bits, [size] * 40), pairs, strict=True):
            row = [0] * (size + 1)
            for w in b:
                new = [0]
                for k in range(size):
                    new.append(row[k] + 1 if a[k] == w else max(new[k], row[k + 1]))
                row = new
            assert got == row[-1]
    assert plain_words("Ab-Cé 1_2\n") == [b"ab", "cé".encode(), b"1", b"2"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    good = lambda: " ".join(rnd.choice(["the", "house", "river", "of", "stones", "walked"]) for _ in range(rnd.randint(20, 60))) + "."
    bad = lambda: " ".join(rnd.choice(["x##", "$$$", "!!", "click%%"]) for _ in range(rnd.randint(20, 60)))
    return [(i, good() if i % 3 else bad()) for i in range(n)]


def test_quality_learns_and_holds_out(spark):
    import zlib

    rows = texts(300)
    docs = make_docs(spark, rows + [(900, None), (901, ""), (None, "a b"), (902, "y" * 100_000), (0, rows[0][1])])
    labels = [(i, int(i % 3 > 0), 0, None) for i in range(300)] + [(None, 1, 0, None), (5, None, None, None), (7, 1, None, None)]
    model = quality.train(docs, spark.createDataFrame(labels, LABELS))
    got = quality.score(docs, model).collect()
    assert len(got) == 305
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    # Labels of the held-out fold are never seen.
    turned = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - (y or 0), t, x) for i, y, t, x in labels if i is not None]
    again = quality.train(docs, spark.createDataFrame(turned, LABELS))
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))


def test_quality_without_labels_or_rows(spark):
    docs = make_docs(spark, texts(10))
    model = quality.train(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    one = quality.train(docs, spark.createDataFrame([(i, 1, 0, None) for i in range(10)], LABELS))
    assert all(r.score > 0.5 for r in quality.score(docs, one).collect())
    assert quality.score(make_docs(spark, []), model).collect() == []
    assert quality.with_score(docs, model).columns == [*docs.columns, "__score"]


def test_pairs_fit_what_single_features_cannot():
    rnd = np.random.default_rng(0)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.fit(x, y).score(x)
    assert ((p > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_quality_on_the_tables(spark, sf):
    from loomlake.llm.common import table
    from loomlake.llm.queries import op5_quality

    d = f"/root/testdata/{sf}"
    label = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    held = [r for r in op5_quality(spark, d).collect() if r.held_out and label.get(r.doc_id) is not None]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.8 * len(held)


def test_each_text_of_an_item_id_is_searched(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    long, short, other = (" ".join(word() for _ in range(n)) for n in (40, 15, 15))
    near = " ".join(long.split()[:25])
    rows = [(1, "so " + short + " it is"), (2, "so " + long + " it is"), (3, other), (4, "nothing here at all"), (5, near + " and " + short)]
    bench = spark.createDataFrame([(0, long, None), (0, short, None), (0, short, None), (1, other, None)], ITEMS)
    got = {(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in contaminated(make_docs(spark, rows), bench).collect()}
    assert got == {(1, 0, 1.0, 1, 15), (2, 0, 1.0, 1, 40), (3, 1, 1.0, 0, 14), (5, 0, 1.0, 26, 40)}


def test_copies_without_intact_grams_and_short_items(spark):
    """Every document and item that the plain recurrence puts at the threshold is found, whatever its length or edits."""
    rnd = random.Random(10)
    vocab = ["w%d" % i for i in range(60)]
    items = [(n, " ".join(rnd.choice(vocab) for _ in range(n))) for n in (1, 2, 3, 4, 6, 8, 11, 12, 15, 24, 40)]
    rows = []
    for n, t in items:
        w = t.split()
        for gap in (1, 2, 3):
            rows.append((len(rows), "x y " + " ".join(v + (" z" if (k + 1) % gap == 0 else "") for k, v in enumerate(w)) + " y x"))
        for _ in range(6):
            edit = [rnd.choice([v, v, v, "z", "", v + " z"]) for v in w]
            rows.append((len(rows), " ".join(edit) + " q " + " ".join(rnd.choice(vocab) for _ in range(30))))
    shares = {(i, n): plain_align(item.split(), t.split()) / (2 * n) for i, t in rows for n, item in items}
    bench = spark.createDataFrame([(*x, None) for x in items] + [(99, "!", None)], ITEMS)
    for least in (THRESHOLD, 0.5, 0.7):
        want = {(*k, share) for k, share in shares.items() if share >= (least if k[1] > 2 else 1)}
        got = contaminated(make_docs(spark, rows), bench, threshold=least).collect()
        assert {(r.doc_id, r.item_id, r.score) for r in got} == want and len(got) == len(want)
        assert {n for _, n, _ in want} == {n for n, _ in items}


def test_most_heavily_edited_copies_are_found(spark, monkeypatch):
    """Copies of the given items with three in ten words replaced, in several blocks; untouched texts stay clean."""
    from loomlake.llm import contamination

    monkeypatch.setattr(contamination, "BLOCK_WORDS", 700)
    rnd = random.Random(12)
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 1500").orderBy("doc_id").limit(300).collect()]
    clean = [t for t in texts if not any(x in t for _, x in items)]
    rows = []
    for n, (_, item) in enumerate(items * 5):
        other = clean[n % len(clean)].split()
        copy = [rnd.choice(other) if rnd.random() < 0.3 else w for w in item.split()]
        rows.append((n, " ".join(other[:60] + copy + other[60:])))
    rows += [(1000 + n, t) for n, t in enumerate(clean)] + [(5000, " ".join(clean * 3) + " " + items[0][1])]
    bench = spark.createDataFrame([(*x, None) for x in items], ITEMS)
    got = {(r.doc_id, r.item_id) for r in contaminated(make_docs(spark, rows), bench).collect()}
    caught = sum((n, items[n % len(items)][0]) in got for n in range(len(items) * 5))
    assert caught >= 0.85 * len(items) * 5
    assert [x for x in got if x[0] >= 1000] == [(5000, items[0][0])]
