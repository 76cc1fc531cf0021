import re
from hashlib import sha256

import corpus_pipeline as c
from made import make_docs
from tokenizers import Tokenizer

from loomlake.llm import quality
from loomlake.llm.common import table
from loomlake.llm.queries import QUERIES, WORD_BPE

SF = "/root/testdata/sf0.001"


def test_each_query_is_registered_once():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1


def test_stages_against_their_own_inputs(spark):
    """Each stage's decisions, recomputed from what the one before it returned."""
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in c.STAGES:
        docs = stage(spark, docs, SF)
        if name != "bpe":
            assert docs.columns == c.COLUMNS
            docs = docs.cache()
        out[name] = docs.collect()
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    keep = {i for i, t in texts.items() if model.score(quality.features(t)[None])[0] >= 0.3}
    assert {r.doc_id for r in out["quality"]} == keep

    def shingles(t):
        w = t.lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(texts[i]) for i in sorted(keep)}
    parent = {i: i for i in keep}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    stay = {i for i in keep if root(i) == i}
    assert {r.doc_id for r in out["minhash_dedup"]} == stay
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in out["decontamination"]}
    assert clean == {i for i in stay if not any(b in texts[i] for b in items)}
    for r in out["pii"]:
        assert r.doc_id in clean and r.n_chars == len(r.text)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
    assert {r.doc_id for r in out["pii"]} == clean
    tok, final = Tokenizer.from_file(WORD_BPE), {r.doc_id: r.text for r in out["pii"]}
    for r in out["bpe"]:
        ids = tok.encode(final[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_nulls_repeats_and_nothing(spark, corpus):
    odd = corpus + [(None, "null id one two three"), (None, "null id one two three"), (None, None), (300, "call +1 (017) 555-7713 now please my friend"), (300, "call +1 (017) 555-7713 now please my friend")]
    docs = make_docs(spark, odd)
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert len(rows) <= len(odd)
        if name == "minhash_dedup":
            ids = [r.doc_id for r in rows]
            assert ids.count(300) == 1 and ids.count(1) == 1 and ids.count(2) == 0 and ids.count(None) == 2
        if name == "pii":
            assert [r.text for r in rows if r.doc_id == 300] == ["call [PHONE] now please my friend"] * 2
            assert len(rows) == len(odd)
        if name == "decontamination":
            assert len(rows) == len(odd)
        if name == "quality":
            model = quality.train(docs, table(spark, SF, "labels"))
            good = [x for x in odd if model.score(quality.features(x[1])[None])[0] >= 0.3]
            assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, good))
        if name == "bpe":
            assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in odd)
            empty = sha256(b"").hexdigest()
            assert all((r.n_tokens, r.ids, r.decoded_sha256) == (0, [], empty) for r in rows if r.doc_id in (40, 41))
        assert stage(spark, make_docs(spark, []), SF).collect() == []


def test_rows_of_one_id_are_told_apart_by_text(spark):
    """Two texts under one id, and rows equal in both: decisions and redactions follow the row's own text."""
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(1, item + " end"), (1, "clean words of another row"), (1, None), (1, ""), (None, item), (None, "mail a@b.cd now"), (1, "mail a@b.cd now"), (1, "mail a@b.cd now")]
    clean = sorted((str(r.doc_id), str(r.text)) for r in c.decontamination_stage(spark, make_docs(spark, rows), SF).collect())
    assert clean == sorted((str(i), str(t)) for i, t in rows if t is None or item not in t)
    told = sorted((str(r.doc_id), str(r.text)) for r in c.pii_stage(spark, make_docs(spark, rows), SF).collect())
    assert told == sorted((str(i), str(t).replace("a@b.cd", "[EMAIL]")) for i, t in rows)


def test_near_duplicates_are_judged_by_row(spark):
    """Rows of one id, or of none, stand for their own texts."""
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    near = lambda tag: text(tag) + " more"
    rows = [(1, text("a")), (1, text("b")), (5, near("a")), (5, text("c")), (5, text("c")), (9, near("c")), (None, text("d")), (None, near("d")), (None, near("b")), (None, text("e"))]
    out = [(r.doc_id, r.text) for r in c.near_dup_stage(spark, make_docs(spark, rows), SF).collect()]
    one = [x for x in out if x[0] is None and x[1] != text("e")]
    assert len(one) == 1 and one[0][1] in (text("d"), near("d"))
    assert len(out) == 5
    assert set(out) - set(one) == {(1, text("a")), (1, text("b")), (5, text("c")), (None, text("e"))}
