"""Personal data: generated candidates, boosted trees over their cells, calibrated thresholds (operator 4).

DataFrame operations only. The trees are fitted in the driver on made-up examples, whose truth is known from how they were
made, so they are the same for every input; on the main path they are expressions.
"""

from __future__ import annotations

import functools
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lookup

#: Kinds in order, with their patterns. The first four are the base ones. Possessive loops and the look-behind
#: leave the matches as they are and keep the matcher linear and without recursion on very long runs.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?:\G|(?<![0-9]))[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret": r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{16,}+",
}
BASE = ["email", "ip", "card", "phone"]
#: Characters of context kept on either side of a candidate.
BEFORE, AFTER = 24, 4
#: Words before a candidate that speak for a secret, a telephone, a card or some other number.
CONTEXT = {
    "secret_word": r"(?i)(?:token|key|secret|password|passwd|auth|bearer)[\"']?\s*(?:is\b)?\s*[:=]?\s*[\"']?\z",
    "phone_word": r"(?i)(?:phone|tel|telephone|mobile|cell|fax|call|dial|ring|text|whatsapp)(?:\s+(?:me|us|at|on|number|no))*[.:]?\s*[(]?\z",
    "card_word": r"(?i)(?:card|visa|mastercard|amex|account)(?:\s+(?:number|no|is))*[.:#]?\s*\z",
    "number_word": r"(?i)(?:order|invoice|version|isbn|issn|page|pages|id|ref|part|model|item|serial|case|doi|since|from|between|total|of)(?:\s+(?:number|no))*[.:#]?\s*\z",
}
#: Boosting rounds, shrinkage, depth; examples, every fifth of which is held out; precision that a kind's threshold must
#: reach on those.
ROUNDS, RATE, DEPTH, EXAMPLES, PRECISION = 20, 0.4, 3, 6_000, 0.95
FEATURES = [
    "is_number", "is_secret", "size_bin", "digit_bin", "separator_bin", "separators", "turns", "cases", "opening",
    *CONTEXT, "quoted", "glued", "follow", "checksum", "octets",
]


def luhn(digits):
    """Whether a column of digits passes the Luhn check."""
    d = F.filter(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")), lambda x: x.isNotNull())
    double = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(double, F.lit(0), lambda a, x: a + x) % 10 == 0


def _found(kind: str, pattern: str, gate):
    """Array of (kind, gap, before, match, after) of the matches of one kind, from the pieces between them."""
    pieces, hits = F.split(F.col("t"), pattern, -1), F.regexp_extract_all(F.col("t"), F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        F.arrays_zip(pieces.alias("p"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("q")), hits,
        lambda z, m: F.struct(
            F.length(z["p"]).alias("gap"), F.right(z["p"], F.lit(BEFORE)).alias("before"), m.alias("m"), F.left(z["q"], F.lit(AFTER)).alias("after")
        ),
    )
    typed = F.transform(
        F.filter(parts, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), x["gap"].alias("gap"), x["before"].alias("before"), x["m"].alias("m"), x["after"].alias("after")),
    )
    return F.when(gate, typed)


def candidates(src: DataFrame) -> DataFrame:
    """(i, none, k, kind, start, end, m, before, after) of every match of every kind; src has id, t."""
    digits, t = F.col("t").rlike("[0-9]"), F.col("t")
    gates = {"email": t.contains("@"), "ip": digits, "card": digits, "phone": t.contains("+") & digits, "number": digits, "secret": t.rlike("[A-Za-z0-9_-]{16}")}
    row = src.where(t.rlike("[0-9@]|[A-Za-z0-9_-]{16}")).select(*keys(), "t")
    all_kinds = F.concat(*(F.coalesce(_found(k, p, gates[k]), F.array().cast("array<struct<kind:string,n:int,gap:int,before:string,m:string,after:string>>")) for k, p in KINDS.items()))
    rows = row.select("i", "none", "k", F.explode(all_kinds).alias("c")).select("i", "none", "k", "c.*").distinct()
    over = "over (partition by i, none, k, kind order by n)"
    rows = rows.withColumn("start", F.expr(f"cast(sum(gap + length(m)) {over} - length(m) as int)"))
    return rows.withColumn("end", F.col("start") + F.length("m")).drop("gap", "n")


def keys() -> list:
    """What tells rows apart without moving their text: the id, whether it is null, and a 128-bit digest of the text."""
    return [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("i"), F.col("id").isNull().alias("none"), F.unhex(F.md5("t")).alias("k")]


def _bin(x, bounds: list[float]):
    return sum((F.when(x > b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")


def described(found: DataFrame) -> DataFrame:
    """Candidates with their base validity (null for other kinds) and features in few bins, of format and context."""
    m, size, before = F.col("m"), F.length("m"), F.col("before")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    octets = ~F.exists(F.split(m, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) > 3) | (F.coalesce(F.substr(x, F.lit(-9), F.lit(9)).try_cast("int"), F.lit(999)) > 255))
    dotted = m.rlike(r"\A[0-9]+(\.[0-9]+){3}\z")
    sums = F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    signs = F.regexp_replace(m, "[A-Za-z0-9]", "")
    turns = size - F.length(F.regexp_replace(m, "(?<=[A-Za-z])(?=[0-9])[0-9]|(?<=[0-9])(?=[A-Za-z])[A-Za-z]", ""))
    lower, upper = m.rlike("[a-z]"), m.rlike("[A-Z]")
    c = found.withColumn("checksum", sums.cast("int"))
    valid = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", n.between(12, 19) & (F.col("checksum") == 1))
        .when(F.col("kind") == "phone", n.between(9, 15))
    )
    return c.withColumns({
        "valid": valid, "octets": (dotted & octets).cast("int"), "is_number": (F.col("kind") == "number").cast("int"), "is_secret": (F.col("kind") == "secret").cast("int"),
        "size_bin": _bin(size, [8, 10, 12, 14, 16, 20, 24, 32, 48]), "digit_bin": _bin(n / size, [0, 0.1, 0.25, 0.5, 0.75, 0.999]),
        "separator_bin": _bin(F.length(signs), [0, 1, 2, 3, 4]), "turns": _bin(turns, [0, 1, 3, 6]), "cases": lower.cast("int") + 2 * upper.cast("int"),
        "separators": F.when(F.length(signs) == 0, 0).when(signs.contains("("), 5).when(signs.contains(")"), 5).when(signs.contains("_"), 4).when(signs.contains("."), 3).when(signs.contains("-"), 2).otherwise(1),
        "opening": F.when(m.rlike(r"\A[0-9]{4}(?![0-9])"), 3).when(m.rlike(r"\A[0-9]{3}(?![0-9])"), 2).when(m.rlike(r"\A[0-9]"), 1).otherwise(0),
        **{name: before.rlike(words).cast("int") for name, words in CONTEXT.items()},
        "quoted": before.rlike(r"[=:\"'(]\s?\z").cast("int"), "glued": before.rlike(r"[A-Za-z0-9$€£/@.]\z").cast("int"),
        "follow": F.when(F.col("after").rlike(r"\A[A-Za-z0-9/%]"), 1).when(F.col("after").rlike(r"\A[\"')]"), 2).otherwise(0),
    }).drop("before", "after")


# -- examples -------------------------------------------------------------------------------------------

#: Words that examples are made of.
WORDS = "meeting report because winter garden little market people under again window often paper quiet number river summer answer before light".split()


def _secret(r: random.Random) -> str:
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    body = "".join(r.choice(kinds[r.random() < 0.5]) for _ in range(r.choice([20, 24, 32, 40, 48])))
    return r.choice(["", "", "", "sk_live_", "ghp_", "AKIA"]) + body


def _identifier(r: random.Random) -> str:
    words = [r.choice(WORDS) for _ in range(r.randint(3, 6))]
    made = r.choice(["_".join(words), "-".join(words), "".join(w.title() for w in words), "_".join(words).upper(), "-".join(words) + f"-{r.randint(1, 2030)}", f"{words[0]}_{words[1]}_{r.randint(1990, 2030)}_{words[2]}"])
    odd = r.choice(["-" * 20, "=" * 3 + "_" * 20, "a" * 24, "".join(f"{r.randrange(16**n):0{n}x}-" for n in (8, 4, 4, 4)) + f"{r.randrange(16**12):012x}"])
    return odd if r.random() < 0.15 else made if len(made) >= 16 else made + "_" * (16 - len(made))


def _digits(r: random.Random, *groups: int) -> list[str]:
    return ["".join(r.choice("0123456789") for _ in range(g)) for g in groups]


def _telephone(r: random.Random) -> str:
    a, b, c = _digits(r, 3, 3, 4)
    return r.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"0{a[:2]} {b} {c[:2]} {c[2:]}", f"0{a}{b}{c}"])


def _quantity(r: random.Random) -> str:
    day = f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    many = "".join(_digits(r, r.randint(7, 11)))
    return r.choice([
        day, f"{day} {r.randint(10, 23)}", many, f"{r.randint(0, 99)}.{many}", f"{r.randint(1800, 2030)}-{r.randint(1800, 2030)}", f"978-{'-'.join(_digits(r, 1, 2, 6, 1))}",
        f"{'.'.join(_digits(r, 1, 2, 3))}.{r.randint(256, 4000)}", " ".join(_digits(r, 2, 2, 2, 2)), f"{r.randint(1, 90)}.{many[:4]} {r.randint(1, 90)}.{many[3:]}", f"10.{many[:4]}", "0" * r.randint(7, 20),
    ])


def examples(count: int = EXAMPLES, seed: int = 11) -> list[tuple[int, str, int, int, bool]]:
    """(number, text, start, end, whether it is personal) of made-up sentences around one span each."""
    r = random.Random(seed)
    out = []
    for n in range(count):
        personal = r.random() < 0.5
        if r.random() < 0.5:
            span = _secret(r) if personal else _identifier(r)
            named = ['token = "', "api_key: ", "password is ", "secret='", "Authorization: Bearer ", "key "]
            plain = ["see ", "use ", "with ", "class ", '"', "file ", ""]
            lead = r.choice(named if r.random() < (0.6 if personal else 0.15) else plain)
        elif r.random() < 0.25:  # groups of four that fail their checksum or not
            span = " ".join(_digits(r, 4, 4, 4, 4)) if personal else "".join(_digits(r, r.randint(12, 19)))
            lead = r.choice(["card number ", "my visa ", "card: ", "pay with "] if personal else ["order ", "id ", "serial number ", "ref ", "in all ", "", "the "])
        else:
            span = _telephone(r) if personal else _quantity(r)
            named = ["call ", "tel. ", "phone: ", "mobile ", "fax ", "ring me at "]
            numbers = ["order ", "total ", "isbn ", "page ", "version ", "since ", "ref ", "between ", "$", "part no "]
            plain = ["is ", "and ", "with ", "", "at "]
            lead = r.choice((named if r.random() < 0.6 else plain) if personal else (numbers if r.random() < 0.6 else plain))
        begin = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 5)))
        begin += " " * bool(begin) + lead
        end = r.choice(["", ".", ",", '"', "'", ")", "", ""]) + r.choice(["", " " + r.choice(WORDS)])
        out.append((n, begin + span + end, len(begin), len(begin) + len(span), personal))
    return out


class BoostedTrees:
    """Boosted regression trees on weighted cells of small integers, with the logistic loss."""

    def __init__(self, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH):
        self.rounds, self.rate, self.depth = rounds, rate, depth
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        rate = (positive.sum() + 0.5) / (weight.sum() + 1)
        self.base = float(np.log(rate / (1 - rate)))
        total = np.full(len(x), self.base)
        for _ in range(self.rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(x, positive - weight * p, weight * p * (1 - p), self.depth)
            self.trees.append(tree)
            total += self._walk(tree, x)
        return self

    def _grow(self, x, g, h, depth):
        value = self.rate * g.sum() / (h.sum() + 1)
        best = (1e-9, None, None)
        for f in range(x.shape[1] if depth and len(x) > 1 else 0):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] is None:
            return value
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        out, left = np.empty(len(x)), x[:, tree[0]] <= tree[1]
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(self._walk(t, x) for t in self.trees))))


def threshold(score: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> float:
    """Smallest score of 0.5 or more from which the labelled candidates are right at PRECISION; above 1 if none is."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(positive[order]) / np.maximum(np.cumsum(weight[order]), 1e-9)
    last = np.concatenate([score[order][1:] != score[order][:-1], [True]]) if len(score) else np.empty(0, bool)
    ok = np.flatnonzero((right >= PRECISION) & last)
    return max(float(score[order][ok[-1]]) - 1e-9, 0.5) if len(ok) and positive.sum() else 1.01  # whatever way scores are summed


@dataclass
class Model:
    """Trees, thresholds by kind, and (kind, candidates, precision, recall) on the held-out examples."""

    trees: BoostedTrees
    thresholds: dict[str, float]
    held_out: list[tuple[str, int, float, float]]

    def score(self):
        """The score of a candidate as an expression over its features."""

        def walk(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(F.col(FEATURES[tree[0]]) <= int(tree[1]), walk(tree[2])).otherwise(walk(tree[3]))

        total = sum((walk(t) for t in self.trees.trees), F.lit(self.trees.base))
        return 1 / (1 + F.exp(-total))

    def least(self):
        """The threshold of a candidate's kind; above 1 where no score was right often enough."""
        out = F.lit(1.01)
        for kind, value in self.thresholds.items():
            out = F.when(F.col("kind") == kind, value).otherwise(out)
        return out


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    """The model of this version. A candidate of an example is right where it covers most of a personal span and little
    else; no feature enters a label."""
    spark = SparkSession.getActiveSession()
    made = spark.createDataFrame(examples(), "id long, t string, a int, b int, personal boolean")
    found = described(candidates(made.select("id", "t"))).join(made.select(F.col("id").cast("string").alias("i"), "a", "b", "personal"), "i")
    inside = F.greatest(F.least("end", "b") - F.greatest("start", "a"), F.lit(0))
    right = F.col("personal") & (inside >= 0.8 * (F.col("b") - F.col("a"))) & (inside >= 0.8 * (F.col("end") - F.col("start")))
    rows = found.select("i", "start", "kind", *FEATURES, right.cast("int").alias("y")).orderBy(F.col("i").cast("long"), "kind", "start").collect()  # of EXAMPLES texts
    x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r["y"] for r in rows], float)
    kind, held = np.array([r["kind"] for r in rows]), np.array([int(r["i"]) % 5 == 0 for r in rows])
    trees = BoostedTrees().fit(x[~held], y[~held], np.ones(int((~held).sum())))
    p, thresholds, report = trees.predict(x), {}, []
    for k in KINDS:
        mine = held & (kind == k)
        thresholds[k] = threshold(p[mine], y[mine], np.ones(int(mine.sum())))
        chosen = mine & (p >= thresholds[k])
        report.append((k, int(mine.sum()), float(y[chosen].mean()) if chosen.any() else 1.0, float(y[chosen].sum() / max(y[mine].sum(), 1))))
    return Model(trees, thresholds, report)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, n_email, n_ip, n_card, n_phone, base, spans for each row; spans are arrays of (start, rank, end,
    kind, score) in order of start and kind, in code points, end exclusive; base has those of the fixed rules.

    Base spans are the leftmost non-overlapping matches of a kind that pass its check; failing matches are
    dropped without a retry. All matches, failing ones and two wider kinds (numbers of 7 digits or more,
    secrets of 16 characters or more) are candidates, and may overlap. Boosted trees score their format and context;
    candidates from their kind's threshold on are added to the base spans, which always stay. The trees are fitted on
    made-up examples of known truth, and a kind's threshold is the least score, of 0.5 or more, from which candidates
    of held-out examples are right at a precision of 0.95. So a text's spans depend on the text alone.

    Null and empty texts have no spans. Repeated rows each get the result; null ids are kept; other columns are
    ignored; an empty table gives an empty result. key is a digest of the text, for joining spans to rows. Ids are of
    any type.
    """
    spark, model = docs.sparkSession, trained()
    key = F.col(id_col)
    if dict(docs.dtypes)[id_col] not in ("string", "binary"):
        key = key.cast("long")
    src = docs.select(key.alias("id"), F.col(text_col).alias("t"))
    found = described(candidates(src.withColumn("id", F.hex("id") if dict(src.dtypes)["id"] == "binary" else F.col("id"))))
    # Written (some tens of bytes a candidate, no text), so that the trees see columns, not the patterns behind them.
    work = Workspace(spark, "pii")
    found = work.save(found.drop("m"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = found.withColumns({"score": model.score(), "base": F.coalesce("valid", F.lit(False))})
    spans = spans.where(F.col("base") | (F.col("score") >= model.least()))
    # What lies inside a base span adds nothing.
    cover = "max(case when base then end end) over (partition by i, none, k order by start, end desc, base desc rows unbounded preceding)"
    spans = spans.withColumn("cover", F.expr(cover)).where("base or cover is null or cover < end")
    spans = spans.withColumn("s", F.struct("start", rank.alias("rank"), "end", "kind", "score"))
    each = spans.groupBy("i", "none", "k").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE),
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("s")))).alias("base"), F.array_sort(F.collect_list("s")).alias("spans"),
    )
    named = src.withColumn("own", F.col("id")).withColumn("id", F.hex("id") if dict(src.dtypes)["id"] == "binary" else F.col("id"))
    out = lookup(named.select("own", *keys()), work.save(each), ["i", "none", "k"], "left", listed="spans")
    work.drop(found)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    return out.select(
        F.col("own").alias(id_col), F.col("k").alias("key"), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"),
    )


def joined(spans):
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text, spans):
    """The text with every span, or run of overlapping ones, replaced by its first kind in brackets."""
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(F.lit(None)))["end"] > s["start"]),
            F.concat(
                F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end"), F.try_element_at(a, F.lit(-1))["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
    )
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"])), merged,
        lambda at, s: F.concat(
            F.substr(text, at + 1, F.coalesce(s["start"], F.length(text)) - at), F.when(s.isNotNull(), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        ),
    )
    return F.when(F.size(spans) > 0, F.array_join(gaps, "")).otherwise(text)
