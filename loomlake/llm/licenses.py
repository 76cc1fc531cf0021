"""License scan by diagonal voting, in DataFrame operations only (operator 7)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lookup

#: Phrases whose every place counts, and their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
#: Sentences of license texts and notices, what in them stands for this license and no other, and labels.
#: A copy may differ in some words, but not in the distinctive ones.
TEMPLATES = [
    ("licensed under the apache license version 2 0 the license", "apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "except in compliance with", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing software distributed under the license", "apache-2.0"),
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining a copy of this software", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "in source and binary forms", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "nor the names of its contributors may be used", "bsd-3"),
    ("licensed under the gnu general public license version 2", "general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "foundation either version 2 of the license", "gpl-2"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "foundation either version 3 of the license", "gpl-3"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license", "lgpl"),
    ("licensed under the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "affero general public license", "agpl"),
    ("licensed under the mozilla public license version 2 0", "mozilla public license", "mpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "released into the public domain", "public-domain"),
    ("licensed under cc by 4 0", "cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", "cc-by-nc"),
]
#: Diagonals this near each other are one copy; share of a template's 2-grams that a copy must hold in order.
NEAR, SHARE = 2, 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character above ASCII whose lower case is an ASCII letter, and one that stays as it is.
KELVIN, OTHER = "K", "ĸ"


def words_of(text):
    """Column of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text; null gives none.

    ``lower`` also maps letters outside A-Z; these stay word characters outside ASCII, so counts and places are the
    same, and so are matches with templates, which are ASCII. Only the Kelvin sign would become an ASCII letter.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER))
    return F.filter(F.split(F.lower(plain), SEPARATORS), lambda w: w != "")


def templates() -> list[tuple[bool, str, list[str], int, int]]:
    """(base, label, words, first and last 2-gram that must stand together) of each phrase and template."""
    out = []
    for phrase, needed, label in [(p, p, x) for p, x in BASE] + TEMPLATES:
        words, core = (re.findall(r"[a-z0-9]+", x) for x in (phrase, needed))
        at = next(i for i in range(len(words)) if words[i : i + len(core)] == core)
        out.append((len(out) < len(BASE), label, words, at, at + len(core) - 2))
    return out


def _templates(spark) -> DataFrame:
    """(template, base, label, size, first, last, offset, a, b, h): a fixed number of rows, one for each 2-gram."""
    rows = []
    for n, (base, label, words, first, last) in enumerate(templates()):
        rows += [(n, base, label, len(words), first, last, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    df = spark.createDataFrame(rows, "template int, base boolean, label string, size int, first int, last int, offset int, a string, b string")
    return df.withColumn("h", F.xxhash64("a", "b"))


def chain(pairs, grams):
    """Length of the longest run of pairs (place, offset) that ascends in both: the 2-grams a copy holds in order.

    The pairs are taken by place, those of one place from the largest offset down; each gets the longest run that ends
    at a smaller offset, one longer, and ``best`` has the longest run that ends at each offset.
    """
    order = F.array_sort(F.transform(pairs, lambda p: F.struct(p["place"].alias("p"), (-p["offset"]).alias("o"))))
    longest = F.aggregate(
        order, F.array_repeat(F.lit(0), grams),
        lambda best, p: F.transform(best, lambda x, i: F.when(i == -p["o"], F.greatest(x, F.coalesce(F.array_max(F.slice(best, 1, -p["o"])), F.lit(0)) + 1)).otherwise(x)),
    )
    return F.array_max(longest)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row.

    Base: all places where a phrase of BASE stands; n_base counts them, first_word and last_word are their
    smallest and largest start, base_labels their distinct labels, sorted and comma-joined. labels adds those of
    TEMPLATES that the text holds a verified copy of; score is the best share of a copy (1 for a base phrase), and spans
    the (start, end, label, share) found.

    The hashes of all rolling 2-grams are joined to the templates' 2-grams, whose number is fixed; places
    whose words differ in spite of equal hashes go, and the rest vote for their diagonal, text place minus
    template place. A base phrase stands where all its 2-grams vote for one diagonal. For the others,
    diagonals of a template within two of each other are merged to a copy. A copy is verified by an ordered alignment:
    the longest run of its 2-grams that ascends in text and template must be 60 % of the template's 2-grams, and the
    template's distinctive words must stand together, on one diagonal. So phrases that licenses share decide nothing.

    Null and empty texts have no words, empty label lists, score 0 and null places. Repeated rows each get
    the result. Null ids are kept; rows are told apart by id and a 128-bit digest of the text. Other columns are
    ignored; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    src = src.select("id", F.unhex(F.md5("t")).alias("k"), words_of(F.col("t")).alias("w"))
    pairs = src.where(F.size("w") > 1).select(
        "id", "k", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))).alias("pos", "z")
    )
    pairs = pairs.select("id", "k", "pos", F.col("z.a").alias("a"), F.col("z.b").alias("b")).where("b is not null")
    grams = _templates(docs.sparkSession)
    votes = pairs.withColumn("h", F.xxhash64("a", "b")).join(F.broadcast(grams), ["h", "a", "b"])
    about = ["template", "base", "label", "size", "first", "last"]
    votes = votes.select("id", "k", *about, "offset", (F.col("pos") - F.col("offset")).alias("diagonal"))
    row = [F.coalesce("id", F.lit(0).cast("long")).alias("i"), F.col("id").isNull().alias("none"), "k"]
    lines = votes.groupBy(*row, *about, "diagonal").agg(F.collect_set("offset").alias("on"))
    core = F.size(F.array_except(F.sequence("first", "last"), "on")) == 0
    lines = lines.withColumn("core", core).where("core or not base")

    # Neighbouring diagonals of a template: a new copy begins where the last diagonal is further than NEAR.
    before = "lag(diagonal) over (partition by i, none, k, template order by diagonal)"
    lines = lines.withColumn("new", F.expr(f"case when base or {before} is null or diagonal - {before} > {NEAR} then 1 else 0 end"))
    lines = lines.withColumn("copy", F.expr("sum(new) over (partition by i, none, k, template order by diagonal)"))
    at = F.transform("on", lambda o: F.struct((F.col("diagonal") + o).alias("place"), o.alias("offset")))
    copies = lines.withColumn("at", at).groupBy("i", "none", "k", *about, "copy").agg(
        F.min("diagonal").alias("start"), F.max("diagonal").alias("stop"), F.max("core").alias("core"), F.flatten(F.collect_list("at")).alias("at")
    )
    share = F.when(F.col("base"), F.lit(1.0)).otherwise(chain(F.col("at"), F.col("size") - 1) / (F.col("size") - 1))
    spans = copies.where("core").withColumn("share", share).where(f"share >= {SHARE}")
    is_base = F.col("base")
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    found = spans.groupBy("i", "none", "k").agg(
        F.count_if(is_base).alias("n_base"), F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"), joined(is_base).alias("base_labels"),
        joined(F.lit(True)).alias("labels"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", (F.col("stop") + F.col("size")).alias("end"), "label", "share"))).alias("spans"),
    )
    rows = src.select("id", *row, F.size("w").alias("n"))
    out = lookup(rows, Workspace(docs.sparkSession, "licenses").save(found), ["i", "none", "k"], "left", listed="spans")
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
