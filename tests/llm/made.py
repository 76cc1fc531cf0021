"""Small tables for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, c string, kept string, score string, label string"


def make_docs(spark, rows, parts=3):
    """(doc_id, text) rows as a table whose other columns clash with the operators' own names or are null."""
    data = [(i, t, None, "s", None if t is None else len(t), "x", None, "no", None, "y") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)
