"""The corpus pipeline: stages over ``documents``, each one operator of ``loomlake.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns
of ``documents``; other columns of their input are left out. Empty tables pass through as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import bpe, quality
from loomlake.llm.common import LOOKUP_ROWS, Workspace, lookup, table
from loomlake.llm.contamination import contaminated
from loomlake.llm.minhash import near_duplicates
from loomlake.llm.pii import personal_spans, redacted
from loomlake.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with __key: a 128-bit digest of id and text (nulls have marks of their own), which tells rows apart."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    text = F.when(F.col("text").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("text")))
    return docs.select(*COLUMNS, F.unhex(F.md5(F.concat(doc_id, F.lit(":"), text))).alias("__key"))


def _without(spark: SparkSession, docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``: these are broadcast where their number allows, else joined by a shuffle."""
    return lookup(docs, Workspace(spark, "drop").save(keys.distinct()), key, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.3 or more stay. The model learns from the labels of ``docs`` outside the held-out fold.

    Null and empty texts are scored as texts without characters; repeated rows get equal scores.
    """
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model).where(F.col("__score") >= quality.THRESHOLD).select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one of smallest doc_id, null ids behind all others.

    Rows are told apart by id and text: of rows equal in both one stays, other rows of the same id are
    judged by their own texts. Rows without words stay.
    """
    keyed = _keyed(docs)
    work = Workspace(spark, "groups")
    found = work.save(near_duplicates(keyed, id_col="__key").select("__key", "component_id"))
    twice = work.save(found.groupBy("__key").count().where("count > 1").select("__key"))
    members = found.where("__key <> component_id")
    members = work.save(members.unionByName(members.select(F.col("component_id").alias("__key"), "component_id")).distinct())
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"]
    stay = lookup(keyed.select("__key", "doc_id"), members, "__key").groupBy("component_id").agg(first.alias("__key"))
    kept = _without(spark, keyed, members.select("__key").join(stay.select("__key"), "__key", "left_anti"), "__key")
    if not twice.isEmpty():
        row = F.min(F.struct(*COLUMNS)).alias("row")
        once = lookup(kept, twice, "__key", "left_semi").groupBy("__key").agg(row).select("row.*", "__key")
        kept = lookup(kept, twice, "__key", "left_anti").unionByName(once.select(*kept.columns))
    return kept.select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go; rows are told apart by id and text.

    Rows of null or empty text hold nothing and stay; repeated rows go or stay together.
    """
    keyed = _keyed(docs)
    found = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="__key")
    return _without(spark, keyed, found.select("__key"), "__key").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets; n_chars is the new text's length.

    Rows without spans, of null or empty text among them, stay as they are, n_chars too; repeated rows are redacted
    alike. Where the spans are few they are broadcast to the texts, so these do not move.
    """
    keyed = _keyed(docs)
    found = personal_spans(keyed, id_col="__key").where(F.size("spans") > 0).select("__key", "spans").dropDuplicates(["__key"])
    found = Workspace(spark, "spans").save(found.withColumnRenamed("spans", "__spans"))
    few = (found.agg(F.sum(F.size("__spans"))).first()[0] or 0) <= LOOKUP_ROWS
    none = F.array().cast(found.schema["__spans"].dataType)
    text = redacted(F.col("text"), F.coalesce("__spans", none))
    out = keyed.join(F.broadcast(found) if few else found, "__key", "left").withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the decoded text of each row.

    Null and empty texts have no ids and the hash of the empty text; repeated rows are returned each.
    """
    out = bpe.encode(docs.select("doc_id", "text"), WORD_BPE, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("minhash_dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, as the next one's input."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.save(docs)
    return docs
