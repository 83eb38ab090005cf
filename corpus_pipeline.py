"""A training corpus from raw documents: language, quality, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents; the last returns the packed pieces. Null and empty texts are rejected by the first stage (no language); very long
texts are steps of their own in each. Scores do not tie with a limit in ways that matter: a row at the limit stays.
Repeated rows get equal verdicts, and one of them stays in the third stage. Further columns, also ones with names
that operators add, are carried through and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, langid, packing, quality
from ledgerloom.llm.common import materialize, settle, table
from ledgerloom.llm.queries import text_crc, tokenizer_path

#: A document stays if its language is at least so probable, and its quality score at least so high.
LANGUAGE_SCORE, QUALITY_SCORE = 0.35, 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    model = langid.fit(docs, F.expr(f"{text_crc()} % 4 != 2"))
    return langid.identify(docs, model, LANGUAGE_SCORE).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    model, _ = quality.learn(docs, table(spark, sf_dir, "labels").filter(f"{text_crc()} % 5 != 0"))
    return quality.accepted(docs, model, QUALITY_SCORE).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of least doc_id.

    Rows that share a doc_id, or have none, are documents of their own by their texts: such rows, few in a sound table, are
    numbered outside of the range of ids and written once; equal and similar texts among them and with all others are
    found like any. Ties cannot occur, repeated rows are copies, further columns of whatever name stay.
    """
    settle(spark)
    odd = materialize(docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").select("doc_id"), "odd-ids")
    if odd.isEmpty():
        return docs.join(_stay(docs.select("doc_id", "text")), "doc_id", "left_semi").select(*docs.columns)
    known = F.broadcast(odd.filter("doc_id is not null")) if odd.count() < 1_000_000 else odd.filter("doc_id is not null")
    plain = docs.filter("doc_id is not null").join(known, "doc_id", "left_anti").select(*docs.columns)
    rest = docs.join(known, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))  # rows with an id come first, and stay
    ends = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("lo"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("hi")).first()
    outside = F.lit(ends.hi) + 1 + F.monotonically_increasing_id() if ends.hi < 1 << 61 else F.lit(ends.lo) - 1 - F.monotonically_increasing_id()
    numbered = materialize(rest.withColumn("_number", outside), "odd-rows")
    stay = _stay(plain.select("doc_id", "text").unionByName(numbered.select(F.col("_number").alias("doc_id"), "text")))
    kept = plain.join(stay, "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(numbered.join(stay.withColumnRenamed("doc_id", "_number"), "_number", "left_semi").select(*docs.columns))


def _stay(rows: DataFrame) -> DataFrame:
    return jaccard.classes(rows, k=5, percent=80).filter("doc_id = component_id").select("doc_id")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return packing.pack(docs, tokenizer_path())[0]


STAGES = [("language ID", language), ("quality classifier", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", uncontaminated), ("packing", packed)]

#: The trained models and the cutting-stock program cannot be expressed in SQL; tests compare run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
