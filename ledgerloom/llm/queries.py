"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, licenses, packing, quality, repetition, urlfilter, wrapper
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_crc(column: str = "doc_id") -> str:
    """crc32 of an id as text."""
    return f"crc32(cast(cast({column} as string) as binary))"


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    found = repetition.rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held_out = F.expr(f"coalesce({text_crc()} % 5 = 0, false)")
    model, x = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out))
    return quality.scored(x, model).select("doc_id", held_out.alias("held_out"), "score", F.expr("cast(score >= 0.3 as int)").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, licenses (ids, comma-joined), n_licenses."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_licenses")


#: The URL rules of op4.
URL_RULES = [urlfilter.parse_rule(*x) for x in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urlfilter.fit(pages, "url", urlfilter.seeded(F.col("url"), URL_RULES))
    return urlfilter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return jaccard.classes(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.expr(f"coalesce({text_crc()} % 4 = 2, false)")
    model = langid.fit(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


#: A further conversation whose texts hold control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], rows.schema)
    return chat.read_back(chat.formatted(rows.unionByName(hard)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())[0]


QUERIES = {
    "op1_repetition_rules": op1_repetition_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_packing": op10_packing,
}
SQL: dict[str, str] = {
    "op1_repetition_rules": repetition.SQL,
    "op3_license_scan": licenses.SQL,
    "op5_jaccard_join": jaccard.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op9_chat_formatting": chat.SQL,
}
