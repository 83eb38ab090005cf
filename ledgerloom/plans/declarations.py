"""Declarations from words to fixed rows: facts, checks against themselves, and allocated codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scalars as S
from ..operators import checks, geometry, instruments


@dataclass
class Declarations:
    """rows: doc_id and the 36 columns; checks: doc_id, table_id, seq, id, passed, severity, detail; allocated: what ``instruments.record`` writes to the ledger (None without a pool)."""

    facts: DataFrame
    rows: DataFrame
    checks: DataFrame
    allocated: DataFrame | None


def _check(df: DataFrame, seq: int, id_: str, passed, severity, detail) -> DataFrame:
    return df.select("doc_id", F.lit(0).alias("table_id"), F.lit(seq).alias("seq"), F.lit(id_).alias("id"), passed.alias("passed"), severity.alias("severity"), detail.alias("detail"))


def run(words: DataFrame, pages: DataFrame, pool: DataFrame | None = None, ledger: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> Declarations:
    """words and pages as in ``geometry.declaration_facts``; documents that are no declarations give nothing, and the caller reads them as tables.

    pool (sheet, position, code) and ledger (key, isin) allocate codes; without a pool the column is empty, with a warning.
    An exhausted sheet and an unknown issuer are errors of their row, never of the run.
    """
    return from_facts(geometry.declaration_facts(words, pages), pool, ledger, config)


def from_facts(facts: DataFrame, pool: DataFrame | None = None, ledger: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> Declarations:
    """The same from facts (doc_id, page_no, title, ...)."""
    spark = facts.sparkSession
    keyed = instruments.with_keys(facts)
    if pool is None:
        allocated, out = None, keyed.withColumns({"isin": F.lit(None).cast("string"), "is_new": F.lit(False)})
    else:
        ledger = ledger if ledger is not None else spark.createDataFrame([], "key string, isin string")
        issuers = spark.createDataFrame([(token, name) for token, name, *_ in instruments.ISSUERS], "token string, name string")
        sheets = instruments.sheets_of(issuers, pool).select(F.col("token").alias("issuer_token"), "sheet")
        asked = keyed.filter("key is not null").join(F.broadcast(sheets), "issuer_token", "left")  # a row per issuer
        requests = asked.select("key", "sheet", F.struct("doc_id", "page_no").alias("seq"))
        allocated = instruments.allocate(requests, pool, ledger)
        out = keyed.join(allocated.select("key", "isin", "is_new"), "key", "left")
    has = F.col("isin").isNotNull()
    if pool is None:
        told = _check(out, 0, "isin_allocated", F.lit(False), F.lit("warning"), F.lit("No code pool is configured, so this column is empty."))
    else:
        detail = F.when(has & F.col("is_new"), F.concat("isin", F.lit(" newly taken from the pool."))).when(has, F.concat("isin", F.lit(" already held by this instrument."))).otherwise(F.coalesce("issuer_error", F.lit("The sheet has no free code left.")))
        told = _check(out, 0, "isin_allocated", has, F.when(has, "info").otherwise("error"), detail)
    # what follows needs no code: without the allocation its plan is a scan, not one more allocation each
    own = instruments.reconcile(keyed).select("doc_id", F.lit(0).alias("table_id"), F.lit(1).alias("seq"), "id", "passed", F.when(F.col("passed"), "info").otherwise("error").alias("severity"), F.lit("").alias("detail"))
    read = keyed.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("confidence").alias("c"))
    found = _check(read, 2, "declaration_read", F.lit(True), F.lit("info"), F.concat(S.counted(F.col("n"), "declaration row"), F.lit(", least confidence "), F.round(F.col("c") * 100).cast("int").cast("string"), F.lit("%.")))
    open_ = checks.unresolved_mapping(keyed.select("doc_id").distinct())
    return Declarations(out, instruments.to_rows(out, config=config), told.unionByName(own).unionByName(found).unionByName(open_), allocated)
