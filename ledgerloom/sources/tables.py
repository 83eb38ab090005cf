"""Sources: test tables, profiles, files, words, code pools and ledgers, as DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Profile

CODE = r"^[A-Z]{2}[A-Z0-9]{9}[A-Z0-9]$"
POOL_HEADINGS = ["ISIN", "CODE", "CODES", "CODE ISIN"]
WORDS = "doc_id string, page_no int, rotation int, box_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, max_bytes: int = 200 << 20) -> DataFrame:
    """Binary files with their hash and a verdict on whether they can be read."""
    return file_verdicts(spark.read.format("binaryFile").load(path), max_bytes)


def file_verdicts(raw: DataFrame, max_bytes: int = 200 << 20) -> DataFrame:
    """path, source_name, size_bytes, sha256 and problem (null if there is none): suffix, size, magic bytes. raw: path, length, content."""
    problem = (
        F.when(~F.lower("path").endswith(".pdf"), "not a .pdf file")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > max_bytes, "file too large")
        .when(F.expr("substring(content, 1, 4) != X'25504446'"), "no PDF content")
    )
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("source_name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), problem.alias("problem"))


#: Where a code pool is looked for if it is not named: this variable, then these folders.
POOL_VARIABLE, POOL_FOLDERS = "LEDGERLOOM_CODE_POOL", (".", "data")


def discover_pool(folders: tuple[str, ...] = POOL_FOLDERS) -> str | None:
    """The file of code cells: what the environment names, else the first CSV or Parquet file by name in the folders, one with ``isin`` in its name before others."""
    named = os.environ.get(POOL_VARIABLE)
    if named:
        return named
    for folder in folders:
        found = sorted((p for p in Path(folder).glob("*") if p.suffix.lower() in (".csv", ".parquet")), key=lambda p: ("isin" not in p.name.lower(), p.name))
        if found:
            return str(found[0])
    return None


def words(spark: SparkSession, path: str) -> DataFrame:
    """Positioned words from JSON lines or Parquet."""
    return spark.read.schema(WORDS).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(WORDS).parquet(path)


def polygons_to_boxes(df: DataFrame) -> DataFrame:
    """Recognised polygons (``polygon`` array of [x, y]) as boxes; blank and malformed detections go."""
    ok = df.filter((F.trim("text") != "") & (F.size("polygon") >= 3) & F.forall("polygon", lambda p: F.size(p) == 2))
    xs, ys = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    return ok.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}).drop("polygon")


def code_pool(cells: DataFrame) -> DataFrame:
    """Codes per sheet in order of first appearance. cells: sheet, position, value."""
    clean = cells.withColumn("code", F.upper(F.trim("value"))).filter(F.col("code").rlike(CODE) & ~F.col("code").isin(POOL_HEADINGS))
    first = clean.groupBy("sheet", "code").agg(F.min("position").alias("at"))
    return first.select("sheet", (F.row_number().over(Window.partitionBy("sheet").orderBy("at", "code")) - 1).alias("position"), "code")


def code_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of allocated codes; a corrupt file is fatal."""
    return spark.read.schema("key string, isin string, allocated_at timestamp, note string").option("mode", "FAILFAST").json(path)


def profiles(folder: str) -> tuple[list[Profile], list[str]]:
    """YAML profiles by file name; unreadable ones are skipped with a warning."""
    import yaml

    out, warnings = [], []
    for p in sorted(Path(folder).glob("*.y*ml")):
        try:
            profile, more = Profile.from_dict(yaml.safe_load(p.read_text()) or {})
        except Exception as e:  # noqa: BLE001
            warnings.append(f"{p.name}: {type(e).__name__}")
            continue
        out.append(profile)
        warnings += more
    return out, warnings


def cached_words(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words found in the cache, pages that miss), by content hash, page, resolution."""
    key = ["sha256", "page_no", "dpi"]
    return cache.join(pages.select(*key).distinct(), key, "left_semi"), pages.join(cache.select(*key).distinct(), key, "left_anti")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per customer, in cents: doc_id, row_no, o_orderkey, date, debit, credit, movement, balance (null where unreadable)."""
    w = Window.partitionBy("doc_id").orderBy("o_orderdate", "o_orderkey")
    # the number is named so that few bytes still come in many partitions: later steps parse every cell
    rows = table(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("o_custkey")).select(
        F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderdate", F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    rows = rows.withColumn("debit", F.when(F.col("status") == "F", F.col("cents"))).withColumn("credit", F.when(F.col("status") != "F", F.col("cents")))
    rows = rows.withColumn("movement", F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).withColumn("row_no", F.row_number().over(w) - 1)
    rows = rows.withColumn("running", F.sum("movement").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    balance = F.when(F.col("o_orderkey") % 53 != 0, F.col("running") + F.when(F.col("o_orderkey") % 97 == 0, 100).otherwise(0))
    return rows.select("doc_id", F.col("row_no").cast("int").alias("row_no"), "o_orderkey", "date", "debit", "credit", "movement", balance.alias("balance"))


def rendered(cents: Column, notation: Column) -> Column:
    """Cents as a cell, in one of eight notations: separators, spaces, brackets, signs, words, currencies."""
    whole, part = F.abs(cents) / 100, F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")
    grouped = F.format_number(F.floor(whole), 0)
    anglo = F.concat(grouped, F.lit("."), part)
    continental = F.concat(F.translate(grouped, ",", "."), F.lit(","), part)
    spaced = F.concat(F.translate(grouped, ",", " "), F.lit(","), part)
    negative = cents < 0
    sign = lambda x: F.when(negative, F.concat(F.lit("-"), x)).otherwise(x)
    return (
        F.when(notation == 0, sign(anglo))
        .when(notation == 1, sign(continental))
        .when(notation == 2, F.when(negative, F.concat(F.lit("("), anglo, F.lit(")"))).otherwise(anglo))
        .when(notation == 3, F.concat(anglo, F.when(negative, F.lit(" DR")).otherwise(F.lit(" CR"))))
        .when(notation == 4, F.concat(spaced, F.when(negative, F.lit("-")).otherwise(F.lit(""))))
        .when(notation == 5, F.concat(F.lit("€ "), sign(continental)))
        .when(notation == 6, F.concat(sign(anglo), F.lit(" USD")))
        .otherwise(F.when(negative, F.concat(F.lit("$["), anglo, F.lit("]"))).otherwise(F.concat(F.lit("$"), anglo)))
    )


STATEMENT = ["Date", "Description", "Reference", "Debit", "Credit", "Balance"]


def statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements as raw table cells (doc_id, table_id, row_no, col_no, raw, row_kind, conf), in one notation per document; the last row states totals."""
    rows = ledger(spark, sf_dir)
    euro = F.col("doc_id") % 2
    shown = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(rendered(F.col(c), euro))
    cells = rows.select("doc_id", "row_no", F.array(F.date_format("date", "dd/MM/yyyy"), F.concat(F.lit("Order "), F.chr(F.lit(65) + (F.col("o_orderkey") % 26))), F.concat(F.lit("00"), F.col("o_orderkey").cast("string")), shown("debit"), shown("credit"), shown("balance")).alias("cells"))
    totals = rows.groupBy("doc_id").agg(F.max("row_no").alias("last"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    # a document in 11 states a total that is 1.00 too high
    off = F.when(F.col("doc_id") % 11 == 0, 100).otherwise(0)
    totals = totals.select("doc_id", (F.col("last") + 1).alias("row_no"), F.array(F.lit(""), F.lit("TOTAL"), F.lit(""), rendered(F.coalesce("debit", F.lit(0)) + off, euro), rendered(F.coalesce("credit", F.lit(0)), euro), F.lit("")).alias("cells"))
    return cells.unionByName(totals).select("doc_id", F.lit(0).alias("table_id"), "row_no", "cells")


