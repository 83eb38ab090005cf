"""Sinks: CSV with its report always beside it, sheets as relations, previews."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S

BOM = "﻿"


@dataclass(frozen=True)
class ExportPaths:
    csv: str
    report: str


def wide(cells: DataFrame, columns: DataFrame, doc_id: object, table_id: int) -> DataFrame:
    """One table as a wide frame in row order: the dynamic schema exists at the sink alone."""
    names = [(r.col_no, r.name) for r in columns.filter((F.col("doc_id") == doc_id) & (F.col("table_id") == table_id)).orderBy("col_no").collect()]
    value = F.coalesce(F.col("text"), F.date_format("date", "yyyy-MM-dd"), F.col("amount").cast("string"), F.lit(""))
    one = cells.filter((F.col("doc_id") == doc_id) & (F.col("table_id") == table_id))
    by = one.groupBy("row_no").agg(*[F.max(F.when(F.col("col_no") == k, value)).alias(f"c{k}") for k, _ in names])
    return by.orderBy("row_no").select(*[F.coalesce(f"c{k}", F.lit("")).alias(n) for k, n in names])


#: Name that reports are signed with.
TOOL = "ledgerloom"


def report(checks: DataFrame, flags: DataFrame, tables: DataFrame | None = None, documents: DataFrame | None = None, primary: DataFrame | None = None) -> DataFrame:
    """One JSON document per doc_id (doc_id, report): tool, n_rows and columns of the primary table, document, validation (passed, checks in order, flags), tables, extra_tables.

    tables: doc_id, table_id, n_rows, columns; documents: doc_id and what is known of it; primary: doc_id, table_id. What is
    not given is left out. Everything is grouped by document.
    """
    c = checks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("table_id", "seq", "id", "passed", "severity", "detail"))).alias("checks"))
    f = flags.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("table_id", "row", "column", "reason", "severity", "value"))).alias("flags"))
    passed = ~F.exists("checks", lambda x: ~x["passed"] & (x["severity"] == "error"))
    none = F.array().cast(f.schema["flags"].dataType)
    out = c.join(f, "doc_id", "left").withColumn("validation", F.struct(passed.alias("passed"), "checks", F.coalesce("flags", none).alias("flags")))
    parts = [F.lit(TOOL).alias("tool")]
    if tables is not None:
        first = primary if primary is not None else tables.groupBy("doc_id").agg(F.min("table_id").alias("table_id"))
        marked = tables.join(first.select("doc_id", F.col("table_id").alias("_first")), "doc_id", "left").withColumn("_main", F.coalesce(F.col("table_id") == F.col("_first"), F.lit(False)))
        each = F.struct((~F.col("_main")).alias("_rest"), "table_id", "n_rows", "columns")
        t = marked.groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("_t"))
        extra = F.transform(F.filter("_t", lambda x: x["_rest"]), lambda x, i: F.struct((i + 1).alias("index"), x["n_rows"].alias("n_rows"), x["columns"].alias("columns")))
        out = out.join(t, "doc_id", "left").withColumns({"n_rows": F.col("_t")[0]["n_rows"], "columns": F.col("_t")[0]["columns"], "extra_tables": extra})
        out = out.withColumn("tables", F.transform("_t", lambda x: F.struct(x["table_id"].alias("table_id"), x["n_rows"].alias("n_rows"), x["columns"].alias("columns"))))
        parts += ["n_rows", "columns"]
    if documents is not None:
        about = documents.select("doc_id", F.struct(*[x for x in documents.columns if x != "doc_id"]).alias("document"))
        out, parts = out.join(about, "doc_id", "left"), [*parts, "document"]
    parts += ["validation", *(["tables", "extra_tables"] if tables is not None else [])]
    return out.select("doc_id", F.to_json(F.struct(*parts)).alias("report"))


def summary_lines(checks: DataFrame) -> DataFrame:
    """doc_id and line: the verdict of each document in words."""
    bad = lambda severity: F.count_if(~F.col("passed") & (F.col("severity") == severity))
    n = checks.groupBy("doc_id").agg(F.count("*").alias("n"), bad("error").alias("e"), bad("warning").alias("w"))
    parts = [S.counted(F.col("n"), "check"), S.counted(F.col("e"), "error"), S.counted(F.col("w"), "warning")]
    return n.select("doc_id", F.concat(F.when(F.col("e") == 0, "PASS").otherwise("FAIL"), F.lit(": "), F.concat_ws(", ", *parts)).alias("line"))


def table_file(name: Column, position: Column) -> Column:
    """The file of a document's table: the primary one, of position 0, has the document's name, others are numbered from 2."""
    return F.concat(name, F.when(position == 0, ".csv").otherwise(F.concat(F.lit(".table"), (position + 1).cast("string"), F.lit(".csv"))))


def read_csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    """What ``export_csv`` wrote: the byte order mark is no part of the first name."""
    return spark.read.schema(schema).option("header", True).option("sep", delimiter).option("escape", '"').option("enforceSchema", True).csv(path)


def monotone(events: DataFrame, keys: list[str], order: str, value: str = "percent") -> DataFrame:
    """``events`` with a progress that never falls."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(value, F.max(value).over(w))


def expired(jobs: DataFrame, keep: int = 40) -> DataFrame:
    """Finished jobs (job_id, created, finished) beyond the ``keep`` newest: their files can go. The newest are found by a top-k, not by a sort of all."""
    done = jobs.filter("finished")
    newest = done.orderBy(F.desc("created"), F.desc("job_id")).limit(keep)
    return done.join(F.broadcast(newest.select("job_id")), "job_id", "left_anti")


def cache_size(spark: SparkSession, path: str) -> int:
    """Bytes that a cache folder holds; 0 without one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def clear_cache(spark: SparkSession, path: str) -> int:
    """Delete a cache folder; returns the bytes it held."""
    size = cache_size(spark, path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return size


def export_csv(table: DataFrame, reports: DataFrame, path: str, delimiter: str = ",") -> ExportPaths:
    """Write a table and its report, both or neither: the report first, so that no table is ever without one. A table of one document: one file; ``export_all`` is for many."""
    paths = ExportPaths(f"{path}.csv", f"{path}.report.json")
    reports.select("report").coalesce(1).write.mode("overwrite").text(paths.report)
    first, *rest = table.columns
    marked = table.withColumnRenamed(first, BOM + first)
    marked.coalesce(1).write.mode("overwrite").option("header", True).option("sep", delimiter).option("escape", '"').csv(paths.csv)
    return paths


def export_all(cells: DataFrame, checks: DataFrame, flags: DataFrame, path: str) -> None:
    """Every document's typed cells and reports, by document: the form for many documents at once."""
    report(checks, flags).write.mode("overwrite").parquet(f"{path}/reports")
    cells.drop("flags").write.mode("overwrite").partitionBy("table_id").parquet(f"{path}/cells")


def validation_sheet(checks: DataFrame) -> DataFrame:
    return checks.withColumn("status", F.when(F.col("passed"), "PASS").otherwise(F.upper("severity")))


def document_sheet(documents: DataFrame) -> DataFrame:
    """Field and value of each document."""
    fields = [c for c in documents.columns if c != "doc_id"]
    return documents.select("doc_id", *[F.col(c).cast("string").alias(c) for c in fields]).unpivot("doc_id", fields, "field", "value")


def column_widths(cells: DataFrame, keys: list[str], first_rows: int = 200) -> DataFrame:
    """keys, col_no, width: the longest of the first rows and two more, from 10 to 50."""
    return cells.filter(F.col("row_no") < first_rows).groupBy(*keys, "col_no").agg(F.greatest(F.lit(10), F.least(F.lit(50), F.max(F.length("raw")) + 2)).alias("width"))


def highlighted(cells: DataFrame, columns: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the flags that a workbook would colour."""
    named = cells.join(columns.select(*keys, "col_no", "name"), [*keys, "col_no"])
    f = flags.select(*keys, F.col("row").alias("row_no"), F.col("column").alias("name"), F.col("reason"), F.col("severity"))
    return named.join(f, [*keys, "row_no", "name"], "left")


def preview(rows: DataFrame, keys: list[str], offset: int = 0, limit: int = 500, flags: DataFrame | None = None) -> DataFrame:
    """The rows offset to offset + limit - 1 of each table, and whether there are more; with flags (keys, row, column, reason, severity), each row's own as a list."""
    more = F.max("row_no").over(Window.partitionBy(*keys)) >= offset + limit
    part = rows.withColumn("truncated", more).filter((F.col("row_no") >= offset) & (F.col("row_no") < offset + limit))
    if flags is None:
        return part
    shown = flags.filter((F.col("row") >= offset) & (F.col("row") < offset + limit))
    own = shown.groupBy(*keys, F.col("row").alias("row_no")).agg(F.sort_array(F.collect_list(F.struct("column", "reason", "severity"))).alias("flags"))
    return part.join(own, [*keys, "row_no"], "left").withColumn("flags", F.coalesce("flags", F.array().cast(own.schema["flags"].dataType)))


def write_word_cache(words: DataFrame, path: str) -> None:
    """Recognised words by content hash, page and resolution, in folders by the hash's first two digits; the committer makes each write whole or nothing."""
    words.withColumn("sha_prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("sha_prefix").parquet(path)


def safe_name(name: Column | str) -> Column | str:
    """A file name without path, control and reserved characters."""
    if isinstance(name, str):
        return re.sub(r"[^\w.\- ]+", "_", name.replace("\\", "/").rsplit("/", 1)[-1]).strip(" .") or "document"
    base = F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)
    return F.regexp_replace(base, r"(?U)[^\w.\- ]+", "_")
