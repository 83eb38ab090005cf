"""Pages to tables: routing, usable grids, headers, continuation over pages, repeated headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scalars as S

# The parts of a header's score (filled, neither number nor date, different, short), and how long a short cell may be.
FILLED, WORDED, DIFFERENT, SHORT, SHORT_CHARS = 0.20, 0.45, 0.20, 0.15, 40
#: A header must score so high, a later row beat an earlier by so much, and stand so far up; a table near a page's edge may run on.
HEADER_SCORE, HEADER_LEAD, HEADER_ROWS, EDGE = 0.62, 0.05, 4, 0.28


def page_kind(config: EngineConfig = EngineConfig()) -> Column:
    """digital, scanned or empty, from n_chars, has_images, has_vectors and read_error."""
    return (
        F.when(F.col("read_error"), "scanned").when(F.col("n_chars") >= config.min_text_chars, "digital").when(F.col("has_images"), "scanned")
        .when(F.col("n_chars") > 0, "digital").when(F.col("has_vectors"), "scanned").otherwise("empty")
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """doc_id and how many pages are of each kind."""
    return pages.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("digital", "scanned", "empty")])


def reroute(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """``pages`` with digital ones that hold images but gave no table as scanned."""
    found = tables.select("doc_id", "page_no").distinct().withColumn("_t", F.lit(True))
    again = (F.col("kind") == "digital") & F.col("has_images") & F.col("_t").isNull()
    return pages.join(found, ["doc_id", "page_no"], "left").withColumn("kind", F.when(again, "scanned").otherwise(F.col("kind"))).drop("_t")


def is_declaration(text: Column) -> Column:
    """Could a document be a declaration? Without text it could; else it names one."""
    return F.coalesce(F.trim(text) == "", F.lit(True)) | F.upper(text).rlike("DECLARATION|CERTIFICAT DE DEPOT|CERTIFICAT DE DÉPÔT")


# ------------------------------------------------------------------ grids


def clean_cells(cells: Column) -> Column:
    return F.transform(cells, S.collapse)


def raggedness(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and raggedness: the spread of row lengths over the greatest; 1.0 for tables without cells."""
    n = F.size("cells")
    return rows.groupBy(*keys).agg(F.when(F.max(n) > 0, (F.max(n) - F.min(n)) / F.max(n)).otherwise(1.0).alias("raggedness"))


def rectangular(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` padded on the right to their table's greatest width."""
    width = F.max(F.size("cells")).over(Window.partitionBy(*keys))
    return rows.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), width - F.size("cells"))))


def nonblank(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def drop_blank(rows: DataFrame, keys: list[str], columns: bool = True) -> DataFrame:
    """Without blank rows, and without blank columns if asked for."""
    rows = rows.filter(nonblank(F.col("cells")))
    if not columns:
        return rows
    flags = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    used = rows.select(*keys, F.posexplode(flags).alias("_i", "_u")).filter("_u").groupBy(*keys).agg(F.collect_set("_i").alias("_used"))
    return rows.join(used, keys).withColumn("cells", F.filter("cells", lambda c, i: F.array_contains(F.col("_used"), i))).drop("_used")


def usable(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the tables with two rows and two columns or more."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("w")).filter("n >= 2 and w >= 2").select(*keys)


# ------------------------------------------------------------------ headers


def signature(cells: Column) -> Column:
    """A row's cells without case, accents and punctuation."""
    return F.array_join(F.transform(cells, lambda c: S.fold(F.coalesce(c, F.lit("")))), "|")


def header_score(cells: Column) -> Column:
    """0 to 1: how much a row looks like titles: filled, neither numbers nor dates, different, short."""

    def of(filled: Column) -> Column:
        n = F.size(filled)
        data = F.size(F.filter(filled, S.looks_numeric)) + F.size(F.filter(filled, lambda c: S.parse_date(c).isNotNull()))
        different = F.size(F.array_distinct(F.transform(filled, S.fold)))
        short = F.size(F.filter(filled, lambda c: F.length(c) <= SHORT_CHARS))
        return F.when(n > 0, FILLED * n / F.size(cells) + WORDED * (1 - data / n) + DIFFERENT * different / n + SHORT * short / n).otherwise(0.0)

    return S.let(F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != ""), of)


def find_headers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, header (cells; empty if no row convinces), consumed (rows up to it), signature. rows: keys, row_no, cells.

    The first rows are folded in order: a later one must beat the best by a lead. A second header line that fills gaps
    of the first is merged with it.
    """
    first = Window.partitionBy(*keys).orderBy("row_no")
    top = rows.withColumn("i", F.row_number().over(first) - 1).filter(F.col("i") <= HEADER_ROWS).withColumn("score", header_score(F.col("cells")))
    lists = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "score", "cells"))).alias("r"))
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).cast("double").alias("score"))
    lead = lambda x: F.when(x["i"] > 0, F.lit(HEADER_LEAD)).otherwise(0.0)
    best = F.aggregate(F.slice("r", 1, HEADER_ROWS), start, lambda b, x: F.when(x["score"] > b["score"] + lead(x), F.struct(x["i"].cast("int").alias("i"), x["score"].cast("double").alias("score"))).otherwise(b))
    lists = lists.withColumn("best", best).withColumn("at", F.when(F.col("best.score") >= HEADER_SCORE, F.col("best.i")).otherwise(-1))
    lists = lists.withColumn("head", F.when(F.col("at") >= 0, F.try_element_at("r", F.col("at") + 1)["cells"]).otherwise(F.array().cast("array<string>")))
    lists = lists.withColumn("next", F.when(F.col("at") >= 0, F.try_element_at("r", F.col("at") + 2)))
    gap = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    pairs = F.arrays_zip(F.col("head").alias("a"), F.col("next.cells").alias("b"))
    gaps, under = F.size(F.filter("head", gap)), F.size(F.filter(pairs, lambda p: gap(p["a"]) & ~gap(p["b"])))
    merged = F.coalesce((F.col("next.score") >= HEADER_SCORE) & (F.size("next.cells") == F.size("head")) & (gaps > 0) & (under >= F.greatest(F.lit(1), F.floor(gaps / 2))), F.lit(False))
    header = F.when(merged, F.transform(pairs, lambda p: F.trim(F.concat_ws(" ", F.trim(p["a"]), F.trim(p["b"]))))).otherwise(F.col("head"))
    return lists.select(*keys, header.alias("header"), (F.col("at") + 1 + merged.cast("int")).alias("consumed"), F.when(F.size(header) > 0, signature(header)).otherwise("").alias("signature"))


# ------------------------------------------------------------------ continuation


def continuation_groups(tables: DataFrame) -> DataFrame:
    """``tables`` with group_id, from 0 per doc_id. tables: doc_id, page_no, table_no, n_cols, header_sig, first_sig, top, bottom, page_height (null: unknown).

    A table goes on with its predecessor's group if it has as many columns, is on the next page, and either its first row
    is the header of the group's first table or the predecessor ran to the foot of its page and it starts at the head.
    The group's header is carried by a fold over the document's tables in order.
    """
    row = F.struct("page_no", "table_no", "n_cols", "header_sig", "first_sig", "top", "bottom", "page_height")
    docs = tables.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("t"))  # a document's tables
    unknown = lambda x: x["page_height"].isNull() | (x["page_height"] == 0)
    low = lambda x: F.coalesce(unknown(x) | x["bottom"].isNull() | (x["bottom"] >= x["page_height"] * (1 - EDGE)), F.lit(True))
    high = lambda x: F.coalesce(unknown(x) | x["top"].isNull() | (x["top"] <= x["page_height"] * EDGE), F.lit(True))

    def step(acc: Column, x: Column) -> Column:
        p = acc["prev"]
        repeated = (acc["sig"] != "") & (x["first_sig"] == acc["sig"])
        goes_on = F.coalesce((p["n_cols"] == x["n_cols"]) & (x["page_no"] - p["page_no"] == 1) & (repeated | (low(p) & high(x))), F.lit(False))
        group = F.when(goes_on, acc["group"]).otherwise(acc["group"] + 1)
        return F.struct(group.alias("group"), F.when(goes_on, acc["sig"]).otherwise(x["header_sig"]).alias("sig"), x.alias("prev"), F.concat(acc["ids"], F.array(group)).alias("ids"))

    start = F.struct(F.lit(-1).alias("group"), F.lit("").alias("sig"), F.try_element_at("t", F.lit(0) + F.size("t") + 1).alias("prev"), F.array().cast("array<int>").alias("ids"))
    folded = docs.withColumn("ids", F.aggregate("t", start, step, lambda acc: acc["ids"]))
    out = folded.select("doc_id", F.explode(F.arrays_zip("t", "ids")).alias("z"))
    return out.select("doc_id", "z.t.*", F.col("z.ids").alias("group_id"))


def pad_to_header(cells: Column, width: Column) -> Column:
    """Short rows padded with blanks; what a long one has too much is joined to its last cell."""
    over = F.array_join(F.filter(F.slice(cells, width, F.greatest(F.size(cells) - width + 1, F.lit(1))), lambda c: F.trim(c) != ""), " ")
    return F.when(F.size(cells) > width, F.concat(F.slice(cells, 1, F.greatest(width - 1, F.lit(0))), F.array(over))).otherwise(F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells))))


def pad_confidences(confs: Column, width: Column) -> Column:
    """As many confidences as columns: 1.0 where there is none, none beyond the width."""
    known = F.coalesce(confs, F.array().cast("array<double>"))
    return F.slice(F.concat(known, F.array_repeat(F.lit(1.0), F.greatest(width - F.size(known), F.lit(0)))), F.lit(1), width)


def stitch(rows: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each group in page order, numbered from 0: the header's rows go from the first page, rows equal to the header everywhere, blank rows too.

    rows: keys, page_no, row_no, cells, and table_no, kind and confs if they are known, which stay; headers: keys, header, consumed,
    signature of the group's first page.
    """
    place = ["page_no", "table_no"] if "table_no" in rows.columns and "table_no" not in keys else ["page_no"]
    joined = rows.join(headers, keys)
    first = F.min(F.struct(*place)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys, *place).orderBy("row_no"))
    joined = joined.withColumn("_first", first).withColumn("_at", at)
    head = (F.col("_first") == F.struct(*place)) & (F.col("_at") <= F.col("consumed"))
    same = (F.col("signature") != "") & (signature(F.col("cells")) == F.col("signature"))
    kept = joined.filter(~head & ~same & ~F.forall("cells", S.is_blank_marker))
    width = F.when(F.size("header") > 0, F.size("header")).otherwise(F.size("cells"))
    order = Window.partitionBy(*keys).orderBy(*place, "_at")
    more = [F.col("kind")] if "kind" in rows.columns else []
    more += [pad_confidences(F.col("confs"), width).alias("confs")] if "confs" in rows.columns else []
    return kept.select(*keys, (F.row_number().over(order) - 1).alias("row_no"), "page_no", pad_to_header(F.col("cells"), width).alias("cells"), *more)


def in_output_order(tables: DataFrame, primary: DataFrame) -> DataFrame:
    """``tables`` (doc_id, table_id) with position: the primary table first, the rest in their order. primary: doc_id, table_id."""
    marked = tables.join(primary.select("doc_id", F.col("table_id").alias("_p")), "doc_id", "left")
    return marked.withColumn("position", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce(F.col("table_id") != F.col("_p"), F.lit(True)), "table_id")) - 1).cast("int")).drop("_p")


def primary_table(cells: DataFrame) -> DataFrame:
    """doc_id and table_id of each document's table with most cells that are not blank; the first on ties. cells: doc_id, table_id, raw."""
    counts = cells.groupBy("doc_id", "table_id").agg(F.count_if(F.trim(F.coalesce("raw", F.lit(""))) != "").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "table_id"))).filter("_r = 1").select("doc_id", "table_id", "n")


def table_label(names: Column) -> Column:
    """The first two names that are not made up, at most 40 characters."""
    text = F.array_join(F.slice(F.filter(names, lambda n: ~n.startswith("column_")), 1, 2), ", ")
    return F.when(F.length(text) > 40, F.concat(F.substring(text, 1, 37), F.lit("..."))).otherwise(text)
