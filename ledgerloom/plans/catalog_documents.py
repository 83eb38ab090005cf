"""More registered queries: words to page rows, whole runs of the engine, declarations, sources and sinks, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..config import EngineConfig, Profile
from ..functions import scalars as S
from ..operators import checks, geometry, infer, instruments, normalize, stitch
from ..sources import tables as sources
from ..sources.tables import code_pool, ledger, rendered, table
from ..storage import Scratch
from . import declarations, engine
from .catalog import BREAKS, FACTS_SQL, TOKENS, query

_text = lambda c: c.cast("string")
_int = lambda c: c.cast("int")

# ------------------------------------------------------------------ scalars


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def short_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with years of two digits: 70 to 99 are of the last century."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.parse_date(F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yy")).alias("d"))


@query("SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS DOUBLE) AS amount FROM orders")
def compatible_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in full-width, superscript, subscript and circled forms."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    k, plain = F.col("o_orderkey") % 3, rendered(F.col("cents"), F.lit(0))
    forms = F.when(k == 0, F.translate(plain, "0123456789,.", "０１２３４５６７８９，．")).when(k == 1, F.translate(plain, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")).otherwise(F.translate(plain, "0123456789", "₀①②③④⑤⑥⑦⑧⑨"))
    return o.select("o_orderkey", S.parse_amount(forms).alias("amount"))


@query(FACTS_SQL + "SELECT doc_id, taux, CAST(q * 1000 AS INTEGER) AS quantite, d2 AS d FROM f")
def fact_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first percentage, integer and date of texts that glue them together."""
    f = _facts(spark, sf_dir)
    day, rate = F.date_format("date_remboursement", "dd/MM/yyyy"), F.replace(F.format_string("%.2f", "taux"), F.lit("."), F.lit(","))
    return f.select("doc_id", S.first_percent(F.concat(F.lit("du "), day, rate, F.lit(" %"))).alias("taux"), S.first_int(F.concat(F.lit("n. "), _text(F.col("quantite")), F.lit(" 000 certificats"))).alias("quantite"), S.first_date(F.concat(day, rate, F.lit("%"))).alias("d"))


@query("""
WITH k AS (SELECT o_custkey AS doc_id, count(*) AS n, list_sort(list(CAST(o_orderkey AS BIGINT))) AS l FROM orders GROUP BY o_custkey)
SELECT doc_id, format('{:,}', n * 1000) || ' rows' AS many, CASE WHEN n = 1 THEN '1 row' ELSE format('{:,}', n) || ' rows' END AS counted, array_to_string(l[1:5], ', ') || CASE WHEN n > 5 THEN ' and ' || CAST(n - 5 AS VARCHAR) || ' more' ELSE '' END AS listed FROM k""")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("o_orderkey")).cast("array<string>").alias("l"))
    return k.select("doc_id", S.counted(F.col("n") * 1000, "row").alias("many"), S.counted(F.col("n"), "row").alias("counted"), S.listed(F.col("l")).alias("listed"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_quantity END AS value FROM lineitem")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.nan_to_null(q).alias("value"))


_SPACE = "[ \\t\\n\\x0b\\f\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(f"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g'))) AS digest FROM documents")
def cell_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as cells: white space collapsed, nulls empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(stitch.clean_cells(F.array("text"))[0].cast("binary")).alias("digest"))


@query("SELECT doc_id, regexp_replace(regexp_extract(source || '/' || coalesce(lang, '') || ': <a>?*.pdf', '[^/]*$'), '[^a-zA-Z0-9_.\\- ]+', '_', 'g') AS name FROM documents")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of sources and languages, without what a file system reserves."""
    return table(spark, sf_dir, "documents").select("doc_id", sinks.safe_name(F.concat(F.col("source"), F.lit("\\"), F.coalesce("lang", F.lit("")), F.lit(": <a>?*.pdf"))).alias("name"))


@query("SELECT doc_id, trim(coalesce(text, '')) = '' OR regexp_matches(upper(text), 'DECLARATION|CERTIFICAT DE D[EÉ]P[OÔ]T|THE ') AS maybe FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' declaration' WHEN doc_id % 11 = 0 THEN '' ELSE replace(upper(text), 'THE ', '') END AS text FROM documents)")
def declaration_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents could be declarations; some are made to name one, some have no text."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(k, F.when(k % 7 == 0, F.concat("text", F.lit(" declaration"))).when(k % 11 == 0, "").otherwise(F.replace(F.upper("text"), F.lit("THE "), F.lit(""))).alias("text"))
    return d.select("doc_id", stitch.is_declaration(F.col("text")).alias("maybe"))


# ------------------------------------------------------------------ pages and rows


@query("""
WITH p AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN 'empty' WHEN l_partkey % 2 = 0 THEN 'digital' ELSE 'scanned' END AS kind FROM lineitem)
SELECT doc_id, CAST(count(*) FILTER (kind = 'digital') AS BIGINT) AS digital, CAST(count(*) FILTER (kind = 'scanned') AS BIGINT) AS scanned, CAST(count(*) FILTER (kind = 'empty') AS BIGINT) AS empty FROM p GROUP BY doc_id""")
def page_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.page_counts(_line_pages(spark, sf_dir))


def _line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "empty").when(F.col("l_partkey") % 2 == 0, "digital").otherwise("scanned")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), kind.alias("kind"), (F.col("l_suppkey") % 3 > 0).alias("has_images"), (F.col("l_quantity") > 20).alias("has_table"))


@query("""
SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_linenumber % 3 = 0 THEN 'empty' WHEN l_partkey % 2 = 0 AND NOT (l_suppkey % 3 > 0 AND max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) <= 20) THEN 'digital' ELSE 'scanned' END AS kind FROM lineitem""")
def ocr_reroute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital pages with images that gave no table are read again as scans."""
    pages = _line_pages(spark, sf_dir)
    return stitch.reroute(pages, pages.filter("has_table")).select("doc_id", "page_no", "kind")


@query("""
SELECT doc_id, 'Document has ' || format('{:,}', n) || ' pages; only the first 40 were processed.' AS warning
FROM (SELECT l_suppkey AS doc_id, count(*) AS n FROM lineitem GROUP BY l_suppkey) WHERE n > 40""")
def page_limit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as pages of one document, against a limit of forty."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.row_number().over(w).alias("page_no"))
    return engine.page_warnings(pages, EngineConfig(max_pages=40))


@query("""
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_no, l_partkey, list_transform(range(1, CAST(l_linenumber % 4 + 2 AS BIGINT)), lambda i: 'c' || CAST(i AS VARCHAR)) AS c FROM lineitem),
w AS (SELECT *, max(len(c)) OVER (PARTITION BY doc_id) AS w FROM r)
SELECT doc_id, row_no, l_partkey, array_to_string(list_concat(c, list_transform(range(w - len(c)), lambda i: '')), '|') AS cells FROM w""")
def rectangular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(1), _int(F.col("l_linenumber") % 4 + 1)), lambda i: F.concat(F.lit("c"), _text(i)))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_no"), "l_partkey", cells.alias("cells"))
    return stitch.rectangular(rows, ["doc_id"]).select("doc_id", "row_no", "l_partkey", F.array_join("cells", "|").alias("cells"))


SPARSE_SQL = """
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_no, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'a' END AS x, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'b' || CAST(l_linenumber AS VARCHAR) END AS y, CASE WHEN l_partkey % 5 = 0 AND l_linenumber % 3 > 0 THEN 'c' ELSE '' END AS z FROM lineitem),
f AS (SELECT * FROM r WHERE trim(x) <> '' OR y <> '' OR z <> ''), k AS (SELECT *, bool_or(trim(x) <> '') OVER w AS kx, bool_or(y <> '') OVER w AS ky, bool_or(z <> '') OVER w AS kz FROM f WINDOW w AS (PARTITION BY doc_id))
"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    x, y = F.when(n % 3 == 0, " ").otherwise("a"), F.when(F.col("l_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("b"), _text(n)))
    z = F.when((F.col("l_partkey") % 5 == 0) & (n % 3 > 0), "c").otherwise("")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("row_no"), "l_partkey", F.array(x, y, z).alias("cells"))


@query(SPARSE_SQL + "SELECT doc_id, row_no, l_partkey, array_to_string(list_filter([CASE WHEN kx THEN x END, CASE WHEN ky THEN y END, CASE WHEN kz THEN z END], lambda v: v IS NOT NULL), '|') AS cells FROM k")
def blank_rows_and_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.drop_blank(_sparse(spark, sf_dir), ["doc_id"]).select("doc_id", "row_no", "l_partkey", F.array_join("cells", "|").alias("cells"))


@query(SPARSE_SQL + "SELECT doc_id FROM k GROUP BY doc_id HAVING count(*) >= 2 AND CAST(bool_or(kx) AS INTEGER) + CAST(bool_or(ky) AS INTEGER) + CAST(bool_or(kz) AS INTEGER) >= 2")
def usable_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.usable(stitch.drop_blank(_sparse(spark, sf_dir), ["doc_id"]), ["doc_id"])


@query("""
SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'Date|Label|Debit (TND)' WHEN 1 THEN 'Date|Label|Debit' WHEN 2 THEN 'Date|Label|Debit' ELSE '' END AS header, CAST(CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS INTEGER) AS consumed FROM customer""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers on the first row, below two lines of figures, stacked over two rows, and missing."""
    data, head = ["01/02/2025", "7", "1,234.50"], ["Date", "Label", "Debit"]
    tables = {0: [["Date", "", "Debit"], ["", "Label", "(TND)"], data], 1: [head, data, data], 2: [["1", "2", "3"], ["4.00", "5", "6"], head, data], 3: [data, data, data]}
    cells = lambda rows: F.array(*[F.struct(F.lit(i).alias("row_no"), F.array(*map(F.lit, r)).alias("cells")) for i, r in enumerate(rows)])
    k = F.col("c_custkey") % 4
    rows = F.when(k == 0, cells(tables[0])).when(k == 1, cells(tables[1])).when(k == 2, cells(tables[2])).otherwise(cells(tables[3]))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")
    return stitch.find_headers(pages, ["doc_id"]).select("doc_id", F.array_join("header", "|").alias("header"), F.col("consumed").cast("int").alias("consumed"))


@query("""
WITH r AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS row_no FROM r WHERE i % 6 > 0 AND o_orderkey % 5 > 0)
SELECT doc_id, CAST(row_no AS INTEGER) AS row_no, CAST(i // 6 + 1 AS INTEGER) AS page_no, CAST(o_orderkey AS VARCHAR) || '||x y' AS cells, CASE WHEN (i // 6) % 2 = 0 THEN 'scanned' ELSE 'digital' END AS kind, CAST(CASE WHEN (i // 6) % 2 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS least FROM k""")
def stitched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all pages in order, whatever the order of input: headers and blank rows go, kinds and confidences stay, long rows are folded into the header's width."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", (F.row_number().over(w) - 1).alias("i"))
    page, key = F.expr("cast(i div 6 as int) + 1"), _text(F.col("o_orderkey"))
    cells = F.when(F.col("i") % 6 == 0, F.array(F.lit("Key"), F.lit("Débit"), F.lit("Note"))).when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("-"), F.lit(" "), F.lit("n/a"))).otherwise(F.array(key, F.lit(""), F.lit("x"), F.lit(""), F.lit("y")))
    scanned = F.expr("(i div 6) % 2 = 0")
    confs = F.when(scanned, F.array(F.lit(0.5), F.lit(0.9))).otherwise(F.lit(None).cast("array<double>"))
    rows = r.select("doc_id", page.alias("page_no"), _int(F.col("i") % 6).alias("row_no"), cells.alias("cells"), F.when(scanned, "scanned").otherwise("digital").alias("kind"), confs.alias("confs")).repartition(5, "row_no")
    heads = rows.select("doc_id").distinct().select("doc_id", F.array(F.lit("Key"), F.lit("Debit"), F.lit("Note")).alias("header"), F.lit(1).alias("consumed"), F.lit("key|debit|note").alias("signature"))
    return stitch.stitch(rows, heads, ["doc_id"]).select("doc_id", "row_no", "page_no", F.array_join("cells", "|").alias("cells"), "kind", F.array_min("confs").alias("least"))


@query("""
WITH c AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 3 AS INTEGER) AS table_id, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, table_id) AS r FROM c)
SELECT doc_id, table_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r > 1, table_id) - 1 AS INTEGER) AS position,
       'd' || CAST(doc_id AS VARCHAR) || CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY r > 1, table_id) = 1 THEN '.csv' ELSE '.table' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r > 1, table_id) AS VARCHAR) || '.csv' END AS file FROM p""")
def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary table first, the others in order and numbered from 2."""
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), _int(F.col("o_orderkey") % 3).alias("table_id"), F.lit("v").alias("raw"))
    tables = stitch.in_output_order(cells.select("doc_id", "table_id").distinct(), stitch.primary_table(cells))
    return tables.select("doc_id", "table_id", "position", sinks.table_file(F.concat(F.lit("d"), _text(F.col("doc_id"))), F.col("position")).alias("file"))


# ------------------------------------------------------------------ words

#: So many pages of words are made in one task.
PAGES_A_TASK = 20_000


def by_document(rows: DataFrame, key: str) -> DataFrame:
    """Rows of which each becomes a page of many words, dealt out by document while they are small: their words then lie by document already, and a task's words fit its memory."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PAGES_A_TASK))
    return rows.repartition(n, F.col(key))


#: Pages of words: each order is a page of its customer's document, with a bank's name, a header, seven rows and a foot.
STATEMENT_ROWS = 7


def statement_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(words, pages): pages differ in width, every other one is scanned, one in five is ruled."""
    o = by_document(table(spark, sf_dir, "orders"), "o_custkey")
    no = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.select(F.col("o_custkey").alias("doc_id"), no.alias("page_no"), F.col("o_orderkey").alias("o"), F.col("o_orderdate").cast("date").alias("d"), (600.0 + F.col("o_orderkey") % 3 * 60).alias("width"))
    word = lambda text, x0, x1, y, conf: F.struct(text.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), y.cast("double").alias("y0"), conf.alias("confidence"))
    fixed = [("Bank of everything", 40, 300, 20), ("Date", 40, 70, 100), ("Label", 120, 160, 100), ("Debit", 300, 340, 100), ("Credit", 420, 460, 100), ("page foot of no table", 60, 420, 300)]
    # a line at a time: one array of all words is a method that the JVM never compiles
    k, y, conf = F.col("k"), 122 + 14 * F.col("k"), F.when(F.col("k") % 3 == 0, 0.9).otherwise(0.95)
    cents = F.expr("(o * 7 + k * 131) % 90000")
    amount = F.concat(_text(F.expr("(o * 7 + k * 131) % 90000 div 100")), F.lit("."), F.lpad(_text(cents % 100), 2, "0"))
    right = F.when((F.col("o") + k) % 2 == 0, 340).otherwise(460)
    row = F.array(word(F.date_format(F.date_add("d", k), "dd/MM/yyyy"), F.lit(40), F.lit(95), y, conf), word(F.lit("Item"), F.lit(120), F.lit(140), y, conf), word(_text(k), F.lit(145), F.lit(155), y, conf), word(amount, right - 8 * F.length(amount), right, y, conf))
    head = F.array(*[word(F.lit(t), F.lit(a), F.lit(b), F.lit(y), F.lit(0.95)) for t, a, b, y in fixed])
    lines = o.select("doc_id", "page_no", "o", "d", (F.col("width") / 600).alias("scale"), F.explode(F.sequence(F.lit(-1), F.lit(STATEMENT_ROWS - 1))).alias("k"))
    scale = F.col("scale")
    w = lines.select("doc_id", "page_no", "scale", F.explode(F.when(k < 0, head).otherwise(row)).alias("w")).select("doc_id", "page_no", "w.text", (F.col("w.x0") * scale).alias("x0"), (F.col("w.x1") * scale).alias("x1"), "w.y0", (F.col("w.y0") + 10).alias("y1"), "w.confidence")
    scale = F.col("width") / 600
    ruled = F.col("o") % 5 == 0
    rules = lambda xs, s: F.when(ruled, F.array(*[F.lit(float(x)) * s for x in xs]))
    pages = o.select("doc_id", "page_no", "width", F.lit(842.0).alias("height"), F.when(F.col("o") % 2 == 0, "scanned").otherwise("digital").alias("kind"), rules((30, 110, 250, 350, 470), scale).alias("x_rules"), rules((95, 116, *[134 + 14 * k for k in range(STATEMENT_ROWS)]), F.lit(1.0)).alias("y_rules"))
    return w, pages


@query(f"""
WITH o AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page_no, o_orderkey AS o, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT *, unnest(range(-1, {STATEMENT_ROWS})) AS k FROM o), a AS (SELECT *, (o * 7 + k * 131) % 90000 AS c FROM r), t AS (SELECT *, CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS amount FROM a)
SELECT doc_id, page_no, CAST(k + 1 AS INTEGER) AS row_no, CASE WHEN k < 0 THEN 'Date|Label|Debit|Credit' ELSE strftime(d + CAST(k AS INTEGER), '%d/%m/%Y') || '|Item ' || CAST(k AS VARCHAR) || CASE WHEN (o + k) % 2 = 0 THEN '|' || amount || '|' ELSE '||' || amount END END AS cells,
       CASE WHEN o % 2 = 1 THEN 'text-columns' WHEN o % 5 = 0 THEN 'ocr-grid' ELSE 'ocr-columns' END AS extractor, CAST(CASE WHEN k % 3 = 0 THEN 0.9 ELSE 0.95 END AS DOUBLE) AS least, CAST(100 AS DOUBLE) AS top, CAST({122 + 14 * (STATEMENT_ROWS - 1) + 10} AS DOUBLE) AS bottom FROM t""")
def page_rows_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to rows: lines, the table's body among them, columns shared by a document's pages, cells with their least confidence."""
    rows = geometry.page_rows(*statement_words(spark, sf_dir))
    return rows.select("doc_id", "page_no", "row_no", F.array_join("cells", "|").alias("cells"), "extractor", F.array_min("confs").alias("least"), "top", "bottom")


@query("""
WITH r AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey FROM orders), c AS (SELECT k, i, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN 31 ELSE 14 END) OVER (PARTITION BY k ORDER BY i) AS DOUBLE) AS centre FROM r),
p AS (SELECT *, centre - lag(centre) OVER w AS up, lead(centre) OVER w - centre AS down FROM c WINDOW w AS (PARTITION BY k ORDER BY i)), m AS (SELECT k, median(up) AS m, count(*) AS n FROM p GROUP BY k)
SELECT p.k, CAST(i AS INTEGER) AS visual_row, n >= 5 AND (coalesce(abs(up - m) <= 0.18 * m, false) OR coalesce(abs(down - m) <= 0.18 * m, false)) AS in_body FROM p JOIN m USING (k)""")
def body_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on the median pitch of their page, next to rows that are not."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), _int(F.row_number().over(w) - 1).alias("visual_row"), F.when(F.col("o_orderkey") % 4 == 0, 31).otherwise(14).alias("pitch"))
    rows = r.select("k", "visual_row", F.sum("pitch").over(Window.partitionBy("k").orderBy("visual_row")).cast("double").alias("centre"))
    return geometry.in_body(rows, ["k"]).select("k", "visual_row", "in_body")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(l_partkey AS DOUBLE) AS x0, CAST(l_suppkey AS DOUBLE) AS y0, CAST(l_partkey + 40 AS DOUBLE) AS x1, CAST(l_suppkey + 13 AS DOUBLE) AS y1 FROM lineitem WHERE l_linenumber % 4 > 0")
def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised polygons as boxes; malformed and blank ones, a quarter, go."""
    x, y, n = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), F.col("l_linenumber")
    corner = lambda a, b: F.array(x + a, y + b)
    good = F.array(corner(40, 2), corner(3, 0), corner(0, 11), corner(38, 13))
    polygon = F.when((n % 8 == 4), F.array(corner(0, 0), corner(1, 1))).otherwise(good)
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("n"), F.when(n % 8 == 0, "  ").otherwise("w").alias("text"), polygon.alias("polygon"))
    return sources.polygons_to_boxes(found).select("doc_id", "n", "x0", "y0", "x1", "y1")


@query("""
WITH c AS (SELECT l_orderkey AS k, l_linenumber AS p, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2)
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sha256, l_linenumber AS page_no, CAST(coalesce(c.n, 0) AS BIGINT) AS n_words FROM lineitem l LEFT JOIN c ON c.k = l.l_orderkey AND c.p = l.l_linenumber""")
def word_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose words are in the cache, and those that miss; the cache is written and read back."""
    li = table(spark, sf_dir, "lineitem")
    key = [_text(F.col("l_orderkey")).alias("sha256"), F.col("l_linenumber").alias("page_no"), F.lit(300).alias("dpi")]
    scratch = Scratch(spark)
    sinks.write_word_cache(li.filter("l_quantity > 25").select(*key, F.lit("w").alias("text")).repartition("sha256"), f"{scratch.path}/words")
    cache = spark.read.schema("sha256 string, page_no int, dpi int, text string, sha_prefix string").parquet(f"{scratch.path}/words")
    found, missing = sources.cached_words(li.select(*key).distinct(), cache)
    counted = found.groupBy("sha256", "page_no").agg(F.count("*").alias("n_words"))
    return counted.unionByName(missing.select("sha256", "page_no", F.lit(0).cast("long").alias("n_words")))


# ------------------------------------------------------------------ columns and checks


@query("""
SELECT c_custkey AS doc_id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 4 WHEN c_custkey % 3 = 1 THEN 3 END AS INTEGER) AS closing, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 END AS INTEGER) AS debit, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 END AS INTEGER) AS credit, CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 END AS INTEGER) AS amount_col FROM customer""")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns are balance, debit, credit and amount: by a declared name, else by what the header says."""
    k = F.col("c_custkey")
    names = [F.when(k % 5 == 0, "Montant net").otherwise("Libellé"), F.when(k % 2 == 0, "DÉBIT").otherwise("Out"), F.when(k % 2 == 0, "Paid in").otherwise("In"), F.when(k % 3 == 1, "Solde").otherwise("Rest"), F.when(k % 3 == 0, "Position").otherwise("Sum")]
    columns = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(0).alias("table_id"), F.posexplode(F.array(*names)).alias("col_no", "name"), F.lit("amount").alias("kind"))
    return infer.resolve_roles(columns, Profile(balance_columns={"closing": "position"})).drop("table_id")


@query("SELECT doc_id, regexp_matches(lower(source), 'rc[12]') OR contains(lower(source), '(rc3') OR lang = 'fr' AS hit FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def header_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's patterns on names; one is no regular expression and is taken as text."""
    d = table(spark, sf_dir, "documents").filter("lang is not null and source is not null").select("doc_id", F.concat("lang", F.lit(" "), "source").alias("name"))
    return d.select("doc_id", infer.header_matches(("RC[12]", "(rc3", "^FR\\b"), F.col("name")).alias("hit"))


KIND_SQL = "WITH o AS (SELECT o_custkey AS doc_id, count(*) AS n, count(*) FILTER (o_orderkey % 4 = 0) AS z FROM orders GROUP BY o_custkey)"


@query(KIND_SQL + " SELECT doc_id, c.i AS col_no, CASE c.i WHEN 0 THEN CASE WHEN 1.0 * z / n >= 0.3 THEN 'text' ELSE 'amount' END WHEN 1 THEN 'text' WHEN 2 THEN 'amount' WHEN 3 THEN 'text' WHEN 4 THEN 'date' ELSE 'amount' END AS kind FROM o, (SELECT CAST(unnest(range(6)) AS INTEGER) AS i) c")
def identifier_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading zeros, long digits, empty columns, and columns whose kind the profile declares."""
    k = F.col("o_orderkey")
    cells = F.array(F.when(k % 4 == 0, F.concat(F.lit("0"), _text(k))).otherwise(F.concat(_text(k), F.lit(".50"))), F.concat(F.lit("1"), F.lpad(_text(k), 7, "0")), F.concat(_text(k), F.lit(".25")), F.lit("n/a"), F.lit("no date"), F.lit("no amount"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("table_id"), F.posexplode(cells).alias("col_no", "raw"))
    names = ["Value", "Cheque no", "Total", "Empty", "Jour", "Prix"]
    heads = rows.select("doc_id", "table_id").distinct().select("*", F.posexplode(F.array(*map(F.lit, names))).alias("col_no", "name"))
    read = infer.read_cells(rows)
    kinds = infer.column_kinds(read, heads, infer.locale(read), Profile(date_columns=("^jour",), amount_columns=("prix",)))
    return kinds.select("doc_id", "col_no", "kind")


@query("""
WITH f AS (SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey % 10 = 0) AS bad, count(*) FILTER (o_orderkey % 10 = 1) AS fixed, count(*) FILTER (o_orderkey % 10 = 2) AS low FROM orders GROUP BY o_custkey)
SELECT doc_id, 'numeric_parsing' AS id, bad = 0 AS passed, CASE WHEN bad = 0 THEN 'Every amount was read.' ELSE format('{:,}', bad) || CASE WHEN bad = 1 THEN ' amount' ELSE ' amounts' END END AS detail FROM f UNION ALL
SELECT doc_id, 'ocr_confidence', false, format('{:,}', fixed) || CASE WHEN fixed = 1 THEN ' cell' ELSE ' cells' END || ' repaired; ' || format('{:,}', low) || CASE WHEN low = 1 THEN ' cell' ELSE ' cells' END || ' of low confidence.' FROM f WHERE fixed + low > 0""")
def flag_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What unread, repaired and doubtful cells say of a table."""
    k = F.col("o_orderkey") % 10
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("table_id"), F.col("o_orderkey").alias("row"), F.when(k == 0, "unparsed_amount").when(k == 1, "ocr_repaired").when(k == 2, "low_confidence").alias("reason"))
    found = checks.check_flags(o, o.filter("reason is not null"))
    return found.select("doc_id", "id", "passed", F.regexp_replace("detail", " not read: .*", "").alias("detail"))


@query("SELECT c_custkey AS doc_id, CAST(CASE WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS code FROM customer")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable documents, those that do not reconcile or have no verdict, and those that pass."""
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 7 == 0, "no PDF content").alias("problem"))
    return checks.exit_codes(d, d.filter("doc_id % 11 != 0").select("doc_id", (F.col("doc_id") % 5 != 0).alias("passed")))


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS percent FROM events")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("percent"))
    return sinks.monotone(e, ["user_id"], "event_id").select("event_id", "user_id", "percent")


@query("SELECT event_id AS job_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'click') WHERE r > 40")
def expired_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs beyond the forty newest."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created"), (F.col("event_type") != "click").alias("finished"))
    return sinks.expired(e).select("job_id")


# ------------------------------------------------------------------ whole runs of the engine

PROFILE = Profile(name="statements", date_columns=("^date$",), amount_columns=("debit", "credit", "balance"))
PAGE_ROWS = 10


def engine_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page_rows, pages) of the customers' statements: ten rows a page under a header; one document in four is scanned, with letters for digits and weak cells; in one of thirteen the second page repeats its header and has no row; customers without orders are pages without a table."""
    rows = ledger(spark, sf_dir)
    shown = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(rendered(F.col(c), F.col("doc_id") % 2))
    hurt = lambda c: F.when((F.col("doc_id") % 4 == 0) & (F.col("o_orderkey") % 10 == 3), F.replace(shown(c), F.lit("0"), F.lit("O"))).otherwise(shown(c))
    cells = F.array(F.date_format("date", "dd/MM/yyyy"), F.concat(F.lit("Order "), F.chr(F.lit(65) + (F.col("o_orderkey") % 26))), F.concat(F.lit("00"), _text(F.col("o_orderkey"))), hurt("debit"), hurt("credit"), shown("balance"))
    weak = F.when(F.col("o_orderkey") % 10 == 7, 0.5).otherwise(0.95)
    gap = F.when((F.col("doc_id") % 13 == 0) & (F.col("row_no") >= PAGE_ROWS), 1).otherwise(0)
    page = F.expr(f"cast(row_no div {PAGE_ROWS} as int)") + 1 + gap
    body = rows.select("doc_id", page.alias("page_no"), _int(F.col("row_no") % PAGE_ROWS + 1).alias("row_no"), cells.alias("cells"), F.array(*[F.lit(0.95)] * 5, weak).alias("confs"))
    sums = rows.groupBy("doc_id").agg(F.max("row_no").alias("last"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    off, euro = F.when(F.col("doc_id") % 11 == 0, 100).otherwise(0), F.col("doc_id") % 2
    last = F.when((F.col("doc_id") % 13 == 0) & (F.col("last") >= PAGE_ROWS), 1).otherwise(0) + F.expr(f"cast(last div {PAGE_ROWS} as int)") + 1
    totals = sums.select("doc_id", last.alias("page_no"), F.lit(PAGE_ROWS + 1).alias("row_no"), F.array(F.lit(""), F.lit("TOTAL"), F.lit(""), rendered(F.coalesce("debit", F.lit(0)) + off, euro), rendered(F.coalesce("credit", F.lit(0)), euro), F.lit("")).alias("cells"), F.lit(None).cast("array<double>").alias("confs"))
    head = F.array(*map(F.lit, sources.STATEMENT))
    none = F.lit(None).cast("array<double>")
    heads = body.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(0).alias("row_no"), head.alias("cells"), none.alias("confs"))
    empty = sums.filter(f"doc_id % 13 = 0 and last >= {PAGE_ROWS}").select("doc_id", F.lit(2).alias("page_no"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("row_no"), head.alias("cells"), none.alias("confs"))
    all_ = body.unionByName(totals).unionByName(heads).unionByName(empty)
    kind = F.when(F.col("doc_id") % 4 == 0, "scanned").otherwise("digital")
    unknown = F.lit(None).cast("double")
    page_rows = all_.select("doc_id", "page_no", F.lit(0).alias("table_no"), "row_no", "cells", unknown.alias("top"), unknown.alias("bottom"), unknown.alias("page_height"), kind.alias("kind"), "confs")
    bare = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).join(sums, "doc_id", "left_anti").select("doc_id", F.lit(1).alias("page_no"))
    pages = page_rows.select("doc_id", "page_no").distinct().unionByName(bare).withColumn("kind", kind)
    return page_rows, pages


DAMAGE = BREAKS + """,
z AS (SELECT doc_id, row_no, o_orderkey, balance, CAST(coalesce(debit, credit) AS BIGINT) AS c FROM ledger),
h AS (SELECT doc_id, count(*) FILTER (doc_id % 4 = 0 AND o_orderkey % 10 = 3 AND (contains(CAST(c // 100 AS VARCHAR), '0') OR contains(lpad(CAST(c % 100 AS VARCHAR), 2, '0'), '0'))) AS fixed, count(*) FILTER (doc_id % 4 = 0 AND o_orderkey % 10 = 7 AND balance IS NOT NULL) AS low, count(*) AS n, max(row_no) AS last FROM z GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (plus) <= count(*) FILTER (minus) AS up, least(count(*) FILTER (plus), count(*) FILTER (minus)) AS breaks FROM b GROUP BY doc_id),
d AS (SELECT doc_id, count(debit) AS nd FROM ledger GROUP BY doc_id)
"""


@query(DAMAGE + """
SELECT doc_id, 'table_found' AS id, true AS passed FROM h UNION ALL SELECT c_custkey, 'table_found', false FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM h) UNION ALL
SELECT doc_id, 'numeric_parsing', true FROM h UNION ALL SELECT doc_id, 'ocr_confidence', false FROM h WHERE fixed + low > 0 UNION ALL
SELECT doc_id, 'stated_totals', NOT (doc_id % 11 = 0 AND nd > 0) FROM d UNION ALL SELECT doc_id, 'running_balance', breaks = 0 FROM s WHERE n >= 3 UNION ALL
SELECT doc_id, 'pages_contributed', NOT (doc_id % 13 = 0 AND last >= 10) FROM h UNION ALL SELECT doc_id, 'duplicate_rows', true FROM h UNION ALL SELECT doc_id, 'summary', true FROM h""")
def engine_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of all documents, through the whole engine."""
    page_rows, pages = engine_input(spark, sf_dir)
    return engine.run(page_rows, PROFILE, pages=pages).checks.select("doc_id", "id", "passed")


@query(DAMAGE + """
SELECT doc_id, 'ocr_repaired' AS reason, CAST(fixed AS BIGINT) AS n FROM h WHERE fixed > 0 UNION ALL SELECT doc_id, 'low_confidence', CAST(low AS BIGINT) FROM h WHERE low > 0 UNION ALL SELECT doc_id, 'balance_break', CAST(breaks AS BIGINT) FROM s WHERE n >= 3 AND breaks > 0""")
def engine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of the same run: repaired and weak cells of scanned pages, rows that break the balance."""
    page_rows, pages = engine_input(spark, sf_dir)
    return engine.run(page_rows, PROFILE, pages=pages).flags.groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ declarations


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import _facts as facts

    return facts(spark, sf_dir)


def declaration_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(readings, pages): each fact of the orders as a printed page; the reading at 270 degrees runs down the page, the one at 90 is right."""
    f = by_document(_facts(spark, sf_dir), "doc_id").withColumn("token", F.element_at(F.split("title", " "), 2))
    comma = lambda c: F.concat(F.replace(F.format_string("%.2f", F.col(c)), F.lit("."), F.lit(",")), F.lit("0"))
    rate = F.concat(F.replace(F.format_string("%.2f", "taux"), F.lit("."), F.lit(",")), F.lit("%"))
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    printed = [
        (F.concat(F.lit("DECLARATION"), "token", F.lit("49-2026")), 920, 299, 1409, 336), (F.lit("Libelle du Certificat de depot"), 147, 769, 589, 809), (F.lit("Taux Prix unitaire"), 680, 772, 966, 810), (F.lit("Montant"), 1007, 772, 1141, 810),
        (F.lit("Quantite"), 1203, 773, 1338, 810), (F.lit("Date de"), 1432, 775, 1556, 811), (F.lit("Date de"), 1729, 775, 1853, 811), (F.lit("souscription"), 1399, 830, 1589, 861), (F.lit("remboursement"), 1670, 830, 1913, 861),
        (F.concat("token", F.lit("-CertificatdeDepot"), rate), 69, 892, 466, 927), (F.concat(day("date_remboursement"), rate), 510, 895, 764, 927), (comma("prix_unitaire"), 792, 896, 952, 928), (comma("montant"), 985, 895, 1167, 930),
        (_text(F.col("quantite")), 1252, 896, 1291, 930), (day("date_souscription"), 1416, 896, 1575, 932), (day("date_remboursement"), 1713, 896, 1869, 933),
    ]
    box = lambda t, a, b, c, d, r: F.struct(F.lit(r).alias("rotation"), t.alias("text"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("y0"), F.lit(float(c)).alias("x1"), F.lit(float(d)).alias("y1"))
    boxes = [box(t, a, b, c, d, 90) for t, a, b, c, d in printed] + [box(t, b, a, d, c, 270) for t, a, b, c, d in printed]
    w = f.select("doc_id", F.lit(1).alias("page_no"), F.explode(F.array(*boxes)).alias("w")).select("doc_id", "page_no", "w.*", F.lit(0.98).alias("confidence"))
    return w, f.select("doc_id", F.lit(1).alias("page_no"), F.explode(F.array(F.lit(90), F.lit(270))).alias("rotation"), F.lit(1650.0).alias("height"))


@query(FACTS_SQL + "SELECT doc_id, CAST(90 AS INTEGER) AS rotation, 'DECLARATION' || tok || '49-2026' AS title, taux, q AS quantite, d1 AS date_souscription, d2 AS date_remboursement, CAST(500 AS DOUBLE) AS prix_unitaire, CAST(500 * q + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS montant, CAST(0.98 AS DOUBLE) AS confidence FROM f")
def declaration_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of declaration pages to facts: rotation, lines, headings over two lines, anchors, the values below them."""
    return geometry.declaration_facts(*declaration_words(spark, sf_dir)).select("doc_id", "rotation", "title", "taux", "quantite", "date_souscription", "date_remboursement", "prix_unitaire", "montant", "confidence")


@query(FACTS_SQL + """,
t AS (SELECT *, doc_id % 17 = 0 AS unknown, list_position([""" + ", ".join(f"'{t}'" for t in TOKENS) + """], tok) <= 4 AS pooled FROM f)
SELECT doc_id, 'isin_allocated' AS id, NOT unknown AND pooled AS passed, CASE WHEN NOT unknown AND pooled THEN 'info' ELSE 'error' END AS severity FROM t UNION ALL
SELECT doc_id, id, passed, CASE WHEN passed THEN 'info' ELSE 'error' END FROM (SELECT doc_id, id, CASE id WHEN 'montant' THEN doc_id % 9 <> 0 WHEN 'date_order' THEN d2 > d1 WHEN 'taux_range' THEN taux > 0 AND taux < 100 ELSE q > 0 END AS passed FROM f, (VALUES ('montant'), ('date_order'), ('taux_range'), ('quantite_positive')) c(id)) UNION ALL
SELECT doc_id, 'declaration_read', true, 'info' FROM f UNION ALL SELECT doc_id, 'mapping_incomplete', false, 'warning' FROM f""")
def declaration_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts to rows and checks, with a pool that has sheets for half of the issuers; some titles name no issuer."""
    f = _facts(spark, sf_dir).select(F.col("doc_id"), F.lit(1).alias("page_no"), F.lit(0.98).alias("confidence"), F.when(F.col("doc_id") % 17 == 0, "Avis").otherwise(F.col("title")).alias("title"), "taux", "quantite", "date_souscription", "date_remboursement", "prix_unitaire", "montant")
    codes = spark.range(table(spark, sf_dir, "orders").count() * 4).withColumnRenamed("id", "i")  # dealt over all cores: no array of all numbers in one row
    sheets = F.array(*[F.lit(name.lower()) for _, name, *_ in instruments.ISSUERS[:4]])
    cells = codes.select(F.element_at(sheets, _int(F.col("i") % 4) + 1).alias("sheet"), F.col("i").alias("position"), F.concat(F.lit("TN"), F.lpad(_text(F.col("i")), 10, "0")).alias("value"))
    return declarations.from_facts(f, code_pool(cells)).checks.select("doc_id", "id", "passed", "severity")


@query(FACTS_SQL + "SELECT CAST(count(*) AS BIGINT) AS n_rows, tok AS token, taux, d1, d2 FROM f GROUP BY tok, taux, d1, d2")
def instrument_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are one instrument share a group."""
    f = instruments.group_key(instruments.with_keys(_facts(spark, sf_dir)))
    return f.groupBy("group_no").agg(F.count("*").alias("n_rows"), F.min("issuer_token").alias("token"), F.min("taux").alias("taux"), F.min("date_souscription").alias("d1"), F.min("date_remboursement").alias("d2")).drop("group_no")


@query("""
WITH k AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS key, c_custkey, 'sheet' || CAST(c_custkey % 3 AS VARCHAR) AS sheet FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY c_custkey) AS rk FROM k),
p AS (SELECT 'sheet' || CAST(p_partkey % 3 AS VARCHAR) AS sheet, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS rk, 'TN' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS code FROM part)
SELECT n.key, p.code AS isin FROM n JOIN p USING (sheet, rk)""")
def allocation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New allocations are appended to the ledger, read back, and asked for again: nothing changes."""
    requests = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _text(F.col("c_custkey"))).alias("key"), F.concat(F.lit("sheet"), _text(F.col("c_custkey") % 3)).alias("sheet"), F.col("c_custkey").alias("seq"))
    p = table(spark, sf_dir, "part")
    pool = code_pool(p.select(F.concat(F.lit("sheet"), _text(F.col("p_partkey") % 3)).alias("sheet"), F.col("p_partkey").alias("position"), F.concat(F.lit("TN"), F.lpad(_text(F.col("p_partkey")), 10, "0")).alias("value")))
    path = f"{Scratch(spark).path}/ledger"
    instruments.record(instruments.allocate(requests, pool, spark.createDataFrame([], "key string, isin string")), path)
    return instruments.allocate(requests, pool, sources.code_ledger(spark, path)).filter("not is_new").select("key", "isin")


# ------------------------------------------------------------------ sources and sinks


@query("""
SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, CASE WHEN doc_id % 3 = 0 THEN 'not a .pdf file' WHEN octet_length(encode(text)) = 0 THEN 'empty file' WHEN octet_length(encode(text)) > 4000 THEN 'file too large' WHEN doc_id % 3 = 1 THEN 'no PDF content' END AS problem
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '%PDF' ELSE '' END || text AS text FROM documents)""")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files: hash, size, and whether they can be read."""
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 == 2, "%PDF").otherwise(""), "text").cast("binary")
    d = table(spark, sf_dir, "documents").select(k, F.concat(F.lit("/in/"), _text(k), F.when(k % 3 == 0, ".txt").otherwise(".PDF")).alias("path"), text.alias("content"), F.length(text).cast("long").alias("length"))
    return sources.file_verdicts(d, 4000).join(d.select("path", "doc_id"), "path").select("doc_id", "sha256", "size_bytes", "problem")


@query("SELECT c_custkey AS \"Clé\", replace(c_name, '#', ';') AS name, c_mktsegment || ' \"x\"' AS segment FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with its report, written with a byte order mark and semicolons, and read back."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Clé"), F.replace("c_name", F.lit("#"), F.lit(";")).alias("name"), F.concat("c_mktsegment", F.lit(' "x"')).alias("segment"))
    paths = sinks.export_csv(c, spark.createDataFrame([("{}",)], "report string"), f"{Scratch(spark).path}/customers", ";")
    return sinks.read_csv(spark, paths.csv, "`Clé` long, name string, segment string", ";")


CHECKS_SQL = "WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_quantity > 5 AS passed, CASE WHEN l_linenumber % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM lineitem), v AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT passed AND severity = 'error') AS e, count(*) FILTER (NOT passed AND severity = 'warning') AS w FROM c GROUP BY doc_id)"


def _line_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("c"), _text(F.col("l_partkey"))).alias("id"), (F.col("l_quantity") > 5).alias("passed"), F.when(F.col("l_linenumber") % 2 == 0, "error").otherwise("warning").alias("severity"), F.lit("d").alias("detail"))


@query(CHECKS_SQL + " SELECT v.doc_id, e = 0 AS passed, CAST(n AS BIGINT) AS n_checks, CAST(count(*) FILTER (q.l_discount > 0.05) AS BIGINT) AS n_flags, CAST(max(q.l_linenumber) AS BIGINT) AS n_rows, 'key,value' AS columns, CAST(1 AS BIGINT) AS n_extra, 'o' || CAST(v.doc_id AS VARCHAR) AS source FROM v JOIN lineitem q ON q.l_orderkey = v.doc_id GROUP BY v.doc_id, e, n")
def report_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report of each document, written beside its table, taken apart again."""
    li = table(spark, sf_dir, "lineitem")
    found = _line_checks(spark, sf_dir)
    flags = li.filter("l_discount > 0.05").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_id"), F.col("l_linenumber").alias("row"), F.lit("value").alias("column"), F.lit("r").alias("reason"), F.lit("warning").alias("severity"), F.lit("v").alias("value"))
    first = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linenumber").cast("long").alias("n_rows")).withColumns({"table_id": F.lit(0), "columns": F.array(F.lit("key"), F.lit("value"))})
    tables = first.unionByName(first.withColumn("table_id", F.lit(1)))
    documents = first.select("doc_id", F.concat(F.lit("o"), _text(F.col("doc_id"))).alias("source_name"))
    text = sinks.report(found, flags, tables, documents, first.select("doc_id", "table_id"))
    shape = "tool string, n_rows long, columns array<string>, document struct<source_name: string>, validation struct<passed: boolean, checks: array<struct<id: string>>, flags: array<struct<row: int>>>, tables array<struct<table_id: int>>, extra_tables array<struct<index: int, n_rows: long>>"
    r = text.select("doc_id", F.from_json("report", shape).alias("r"))
    return r.select("doc_id", F.col("r.validation.passed").alias("passed"), F.size("r.validation.checks").cast("long").alias("n_checks"), F.size("r.validation.flags").cast("long").alias("n_flags"), "r.n_rows", F.array_join("r.columns", ",").alias("columns"), F.size("r.extra_tables").cast("long").alias("n_extra"), F.col("r.document.source_name").alias("source"))


@query(CHECKS_SQL + " SELECT doc_id, CASE WHEN e = 0 THEN 'PASS' ELSE 'FAIL' END || ': ' || format('{:,}', n) || CASE WHEN n = 1 THEN ' check' ELSE ' checks' END || ', ' || format('{:,}', e) || CASE WHEN e = 1 THEN ' error' ELSE ' errors' END || ', ' || format('{:,}', w) || CASE WHEN w = 1 THEN ' warning' ELSE ' warnings' END AS line FROM v")
def console_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.summary_lines(_line_checks(spark, sf_dir))


@query("""
SELECT l_orderkey AS doc_id, l_linenumber AS row_no, c.i AS col_no, CASE WHEN c.i = 1 AND l_discount > 0.05 THEN 'low_confidence' END AS reason, l_partkey FROM lineitem, (SELECT CAST(unnest(range(2)) AS INTEGER) AS i) c""")
def highlighted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells beside the flags that a workbook would colour. The line's part tells repeated lines apart."""
    li = table(spark, sf_dir, "lineitem").withColumn("table_id", F.concat_ws("-", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    keys = [F.col("l_orderkey").alias("doc_id"), "table_id"]
    cells = li.select(*keys, F.col("l_linenumber").alias("row_no"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("col_no", "raw"), "l_partkey")
    columns = cells.select("doc_id", "table_id", "col_no").distinct().withColumn("name", F.when(F.col("col_no") == 0, "key").otherwise("value"))
    flags = li.filter("l_discount > 0.05").select(*keys, F.col("l_linenumber").alias("row"), F.lit("value").alias("column"), F.lit("low_confidence").alias("reason"), F.lit("warning").alias("severity")).distinct()
    return sinks.highlighted(cells, columns, flags, ["doc_id", "table_id"]).select("doc_id", "row_no", "col_no", "reason", "l_partkey")


@query("""
WITH l AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row_no, o_orderkey FROM orders)
SELECT doc_id, row_no, o_orderkey, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 2 WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_flags FROM l WHERE row_no BETWEEN 1 AND 4""")
def preview_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of each table, each row with its flags."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), _int(F.row_number().over(w) - 1).alias("row_no"), "o_orderkey")
    k = F.col("o_orderkey")
    flags = rows.select("doc_id", F.col("row_no").alias("row"), F.explode(F.array_compact(F.array(F.when(k % 2 == 0, "two"), F.when(k % 3 == 0, "three")))).alias("reason"), F.lit("Amount").alias("column"), F.lit("warning").alias("severity"))
    return sinks.preview(rows, ["doc_id"], 1, 4, flags).select("doc_id", "row_no", "o_orderkey", F.size("flags").cast("long").alias("n_flags"))
