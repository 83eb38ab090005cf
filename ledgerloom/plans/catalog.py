"""The registered queries over the test tables, one per operator, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Profile
from ..functions import scalars as S
from ..operators import checks, geometry, infer, instruments, normalize, stitch
from ..sinks import column_widths, document_sheet, preview, validation_sheet
from ..sources.tables import code_pool, ledger, rendered, statement_cells, table
from ..storage import Scratch, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderdate").cast("date").alias("d")))


#: The ledger of ``sources.tables.ledger`` in SQL.
LEDGER = """
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS s FROM orders),
m AS (SELECT *, CASE WHEN s = 'F' THEN cents END AS debit, CASE WHEN s <> 'F' THEN cents END AS credit, CASE WHEN s = 'F' THEN -cents ELSE cents END AS movement,
      CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS row_no FROM o),
r AS (SELECT *, CAST(sum(movement) OVER (PARTITION BY doc_id ORDER BY row_no) AS BIGINT) AS running FROM m),
ledger AS (SELECT doc_id, row_no, o_orderkey, date, debit, credit, movement, CASE WHEN o_orderkey % 53 <> 0 THEN running + CASE WHEN o_orderkey % 97 = 0 THEN 100 ELSE 0 END END AS balance FROM r)
"""
BREAKS = LEDGER + """,
p AS (SELECT *, lag(balance) OVER (PARTITION BY doc_id ORDER BY row_no) AS previous FROM ledger WHERE balance IS NOT NULL),
b AS (SELECT doc_id, row_no, movement, balance, coalesce(previous + movement <> balance, false) AS plus, coalesce(previous - movement <> balance, false) AS minus FROM p)
"""


# ------------------------------------------------------------------ scalars


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS DOUBLE) AS amount FROM orders")
def parse_amount_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's signed price, written in one of eight notations and read back."""
    o = _orders(spark, sf_dir).withColumn("signed", F.when(F.col("o_orderstatus") == "F", -F.col("cents")).otherwise(F.col("cents")))
    return o.select("o_orderkey", S.parse_amount(rendered(F.col("signed"), F.col("o_orderkey") % 8)).alias("amount"))


_CODES, _SIGNS = "|".join(S.CURRENCY_CODES), "|".join(S.DEBIT_WORDS + S.CREDIT_WORDS)


@query(rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS w FROM documents),
p AS (SELECT doc_id, w, upper(regexp_replace(regexp_replace(w, '[\x09\x0b\x0c\r{S.SPACES.strip()}]', '', 'g'), '[{S.MINUSES}]', '-', 'g')) AS u FROM t),
q AS (SELECT doc_id, w, regexp_replace(u, '[%{S.CURRENCY_SYMBOLS}]', '', 'g') AS u FROM p),
r AS (SELECT doc_id, w, u, regexp_full_match(u, '(?:[-+(\[]|(?:{_CODES})\.*|{_SIGNS})*[\d.,]*\d[\d.,]*(?:[-)\]]|\.*(?:{_CODES})|{_SIGNS})*') AS shaped,
      regexp_replace(regexp_replace(u, '[^(\[\])]', '', 'g'), '\(\)|\[\]|\(\(\)\)', '', 'g') AS brackets, regexp_extract(u, '[\d.,]*\d[\d.,]*') AS b FROM q),
v AS (SELECT doc_id, shaped AND brackets = '' AND lower(w) NOT IN ({", ".join(f"'{m}'" for m in S.BLANK_MARKERS)}) AS able,
      CASE WHEN contains(b, '.') AND contains(b, ',') THEN CASE WHEN regexp_matches(b, ',[^.]*$') THEN replace(replace(b, '.', ''), ',', '.') ELSE replace(b, ',', '') END
           WHEN contains(b, ',') THEN CASE WHEN regexp_full_match(b, '\d{{1,3}}(,\d{{3}})+') THEN replace(b, ',', '') WHEN len(b) - len(replace(b, ',', '')) = 1 THEN replace(b, ',', '.') END
           WHEN len(b) - len(replace(b, '.', '')) > 1 THEN CASE WHEN regexp_full_match(b, '\d{{1,3}}(\.\d{{3}}){{2,}}') THEN replace(b, '.', '') END ELSE b END AS x FROM r)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (able AND regexp_full_match(x, '\d+\.?\d*|\.\d+') AND len(ltrim(split_part(x, '.', 1), '0')) <= 15) AS BIGINT) AS n_numbers
FROM v GROUP BY doc_id""")
def parse_amount_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document, of whatever form: which are amounts?"""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[ \n]+")).alias("w")).filter("w != ''")
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(S.parse_amount(F.col("w")).isNotNull()).alias("n_numbers"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def parse_date_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in six notations and read back."""
    o = _orders(spark, sf_dir)
    k, d = F.col("o_orderkey") % 6, F.col("d")
    months = F.split(F.lit("janv,fév,mars,avril,mai,juin,juillet,août,sept,octobre,novembre,décembre"), ",")
    text = (
        F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "dd.MM.yyyy"))
        .when(k == 3, F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(months, F.month(d)), F.year(d).cast("string"))).when(k == 4, F.date_format(d, "MMM d yyyy")).otherwise(F.date_format(d, "MM-dd-yyyy"))
    )
    return o.select("o_orderkey", S.parse_date(text, k != 5).alias("d"))


@query("SELECT doc_id, md5(f) AS digest, CAST(length(f) AS BIGINT) AS n_chars FROM (SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^A-Za-z0-9]+', '', 'g')) AS f FROM documents)")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without accents, case and punctuation, as digest and length."""
    folded = table(spark, sf_dir, "documents").select("doc_id", S.fold(F.col("text")).alias("f"))
    return folded.select("doc_id", F.md5(F.col("f").cast("binary")).alias("digest"), F.length("f").cast("long").alias("n_chars"))


@query("""
WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders), s AS (SELECT o_orderkey, c, format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS s FROM c),
d AS (SELECT o_orderkey, c, CASE o_orderkey % 3 WHEN 0 THEN replace(s, '0', 'O') WHEN 1 THEN replace(s, '5', 'S') ELSE s END AS d FROM s)
SELECT o_orderkey, CAST(CASE WHEN NOT regexp_matches(d, '^[OS][^0-9][^0-9]') THEN c / 100.0 END AS DOUBLE) AS amount FROM d""")
def ocr_digit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with letters for digits, repaired and read. A first letter that no digit is near stays, and the cell unread."""
    o = _orders(spark, sf_dir)
    clean = rendered(F.col("cents"), F.lit(0))
    damaged = F.when(F.col("o_orderkey") % 3 == 0, F.replace(clean, F.lit("0"), F.lit("O"))).when(F.col("o_orderkey") % 3 == 1, F.replace(clean, F.lit("5"), F.lit("S"))).otherwise(clean)
    return o.select("o_orderkey", S.parse_amount(S.repair_ocr_digits(damaged)).alias("amount"))


MARKS = ["-", "n/a", "N/A", "Néant", " nil ", "0", "x", "xx", "xxx", "", "none", "total", "...", "void", "1-"]


@query(f"SELECT o_orderkey, lower(trim(m)) IN ('-', 'n/a', 'néant', 'nil', 'x', 'xx', '', 'none', '...', 'void') AS blank FROM (SELECT o_orderkey, list_extract({MARKS!r}, CAST(o_orderkey % {len(MARKS)} AS INTEGER) + 1) AS m FROM orders)")
def blank_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that mean nothing is here."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.is_blank_marker(F.element_at(F.array(*map(F.lit, MARKS)), (F.col("o_orderkey") % len(MARKS)).cast("int") + 1)).alias("blank"))


# ------------------------------------------------------------------ votes and columns


@query("SELECT o_custkey AS doc_id, CASE WHEN count(*) < 1 THEN NULL WHEN o_custkey % 3 = 0 THEN '.' WHEN o_custkey % 3 = 1 THEN ',' END AS decimal FROM orders GROUP BY o_custkey")
def decimal_separator_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in English or continental notation, or half in either: the vote finds the separator, and none where evidence is mixed."""
    o = _orders(spark, sf_dir)
    kind = F.when(F.col("o_custkey") % 3 < 2, F.col("o_custkey") % 3)
    # a mixed document states each amount in both notations
    cells = o.select(F.col("o_custkey").alias("doc_id"), F.explode(F.when(kind.isNull(), F.array(rendered(F.col("cents"), F.lit(0)), rendered(F.col("cents"), F.lit(1)))).otherwise(F.array(rendered(F.col("cents"), kind)))).alias("raw"))
    return infer.decimal_separator(cells, ["doc_id"])


@query("""
WITH v AS (SELECT o_custkey AS doc_id, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT doc_id, CASE WHEN count(*) FILTER (day(d) > 12) = 0 THEN NULL ELSE doc_id % 2 = 0 END AS dayfirst FROM v GROUP BY doc_id""")
def dayfirst_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    text = F.when(F.col("o_custkey") % 2 == 0, F.date_format("d", "dd/MM/yyyy")).otherwise(F.date_format("d", "MM/dd/yyyy"))
    return infer.dayfirst(o.select(F.col("o_custkey").alias("doc_id"), text.alias("raw")), ["doc_id"])


def _statement(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from ..sources.tables import STATEMENT

    rows = statement_cells(spark, sf_dir)
    heads = rows.select("doc_id", "table_id").distinct().select("*", F.posexplode(F.array(*map(F.lit, STATEMENT))).alias("col_no", "raw"))
    return normalize.normalize(rows, heads)


@query(LEDGER + """,
k AS (SELECT doc_id, count(debit) AS nd, count(credit) AS nc, count(balance) AS nb FROM ledger GROUP BY doc_id)
SELECT doc_id, c.i AS col_no, CASE c.i WHEN 0 THEN 'date' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 3 THEN CASE WHEN nd > 0 THEN 'amount' ELSE 'text' END
       WHEN 4 THEN CASE WHEN nc > 0 THEN 'amount' ELSE 'text' END ELSE CASE WHEN nb > 0 THEN 'amount' ELSE 'text' END END AS kind
FROM k, (SELECT CAST(unnest(range(6)) AS INTEGER) AS i) c""")
def column_kind_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statement(spark, sf_dir)["columns"].select("doc_id", "col_no", "kind")


@query("""
WITH h AS (SELECT c_custkey AS doc_id, i, CASE WHEN (c_custkey + i) % 3 = 0 THEN '' WHEN (c_custkey + i) % 3 = 1 THEN 'Amount' ELSE 'AMOUNT' END AS raw FROM customer, (SELECT CAST(unnest(range(4)) AS INTEGER) AS i)),
n AS (SELECT doc_id, i, CASE WHEN raw = '' THEN 'column_' || CAST(i + 1 AS VARCHAR) ELSE raw END AS base FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(base) ORDER BY i) AS k FROM n)
SELECT doc_id, i AS col_no, CASE WHEN k > 1 THEN base || ' (' || CAST(k AS VARCHAR) || ')' ELSE base END AS name FROM k""")
def clean_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col_no"))
    k = (F.col("doc_id") + F.col("col_no")) % 3
    return infer.clean_headers(c.withColumn("raw", F.when(k == 0, "  ").when(k == 1, " Amount ").otherwise("AMOUNT")), ["doc_id"])


PROFILES = [Profile(name="alpha", match_keywords=("the", "thing")), Profile(name="beta", match_keywords=("and", "with", "from")), Profile(name="gamma", match_keywords=("elle",))]


@query("""
SELECT doc_id, CASE WHEN contains(t, 'and') AND contains(t, 'with') AND contains(t, 'from') THEN 'beta' WHEN contains(t, 'the') AND contains(t, 'thing') THEN 'alpha'
       WHEN contains(t, 'elle') THEN 'gamma' ELSE 'generic' END AS profile FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def profile_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.select_profile(table(spark, sf_dir, "documents").select("doc_id", "text"), PROFILES)


# ------------------------------------------------------------------ totals and checks


@query(LEDGER + "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_totals FROM ledger GROUP BY doc_id")
def totals_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, totals = normalize.split_totals(statement_cells(spark, sf_dir))
    return data.groupBy("doc_id").agg(F.count("*").alias("n_rows")).join(totals.groupBy("doc_id").agg(F.count("*").alias("n_totals")), "doc_id")


STATED = LEDGER + """,
t AS (SELECT doc_id, count(debit) AS nd, count(credit) AS nc, count(balance) AS nb FROM ledger GROUP BY doc_id)
"""


@query(STATED + "SELECT doc_id, NOT (doc_id % 11 = 0 AND nd > 0) AS passed FROM t WHERE nd > 0 OR nc > 0")
def stated_totals_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document in eleven states a debit total that is 1.00 too high."""
    n = _statement(spark, sf_dir)
    roles = infer.resolve_roles(n["columns"])
    return checks.check_stated_totals(n["cells"], n["columns"], n["totals"], roles).select("doc_id", "passed")


@query(BREAKS + """
SELECT b.doc_id, b.row_no, b.movement, b.balance FROM b JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (plus) <= count(*) FILTER (minus) AS up FROM b GROUP BY doc_id) s USING (doc_id)
WHERE s.n >= 3 AND CASE WHEN up THEN plus ELSE minus END""")
def running_balance_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("doc_id", "row_no", "movement", "balance")
    found = checks.balance_breaks(rows, ["doc_id"])
    chosen = checks.running_balance(rows, ["doc_id"]).select("doc_id", "sign")
    at = F.when(F.col("sign") == 1, F.col("breaks_plus")).otherwise(F.col("breaks_minus"))
    return found.join(chosen, "doc_id").filter(at).select("doc_id", "row_no", "movement", "balance")


@query(BREAKS + """,
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (plus) AS p, count(*) FILTER (minus) AS m FROM b GROUP BY doc_id),
t AS (SELECT doc_id, sum(coalesce(debit, 0)) AS d, sum(coalesce(credit, 0)) AS c, count(*) AS n_rows FROM ledger GROUP BY doc_id)
SELECT t.doc_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(d AS BIGINT) AS debit_cents, CAST(c AS BIGINT) AS credit_cents, CAST(coalesce(least(p, m), 0) AS BIGINT) AS n_breaks,
       s.n IS NULL OR s.n < 3 OR least(p, m) = 0 AS balance_ok, doc_id % 11 <> 0 AS totals_ok FROM t LEFT JOIN s USING (doc_id)""")
def ledger_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per statement, does the running balance hold and do the stated totals match what the cells, read back, add up to?"""
    rows = ledger(spark, sf_dir)
    cells = rows.select("doc_id", "row_no", "movement", *[S.parse_amount(rendered(F.col(c), F.col("doc_id") % 8)).alias(c) for c in ("debit", "credit", "balance")])
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    cells = cells.select("doc_id", "row_no", "movement", *[cents(c).alias(c) for c in ("debit", "credit", "balance")])
    # breaks under either sign, sums and counts in one pass over the document's rows
    marked, has = checks.marked_breaks(cells, ["doc_id"]), F.col("balance").isNotNull()
    out = marked.groupBy("doc_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.coalesce("debit", F.lit(0))).alias("debit_cents"), F.sum(F.coalesce("credit", F.lit(0))).alias("credit_cents"),
        F.count_if(has).alias("n"), F.least(F.count_if(F.col("breaks_plus")), F.count_if(F.col("breaks_minus"))).alias("n_breaks"),
    )
    stated = F.col("debit_cents") + F.when(F.col("doc_id") % 11 == 0, 100).otherwise(0)
    return out.select("doc_id", "n_rows", "debit_cents", "credit_cents", "n_breaks", ((F.col("n") < 3) | (F.col("n_breaks") == 0)).alias("balance_ok"), S.close(F.col("debit_cents") / 100, stated / 100).alias("totals_ok"))


@query("""
WITH o AS (SELECT o_custkey % 50 AS doc_id, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT doc_id, sum(c) + CASE WHEN doc_id % 5 = 0 THEN 1000 ELSE 0 END = sum(c) AS passed FROM o GROUP BY doc_id""")
def debits_equal_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals that enter each order on both sides; one in five has a further debit of 10.00."""
    o = _orders(spark, sf_dir).select((F.col("o_custkey") % 50).alias("doc_id"), F.lit(0).alias("table_id"), "cents")
    sides = o.select("doc_id", "table_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("col_no"), (F.col("cents") / 100).alias("amount"))
    extra = o.filter("doc_id % 5 = 0").select("doc_id", "table_id").distinct().select("*", F.lit(0).alias("col_no"), F.lit(10.0).alias("amount"))
    roles = o.select("doc_id", "table_id").distinct().select("*", F.lit(0).alias("debit"), F.lit(1).alias("credit"), F.lit(None).cast("int").alias("closing"))
    return checks.check_debits_equal_credits(sides.unionByName(extra), roles).select("doc_id", "passed")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], [], "doc_id").select("doc_id")


@query("""
SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 <> 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.lit(0).alias("col_no"), F.col("event_id").alias("row_no"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("raw"))
    return normalize.forward_fill(e, ["user_id"]).select("user_id", F.col("row_no").alias("event_id"), F.col("raw").alias("label"))


@query("SELECT o_custkey AS doc_id, string_agg(DISTINCT expected, ',' ORDER BY expected) AS missing FROM (SELECT DISTINCT o_custkey, e.expected FROM orders, (VALUES ('F'), ('O'), ('P')) e(expected) WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = orders.o_custkey AND p.o_orderstatus = e.expected)) GROUP BY o_custkey")
def expected_columns_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose columns are their orders' statuses, against F, O and P."""
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("name")).distinct()
    found = checks.missing_columns(c, Profile(expected_columns=("F", "O", "P")), ["doc_id"])
    return found.filter(F.size("missing") > 0).select("doc_id", F.array_join(F.sort_array("missing"), ",").alias("missing"))


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS doc_id, month(o_orderdate) AS page_no FROM orders), s AS (SELECT doc_id, min(page_no) AS lo, max(page_no) AS hi FROM r GROUP BY doc_id),
p AS (SELECT c_custkey AS doc_id, i AS page_no FROM customer, (SELECT unnest(range(1, 13)) AS i) WHERE (c_custkey + i) % 7 <> 0)
SELECT p.doc_id, CAST(p.page_no AS INTEGER) AS page_no FROM p JOIN s USING (doc_id) WHERE page_no > lo AND page_no < hi AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND r.page_no = p.page_no)""")
def pages_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as pages: those between a customer's first and last that have no order and are not empty."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.month("o_orderdate").alias("page_no"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page_no"))
    return checks.missing_pages(pages.withColumn("kind", F.when((F.col("doc_id") + F.col("page_no")) % 7 == 0, "empty").otherwise("digital")), rows)


@query("""
SELECT o_custkey AS doc_id, CAST(o_orderkey AS BIGINT) AS row, CASE WHEN o_orderkey % 10 = 0 THEN 'unparsed_amount' WHEN o_orderkey % 10 = 1 THEN 'ocr_repaired' ELSE 'low_confidence' END AS reason,
       CASE WHEN o_orderkey % 10 = 0 THEN 'error' ELSE 'warning' END AS severity FROM orders WHERE o_orderkey % 10 < 3""")
def flag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that cannot be read, are read after repair, or are read with little confidence."""
    o = _orders(spark, sf_dir)
    k, clean = F.col("o_orderkey") % 10, rendered(F.col("cents"), F.lit(0))
    raw = F.when(k == 0, "see note").when(k == 1, F.concat(F.lit("l,"), F.lpad((F.col("cents") % 1000).cast("string"), 3, "0"), F.lit(".00"))).otherwise(clean)
    cells = o.select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("table_id"), F.col("o_orderkey").alias("row_no"), F.lit(0).alias("col_no"), raw.alias("raw"), F.lit("scanned").alias("kind"), F.when(k == 2, 0.5).otherwise(0.95).alias("conf"))
    cells = Scratch(spark).keep(cells, "cells")  # read three times
    columns = cells.select("doc_id", "table_id").distinct().select("*", F.lit(0).alias("col_no"), F.lit("Amount").alias("name"), F.lit("amount").alias("kind"))
    votes = cells.select("doc_id", "table_id").distinct().select("*", F.lit(".").alias("decimal"), F.lit(None).cast("boolean").alias("dayfirst"))
    flags = normalize.cell_flags(normalize.typed_cells(cells, columns, votes), columns)
    return flags.select("doc_id", "row", "reason", "severity")


@query("""
WITH c AS (SELECT l_orderkey AS doc_id, l_quantity > 5 AS passed, CASE WHEN l_linenumber % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM lineitem)
SELECT doc_id, count(*) FILTER (NOT passed AND severity = 'error') = 0 AS passed, CAST(count(*) FILTER (NOT passed AND severity = 'error') AS BIGINT) AS n_errors, CAST(count(*) FILTER (NOT passed AND severity = 'warning') AS BIGINT) AS n_warnings FROM c GROUP BY doc_id""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") > 5).alias("passed"), F.when(F.col("l_linenumber") % 2 == 0, "error").otherwise("warning").alias("severity"))
    return checks.verdict(c, ["doc_id"])


@query("""
SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE WHEN l_quantity > 5 THEN 'PASS' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END END AS status FROM lineitem""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity") > 5).alias("passed"), F.when(F.col("l_linenumber") % 2 == 0, "error").otherwise("warning").alias("severity"))
    return validation_sheet(c).select("doc_id", "seq", "status")


# ------------------------------------------------------------------ pages and tables


@query("""
SELECT o_orderkey AS page_no, CASE WHEN o_orderkey % 13 = 0 THEN 'scanned' WHEN o_custkey % 100 >= 50 THEN 'digital' WHEN o_orderkey % 3 = 0 THEN 'scanned' WHEN o_custkey % 100 > 0 THEN 'digital' WHEN o_orderkey % 2 = 0 THEN 'scanned' ELSE 'empty' END AS kind FROM orders""")
def page_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pages = o.select(k.alias("page_no"), (F.col("o_custkey") % 100).alias("n_chars"), (k % 3 == 0).alias("has_images"), (k % 2 == 0).alias("has_vectors"), (k % 13 == 0).alias("read_error"))
    return pages.select("page_no", stitch.page_kind().alias("kind"))


@query("""
WITH RECURSIVE t AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page_no, CAST(2 + (o_orderkey // 8) % 2 AS INTEGER) AS n_cols, o_orderkey % 4 < 2 AS low, o_orderkey % 7 < 5 AS high,
      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'h' || CAST(o_orderkey % 3 AS VARCHAR) END AS hsig, 'h' || CAST(o_orderkey % 2 AS VARCHAR) AS fsig FROM orders),
f AS (SELECT doc_id, page_no, n_cols, low, hsig AS sig, 0 AS group_id FROM t WHERE page_no = 1 UNION ALL
      SELECT doc_id, page_no, n_cols, low, CASE WHEN on_ THEN sig ELSE hsig END, group_id + CASE WHEN on_ THEN 0 ELSE 1 END FROM
      (SELECT t.*, f.sig, f.group_id, f.n_cols = t.n_cols AND ((f.sig <> '' AND t.fsig = f.sig) OR (f.low AND t.high)) AS on_ FROM f JOIN t ON t.doc_id = f.doc_id AND t.page_no = f.page_no + 1))
SELECT doc_id, page_no, CAST(group_id AS INTEGER) AS group_id FROM f""")
def page_continuation_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that go on where the foot of one and the head of the next are used, or where the group's first header returns."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    sig = lambda n: F.concat(F.lit("h"), (k % n).cast("string"))
    t = o.select(
        F.col("o_custkey").alias("doc_id"), F.row_number().over(w).alias("page_no"), F.lit(0).alias("table_no"), F.expr("cast(2 + (o_orderkey div 8) % 2 as int)").alias("n_cols"), F.when(k % 5 == 0, "").otherwise(sig(3)).alias("header_sig"), sig(2).alias("first_sig"),
        F.when(k % 7 < 5, 60.0).otherwise(400.0).alias("top"), F.when(k % 4 < 2, 800.0).otherwise(500.0).alias("bottom"), F.lit(842.0).alias("page_height"),
    )
    return stitch.continuation_groups(t).select("doc_id", "page_no", "group_id")


@query("""
WITH h AS (SELECT c_custkey AS k, [CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Name' END, CASE WHEN c_custkey % 5 = 0 THEN '1,234.50' ELSE 'Segment' END, CASE WHEN c_custkey % 3 = 0 THEN 'name' ELSE c_mktsegment END, repeat('z', CAST(20 + c_custkey % 40 AS INTEGER))] AS c FROM customer),
f AS (SELECT k, c, list_filter(c, lambda x: x <> '') AS f FROM h)
SELECT k, CAST(round(10000 * (0.20 * len(f) / len(c) + 0.45 * (1 - CAST(len(list_filter(f, lambda x: x = '1,234.50')) AS DOUBLE) / len(f)) + 0.20 * len(list_distinct(list_transform(f, lambda x: lower(x)))) / len(f) + 0.15 * len(list_filter(f, lambda x: len(x) <= 40)) / len(f))) AS BIGINT) AS score FROM f""")
def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    cells = F.array(F.when(k % 4 == 0, "").otherwise("Name"), F.when(k % 5 == 0, "1,234.50").otherwise("Segment"), F.when(k % 3 == 0, "name").otherwise(F.col("c_mktsegment")), F.repeat(F.lit("z"), (20 + k % 40).cast("int")))
    return c.select(k.alias("k"), F.round(10000 * stitch.header_score(cells)).cast("long").alias("score"))


@query("""
WITH r AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey FROM orders)
SELECT doc_id, CAST(count(*) FILTER (i % 4 <> 1) AS BIGINT) AS n_rows FROM r GROUP BY doc_id HAVING count(*) FILTER (i % 4 <> 1) > 0""")
def repeat_header_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of three rows a page, each page with the header again (in another case on later pages)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(w) - 1).alias("i"), "o_orderkey")
    head = F.when(F.col("i") < 4, F.array(F.lit("Date"), F.lit("Débit"))).otherwise(F.array(F.lit("DATE"), F.lit("DEBIT")))
    rows = r.select("doc_id", F.expr("cast(i div 4 as int)").alias("page_no"), (F.col("i") % 4).cast("int").alias("row_no"), F.when(F.col("i") % 4 == 0, head).otherwise(F.array(F.lit("01/02/2025"), F.col("o_orderkey").cast("string"))).alias("cells"))
    heads = rows.select("doc_id").distinct().select("doc_id", F.array(F.lit("Date"), F.lit("Débit")).alias("header"), F.lit(1).alias("consumed"), F.lit("date|debit").alias("signature"))
    return stitch.stitch(rows, heads, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_rows"))


@query("""
SELECT l_orderkey AS doc_id, CAST(round(1000.0 * (max(l_linenumber % 4 + 1) - min(l_linenumber % 4 + 1)) / max(l_linenumber % 4 + 1)) AS BIGINT) AS raggedness FROM lineitem GROUP BY l_orderkey""")
def raggedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.array_repeat(F.lit("c"), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("cells"))
    return stitch.raggedness(rows, ["doc_id"]).select("doc_id", F.round(1000 * F.col("raggedness")).cast("long").alias("raggedness"))


@query("""
WITH r AS (SELECT o_orderkey, list_transform(range(1, CAST(o_orderkey % 5 + 2 AS BIGINT)), lambda i: 'c' || CAST(i AS VARCHAR)) AS c FROM orders)
SELECT o_orderkey, CASE WHEN len(c) > 3 THEN c[1] || '|' || c[2] || '|' || array_to_string(c[3:], ' ') ELSE array_to_string(list_concat(c, list_transform(range(3 - len(c)), lambda i: '')), '|') END AS cells FROM r""")
def row_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("c"), i.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(stitch.pad_to_header(cells, F.lit(3)), "|").alias("cells"))


@query("""
WITH c AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 3 AS INTEGER) AS table_id, count(*) FILTER (o_orderkey % 4 <> 0) AS n FROM orders GROUP BY 1, 2)
SELECT doc_id, table_id, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, table_id) AS r FROM c) WHERE r = 1""")
def primary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return stitch.primary_table(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (k % 3).cast("int").alias("table_id"), F.when(k % 4 == 0, " ").otherwise("v").alias("raw")))


@query("""
WITH n AS (SELECT c_custkey AS doc_id, list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'column_1' ELSE c_mktsegment END, c_name, repeat('x', CAST(c_custkey % 30 AS INTEGER) + 1)], lambda x: NOT starts_with(x, 'column_'))[1:2] AS n FROM customer), t AS (SELECT doc_id, array_to_string(n, ', ') AS t FROM n)
SELECT doc_id, CASE WHEN len(t) > 40 THEN t[1:37] || '...' ELSE t END AS label FROM t""")
def table_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(F.when(k % 3 == 0, "column_1").otherwise(F.col("c_mktsegment")), F.col("c_name"), F.repeat(F.lit("x"), (k % 30).cast("int") + 1))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), stitch.table_label(names).alias("label"))


# ------------------------------------------------------------------ geometry: lines of an order are words on its page

WORDS_SQL = """
WITH w AS (SELECT l_orderkey AS doc_id, CAST(1 AS INTEGER) AS page_no, CAST(l_linenumber AS INTEGER) AS n, CAST(l_partkey % 900 AS DOUBLE) AS x0, CAST(l_partkey % 900 + 20 + l_suppkey % 60 AS DOUBLE) AS x1, CAST(l_linenumber * 20 + l_suppkey % 5 AS DOUBLE) AS y0, CAST(l_linenumber * 20 + l_suppkey % 5 + 10 AS DOUBLE) AS y1 FROM lineitem)
"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 900, F.col("l_linenumber") * 20 + F.col("l_suppkey") % 5
    d = lambda c: c.cast("double")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("n"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"), d(x).alias("x0"), d(y).alias("y0"), d(x + 20 + F.col("l_suppkey") % 60).alias("x1"), d(y + 10).alias("y1"), F.lit(0.9).alias("confidence"))


@query(WORDS_SQL + """,
b AS (SELECT *, CAST(floor((y0 + y1) / 2 / 40) AS INTEGER) AS band FROM w WHERE (y0 + y1) / 2 < 120)
SELECT doc_id, n, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY band) - 1 AS INTEGER) AS visual_row FROM b""")
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in bands between rules at 0, 40, 80 and 120."""
    w = _words(spark, sf_dir)
    rules = w.select("doc_id", "page_no").distinct().withColumn("y_rules", F.array(*[F.lit(float(y)) for y in (0, 40, 80, 120)]))
    return geometry.row_bands(w, rules).select("doc_id", "n", "visual_row")


@query(WORDS_SQL.replace("WITH w", "WITH RECURSIVE w") + """,
s AS (SELECT doc_id, n, (y0 + y1) / 2 AS yc, row_number() OVER (PARTITION BY doc_id ORDER BY (y0 + y1) / 2, x0, n) AS i FROM w),
f AS (SELECT doc_id, i, n, yc AS total, 1 AS many, 0 AS visual_row FROM s WHERE i = 1 UNION ALL
      SELECT doc_id, i, n, CASE WHEN near THEN total + yc ELSE yc END, CASE WHEN near THEN many + 1 ELSE 1 END, visual_row + CASE WHEN near THEN 0 ELSE 1 END FROM
      (SELECT s.*, f.total, f.many, f.visual_row, abs(s.yc - f.total / f.many) <= 5.5 AS near FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1))
SELECT doc_id, n, CAST(visual_row AS INTEGER) AS visual_row FROM f""")
def rows_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.rows_by_position(_words(spark, sf_dir)).select("doc_id", "n", "visual_row")


@query(WORDS_SQL + """
SELECT doc_id, n, CAST(least(3, greatest(0, (CASE WHEN 0 <= xc THEN 1 ELSE 0 END) + (CASE WHEN 250 <= xc THEN 1 ELSE 0 END) + (CASE WHEN 500 <= xc THEN 1 ELSE 0 END) + (CASE WHEN 750 <= xc THEN 1 ELSE 0 END) + (CASE WHEN 900 <= xc THEN 1 ELSE 0 END) - 1)) AS INTEGER) AS col_no FROM (SELECT *, (x0 + x1) / 2 AS xc FROM w)""")
def cell_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.array(*[F.lit(float(x)) for x in (0, 250, 500, 750, 900)])
    return _words(spark, sf_dir).select("doc_id", "n", geometry.column_of((F.col("x0") + F.col("x1")) / 2, b).cast("int").alias("col_no"))


@query(WORDS_SQL + """,
v AS (SELECT doc_id // 64 AS d, doc_id AS r, x0, x1 FROM w), m AS (SELECT d, r, count(*) >= 2 AS multi FROM v GROUP BY d, r), y AS (SELECT d, bool_or(multi) AS any_ FROM m GROUP BY d),
k AS (SELECT v.* FROM v JOIN m USING (d, r) JOIN y USING (d) WHERE multi OR NOT any_),
e AS (SELECT d, min(x0) AS lo, max(x1) AS hi, count(DISTINCT r) AS n FROM k GROUP BY d),
c AS (SELECT d, x, count(DISTINCT r) AS c FROM (SELECT d, r, unnest(range(CAST(floor(x0) AS BIGINT), CAST(least(1001, ceil(x1)) AS BIGINT) + 1)) AS x FROM k) GROUP BY d, x),
a AS (SELECT d, n, unnest(range(0, 1002)) AS x FROM e),
f AS (SELECT a.*, a.x - row_number() OVER (PARTITION BY a.d ORDER BY a.x) AS g FROM a LEFT JOIN c ON a.d = c.d AND a.x = c.x WHERE coalesce(c, 0) <= greatest(1, floor(0.06 * n))),
s AS (SELECT d, min(x) AS p, max(x) AS q FROM f GROUP BY d, g),
i AS (SELECT d, count(*) AS n, sum(p + q) AS t FROM s WHERE q - p + 1 >= 10 AND p > 0 AND q < 1001 GROUP BY d)
SELECT CAST(e.d AS BIGINT) AS doc_id, lo, hi, CAST(coalesce(i.n, 0) AS BIGINT) AS n_inner, CAST(coalesce(t, 0) AS BIGINT) AS twice_middles FROM e LEFT JOIN i ON e.d = i.d""")
def corridor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the rows of documents of 64: which corridors hardly any of them crosses."""
    w = _words(spark, sf_dir).select(F.expr("doc_id div 64").alias("d"), F.col("doc_id").alias("row"), "x0", "x1")
    b = geometry.corridors(w, ["d"])
    inner = F.slice("boundaries", 2, F.size("boundaries") - 2)
    return b.select(F.col("d").alias("doc_id"), F.col("boundaries")[0].alias("lo"), F.element_at("boundaries", -1).alias("hi"), F.size(inner).cast("long").alias("n_inner"), F.aggregate(inner, F.lit(0.0), lambda a, x: a + 2 * x).cast("long").alias("twice_middles"))


@query("""
WITH t AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey % 3 <> 0 AS f FROM orders),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) > 2 THEN 1 ELSE 0 END AS n FROM t WHERE f),
r AS (SELECT k, min(i) AS a, max(i) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) AS s FROM g) GROUP BY k, s),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b - a DESC, a) AS rn FROM r)
SELECT k, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end" FROM b WHERE rn = 1 AND b - a + 1 >= 3""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.row_number().over(w) - 1).alias("visual_row"), (F.col("o_orderkey") % 3 != 0).alias("in_body"))
    return geometry.longest_run(t, ["k"])


@query(WORDS_SQL + """,
a AS (SELECT doc_id, x0, x1, y1 AS bottom FROM w WHERE n = 1),
c AS (SELECT a.doc_id, w.n, w.y0, w.x0, greatest(0, least(a.x1, w.x1) - greatest(a.x0, w.x0)) / least(a.x1 - a.x0, w.x1 - w.x0) AS s FROM a JOIN w ON a.doc_id = w.doc_id AND w.y0 >= a.bottom - 2 AND w.y0 - a.bottom <= 100)
SELECT doc_id, 'w' || CAST(n AS VARCHAR) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, s DESC, x0, n) AS r FROM c WHERE s >= 0.3) WHERE r = 1""")
def value_below_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each page as a heading, and the nearest word under it."""
    w = _words(spark, sf_dir)
    anchor = w.filter("n = 1").select("doc_id", "page_no", F.lit("first").alias("fact"), "x0", "x1", F.col("y1").alias("bottom"))
    height = w.select("doc_id", "page_no").distinct().withColumn("height", F.lit(1000.0))
    return geometry.value_below(anchor, w, height).select("doc_id", "text")


@query(WORDS_SQL + """,
h AS (SELECT doc_id, n, (y0 + y1) / 2 AS yc, x0, 0.6 * 10 AS lim FROM w), g AS (SELECT *, CASE WHEN yc - lag(yc) OVER (PARTITION BY doc_id ORDER BY yc, x0, n) > lim THEN 1 ELSE 0 END AS b FROM h)
SELECT doc_id, n, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY yc, x0, n ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line FROM g""")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.lines(_words(spark, sf_dir)).select("doc_id", "n", "line")


# ------------------------------------------------------------------ instruments: customers' orders as issuances

TOKENS = [i[0] for i in instruments.ISSUERS]
FACTS_SQL = f"""
WITH f AS (SELECT o_orderkey AS doc_id, list_extract({TOKENS!r}, CAST(o_custkey % 8 AS INTEGER) + 1) AS tok, CAST((o_custkey % 40) / 4.0 AS DOUBLE) AS taux, CAST(1 + o_orderkey % 20 AS INTEGER) AS q, CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) + CAST(30 * (1 + o_orderkey % 20) AS INTEGER) AS d2, o_custkey FROM orders)
"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c, k, d = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    token = F.element_at(F.array(*map(F.lit, TOKENS)), (c % 8).cast("int") + 1)
    return o.select(
        k.alias("doc_id"), F.concat(F.lit("DECLARATION "), token, F.lit(" 49-2026")).alias("title"), ((c % 40) / 4.0).cast("double").alias("taux"), (1 + k % 20).cast("int").alias("quantite"), d.alias("date_souscription"),
        F.date_add(d, (30 * (1 + k % 20)).cast("int")).alias("date_remboursement"), F.lit(500.0).alias("prix_unitaire"), (500.0 * (1 + k % 20) + F.when(k % 9 == 0, 1).otherwise(0)).cast("double").alias("montant"),
    )


KEY_SQL = "tok || '-' || substring(sha256(tok || '|' || printf('%.4f', taux) || '|' || strftime(d1, '%Y-%m-%d') || '|' || strftime(d2, '%Y-%m-%d')), 1, 16)"


@query(FACTS_SQL + f"SELECT doc_id, {KEY_SQL} AS key FROM f")
def allocation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruments.with_keys(_facts(spark, sf_dir)).select("doc_id", "key")


@query(FACTS_SQL + f"""
SELECT doc_id, '' AS ISIN, tok || ' ' || replace(printf('%.2f', taux), '.', ',') || '% ' || strftime(d2, '%d%m%Y') AS name, i.code AS issuer, replace(regexp_replace(printf('%.4f', taux), '[.]?0+$', ''), '.', ',') AS rate,
       CAST(q AS BIGINT) AS totalnumberOfCertificates, CAST(0 AS BIGINT) AS totalAmountToBePaid, strftime(d1, '%d/%m/%Y') AS auctionDate, CASE WHEN d2 - d1 <= 365 THEN 'Discount' ELSE 'Coupon' END AS type, strftime(d1, '%d/%m/%Y') AS issueDate,
       strftime(d1, '%d/%m/%Y') AS startDate, strftime(d2, '%d/%m/%Y') AS maturityDate, '' AS issuanceProgramme, CASE WHEN d2 - d1 <= 365 THEN 'certificat de depot inf 1an TF' ELSE 'certificat de deport sup 1an TF' END AS instrument, '' AS guarantor,
       strftime(d1, '%d/%m/%Y') AS entitlementDate, 'Standard' AS auctionType, i.bic AS BIC, '' AS code, CAST(500 * q AS BIGINT) AS nominalValueAllotted, CAST(q AS BIGINT) AS numberOfCertificates, CAST(0 AS BIGINT) AS amountToBePaid, 'NO' AS client, {", ".join(f"'' AS {c}" for c in instruments.CLIENT_COLUMNS)}
FROM f JOIN (VALUES {", ".join(f"('{t}', '{c}', '{b}')" for t, _, c, b in instruments.ISSUERS)}) i(tok, code, bic) USING (tok)""")
def declaration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruments.to_rows(instruments.with_keys(_facts(spark, sf_dir)).withColumn("isin", F.lit(None).cast("string")))


@query(FACTS_SQL + """
SELECT doc_id, id, CASE id WHEN 'montant' THEN doc_id % 9 <> 0 WHEN 'date_order' THEN d2 > d1 WHEN 'taux_range' THEN taux > 0 AND taux < 100 ELSE q > 0 END AS passed FROM f, (VALUES ('montant'), ('date_order'), ('taux_range'), ('quantite_positive')) c(id)""")
def declaration_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruments.reconcile(_facts(spark, sf_dir))


@query("""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'CIL' WHEN c_custkey % 5 = 1 THEN 'HNL' WHEN c_custkey % 5 = 2 THEN 'UNF' END AS token, CASE WHEN c_custkey % 5 = 3 THEN 'several issuers: AIL, CIL' WHEN c_custkey % 5 = 4 THEN 'no known issuer' END AS error FROM customer""")
def issuer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = ["DECLARATIONCIL49-2026", "Déclaration: declaration HNL 3", "Avis UNF/2026", "Avis AIL et CIL", "Avis"]
    token, error = instruments.issuer_of(F.element_at(F.array(*map(F.lit, titles)), (F.col("c_custkey") % 5).cast("int") + 1))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), token.alias("token"), error.alias("error"))


@query("""
WITH k AS (SELECT 'k' || CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS seq, 'sheet' || CAST(o_custkey % 3 AS VARCHAR) AS sheet FROM orders),
p AS (SELECT 'sheet' || CAST(p_partkey % 3 AS VARCHAR) AS sheet, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1 AS pos, 'TN' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS code FROM part),
l AS (SELECT 'k' || CAST(i AS VARCHAR) AS key, 'TN' || lpad(CAST(3 * i + 1 AS VARCHAR), 10, '0') AS isin FROM (SELECT unnest(range(0, 10)) AS i)),
n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY seq, key) AS rk FROM k WHERE key NOT IN (SELECT key FROM l)),
f AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY pos) AS rk FROM p WHERE code NOT IN (SELECT isin FROM l))
SELECT k.key, l.isin, false AS is_new FROM k JOIN l USING (key) UNION ALL SELECT n.key, f.code, true FROM n LEFT JOIN f USING (sheet, rk)""")
def isin_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for every order and all parts as pool: more keys than codes, ten of them allocated before."""
    text = lambda c: c.cast("string")
    requests = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), text(F.col("o_orderkey"))).alias("key"), F.concat(F.lit("sheet"), text(F.col("o_custkey") % 3)).alias("sheet"), F.col("o_orderkey").alias("seq"))
    p = table(spark, sf_dir, "part")
    pool = code_pool(p.select(F.concat(F.lit("sheet"), text(F.col("p_partkey") % 3)).alias("sheet"), F.col("p_partkey").alias("position"), F.concat(F.lit(" tn"), F.lpad(text(F.col("p_partkey")), 10, "0")).alias("value")))
    known = spark.range(10).select(F.concat(F.lit("k"), text(F.col("id"))).alias("key"), F.concat(F.lit("TN"), F.lpad(text(3 * F.col("id") + 1), 10, "0")).alias("isin"))
    return instruments.allocate(requests, pool, known).select("key", "isin", "is_new")


# ------------------------------------------------------------------ sinks


@query(LEDGER + "SELECT doc_id, row_no, o_orderkey, max(row_no) OVER (PARTITION BY doc_id) >= 7 AS truncated FROM ledger QUALIFY row_no >= 2 AND row_no < 7")
def preview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(ledger(spark, sf_dir).select("doc_id", "row_no", "o_orderkey"), ["doc_id"], 2, 5)


@query("SELECT c_custkey AS doc_id, f AS field, CASE f WHEN 'c_name' THEN c_name WHEN 'c_nationkey' THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS value FROM customer, (VALUES ('c_name'), ('c_nationkey'), ('c_mktsegment')) v(f)")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sheet(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", "c_nationkey", "c_mktsegment"))


@query("""
WITH c AS (SELECT doc_id // 300 AS d, 0 AS col_no, text AS raw FROM documents WHERE doc_id % 300 < 200 UNION ALL SELECT doc_id // 300, 1, source FROM documents WHERE doc_id % 300 < 200)
SELECT d AS doc_id, CAST(col_no AS INTEGER) AS col_no, CAST(greatest(10, least(50, max(length(raw)) + 2)) AS INTEGER) AS width FROM c GROUP BY d, col_no""")
def sheet_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cells in tables of 300 rows, whose number grows with the documents; the first 200 rows of each count."""
    d = table(spark, sf_dir, "documents")
    cell = lambda n, c: d.select(F.expr("doc_id div 300").alias("d"), F.expr("doc_id % 300").alias("row_no"), F.lit(n).alias("col_no"), F.col(c).alias("raw"))
    return column_widths(cell(0, "text").unionByName(cell(1, "source")), ["d"]).withColumnRenamed("d", "doc_id")


@query("""
WITH s AS (SELECT DISTINCT upper(substring(c_mktsegment, 1, 4 + CAST(c_nationkey % 2 AS INTEGER) * 10)) AS sheet FROM customer), i AS (SELECT DISTINCT c_mktsegment AS name FROM customer),
c AS (SELECT name, sheet, CASE WHEN lower(name) = lower(sheet) THEN 0 ELSE 1 END AS r FROM i JOIN s ON starts_with(lower(name), lower(sheet)) OR starts_with(lower(sheet), lower(name)))
SELECT name, sheet FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, len(sheet) DESC, sheet) AS n FROM c) WHERE n = 1""")
def sheet_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as issuers, their cut names in capitals as sheets."""
    c = table(spark, sf_dir, "customer")
    pool = c.select(F.upper(F.expr("substring(c_mktsegment, 1, 4 + cast(c_nationkey % 2 as int) * 10)")).alias("sheet")).distinct()
    issuers = c.select(F.col("c_mktsegment").alias("name")).distinct().withColumn("token", F.col("name"))
    return instruments.sheets_of(issuers, pool).select("name", "sheet")


@query("""
WITH r AS (SELECT o_custkey AS doc_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 60) AS page_no, o_orderkey FROM orders),
p AS (SELECT doc_id, CAST(unnest(range(1, max(page_no) + 3)) AS INTEGER) AS page_no FROM r GROUP BY doc_id),
k AS (SELECT doc_id, page_no FROM r WHERE o_orderkey % 3 > 0), s AS (SELECT doc_id, min(page_no) AS lo, max(page_no) AS hi FROM k GROUP BY doc_id)
SELECT s.doc_id, NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = s.doc_id AND p.page_no > lo AND p.page_no < hi AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = p.doc_id AND k.page_no = p.page_no)) AS passed FROM s""")
def pages_contributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.expr("o_orderkey div 60"))
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.dense_rank().over(w).alias("page_no"), "o_orderkey")
    pages = r.groupBy("doc_id").agg(F.max("page_no").alias("m")).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("m") + 2)).alias("page_no"), F.lit("digital").alias("kind"))
    return checks.check_pages(pages, r.filter("o_orderkey % 3 > 0").select("doc_id", F.lit(0).alias("table_id"), "page_no")).select("doc_id", "passed")


@query("SELECT c_custkey AS doc_id, 'table_found' AS id, false AS passed FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0) UNION ALL SELECT c_custkey, 'ocr_unavailable', false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0) AND c_nationkey > 12")
def documents_without_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_nationkey") > 12, 1).otherwise(0).alias("n_scanned"))
    return checks.without_tables(documents, table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("doc_id")), "no reader").select("doc_id", "id", "passed")


@query("""
WITH p AS (SELECT o_custkey AS k, CAST(o_orderkey % 500 AS BIGINT) AS pos FROM orders), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) > 4 THEN 1 ELSE 0 END AS n FROM p),
r AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY pos RANGE UNBOUNDED PRECEDING) AS run FROM g)
SELECT k, CAST((min(pos) + max(pos)) / 2.0 AS DOUBLE) AS centre FROM r GROUP BY k, run""")
def rule_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.merged_runs(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 500).alias("at")), ["k"])


@query("""
WITH w AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 4 AS INTEGER) AS rotation, l_quantity > l_linenumber * 10 AS wide, CAST(round(l_discount * 100) AS BIGINT) AS c FROM lineitem),
r AS (SELECT doc_id, rotation, count(*) FILTER (wide) * 1.0 / count(*) AS s, sum(c) * 1.0 / count(*) AS m FROM w GROUP BY doc_id, rotation)
SELECT doc_id, rotation FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, m DESC, rotation) AS n FROM r) WHERE n = 1""")
def page_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    words = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 4).cast("int").alias("rotation"), F.lit(0.0).alias("x0"), F.col("l_quantity").alias("x1"), F.lit(0.0).alias("y0"), (F.col("l_linenumber") * 10.0).alias("y1"), F.round(F.col("l_discount") * 100).alias("confidence"))
    return geometry.choose_rotation(words, ["doc_id"])
