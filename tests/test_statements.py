"""Statements end to end: a clean one reconciles, a broken one is caught, row order does not matter."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import sinks
from ledgerloom.config import Profile
from ledgerloom.operators import checks, geometry, infer, instruments, normalize, stitch
from ledgerloom.plans import engine

HEADER = ["Date", "Description", "Reference", "Debit", "Credit", "Balance"]
ROWS = [x.split("|") for x in """01/03/2025|Opening balance||||12,450.00
03/03/2025|Card payment - STATIONERY|0041123|340.25||12,109.75
07/03/2025|Transfer received|0041187||1,200.50|13,310.25
14/03/2025|Direct debit - UTILITIES|0041234|512.00||12,798.25
18/03/2025|Cheque deposit|0041318||2,000.00|14,798.25
21/03/2025|Salary - MARCH|0041402||3,150.00|17,948.25
25/03/2025|Card payment - TRAVEL|0041477|1,024.80||16,923.45
27/03/2025|Bank charges|0041520|35.00||16,888.45
28/03/2025|Interest paid|0041556||12.35|16,900.80
31/03/2025|Card payment - SUPPLIES|0041610|289.90||16,610.90
|TOTAL||2,201.95|6,362.85|16,610.90""".split("\n")]
PAGE = "doc_id string, page_no int, table_no int, row_no int, cells array<string>, top double, bottom double, page_height double"


def pages(spark):
    rows = []
    for doc, lines in (("ok", ROWS), ("broken", [r for r in ROWS if r[2] != "0041402"])):
        for page, part in ((1, lines[:6]), (2, lines[6:])):
            rows += [(doc, page, 0, i, c, 60.0, 800.0, 842.0) for i, c in enumerate([HEADER, *part])]
    return spark.createDataFrame(rows, PAGE)


@pytest.fixture(scope="module")
def result(spark):
    return engine.run(pages(spark).repartition(7))


def found(result):
    return {(r.doc_id, r.id): r for r in result.checks.collect()}


def test_clean_statement_passes(result):
    assert {r.doc_id: r.passed for r in result.verdicts.collect()} == {"ok": True, "broken": False}


def test_broken_statement_names_what_is_missing(result):
    got = found(result)
    assert "3,150.00" in got["broken", "stated_totals"].detail
    assert "row 6" in got["broken", "running_balance"].detail
    assert got["ok", "stated_totals"].passed and got["ok", "running_balance"].passed
    assert "9 data rows" in got["broken", "table_found"].detail  # failures never block output


def test_types_and_kept_text(result):
    kinds = {(r.col_no, r.kind) for r in result.columns.filter("doc_id = 'ok'").collect()}
    assert kinds == {(0, "date"), (1, "text"), (2, "text"), (3, "amount"), (4, "amount"), (5, "amount")}
    assert result.cells.filter("doc_id = 'ok' and row_no = 1 and col_no = 2").first().text == "0041123"


def test_export_writes_report_beside_csv(spark, result, tmp_path):
    table = sinks.wide(result.cells, result.columns, "ok", 0)
    paths = sinks.export_csv(table, sinks.report(result.checks, result.flags).filter("doc_id = 'ok'"), str(tmp_path / "out"), ";")
    part = next((tmp_path / "out.csv").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfDate;Description") and part.count(b"\n") == 11
    assert spark.read.text(paths.report).count() == 1


def test_continuation_carries_the_group_header(spark):
    rows = [("d", 1, 0, 2, "h1", "h1", 300.0, 400.0, 842.0), ("d", 2, 0, 2, "h2", "x", 300.0, 400.0, 842.0), ("d", 3, 0, 2, "h2", "h2", 300.0, 400.0, 842.0)]
    t = spark.createDataFrame(rows, "doc_id string, page_no int, table_no int, n_cols int, header_sig string, first_sig string, top double, bottom double, page_height double")
    assert [r.group_id for r in stitch.continuation_groups(t).orderBy("page_no").collect()] == [0, 1, 1]


def test_headers_may_be_stacked_or_missing(spark):
    rows = [("a", 0, ["1", "2", "3"]), ("c", 0, ["Opening", "", "Debit"]), ("c", 1, ["", "Balance", "(TND)"]), ("c", 2, ["1.00", "2.00", "3"])]
    got = {r.k: (r.header, r.consumed) for r in stitch.find_headers(spark.createDataFrame(rows, "k string, row_no int, cells array<string>"), ["k"]).collect()}
    assert got == {"a": ([], 0), "c": (["Opening", "Balance", "Debit (TND)"], 2)}


def test_repeated_header_names_stay_different(spark):
    """A deliberate deviation: a numbered name never collides with another column's own."""
    h = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Amount", "Amount", "Amount (2)", ""])], "doc_id int, col_no int, raw string")
    names = [r.name for r in infer.clean_headers(h, ["doc_id"]).orderBy("col_no").collect()]
    assert names[:2] == ["Amount", "Amount (2)"] and len({n.lower() for n in names}) == 4 and names[3] == "column_4"


def test_total_rows(spark):
    rows = [["TOTAL", "1"], ["Total fees debited in the month of March", "2"], ["x", "3"], ["Total des mouvements", "4"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>")
    assert [r.t for r in df.select("i", normalize.is_total_row(F.col("cells")).alias("t")).orderBy("i").collect()] == [True, False, False, True]


def test_dotted_dates_are_no_evidence_for_a_comma(spark):
    """A deliberate deviation: cells that are dates do not vote on the separator."""
    c = spark.createDataFrame([(1, "01.03.2025"), (1, "02.03.2025"), (1, "1,234.50")], "doc_id int, raw string")
    assert infer.decimal_separator(c, ["doc_id"]).first().decimal == "."


def test_journal_check_needs_a_journal(spark):
    """A deliberate deviation: declaring a closing balance does not turn a statement into a journal."""
    cells = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 4.0)], "doc_id int, table_id int, col_no int, amount double")
    roles = spark.createDataFrame([(1, 0, 0, 1, 2)], "doc_id int, table_id int, debit int, credit int, closing int")
    assert checks.check_debits_equal_credits(cells, roles, Profile(balance_columns={"closing": "Balance"})).count() == 0
    assert not checks.check_debits_equal_credits(cells, roles.withColumn("closing", F.lit(None).cast("int"))).first().passed


def test_journal_check_of_large_sums(spark):
    """A deliberate deviation: cents add up exactly, so the tolerance stays at one cent for large sums."""
    cells = spark.createDataFrame([(i, 0, c, 1e10) for i in (1, 2) for c in (0, 1) for _ in range(4)] + [(1, 0, 0, 10.0), (2, 0, 0, 0.01)], "doc_id int, table_id int, col_no int, amount double")
    roles = spark.createDataFrame([(i, 0, 0, 1, None) for i in (1, 2)], "doc_id int, table_id int, debit int, credit int, closing int")
    assert {r.doc_id: r.passed for r in checks.check_debits_equal_credits(cells, roles).collect()} == {1: False, 2: True}


WORDS = """DECLARATIONCIL49-2026|920,299,1409,336;Libelle du Certificat de depot|147,769,589,809;Taux Prix unitaire|680,772,966,810;Montant|1007,772,1141,810;Quantite|1203,773,1338,810
Date de|1432,775,1556,811;Date de|1729,775,1853,811;souscription|1399,830,1589,861;remboursement|1670,830,1913,861;CIL-CertificatdeDepot8,00%|69,892,466,927;31/07/20268,00%|510,895,764,927
500000,000|792,896,952,928;5000000,000|985,895,1167,930;10|1252,896,1291,930;31/07/2026|1416,896,1575,932;09/09/2026|1713,896,1869,933""".replace("\n", ";")


def test_declaration_page_to_row(spark):
    rows = [("d", 1, i, t, *map(float, b.split(",")), 0.98) for i, (t, b) in enumerate(x.split("|") for x in WORDS.split(";"))]
    words = spark.createDataFrame(rows, "doc_id string, page_no int, box_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    facts = geometry.facts(words, spark.createDataFrame([("d", 1, 1650.0)], "doc_id string, page_no int, height double"))
    row = instruments.to_rows(instruments.with_keys(facts).withColumn("isin", F.lit("TN0000000001"))).first()
    assert (row["name"], row["rate"], row["nominalValueAllotted"], row["type"], row["BIC"]) == ("CIL 8,00% 09092026", "8", 5000, "Discount", "CILTTN00020")
    assert all(r.passed for r in instruments.reconcile(facts).collect())


def test_allocation_is_idempotent_and_never_shares_a_code(spark):
    pool = spark.createDataFrame([("a", 0, "c0"), ("a", 1, "c1"), ("b", 0, "c1"), ("b", 1, "c2")], "sheet string, position int, code string")
    ask = spark.createDataFrame([("k1", "a", 1), ("k1", "a", 5), ("k2", "a", 2), ("k3", "b", 3), ("k4", "b", 4)], "key string, sheet string, seq int")
    none = spark.createDataFrame([], "key string, isin string")
    first = {r.key: r.isin for r in instruments.allocate(ask, pool, none).collect()}
    assert first == {"k1": "c0", "k2": "c1", "k3": "c2", "k4": None}
    again = instruments.allocate(ask.filter("key != 'k4'"), pool, spark.createDataFrame([(k, v) for k, v in first.items() if v], "key string, isin string")).collect()
    assert {r.key: r.isin for r in again} == {k: v for k, v in first.items() if v} and not any(r.is_new for r in again)


def test_exhausted_pool_writes_nothing(spark, tmp_path):
    pool = spark.createDataFrame([("a", 0, "c0")], "sheet string, position int, code string")
    ask = spark.createDataFrame([("k1", "a", 1), ("k2", "a", 2)], "key string, sheet string, seq int")
    with pytest.raises(instruments.PoolExhausted):
        instruments.record(instruments.allocate(ask, pool, spark.createDataFrame([], "key string, isin string")), str(tmp_path / "ledger"))
    assert not (tmp_path / "ledger").exists()


def test_landing_stream(spark, tmp_path):
    from ledgerloom.streaming import landing

    pages(spark).coalesce(1).write.json(str(tmp_path / "in"))
    landing.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out/checks")).filter("not passed").select("doc_id").distinct().count() == 1
