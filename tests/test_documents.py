"""Whole documents: scans, letters without tables, long documents, several tables; sources, sinks and declarations as a caller uses them."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_statements import HEADER, PAGE, ROWS, pages

from ledgerloom import sinks
from ledgerloom.config import EngineConfig, Profile
from ledgerloom.functions import registry
from ledgerloom.operators import geometry, instruments
from ledgerloom.plans import declarations, engine
from ledgerloom.sources import tables
from ledgerloom.storage import Scratch

SCAN = PAGE + ", kind string, confs array<double>"


def damaged(row):
    """A scanned row: letters for digits in the one debit of 512.00."""
    return [c.replace("512.00", "S12.OO") for c in row]


def scanned(spark):
    rows = []
    for page, part in ((1, ROWS[:6]), (2, ROWS[6:])):
        for i, c in enumerate([HEADER, *map(damaged, part)]):
            rows.append(("scan", page, 0, i, c, 60.0, 800.0, 842.0, "scanned", [0.98] * 5 + [0.6 if "16,888" in c[5] else 0.97]))
    return spark.createDataFrame(rows, SCAN)


def test_scanned_statement_is_repaired_and_reconciles(spark):
    result = engine.run(scanned(spark).repartition(5))
    found = {r.id: r for r in result.checks.collect()}
    assert found["stated_totals"].passed and found["running_balance"].passed and found["numeric_parsing"].passed and found["pages_contributed"].passed
    assert not found["ocr_confidence"].passed and "1 cell of low confidence" in found["ocr_confidence"].detail
    flags = {(r.row, r.column, r.reason) for r in result.flags.collect()}
    assert (3, "Debit", "ocr_repaired") in flags and (7, "Balance", "low_confidence") in flags
    assert result.verdicts.first().passed
    result.close()


def test_a_letter_has_no_table_and_fails(spark):
    known = pages(spark).select("doc_id", "page_no").distinct().withColumn("kind", F.lit("digital"))
    known = known.unionByName(spark.createDataFrame([("letter", 1, "scanned")], "doc_id string, page_no int, kind string"))
    result = engine.run(pages(spark), pages=known, ocr_problem="no reader is installed")
    found = {(r.doc_id, r.id): r for r in result.checks.collect()}
    assert not found["letter", "table_found"].passed and "1 scanned page not read" in found["letter", "ocr_unavailable"].detail
    assert {r.doc_id: r.passed for r in result.verdicts.collect()} == {"ok": True, "broken": False, "letter": False}
    result.close()


def test_pages_beyond_the_limit_are_told(spark):
    result = engine.run(pages(spark).filter("doc_id = 'ok'"), config=EngineConfig(max_pages=1))
    assert [r.warning for r in result.warnings.collect()] == ["Document has 2 pages; only the first 1 were processed."]
    assert result.cells.agg(F.max("row_no")).first()[0] == 5
    result.close()


def test_close_deletes_what_a_run_wrote(spark):
    result = engine.run(pages(spark).filter("doc_id = 'ok'"))
    folder = Path(result.scratch.path.removeprefix("file://"))
    assert any(folder.iterdir())
    result.close()
    assert not folder.exists()


def test_tables_of_one_page_stay_apart(spark):
    t = [["Department", "2024", "2025"], ["Sales", "1.00", "2.00"], ["Research", "3.00", "4.00"]], [["Name", "Extension"], ["Ada", "12"], ["Bo", "14"]]
    rows = [("m", 1, no, i, c, 100.0 + 300 * no, 300.0 + 300 * no, 842.0) for no, x in enumerate(t) for i, c in enumerate(x)]
    result = engine.run(spark.createDataFrame(rows, PAGE), Profile(fill_merged_labels=True))
    assert result.cells.select("table_id").distinct().count() == 2 and result.primary.first().table_id == 0
    result.close()


def test_merged_labels_are_carried_down(spark):
    rows = [["Kind", "Amount", "Note"], ["A", "1,100.50", "x"], ["", "2.50", "y"], ["B", "", "z"], ["", "4.50", "z"]]
    result = engine.run(spark.createDataFrame([("f", 1, 0, i, c, None, None, None) for i, c in enumerate(rows)], PAGE), Profile(fill_merged_labels=True))
    got = {(r.row_no, r.col_no): r.text or r.amount for r in result.cells.collect()}
    assert [got[i, 0] for i in range(4)] == ["A", "A", "B", "B"] and got[2, 1] is None and got[3, 1] == 4.5
    result.close()


def test_words_of_one_page(spark):
    """A page without a clear pitch keeps all rows; one column is no table unless it is a scan."""
    rows = [(d, 1, t, x, y, x + 30, y + 10.0, 0.9) for d in ("two", "one") for t, x, y in (("A", 50.0, 20.0), ("B", 300.0 if d == "two" else 52.0, 20.0 if d == "two" else 60.0), ("c", 52.0, 90.0), ("d", 301.0 if d == "two" else 51.0, 90.0 if d == "two" else 170.0))]
    words = spark.createDataFrame(rows, "doc_id string, page_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    about = spark.createDataFrame([("two", 1, 600.0, 842.0, "digital"), ("one", 1, 600.0, 842.0, "digital")], "doc_id string, page_no int, width double, height double, kind string").withColumns({"x_rules": F.lit(None).cast("array<double>"), "y_rules": F.lit(None).cast("array<double>")})
    assert [(r.doc_id, r.cells) for r in geometry.page_rows(words, about).orderBy("row_no").collect()] == [("two", ["A", "B"]), ("two", ["c", "d"])]
    assert geometry.page_rows(words.limit(0), about).count() == 0


def test_export_and_its_report(spark, tmp_path):
    result = engine.run(pages(spark).filter("doc_id = 'ok'"))
    of = result.columns.groupBy("doc_id", "table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "name"))), lambda x: x["name"]).alias("columns"))
    sizes = of.join(result.cells.groupBy("doc_id", "table_id").agg(F.countDistinct("row_no").alias("n_rows")), ["doc_id", "table_id"])
    report = json.loads(sinks.report(result.checks, result.flags, sizes, None, result.primary).first().report)
    assert report["n_rows"] == 10 and report["columns"] == HEADER and report["validation"]["passed"] and report["extra_tables"] == []
    sinks.export_all(result.cells, result.checks, result.flags, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all/cells")).count() == 60
    result.close()


def test_caches_and_pools_are_found(spark, tmp_path, monkeypatch):
    words = spark.createDataFrame([("ab12", 1, 300, "x")], "sha256 string, page_no int, dpi int, text string")
    sinks.write_word_cache(words, str(tmp_path / "cache"))
    assert sinks.cache_size(spark, str(tmp_path / "cache")) > 0 and (tmp_path / "cache/sha_prefix=ab").exists()
    assert sinks.clear_cache(spark, str(tmp_path / "cache")) > 0 and sinks.cache_size(spark, str(tmp_path / "cache")) == 0
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "block ISIN.csv").write_text("")
    monkeypatch.delenv(tables.POOL_VARIABLE, raising=False)
    assert tables.discover_pool((str(tmp_path),)).endswith("block ISIN.csv") and tables.discover_pool((str(tmp_path / "none"),)) is None
    monkeypatch.setenv(tables.POOL_VARIABLE, "/x")
    assert tables.discover_pool() == "/x"


def test_a_corrupt_ledger_is_fatal(spark, tmp_path):
    (tmp_path / "ledger.json").write_text('{"key": "k", "isin"')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        tables.code_ledger(spark, str(tmp_path / "ledger.json")).collect()


def test_files_and_profiles_on_disk(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    (tmp_path / "c.yaml").write_text("name: bank\nmatch_keywords: [solde]\nodd: 1\n")
    (tmp_path / "d.yml").write_text(": [")
    got = {r.source_name: r.problem for r in tables.files(spark, str(tmp_path / "*.pdf")).collect()}
    assert got == {"a.pdf": None, "b.pdf": "no PDF content"}
    found, warnings = tables.profiles(str(tmp_path))
    assert [p.name for p in found] == ["bank"] and len(warnings) == 2


def test_declarations_without_a_pool(spark):
    facts = spark.createDataFrame([("d", 1, "DECLARATIONCIL49", 8.0, 10, "x", 0.9)], "doc_id string, page_no int, title string, taux double, quantite int, libelle string, confidence double")
    facts = facts.withColumns({"date_souscription": F.to_date(F.lit("2026-07-31")), "date_remboursement": F.to_date(F.lit("2026-09-09")), "prix_unitaire": F.lit(500.0), "montant": F.lit(5000.0)})
    done = declarations.from_facts(facts)
    row, found = done.rows.first(), {r.id: (r.passed, r.severity) for r in done.checks.collect()}
    assert len(row) == 37 and row["ISIN"] == "" and row["investorType"] == "" and done.allocated is None
    assert found["isin_allocated"] == (False, "warning") and found["montant"][0] and found["mapping_incomplete"] == (False, "warning")
    assert [*done.rows.columns][1:] == [*instruments.MAIN_COLUMNS, *instruments.CLIENT_COLUMNS]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://elsewhere"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        Scratch(Session())


def test_functions_by_name(spark):
    registry.register(spark)
    got = spark.sql("SELECT nfkc('ﬁn ①') AS n, parse_amount('(1,234.50)') AS a, parse_amount('1.234', ',') AS c, parse_cell_date('4 avril 2025') AS d, is_blank_marker('n/a') AS b, repair_ocr_digits('1,2S4.56') AS r, fold_text('Débit (TND)') AS f").first()
    assert (got.n, got.a, got.c, str(got.d), got.b, got.r, got.f) == ("fin 1", -1234.5, 1234.0, "2025-04-04", True, "1,254.56", "debittnd")


def test_declaration_facts_deal_out_words_once(spark):
    """No join is planned between the steps: there were 15, with 31 exchanges, which the driver kept each time it planned anew."""
    from ledgerloom.operators import geometry

    words = spark.createDataFrame([], "doc_id string, page_no int, rotation int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    pages = spark.createDataFrame([], "doc_id string, page_no int, rotation int, height double")
    plan = geometry.declaration_facts(words, pages)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan


def test_declaration_facts_of_a_lone_reading_without_height(spark):
    """A reading without a height gives nothing, as before; the other reading of the page is taken."""
    from ledgerloom.operators import geometry

    from test_statements import WORDS

    rows = [("d", 1, r, t, *map(float, b.split(",")), 0.98) for r in (270, 90) for t, b in (x.split("|") for x in WORDS.split(";"))]
    words = spark.createDataFrame(rows, "doc_id string, page_no int, rotation int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    pages = spark.createDataFrame([("d", 1, 90, 1650.0), ("d", 1, 270, None)], "doc_id string, page_no int, rotation int, height double")
    got = geometry.declaration_facts(words, pages).collect()
    assert [(r.rotation, r.taux, r.quantite, r.confidence) for r in got] == [(90, 8.0, 10, 0.98)]


def test_declaration_checks_allocate_once(spark):
    """Only the check of the code itself needs the allocation; all four branches repeated it, which the driver planned and kept."""
    facts = spark.createDataFrame([("d", 1, 0.9, "DECLARATION CIL", 5.0, 2, None, None, None, None)], "doc_id string, page_no int, confidence double, title string, taux double, quantite int, date_souscription date, date_remboursement date, prix_unitaire double, montant double")
    pool = spark.createDataFrame([("compagnie internationale de leasing emetteur cd", 0, "c0")], "sheet string, position int, code string")
    done = declarations.from_facts(facts, pool)
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("row_number(")
    assert 0 < planned(done.checks) <= planned(done.allocated)
    assert {(r.id, r.detail) for r in done.checks.filter("id = 'isin_allocated'").collect()} == {("isin_allocated", "c0 newly taken from the pool.")}


def test_page_rows_keep_no_words_on_disk(spark, monkeypatch):
    """Words that lie by document are neither written nor dealt out again by page: both took several times the input's disk."""
    from ledgerloom.operators import geometry
    from ledgerloom.storage import Scratch

    def keep(*_):
        raise AssertionError("words are written")

    monkeypatch.setattr(Scratch, "keep", keep)
    words = spark.createDataFrame([], "doc_id string, page_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double").repartition(3, "doc_id")
    pages = spark.createDataFrame([], "doc_id string, page_no int, width double, height double, kind string, x_rules array<double>, y_rules array<double>").repartition(3, "doc_id")
    plan = geometry.page_rows(words, pages)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("page_no" in line.split("hashpartitioning(")[1] for line in dealt)


def _page_by_hand(words, width, x_rules, y_rules):
    """(row, in the body, in the table) of each word of one page, a word at a time."""
    from statistics import median

    words = sorted(words, key=lambda w: ((w[2] + w[4]) / 2, w[1], w[0]))
    ys = [(w[2] + w[4]) / 2 for w in words]
    if y_rules and len(y_rules) >= 3:
        bands = [sum(r <= y for r in y_rules) for y in ys]
        rank = {b: i for i, b in enumerate(sorted({b for b in bands if 0 < b < len(y_rules)}))}
        return [(w, rank[b], True, True) for w, b in zip(words, bands, strict=True) if b in rank]
    high = [w[4] - w[2] for w in words if w[4] > w[2]]
    limit, rows, own = 0.55 * median(high) if high else 12.0, [], []
    for y in ys:
        if not own or abs(y - sum(own) / len(own)) > limit:
            own = []
            rows.append(own)
        own.append(y)
    at = [i for i, r in enumerate(rows) for _ in r]
    means = [sum(r) / len(r) for r in rows]
    first, last = 0, len(rows) - 1
    if len(rows) >= 5:
        pitch = [b - a for a, b in zip(means, means[1:], strict=False)]
        near = [abs(p - median(pitch)) <= 0.18 * median(pitch) for p in pitch]
        true = [r for r in range(len(rows)) if (r and near[r - 1]) or (r < len(near) and near[r])]
        runs = []
        for r in true:
            if runs and r - runs[-1][1] <= 2:
                runs[-1][1] = r
            else:
                runs.append([r, r])
        best = max(runs, key=lambda x: x[1] - x[0], default=None)
        first, last = best if best and best[1] - best[0] >= 2 else (first, last)
    return [(w, r, first <= r <= last, first - 1 <= r <= last) for w, r in zip(words, at, strict=True)]


def _tables_by_hand(pages, words):
    """{(doc, page): [(cells, least confidence)]}: pages' columns from the places that hardly a row of their document covers."""
    placed = {}
    for k, (width, _, kind, xs, ys) in pages.items():
        placed[k] = _page_by_hand([w[2:] for w in words if w[:2] == k], width, xs, ys)
    out = {}
    for doc in {k[0] for k in pages}:
        rows = {}
        for k, (width, _, kind, xs, ys) in pages.items():
            if k[0] == doc and not (xs and len(xs) >= 3):
                for w, r, body, _ in placed[k]:
                    if body:
                        s = 1000.0 / width
                        rows.setdefault((k, r), []).append((w[1] * s, w[3] * s))
        many = {k: r for k, r in rows.items() if len(r) >= 2} or rows
        shared = None
        if many:
            cover = [0] * 1002
            for r in many.values():
                for p in {p for a, b in r for p in range(max(0, int(a // 1)), min(1001, int(-(-b // 1))) + 1)}:
                    cover[p] += 1
            free = [c <= max(1, int(0.06 * len(many))) for c in cover]
            middles, a = [], None
            for p, f in enumerate([*free, False]):
                if f and a is None:
                    a = p
                elif not f and a is not None:
                    if p - a >= 10 and a > 0 and p - 1 < 1001:
                        middles.append((a + p - 1) / 2)
                    a = None
            every = [x for r in many.values() for x in r]
            shared = [min(x[0] for x in every), *middles, max(x[1] for x in every)]
        for k, (width, _, kind, xs, ys) in pages.items():
            if k[0] != doc:
                continue
            grid = bool(xs) and len(xs) >= 3
            bounds = sorted(xs) if grid else shared and [b * width / 1000 for b in shared]
            if not bounds:
                continue
            table = {}
            for w, r, _, inside in placed[k]:
                if inside:
                    c = min(len(bounds) - 2, max(0, sum(b <= (w[1] + w[3]) / 2 for b in bounds) - 1))
                    table.setdefault(r, {}).setdefault(c, []).append(w)
            found = []
            for r in sorted(table):
                cells = [" ".join(w[0] for w in sorted(table[r].get(c, []), key=lambda w: (w[1], w[0]))) for c in range(len(bounds) - 1)]
                if any(c.strip(" ") for c in cells):
                    found.append(("|".join(cells), min(w[5] for ws in table[r].values() for w in ws)))
            if found and (kind == "scanned" or (len(found) >= 2 and len(bounds) > 2)):
                out[k] = found
    return out


def _odd_pages(seed=7, docs=14):
    import random

    rng = random.Random(seed)
    pages, words = {}, []
    for doc in range(docs):
        for page in range(1, 1 + rng.choice([1, 2, 3, 9])):
            width = rng.choice([600.0, 612.5, 800.0])
            ruled = rng.random()
            xs = [30.0, 250.0, 110.0, 350.0] if ruled < 0.25 else [5.0] if ruled < 0.4 else None
            ys = sorted(rng.uniform(50, 300) for _ in range(rng.choice([2, 3, 9]))) if rng.random() < 0.4 else None
            pages[doc, page] = (width, 842.0, rng.choice(["scanned", "digital"]), xs, ys)
            y = 60.0
            for _ in range(rng.choice([0, 1, 2, 6, 25])):
                y += rng.choice([14.0, 14.0, 14.0, 14.5, 31.0])
                for x in (40, 180, 330, 470):
                    if rng.random() < 0.7:
                        x0, y0 = x + rng.choice([0.0, 0.0, 3.5, 9.0]), y + rng.choice([0.0, 0.0, 1.0, 4.0])
                        words.append((doc, page, rng.choice(["a", "b", "é 1", " ", ""]), x0, y0, x0 + rng.choice([0.0, 20.0, 60.0, 180.0]), y0 + rng.choice([10.0, 10.0, 8.0, 0.0]), rng.choice([0.5, 0.9])))
    return pages, words


def test_page_rows_of_odd_pages_as_by_hand(spark):
    """Words are placed many pages at a time, in one pass over them: one sort, one call of Python, no array of a page's words."""
    from ledgerloom.operators import geometry

    about, words = _odd_pages()
    placed = spark.createDataFrame(words[::-1], "doc_id long, page_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    pages = spark.createDataFrame([(*k, *v) for k, v in about.items()], "doc_id long, page_no int, width double, height double, kind string, x_rules array<double>, y_rules array<double>")
    rows = geometry.page_rows(placed, pages)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "collect_list" not in plan
    got = {}
    for r in rows.orderBy("doc_id", "page_no", "row_no").collect():
        assert r.row_no == len(got.setdefault((r.doc_id, r.page_no), []))
        got[r.doc_id, r.page_no].append(("|".join(r.cells), min(r.confs)))
    hand = _tables_by_hand(about, words)
    assert len(hand) > 20 and got == hand


def test_long_documents_are_placed_in_parts():
    """Whatever the chunks: whole documents, some of a batch, or a document in parts that wait in a file."""
    import pyarrow as pa

    from ledgerloom.operators import geometry, placing

    about, words = _odd_pages(11)
    rows = [(*k, placing.ABOUT, v[2], v[0], v[1], None, None, None) for k, v in about.items()]
    rows += [(*k, part, None, x, None, None, None, None) for k, v in about.items() for part, xs in ((placing.X_RULE, v[3]), (placing.Y_RULE, v[4])) for x in xs or []]
    rows += [(d, p, placing.WORD, *w) for d, p, *w in words]
    rows.sort(key=lambda r: (*r[:3], r[4], r[3] or ""))
    first = {d: next(i for i, r in enumerate(rows) if r[0] == d) for d in {r[0] for r in rows}}
    names = ["doc_id", "page_no", "_part", "text", "x0", "y0", "x1", "y1", "confidence", "_i"]
    table = pa.table({n: pa.array(c, pa.string() if n == "text" else pa.float64() if n[0] in "xyc" else pa.int64()) for n, c in zip(names, zip(*[(*r, i - first[r[0]] + 1) for i, r in enumerate(rows)], strict=True), strict=True)})
    base = {"width": 1000, "crossing": geometry.CROSSING, "gap": 10, "tolerance": geometry.ROW_TOLERANCE, "pitch": geometry.PITCH, "rules": geometry.RULES}

    def found(batch, chunk, long):
        return [r for b in placing.page_tables(iter(table.to_batches(batch)), base | {"chunk": chunk, "long": long}) for r in b.to_pylist()]

    whole = found(10_000, 100_000, 400_000)
    assert {(r["doc_id"], r["page_no"]) for r in whole} == set(_tables_by_hand(about, words))
    for sizes in ((1, 1, 1), (3, 5, 20), (50, 60, 60), (7, 400, 10**9)):
        assert found(*sizes) == whole
