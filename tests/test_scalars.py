"""Cells as amounts and dates; null beats a plausible wrong number."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S

AMOUNTS = {
    "1,234,567.89": 1234567.89, ".5": 0.5, "1.234.567,89": 1234567.89, "12,50": 12.5, "(1,234.56)": -1234.56, "[1,234.56]": -1234.56, "1234.56-": -1234.56, "−12": -12, "–12": -12,
    "1,234.56 DR": -1234.56, "DR 1,234.56": -1234.56, "1,234.56 CR": 1234.56, "CT 5": 5, "(1,234.56) DR": -1234.56, "$(1,234.56)": -1234.56, "(1,234.56 USD)": -1234.56, "1 234,56": 1234.56,
    "USD 12 USD": 12, "5.DT": 5, "12%": 12, "DR(5CR)": 5, "１２３": 123, "+5": 5, "1,234": 1234, "débit 7": -7, "((5))": -5,
    "Page 1 of 12": None, "Account 40-12-88": None, "12 Main Street": None, "N/A": None, "1.2.3.4": None, "True": None, "1" * 33: None, "(5": None, "(5]": None, "()": None, "1,23,4": None,
    "5 USD CR": None, "1e5": None, "0.00-": None, "": None, None: None,
}
DATES = {
    "04/03/2025": "2025-03-04", "25/03/2025": "2025-03-25", "03/25/2025": "2025-03-25", "Mar 4 2025": "2025-03-04", "4 avril 2025": "2025-04-04", "04/03/98": "1998-03-04", "2025-3-4": "2025-03-04",
    "4 Mar 25": "2025-03-04", "31/02/2025": None, "12/2025": None, "2025/13/1": None, "x": None, None: None,
}
REPAIRS = {"l,234.56": "1,234.56", "1,2S4.56": "1,254.56", "Solar": "Solar", "B2B": "828", "89O.10": "890.10", "1OOOO": "10000", "": "", None: None}


def apply(spark, cells, function, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, s {kind}").select("i", function(F.col("s")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_amounts(spark):
    assert dict(zip(AMOUNTS, apply(spark, AMOUNTS, S.parse_amount), strict=True)) == AMOUNTS


@pytest.mark.parametrize(("sep", "want"), [(",", 1234.0), (".", 1.234)])
def test_declared_separator(spark, sep, want):
    assert apply(spark, ["1.234"], lambda c: S.parse_amount(c, F.lit(sep))) == [want]


def test_dates(spark):
    got = [str(d) if d else None for d in apply(spark, DATES, S.parse_date)]
    assert dict(zip(DATES, got, strict=True)) == DATES


def test_month_first(spark):
    assert apply(spark, ["04/03/2025"], lambda c: S.parse_date(c, F.lit(False))) == [dt.date(2025, 4, 3)]


def test_ocr_repair_cascades(spark):
    assert dict(zip(REPAIRS, apply(spark, REPAIRS, S.repair_ocr_digits), strict=True)) == REPAIRS


def test_accents_fold(spark):
    """A deliberate deviation: accents are folded, not deleted, so that Débit and DEBIT are one header."""
    assert apply(spark, ["Débit (TND)", "DEBIT TND"], S.fold) == ["debittnd", "debittnd"]


def test_first_percent_behind_a_date(spark):
    assert apply(spark, ["31/07/20268,00%", "none"], S.first_percent) == [8.0, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), min_size=20, max_size=60))
def test_round_trip_of_every_notation(spark, cents):
    from ledgerloom.sources.tables import rendered

    df = spark.createDataFrame([(c, n) for c in cents for n in range(8)], "c long, n int")
    bad = df.filter(~S.parse_amount(rendered(F.col("c"), F.col("n"))).eqNullSafe(F.col("c") / 100))
    assert bad.count() == 0


def test_functions_for_sql_follow_the_expressions(spark):
    """Random cells: what the registered functions say is what the expressions say."""
    import random

    from ledgerloom.functions import registry

    draw = random.Random(7)
    pieces = ["1", "234", "56", ".", ",", " ", "-", "(", ")", "[", "]", "DR", "CR", "€", "USD", "12", "2025", "/", "avril", "Mar", "O", "S", "l", "％", "½", "0", "x", "n/a"]
    cells = ["".join(draw.choices(pieces, k=draw.randrange(1, 7))) for _ in range(4000)] + [None, "", "31/02/2025", "4 Mar 25", "(1,234.56) DR", "1.234.567,89", "[DR (12)]", "2025-03-04"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", S.parse_amount(F.col("c")).alias("a"), S.parse_amount(F.col("c"), F.lit(",")).alias("k"), S.parse_date(F.col("c"), F.lit(False)).alias("d"), S.is_blank_marker(F.col("c")).alias("b"), S.repair_ocr_digits(F.col("c")).alias("r"), S.fold(F.col("c")).alias("f"))
    for r in rows.collect():
        assert (r.a, r.k, r.d, r.b, r.r, r.f) == (registry.amount(r.c), registry.amount(r.c, ","), registry.date(r.c, False), registry.blank(r.c), registry.repaired(r.c), registry.folded(r.c)), r.c
