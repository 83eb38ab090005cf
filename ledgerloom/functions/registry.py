"""The scalar functions by name: as expressions for DataFrames, and as vectorised functions for SQL text.

In a plan the expressions of ``scalars`` are the way: they stay in the JVM. SQL text cannot name an expression that
holds lambdas, so ``register`` offers the same rules over Arrow batches; tests hold the two against each other.
"""

from __future__ import annotations

import datetime
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scalars as S

FUNCTIONS = {"parse_amount": S.parse_amount, "parse_cell_date": S.parse_date, "is_blank_marker": S.is_blank_marker, "repair_ocr_digits": S.repair_ocr_digits, "fold_text": S.fold}


def with_function(df: DataFrame, name: str, column: str, out: str) -> DataFrame:
    """``df`` with a registered function of a column: the expression itself, inside the plan."""
    return df.withColumn(out, FUNCTIONS[name](F.col(column)))


def nfkc(s: str | None) -> str | None:
    """Full compatibility normalisation, which Spark has no built-in for."""
    return s if s is None or s.isascii() else unicodedata.normalize("NFKC", s)


def blank(s: str | None) -> bool:
    return s is None or s.strip(" ").lower() in {"", *S.BLANK_MARKERS}


_SQUEEZE = str.maketrans("", "", S.SPACES + S.CURRENCY_SYMBOLS + "%") | {ord(c): "-" for c in S.MINUSES}
_AMOUNT, _SIGN = re.compile(S.AMOUNT, re.A), re.compile(S._SIGNS)


def amount(s: str | None, decimal: str | None = None) -> float | None:
    """``scalars.parse_amount`` of one cell."""
    if s is None or blank(nfkc(s).translate(str.maketrans("", "", S.SPACES))):
        return None
    m = _AMOUNT.match(nfkc(s).translate(_SQUEEZE).upper())
    if not m:
        return None
    before, body, after = m.groups()
    if re.sub(r"[^(\[]", "", before) != re.sub(r"[^)\]]", "", after)[::-1].translate(str.maketrans(")]", "([")):
        return None
    dots, commas = body.count("."), body.count(",")
    if decimal is None and dots and commas:
        decimal = "," if body.rfind(",") > body.rfind(".") else "."
    elif decimal is None and commas:
        decimal = "." if re.fullmatch(r"\d{1,3}(,\d{3})+", body, re.A) else "," if commas == 1 else ""
    elif decimal is None and dots > 1:
        decimal = "," if re.fullmatch(r"\d{1,3}(\.\d{3}){2,}", body, re.A) else ""
    if decimal == "":
        return None
    plain = body.replace(".", "").replace(",", ".") if decimal == "," else body.replace(",", "")
    if not re.fullmatch(r"\d+\.?\d*|\.\d+", plain, re.A) or len(plain.split(".")[0].lstrip("0")) > 15:
        return None
    left, right = list(_SIGN.finditer(before)), _SIGN.search(after)
    if not left and not right:
        negative = bool(re.search(r"[-(\[)\]]", before + after))
    else:  # the innermost word decides: the one that fewer brackets part from the digits' own side
        outer = (len(re.findall(r"[(\[]", before[: left[-1].start()])) if left else -1, len(re.findall(r"[)\]]", after[right.end() :])) if right else -1)
        negative = (left[-1] if left and outer[0] >= outer[1] else right)[0] in S.DEBIT_WORDS
    return -float(plain) if negative else float(plain)


_MONTH = {name: n for name, n in S._MONTH_PAIRS}


def date(s: str | None, dayfirst: bool | None = None) -> datetime.date | None:
    """``scalars.parse_date`` of one cell."""
    text = nfkc(s).strip(" ") if s is not None else ""
    parts = [p for p in re.split(r"[/\-.\s]+", text, flags=re.A) if p]
    if len(parts) < 3:
        return None
    numbers = [int(p) if re.fullmatch(r"\d{1,6}", p, re.A) else None for p in parts[:3]]
    months = [i for i, p in enumerate(parts[:3]) if p.lower() in _MONTH]
    iso = re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", text, re.A)
    rest = [numbers[i] for i in range(3) if not months or i != months[0]]
    if None in rest:
        return None
    if iso:
        y, m, d = numbers
    elif months:
        m, (one, two) = _MONTH[parts[months[0]].lower()], rest
        y, d = (two, one) if two > 31 or (months[0] == 1 and one <= 31) else (one, two)
    else:
        a, b, c = rest
        if a > 31:
            y, m, d = a, b, c
        else:
            first = b <= 12 if a > 12 else False if b > 12 else dayfirst is not False
            y, m, d = (c, b, a) if first else (c, a, b)
    if not iso:
        y = y if y >= 100 else y + 1900 if y >= 70 else y + 2000
    try:
        return datetime.date(y, m, d)
    except ValueError:
        return None


def repaired(s: str | None) -> str | None:
    """``scalars.repair_ocr_digits`` of one cell."""
    if s is None:
        return None
    out = list(s)
    for i, c in enumerate(out):
        if c in S.OCR_DIGITS and any(x in "0123456789" for x in out[max(0, i - 2) : i] + out[i + 1 : i + 3]):
            out[i] = S.OCR_DIGITS[c]
    return "".join(out)


def folded(s: str | None) -> str | None:
    return None if s is None else re.sub("[^a-z0-9]+", "", s.translate(str.maketrans(S._ACCENTED, S._PLAIN)).lower())


def register(spark: SparkSession) -> None:
    """nfkc, parse_amount(cell[, separator]), parse_cell_date(cell[, day_first]), is_blank_marker, repair_ocr_digits and fold_text for SQL text."""
    optional = lambda x: None if pd.isna(x) else x

    def one(f, form):
        @F.pandas_udf(form)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: f(optional(x))).astype(object)

        return run

    def two(f, form):
        @F.pandas_udf(form)
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([f(*map(optional, x)) for x in zip(*columns, strict=True)], dtype=object)

        return run

    for name, made in {"nfkc": one(nfkc, "string"), "parse_amount": two(amount, "double"), "parse_cell_date": two(date, "date"), "is_blank_marker": one(blank, "boolean"), "repair_ocr_digits": one(repaired, "string"), "fold_text": one(folded, "string")}.items():
        spark.udf.register(name, made)
