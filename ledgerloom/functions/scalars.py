"""Scalar functions on cells, as Column expressions: amounts, dates, labels, OCR repair.

Null beats a plausible wrong number: what is not certainly an amount or a date becomes null. Everything stays
inside code generation but for the two folds noted below.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, codes and words that must be known for right results.
SPACES = "      　\t\r\n\x0b\x0c"
MINUSES = "−–—‐‑‒﹣－"
CURRENCY_SYMBOLS = "$€£¥₹₽₩¢₪₦₺₫₴₡₱₲₵₸₼₾﷼¤"
CURRENCY_CODES = """
USD EUR GBP CHF CAD SEK NOK DKK PLN CZK HUF RON TND DT MAD DZD EGP LYD AED SAR QAR KWD BHD OMR JOD LBP ILS TRY JPY CNY AUD NZD SGD HKD
INR PKR BDT IDR MYR THB VND PHP KRW TWD ZAR NGN KES GHS RUB UAH BRL MXN ARS CLP COP PEN UYU
""".split()
BLANK_MARKERS = ["-", "--", "---", "–", "—", ".", "..", "...", "nil", "n/a", "na", "n.a.", "n.a", "none", "null", "void", "néant", "neant", "s/o", "sans objet", "0.00-", "x", "xx"]
DEBIT_WORDS, CREDIT_WORDS = ["DEBIT", "DÉBIT", "DR", "DB"], ["CREDIT", "CRÉDIT", "CR", "CT"]
OCR_DIGITS = {
    "O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "|": "1", "i": "1", "!": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6",
    "T": "7", "?": "7", "B": "8", "g": "9", "q": "9",
}
MONTHS = {
    1: "jan january janv janvier", 2: "feb february fev fév fevr février", 3: "mar march mars", 4: "apr april avr avril", 5: "may mai", 6: "jun june juin",
    7: "jul july juil juillet", 8: "aug august aou août aout", 9: "sep sept september septembre", 10: "oct october octobre", 11: "nov november novembre", 12: "dec december déc decembre décembre",
}

#: Characters that compatibility normalisation makes one ASCII character, and what they become: full-width forms, superscripts, letter-like signs.
_PAIRS = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
_WIDE, _NARROW = ("".join(x) for x in zip(*[(c, n) for c, n in _PAIRS if len(n) == 1 and n.isascii()], strict=True))
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it: expression trees stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compatible(s: Column) -> Column:
    """Compatibility normalisation of all characters that become one ASCII character, and of the ellipsis; ``registry.nfkc`` does the rest."""
    return F.replace(F.translate(s, _WIDE, _NARROW), F.lit("…"), F.lit("..."))


def clean_spaces(s: Column) -> Column:
    """Without any space-like character."""
    return F.translate(s, SPACES, "")


def collapse(s: Column) -> Column:
    """Null as empty, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))


def is_blank_marker(s: Column) -> Column:
    """Null, blank, or a mark that means nothing is here."""
    low = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    return (low == "") | low.isin(BLANK_MARKERS)


def fold(s: Column) -> Column:
    """Accents dropped, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.translate(s, _ACCENTED, _PLAIN)), "[^a-z0-9]+", "")


def label(s: Column) -> Column:
    """Lower case, anything but ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


# ------------------------------------------------------------------ amounts

_CODES = "|".join(sorted(CURRENCY_CODES, key=lambda c: (-len(c), c)))
_SIGNS = "|".join(sorted(DEBIT_WORDS + CREDIT_WORDS, key=lambda c: (-len(c), c)))
_BEFORE = rf"(?:[-+(\[]|(?:{_CODES})\.*(?=[\d(.,-])|(?:{_SIGNS})(?=[\d(.-]))*"
_AFTER = rf"(?:[-)\]]|(?<=[\d).,])\.*(?:{_CODES})|(?<=[\d).,])(?:{_SIGNS}))*"
#: A cell without spaces and currency symbols: notation before, digits and separators, notation behind.
AMOUNT = rf"^({_BEFORE})([\d.,]*?\d[\d.,]*?)({_AFTER})$"


def prepared(s: Column) -> Column:
    """Upper case, without spaces and currency symbols, every dash a minus."""
    return F.upper(F.translate(F.translate(clean_spaces(compatible(s)), MINUSES, "-" * len(MINUSES)), CURRENCY_SYMBOLS + "%", ""))


def _notation(s: Column) -> Column:
    """[notation before, digits and separators, notation behind] of an amount cell; a single string otherwise."""
    return F.split(F.regexp_replace(prepared(s), AMOUNT, "$1\u0001$2\u0001$3"), "\u0001")


def _read(s: Column, value: Callable[[Column, Column, Column], Column]) -> Column:
    """``value`` of the three parts of an amount cell whose brackets match; null for all others."""

    def of(parts: Column) -> Column:
        before, body, after = (F.try_element_at(parts, F.lit(k)) for k in (1, 2, 3))
        opened = F.translate(F.regexp_replace(before, r"[^(\[]", ""), "([", ")]")
        closed = F.reverse(F.regexp_replace(after, r"[^)\]]", ""))
        return F.when(opened == closed, value(before, body, after))

    return F.when(~is_blank_marker(clean_spaces(s)), let(_notation(s), of))


def amount_body(s: Column) -> Column:
    """Digits and separators of a cell that is an amount, in whichever notation; null for all others."""
    return _read(s, lambda before, body, after: body)


def _negative(before: Column, after: Column) -> Column:
    """The sign that notation gives. A debit or credit word sets it, the innermost if there are several; else brackets and minuses do."""
    none = ~F.concat(before, after).rlike(_SIGNS)
    inner_before = F.regexp_extract(before, rf"^(.*?)({_SIGNS})(?:(?!{_SIGNS}).)*$", 2)
    inner_after = F.regexp_extract(after, rf"^(?:(?!{_SIGNS}).)*?({_SIGNS})", 1)
    depth_before = F.length(F.regexp_replace(F.regexp_extract(before, rf"^(.*)(?:{_SIGNS})(?:(?!{_SIGNS}).)*$", 1), r"[^(\[]", ""))
    depth_after = F.length(F.regexp_replace(F.regexp_extract(after, rf"^(?:(?!{_SIGNS}).)*?(?:{_SIGNS})(.*)$", 1), r"[^)\]]", ""))
    word = F.when(inner_before == "", inner_after).when(inner_after == "", inner_before).when(depth_before >= depth_after, inner_before).otherwise(inner_after)
    return F.when(none, F.concat(before, after).rlike(r"[-(\[)\]]")).otherwise(word.isin(DEBIT_WORDS))


def body_value(body: Column, decimal: Column) -> Column:
    """The magnitude of digits and separators. decimal: ``.``, ``,`` or null for the cell's own evidence; null where no convention gives one number."""
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    as_dot, as_comma = F.replace(body, F.lit(","), F.lit("")), F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    commas_group, dots_group = body.rlike(r"^\d{1,3}(,\d{3})+$"), body.rlike(r"^\d{1,3}(\.\d{3}){2,}$")
    own = (
        F.when(body.contains(".") & body.contains(","), F.when(body.rlike(r",[^.]*$"), as_comma).otherwise(as_dot))
        .when(body.contains(","), F.when(commas_group, as_dot).when(count(",") == 1, as_comma))
        .when(count(".") > 1, F.when(dots_group, F.replace(body, F.lit("."), F.lit(""))))
        .otherwise(body)
    )
    whole = lambda x: F.length(F.regexp_replace(F.substring_index(x, ".", 1), "^0+", ""))
    plain = F.when(decimal == ".", as_dot).when(decimal == ",", as_comma).otherwise(own)
    return let(plain, lambda x: F.when(x.rlike(r"^(\d+\.?\d*|\.\d+)$") & (whole(x) <= 15), x.try_cast("double")))


def amount_parts(s: Column) -> Column:
    """A cell that is an amount as (body: digits and separators, negative); null for all others. What needs no separator is done here, once."""
    sign = lambda before, after: F.when((before == "") & (after == ""), False).otherwise(_negative(before, after))
    return _read(s, lambda before, body, after: F.struct(body.alias("body"), sign(before, after).alias("negative")))


def parts_value(body: Column, negative: Column, decimal: Column) -> Column:
    """The signed amount of ``amount_parts`` under a separator (null: the cell's own evidence)."""
    return let(body_value(body, decimal), lambda v: F.when(negative, -v).otherwise(v))


def parse_amount(s: Column, decimal: Column | None = None) -> Column:
    """A cell as a signed double, or null: brackets, signs, debit and credit words, currencies, any separators."""
    separator = decimal if decimal is not None else F.lit(None).cast("string")
    return let(amount_parts(s), lambda x: parts_value(x["body"], x["negative"], separator))


def looks_numeric(s: Column) -> Column:
    """Digits, no letters beside its notation, and digits for three tenths of its characters."""
    clean = clean_spaces(F.coalesce(s, F.lit("")))
    core = F.regexp_replace(F.regexp_replace(prepared(s), rf"^{_BEFORE}", ""), rf"{_AFTER}$", "")
    digits = F.length(F.regexp_replace(clean, r"\D", ""))
    return F.coalesce(~is_blank_marker(clean) & (digits > 0) & ~core.rlike(r"(?U)\p{L}") & (digits >= 0.3 * F.length(clean)), F.lit(False))


def decimal_votes(s: Column) -> tuple[Column, Column]:
    """(weight for the point, weight for the comma) as the decimal separator, of one cell."""
    both = let(amount_body(s), body_votes)
    return F.coalesce(both["point"], F.lit(0.0)), F.coalesce(both["comma"], F.lit(0.0))


def body_votes(body: Column) -> Column:
    """(point, comma): the weights of an amount's digits and separators; null where they say nothing."""
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    dots, commas = count("."), count(",")
    last_comma, after_comma, after_dot = body.rlike(r",[^.]*$"), F.length(F.substring_index(body, ",", -1)), F.length(F.substring_index(body, ".", -1))
    point = F.when((dots > 0) & (commas > 0), F.when(last_comma, 0.0).otherwise(3.0)).when(commas > 1, 2.0).when(dots > 1, 0.0).when((commas == 1) & (after_comma == 3), 0.25).when((dots == 1) & (after_dot == 2), 1.0)
    comma = F.when((dots > 0) & (commas > 0), F.when(last_comma, 3.0).otherwise(0.0)).when(commas > 1, 0.0).when(dots > 1, 2.0).when((dots == 1) & (after_dot == 3), 0.25).when((commas == 1) & (after_comma == 2), 1.0)
    return F.struct(point.alias("point"), comma.alias("comma"))


# ------------------------------------------------------------------ OCR repair


def repair_ocr_digits(s: Column) -> Column:
    """Letters that OCR takes for digits, as digits, where a digit lies within two places; from left to right, so that a repaired one counts. A fold over places."""
    letters, digits = "".join(OCR_DIGITS), "".join(OCR_DIGITS.values())
    step = lambda acc, i: F.when(
        F.instr(F.lit(letters), F.substring(acc, i, F.lit(1))).cast("int") > 0,
        F.when(
            F.concat(F.substring(acc, F.greatest(i - 2, F.lit(1)), F.least(i - 1, F.lit(2))), F.substring(acc, i + 1, F.lit(2))).rlike(r"\d"),
            F.concat(F.substring(acc, F.lit(1), i - 1), F.translate(F.substring(acc, i, F.lit(1)), letters, digits), F.substring(acc, i + 1, F.length(acc))),
        ).otherwise(acc),
    ).otherwise(acc)
    fixable = F.translate(s, letters, "") != s
    return F.when(fixable & s.rlike(r"\d"), F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), s, step)).otherwise(s)


# ------------------------------------------------------------------ dates

_MONTH_PAIRS = [(name, n) for n, names in MONTHS.items() for name in names.split()]


def month_number(s: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _MONTH_PAIRS for x in pair])
    return F.try_element_at(table, F.regexp_replace(F.lower(s), r"\.+$", ""))


def full_year(y: Column) -> Column:
    return F.when(y >= 100, y).when(y >= 70, y + 1900).otherwise(y + 2000)


def make_date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null if there is none."""
    return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")


def date_parts(s: Column) -> Column:
    """What separators part, without empty parts."""
    return F.array_remove(F.split(F.trim(compatible(s)), r"[/\-.\s]+"), "")


#: What a cell must look like for its parts to be tried as a date: three short parts, two digits apart.
_DATED = r"(?s)^[/\-.\s]*(?:\d{1,6}|[^\d/\-.\s]{3,10})(?:[/\-.\s]+(?:\d{1,6}|[^\d/\-.\s]{3,10})){2}(?:[/\-.\s].*)?$"


def date_readings(s: Column) -> Column:
    """A cell as (dmy, mdy): its date if an ambiguous one has the day first, and if it has the month first; null where it is no date.

    ISO first; month names in English and French; numbers that prove an order beat either reading. With a named month in
    second place the last part is the year, also one of two digits.
    """

    def numbered(x: Column) -> Column:
        a, b, c = x["a"], x["b"], x["c"]
        day, month = F.struct(c.alias("y"), b.alias("m"), a.alias("d")), F.struct(c.alias("y"), a.alias("m"), b.alias("d"))
        # a month's name: of the two numbers beside it, one is the year
        one, two = F.when(x["at"] == 1, b).otherwise(a), F.when(x["at"] == 3, b).otherwise(c)
        last = (two > 31) | ((x["at"] == 2) & (one <= 31))
        named = F.struct(F.when(last, two).otherwise(one).alias("y"), x["month"].alias("m"), F.when(last, one).otherwise(two).alias("d"))
        proven = F.when(x["month"].isNotNull(), named).when(a > 31, F.struct(a.alias("y"), b.alias("m"), c.alias("d"))).when((a > 12) & (b <= 12), day).when((b > 12) & (a <= 12), month)
        date = lambda v: make_date(full_year(v["y"]), v["m"], v["d"])
        both = lambda d: F.struct(d.alias("dmy"), d.alias("mdy"))
        return let(proven, lambda p: F.when(p.isNotNull(), let(date(p), both)).otherwise(F.struct(date(day).alias("dmy"), date(month).alias("mdy"))))

    def of(parts: Column) -> Column:
        at = lambda k: F.try_element_at(parts, F.lit(k))
        number = lambda k: F.when(at(k).rlike(r"^\d{1,6}$"), at(k).try_cast("int"))
        months = F.transform(F.slice(parts, 1, 3), month_number)
        where = F.array_position(F.transform(months, lambda m: m.isNotNull()), True)
        return let(F.struct(number(1).alias("a"), number(2).alias("b"), number(3).alias("c"), where.alias("at"), F.try_element_at(months, F.greatest(where, F.lit(1)).cast("int")).alias("month")), numbered)

    def read(text: Column) -> Column:
        iso = text.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$")
        # an ISO date is its three parts in order
        in_order = let(date_parts(text), lambda p: make_date(*[F.try_element_at(p, F.lit(k)).try_cast("int") for k in (1, 2, 3)]))
        return F.when(text.rlike(_DATED), F.when(iso, let(in_order, lambda d: F.struct(d.alias("dmy"), d.alias("mdy")))).otherwise(let(date_parts(text), of)))

    return let(F.trim(compatible(s)), read)


def parse_date(s: Column, dayfirst: Column | None = None) -> Column:
    """A cell as a date, or null, as ``date_readings`` says; ``dayfirst`` decides ambiguous ones (null: day first)."""
    default = F.coalesce(dayfirst if dayfirst is not None else F.lit(None).cast("boolean"), F.lit(True))
    return let(date_readings(s), lambda r: F.when(default, r["dmy"]).otherwise(r["mdy"]))


def dayfirst_votes(s: Column) -> tuple[Column, Column]:
    """(proves day first, proves month first) as 0 or 1, of one cell; ISO dates prove nothing."""

    def of(parts: Column) -> Column:
        a, b = (F.when(F.try_element_at(parts, F.lit(k)).rlike(r"^\d{1,6}$"), F.try_element_at(parts, F.lit(k)).try_cast("int")) for k in (1, 2))
        able = F.size(parts) >= 3
        return F.struct((able & (a > 12) & (b <= 12)).alias("day"), (able & (b > 12) & (a <= 12)).alias("month"))

    both = F.when(~F.trim(s).rlike(r"^\d{4}[-/.]"), let(date_parts(s), of))
    return F.coalesce(both["day"].cast("int"), F.lit(0)), F.coalesce(both["month"].cast("int"), F.lit(0))


# ------------------------------------------------------------------ comparison, geometry, phrases, formats


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equal within a rounding tolerance that widens a little for large sums."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance) + F.abs(b) * 1e-9)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of the narrower interval that two intervals have in common."""
    narrow = F.least(a1 - a0, b1 - b0)
    return F.when(narrow > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / narrow).otherwise(0.0)


def counted(n: Column, noun: str, plural: str | None = None) -> Column:
    """``1,234 rows``."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, noun).otherwise(plural or f"{noun}s"))


def listed(names: Column, most: int = 5) -> Column:
    """``a, b and 3 more``."""
    n = F.size(names)
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(n > most, F.concat(F.lit(" and "), (n - most).cast("string"), F.lit(" more"))).otherwise(""))


def first_percent(s: Column) -> Column:
    """The first percentage, dates taken out before."""
    bare = F.regexp_replace(s, r"\d{1,2}/\d{1,2}/\d{4}", " ")
    return F.replace(F.regexp_extract(bare, r"(?<!\d)(\d{1,2}(?:[.,]\d{1,4})?)\s*%", 1), F.lit(","), F.lit(".")).try_cast("double")


def first_date(s: Column) -> Column:
    d = lambda k: F.regexp_extract(s, r"(\d{1,2})/(\d{1,2})/(\d{4})", k).try_cast("int")
    return make_date(d(3), d(2), d(1))


def first_int(s: Column) -> Column:
    return F.regexp_extract(clean_spaces(s), r"(\d+)", 1).try_cast("int")


def format_rate(rate: Column) -> Column:
    """At most four decimals, a comma, no zeros at the end."""
    return F.replace(F.regexp_replace(F.format_string("%.4f", rate), r"\.?0+$", ""), F.lit("."), F.lit(","))


def format_taux(rate: Column) -> Column:
    return F.concat(F.replace(F.format_string("%.2f", rate), F.lit("."), F.lit(",")), F.lit("%"))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


