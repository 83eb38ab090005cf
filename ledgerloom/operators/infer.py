"""Votes over a whole table: separators, day order, column kinds; unique headers; profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GENERIC, Profile
from ..functions import scalars as S

KEYS = ["doc_id", "table_id"]
# Words in headers of identifier columns, and of the columns that have a role.
ROLE_HEADERS = {"closing": r"\b(balance|solde|closing|bal)\b", "debit": r"\b(debit|d[ée]bit|withdrawal|withdrawn|paid\s*out|dr)\b", "credit": r"\b(credit|cr[ée]dit|deposit|paid\s*in|cr)\b", "amount": r"\b(amount|montant|value|net)\b"}
ID_HEADER = r"(?iuU)\b(account|acct|iban|swift|bic|ref|reference|cheque|check|voucher|invoice|receipt|id|code|no|num|number)\b"


def read_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with what each says on its own, parsed once: blank, body and negative (an amount's parts), dmy and mdy (a date's readings), and its votes point, comma, day, month. cells: raw and more."""
    raw = F.col("raw")
    found = cells.select("*", S.is_blank_marker(raw).alias("blank"), S.amount_parts(raw).alias("_parts"), S.date_readings(raw).alias("_dates"))
    found = found.select(*cells.columns, "blank", F.col("_parts.body").alias("body"), F.col("_parts.negative").alias("negative"), F.col("_dates.dmy").alias("dmy"), F.col("_dates.mdy").alias("mdy"))
    dated = F.col("dmy").isNotNull() | F.col("mdy").isNotNull()
    votes = F.when(~dated & F.col("body").isNotNull(), S.let(F.col("body"), S.body_votes))  # cells that are dates are no evidence
    day, month = S.dayfirst_votes(raw)
    found = found.select("*", votes.alias("_votes"), F.when(dated, day).otherwise(0).alias("day"), F.when(dated, month).otherwise(0).alias("month"))
    return found.select("*", F.coalesce("_votes.point", F.lit(0.0)).alias("point"), F.coalesce("_votes.comma", F.lit(0.0)).alias("comma")).drop("_votes")


def _separator(point: Column, comma: Column) -> Column:
    best = F.greatest(point, comma)
    clear = (best >= 1.0) & (best >= 1.5 * F.least(point, comma))
    return F.when(clear, F.when(point >= comma, ".").otherwise(","))


def decimal_separator(cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``.`` or ``,`` per table, null without evidence or with mixed evidence. Cells that are dates are no evidence. cells: keys, raw."""
    undated = S.let(S.date_readings(F.col("raw")), lambda r: F.coalesce(r["dmy"], r["mdy"])).isNull()
    point, comma = S.decimal_votes(F.when(undated, F.col("raw")))
    sums = cells.select(*keys, point.alias("p"), comma.alias("c")).groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    return sums.select(*keys, _separator(F.col("p"), F.col("c")).alias("decimal"))


def dayfirst(cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """True or false per table by how many cells prove it, null on a tie. cells: keys, raw."""
    day, month = S.dayfirst_votes(F.col("raw"))
    sums = cells.select(*keys, day.alias("d"), month.alias("m")).groupBy(*keys).agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    return sums.select(*keys, F.when(F.col("d") != F.col("m"), F.col("d") > F.col("m")).alias("dayfirst"))


def locale(read: DataFrame, profile: Profile = GENERIC, keys: list[str] = KEYS) -> DataFrame:
    """decimal and dayfirst per table, in one pass over ``read_cells``; what the profile declares wins."""
    sums = read.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("point", "comma", "day", "month")])
    decimal = F.lit(profile.decimal_separator) if profile.decimal_separator else _separator(F.col("point"), F.col("comma"))
    first = F.lit(profile.dayfirst) if profile.dayfirst is not None else F.when(F.col("day") != F.col("month"), F.col("day") > F.col("month"))
    return sums.select(*keys, decimal.alias("decimal"), first.alias("dayfirst"))


def values(read: DataFrame) -> DataFrame:
    """``read_cells`` with decimal and dayfirst beside them, as value (amount under the table's separator) and date (under its day order)."""
    return read.withColumns({"value": S.parts_value(F.col("body"), F.col("negative"), F.col("decimal")), "date": F.when(F.coalesce("dayfirst", F.lit(True)), F.col("dmy")).otherwise(F.col("mdy"))})


def clean_headers(headers: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, col_no, name: white space collapsed, blanks named by place, repeated names numbered until all differ. headers: keys, col_no, raw."""
    named = headers.withColumn("base", F.when(S.collapse(F.col("raw")) == "", F.concat(F.lit("column_"), (F.col("col_no") + 1).cast("string"))).otherwise(S.collapse(F.col("raw"))))
    w = Window.partitionBy(*keys, F.lower("base")).orderBy("col_no")
    numbered = named.withColumn("k", F.row_number().over(w))
    numbered = numbered.withColumn("name", F.when(F.col("k") > 1, F.concat("base", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("base")))
    # a numbered name may be another column's own: the later one is numbered by its place as well
    again = Window.partitionBy(*keys, F.lower("name")).orderBy("col_no")
    numbered = numbered.withColumn("k2", F.row_number().over(again))
    return numbered.select(*keys, "col_no", F.when(F.col("k2") > 1, F.concat("name", F.lit(" ["), (F.col("col_no") + 1).cast("string"), F.lit("]"))).otherwise(F.col("name")).alias("name"))


def header_matches(patterns: tuple[str, ...], name: Column) -> Column:
    """Does any pattern occur in a header? An invalid regular expression is taken as plain text."""
    out = F.lit(False)
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            p = re.escape(p)
        out = out | name.rlike(f"(?iuU){p}")
    return out


def column_kinds(cells: DataFrame, columns: DataFrame, votes: DataFrame, profile: Profile = GENERIC, threshold: float = 0.70, keys: list[str] = KEYS) -> DataFrame:
    """keys, col_no, name, kind (text, amount, date), reason, decimal and dayfirst. cells: read_cells; columns: keys, col_no, name; votes: keys, decimal, dayfirst."""
    filled = values(cells.filter("not blank").join(votes, keys))
    text = F.trim("raw")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    counts = filled.groupBy(*keys, "col_no").agg(
        F.count("*").alias("n"), share(text.rlike(r"^0\d+$")).alias("zero"), share(text.rlike(r"^\d{5,}$")).alias("long"),
        share(F.col("date").isNotNull()).alias("dates"), share(F.col("value").isNotNull()).alias("amounts"),
    )
    all_ = columns.join(votes, keys, "left").join(counts, [*keys, "col_no"], "left")
    name = F.col("name")
    identifier = header_matches(profile.identifier_columns, name) | (F.col("zero") >= 0.3) | ((F.col("long") >= 0.8) & name.rlike(ID_HEADER)) | (F.col("long") >= 0.95)
    choice = (
        F.when(header_matches(profile.date_columns, name), F.array(F.lit("date"), F.lit("declared by the profile")))
        .when(header_matches(profile.amount_columns, name), F.array(F.lit("amount"), F.lit("declared by the profile")))
        .when(F.col("n").isNull(), F.array(F.lit("text"), F.lit("column is empty")))
        .when(identifier, F.array(F.lit("text"), F.lit("identifier")))
        .when(F.col("dates") >= threshold, F.array(F.lit("date"), F.lit("values parse as dates")))
        .when(F.col("amounts") >= threshold, F.array(F.lit("amount"), F.lit("values parse as amounts")))
        .otherwise(F.array(F.lit("text"), F.lit("neither numeric nor dated")))
    )
    return all_.select(*keys, "col_no", "name", choice[0].alias("kind"), choice[1].alias("reason"), "decimal", "dayfirst")


def select_profile(samples: DataFrame, profiles: list[Profile], requested: str | None = None) -> DataFrame:
    """doc_id and profile: of the profiles whose keywords all occur in the sample text, the one with most; ties by order; ``generic`` else. A requested name wins if it exists."""
    if requested is not None:
        known = requested in [p.name for p in profiles]
        return samples.select("doc_id", F.lit(requested if known else GENERIC.name).alias("profile"))
    low, out = F.lower("text"), F.lit(GENERIC.name)
    ranked = sorted((p for p in profiles if p.match_keywords), key=lambda p: -len(p.match_keywords))  # stable: first one on ties
    for p in reversed(ranked):
        all_ = F.lit(True)
        for k in p.match_keywords:
            all_ = all_ & low.contains(k.lower())
        out = F.when(all_, p.name).otherwise(out)
    return samples.select("doc_id", F.coalesce(out, F.lit(GENERIC.name)).alias("profile"))


def resolve_roles(columns: DataFrame, profile: Profile = GENERIC, keys: list[str] = KEYS) -> DataFrame:
    """One row per table: col_no of closing, debit, credit and amount_col (null if none). A declared name wins; else the first amount column that matches."""
    agg = []
    for role, pattern in ROLE_HEADERS.items():
        declared = profile.balance_columns.get(role)
        guess = F.min(F.when((F.col("kind") == "amount") & F.col("name").rlike(f"(?iuU){pattern}"), F.col("col_no")))
        own = F.min(F.when(F.lower("name") == (declared or "").lower(), F.col("col_no"))) if declared else F.lit(None).cast("int")
        agg.append(F.coalesce(own, guess).alias("amount_col" if role == "amount" else role))
    out = columns.groupBy(*keys).agg(*agg)
    for role in ("credit", "debit"):
        out = out.withColumn(role, F.when(F.col(role) == F.col("closing"), None).otherwise(F.col(role)))
    return out
