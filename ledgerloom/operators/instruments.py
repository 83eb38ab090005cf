"""Instrument rows from facts: issuers, the fixed 36-column row, checks, and idempotent allocation of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scalars as S

# Issuers as (token, sheet name, issuer code, BIC), the output columns, and literal strings of the contract.
ISSUERS = [
    ("AIL", "BTK LEASING EMETTEUR CD", "AILETN00003", "AILETN00020"),
    ("ATT", "ATTIJARI LEASING CD", "ATTLTN00003", "ATTLTN00020"),
    ("BHL", "BH LEASING SA EMETTEUR CD", "BHLSTN00004", "BHLSTN00020"),
    ("CIL", "COMPAGNIE INTERNATIONALE DE LEASING EMETTEUR CD", "CILTTN00003", "CILTTN00020"),
    ("HNL", "HANNIBAL LEASE SA EMETTEUR CD", "HNLETN00003", "HNLETN00020"),
    ("UNF", "UNION DE FACTORING EMETTEUR CD", "UNFATN00003", "UNFATN00020"),
    ("TLF", "TUNISIE LEASING ET FACTORING EMETTEUR CD", "TLFTTN00003", "TLFTTN00020"),
    ("ATL", "ARAB TUNISIAN LEASE EMETTEUR CD", "ATLETN00003", "ATLETN00020"),
]
MAIN_COLUMNS = """
ISIN name issuer rate totalnumberOfCertificates totalAmountToBePaid auctionDate type issueDate startDate maturityDate issuanceProgramme instrument guarantor
entitlementDate auctionType BIC code nominalValueAllotted numberOfCertificates amountToBePaid client
""".split()
CLIENT_COLUMNS = """
clientId clientType firstName lastName registrationDate economicSector residentStatus nationality defaultAssetCategory natureOfIdentification nationalId fiscalId gender investorType
""".split()
DISCOUNT, COUPON = ("Discount", "certificat de depot inf 1an TF"), ("Coupon", "certificat de deport sup 1an TF")
DISCOUNT_DAYS = 365


def issuer_of(title: Column) -> tuple[Column, Column]:
    """(token, error): the token behind the word DECLARATION, of four letters or three; else the only one that occurs anywhere."""
    plain = F.regexp_replace(F.upper(F.coalesce(title, F.lit(""))), "[^A-Z0-9]+", "")
    after = F.regexp_extract(plain, "DECLARATION([A-Z]+)", 1)
    tokens = [i[0] for i in ISSUERS]
    present = F.array_compact(F.array(*[F.when(plain.contains(t), F.lit(t)) for t in tokens]))
    token = F.when(F.substring(after, 1, 4).isin(tokens), F.substring(after, 1, 4)).when(F.substring(after, 1, 3).isin(tokens), F.substring(after, 1, 3)).when(F.size(present) == 1, present[0])
    error = F.when(token.isNull(), F.when(F.size(present) > 1, F.concat(F.lit("several issuers: "), F.array_join(F.array_sort(present), ", "))).otherwise(F.lit("no known issuer")))
    return token, error


def issuer_field(token: Column, field: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for i in ISSUERS for x in (i[0], i[field])]), token)


def name_of(token: Column, taux: Column, until: Column) -> Column:
    return F.concat_ws(" ", token, S.format_taux(taux), F.date_format(until, "ddMMyyyy"))


def is_discount(since: Column, until: Column) -> Column:
    return F.datediff(until, since) <= DISCOUNT_DAYS


def allocation_key(token: Column, taux: Column, since: Column, until: Column) -> Column:
    """One instrument, however many subscribers: token, rate, both dates."""
    text = F.concat_ws("|", token, F.format_string("%.4f", taux), F.date_format(since, "yyyy-MM-dd"), F.date_format(until, "yyyy-MM-dd"))
    return F.concat(token, F.lit("-"), F.substring(F.sha2(text, 256), 1, 16))


def with_keys(facts: DataFrame) -> DataFrame:
    """``facts`` with issuer_token, issuer_error and key (null without issuer)."""
    token, error = issuer_of(F.col("title"))
    out = facts.withColumns({"issuer_token": token, "issuer_error": error})
    return out.withColumn("key", F.when(F.col("issuer_token").isNotNull(), allocation_key(F.col("issuer_token"), F.col("taux"), F.col("date_souscription"), F.col("date_remboursement"))))


def group_key(facts: DataFrame) -> DataFrame:
    """``facts`` (with_keys) with group_no, the same for all rows of one instrument: issuer, rate to four places and both dates; null without an issuer."""
    group = F.struct("issuer_token", F.round("taux", 4).alias("taux"), "date_souscription", "date_remboursement")
    return facts.withColumn("group_no", F.when(F.col("issuer_token").isNotNull(), F.xxhash64(group)))


def to_rows(facts: DataFrame, client_columns: tuple[str, ...] = tuple(CLIENT_COLUMNS), config: EngineConfig = EngineConfig()) -> DataFrame:
    """The 36 columns of each fact with an issuer: 22 that are known and the subscriber's 14, empty; dates come from the subscription, so that a rerun gives the same row. facts: with_keys plus isin."""
    french = lambda c: F.date_format(c, "dd/MM/yyyy")
    since, until = F.col("date_souscription"), F.col("date_remboursement")
    kind = F.when(is_discount(since, until), DISCOUNT[0]).otherwise(COUPON[0])
    instrument = F.when(is_discount(since, until), DISCOUNT[1]).otherwise(COUPON[1])
    q = F.col("quantite").cast("long")
    values = {
        "ISIN": F.coalesce("isin", F.lit("")), "name": name_of(F.col("issuer_token"), F.col("taux"), until), "issuer": issuer_field(F.col("issuer_token"), 2), "rate": S.format_rate(F.col("taux")),
        "totalnumberOfCertificates": q, "totalAmountToBePaid": F.lit(0).cast("long"), "auctionDate": french(since), "type": kind, "issueDate": french(since), "startDate": french(since),
        "maturityDate": french(until), "issuanceProgramme": F.lit(""), "instrument": instrument, "guarantor": F.lit(""), "entitlementDate": french(since), "auctionType": F.lit("Standard"),
        "BIC": issuer_field(F.col("issuer_token"), 3), "code": F.lit(""), "nominalValueAllotted": config.nominal_per_certificate * q, "numberOfCertificates": q,
        "amountToBePaid": F.lit(0).cast("long"), "client": F.lit("NO"),
    }
    return facts.filter("issuer_token is not null").select("doc_id", *[values[c].alias(c) for c in MAIN_COLUMNS], *[F.lit("").alias(c) for c in client_columns])


def reconcile(facts: DataFrame) -> DataFrame:
    """Checks of each fact against the document's own figures: doc_id, id, passed. The product is checked only where price and amount were read."""
    product = F.when(F.col("prix_unitaire").isNotNull() & F.col("montant").isNotNull(), F.struct(F.lit("montant").alias("id"), (F.abs(F.col("prix_unitaire") * F.col("quantite") - F.col("montant")) <= 0.001).alias("passed")))
    check = lambda id_, ok: F.struct(F.lit(id_).alias("id"), ok.alias("passed"))
    rows = F.array_compact(F.array(product, check("date_order", F.col("date_remboursement") > F.col("date_souscription")), check("taux_range", (F.col("taux") > 0) & (F.col("taux") < 100)), check("quantite_positive", F.col("quantite") > 0)))
    return facts.select("doc_id", F.inline(rows))


def _sheet(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def sheets_of(issuers: DataFrame, pool: DataFrame) -> DataFrame:
    """``issuers`` (token, name) with sheet: the pool's sheet of the same name, else one of which either is a prefix of the other."""
    sheets = pool.select("sheet").distinct().withColumn("_s", _sheet(F.col("sheet")))
    named = issuers.withColumn("_n", _sheet(F.col("name")))
    exact = named.join(sheets, named._n == sheets._s).select("token", "name", "sheet")
    rest = named.join(exact.select("token"), "token", "left_anti")
    prefix = rest.join(sheets, F.expr("startswith(_n, _s) or startswith(_s, _n)"))  # a dimension of eight rows
    best = prefix.withColumn("_r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc(F.length("_s")), "sheet"))).filter("_r = 1")
    return exact.unionByName(best.select("token", "name", "sheet"))


def allocate(requests: DataFrame, pool: DataFrame, ledger: DataFrame) -> DataFrame:
    """key, sheet, isin, is_new, exhausted of each requested key: idempotent by key, else the sheet's first code that no issuer has used.

    requests: key, sheet, seq (order of arrival); pool: sheet, position, code; ledger: key, isin. A code that is on several
    sheets belongs to the one that comes first by name, so that no two sheets hand it out.
    """
    keys = requests.groupBy("key").agg(F.min("seq").alias("seq"), F.min_by("sheet", "seq").alias("sheet"))
    known = keys.join(ledger.select("key", "isin"), "key").select("key", "sheet", "isin", F.lit(False).alias("is_new"))
    new = keys.join(ledger.select("key"), "key", "left_anti").withColumn("rk", F.row_number().over(Window.partitionBy("sheet").orderBy("seq", "key")))
    own = pool.withColumn("_o", F.row_number().over(Window.partitionBy("code").orderBy("sheet", "position"))).filter("_o = 1")
    free = own.join(ledger.select(F.col("isin").alias("code")), "code", "left_anti").withColumn("rk", F.row_number().over(Window.partitionBy("sheet").orderBy("position")))
    given = new.join(free.select("sheet", "rk", F.col("code").alias("isin")), ["sheet", "rk"], "left").select("key", "sheet", "isin", F.lit(True).alias("is_new"))
    return known.unionByName(given).withColumn("exhausted", F.col("isin").isNull())


class PoolExhausted(RuntimeError):
    """A sheet has no free code left."""


def record(allocated: DataFrame, path: str) -> int:
    """Append the new allocations to the ledger at ``path`` (one writer) and return how many; nothing is written if any sheet is exhausted."""
    out = allocated.filter("is_new")
    short = out.filter("exhausted").select("sheet").distinct().limit(5).collect()
    if short:
        raise PoolExhausted(", ".join(str(r.sheet) for r in short))
    n = out.count()
    if n:
        out.select("key", "isin", F.current_timestamp().alias("allocated_at"), F.lit("").alias("note")).write.mode("append").json(path)
    return n
