"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of letters (case folded; anything else is one blank) are hashed into ``DIMS`` features. Term frequencies
are shares of a text's n-grams, inverse document frequencies come from the training sample. Training is
follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty, which leaves most weights at exactly 0;
a temperature is then calibrated on a part of the sample that training has not seen.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, per_row, received, ship, steps, trim, with_columns

DIMS = 1 << 15
ORDERS = (2, 3)
#: The training sample, a bound on the fit alone: rows in all, of any language at least and at most, and different features of rows in all. Every language that has a row has its share, whatever their number.
SAMPLE_ROWS, LEAST_ROWS, MOST_ROWS, SAMPLE_FEATURES = 4000, 50, 1000, 1 << 22
#: Languages up to which their cuts are broadcast.
BROADCAST_LANGUAGES = 10_000
#: Scale of the features: shares of single n-grams are small.
SCALE = 64.0
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(0x3400):  # scripts with case and other alphabets
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    rest = np.arange(0x3400, sys.maxunicode + 1, dtype=np.uint32)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x3400, 0x32000)), bool)
    out[0x3400:0x32000][letters] = rest[: len(letters)][letters]
    for c in (*range(0xA640, 0xABC0), *range(0xFF21, 0xFF5B), *range(0x10400, 0x10600), *range(0x1E900, 0x1E944)):
        low = chr(c).lower()
        if chr(c).isalpha() and len(low) == 1:
            out[c] = ord(low)
    return out


def n_grams(text: pa.Array, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(a feature for each place and order, -1 for none; offsets of the texts' places; has a letter)."""
    texts = [x or "" for x in text.to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    c = table[points].astype(np.uint64)
    letters = per_row((c > 0).astype(np.int64), offsets) > 0
    out = []
    for order in ORDERS:
        m = max(0, len(c) - order + 1)
        h, some = np.zeros(m, np.uint64), np.zeros(m, bool)
        for i in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : m + i] + np.uint64(order)
            some |= c[i : m + i] > 0
        h ^= h >> np.uint64(29)
        f = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)).astype(np.int32)
        full = np.full(len(c), -1, np.int32)
        full[:m] = np.where(some, f, -1)
        for i in range(1, order):  # across the end of a text
            ends = offsets[1:] - i
            full[ends[(ends >= offsets[:-1]) & (ends >= 0) & (ends < len(c))]] = -1
        out.append(full)
    return out, offsets, letters


def features(docs: DataFrame) -> DataFrame:
    """lang, the features of the whole text and their counts (16 and 32 bits each); texts without letters are left out."""

    def run(batches: Iterator[pa.RecordBatch]):
        table = letter_table()
        for batch in steps(batches, "text"):
            grams, offsets, letters = n_grams(batch.column("text"), table)
            keys, counts = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = np.concatenate([g[a:b] for g in grams])
                k, n = np.unique(own[own >= 0], return_counts=True)
                keys.append(k.astype("<u2").tobytes())
                counts.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "lang": batch.column("lang"), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())}).filter(pa.array(letters))

    return docs.select("h", "lang", "text").mapInArrow(run, "h long, lang string, keys binary, counts binary")


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float

    def table(self) -> np.ndarray:
        return (self.weights * (self.idf * SCALE)[:, None]).astype(np.float32)

    def score(self, grams: list[np.ndarray], offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Calibrated probabilities: a text's logits are its n-grams' mean weights."""
        total, n = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for g in grams:
            has = g >= 0
            f, row = g[has], own[has]
            n += np.bincount(row, minlength=len(n))
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, table[:, k][f], minlength=len(n))
        return softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> Model:
    """FTRL-proximal over (language, features, counts); every fifth row is kept for the temperature."""
    languages = sorted({x[0] for x in rows})
    n_lang = len(languages)
    held = np.arange(len(rows)) % 5 == 4
    df = np.zeros(DIMS)
    for x, out in zip(rows, held, strict=True):
        if not out:
            df[x[1]] += 1
    idf = np.log((1 + (~held).sum()) / (1 + df)) + 1
    place = {x: i for i, x in enumerate(languages)}
    value = lambda i: SCALE * idf[rows[i][1]] * rows[i][2] / max(rows[i][2].sum(), 1)
    y = np.array([place[x[0]] for x in rows])
    z, g2 = np.zeros((DIMS, n_lang)), np.zeros((DIMS, n_lang))
    bz, bg = np.zeros(n_lang), np.zeros(n_lang)

    def weights(z, g2, l1):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))

    for _ in range(epochs):
        for i in np.flatnonzero(~held):
            k, v = rows[i][1], value(i)
            w, b = weights(z[k], g2[k], l1), weights(bz, bg, 0.0)
            p = softmax(v @ w + b)
            p[y[i]] -= 1
            g = v[:, None] * p
            z[k] += g - (np.sqrt(g2[k] + g * g) - np.sqrt(g2[k])) / alpha * w
            g2[k] += g * g
            bz += p - (np.sqrt(bg + p * p) - np.sqrt(bg)) / alpha * b
            bg += p * p
    w, b = weights(z, g2, l1), weights(bz, bg, 0.0)
    logits = np.array([value(i) @ w[rows[i][1]] + b for i in np.flatnonzero(held)]).reshape(-1, n_lang)
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.25, 8, 61) if len(logits) else []:
        loss = -np.log(np.maximum(softmax(logits / t)[np.arange(len(logits)), y[held]], 1e-12)).mean()
        if loss < best:
            best, temperature = loss, float(t)
    return Model(languages, idf, w, b, temperature)


def fit(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from a sample of the rows with a non-null lang that ``learn`` admits; None without any.

    Of each language, the rows of least hash (of doc_id and text), as many as its share of ``sample_rows`` and
    ``SAMPLE_FEATURES``: a rare language is learnt as well as a frequent one. Counts of languages say how low a hash must be to
    come into question; only those rows, about twice the sample, are ranked. Ties and repeated rows are cut by their
    features, so that a run gives what another gives.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull()).select(F.xxhash64("doc_id", "text").alias("h"), "lang", F.col("text").cast("string").alias("text"))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "languages")
    n = counts.count()
    if not n:
        discard(counts)
        return None
    share = min(MOST_ROWS, max(LEAST_ROWS, sample_rows // n))
    low = F.lit(float(-(1 << 63))) + F.least(F.lit(1.0), F.lit(2.0 * share) / F.col("n")) * float((1 << 64) - (1 << 12))
    cuts = counts.select("lang", F.greatest("least", low.cast("long")).alias("cut"))
    cuts = F.broadcast(cuts) if n <= BROADCAST_LANGUAGES else cuts  # a row per language: texts stay where they are
    found = features(rows.join(cuts, "lang").filter("h <= cut").select("h", "lang", "text"))
    of = Window.partitionBy("lang").orderBy("h", "keys", "counts")
    found = found.withColumn("_r", F.row_number().over(of)).filter(F.col("_r") <= share)  # repeated ids may exceed the share
    before = F.sum(F.length("keys") / 2).over(of.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_n", before).filter((F.col("_r") == 1) | (F.col("_n") <= SAMPLE_FEATURES // n)).orderBy("h", "lang", "keys", "counts")
    rows = [(r.lang, np.frombuffer(r.keys, "<u2").astype(np.int32), np.frombuffer(r.counts, "<u4").astype(np.float32)) for r in found.select("h", "lang", "keys", "counts").collect()]
    model = train(rows) if rows else None
    del rows
    discard(counts)
    trim()
    return model


def identify(docs: DataFrame, model: Model | None, least: float | None = None) -> DataFrame:
    """``docs`` with lang_pred and lang_score (0 to 1), from whole texts; rows that score below ``least``, or are ``und``, go if it is given.

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a model. Repeated rows
    get equal results; an empty table stays empty; columns of these names are replaced, others stay.
    """
    docs = docs.drop("lang_pred", "lang_score")
    bounded_batches(docs.sparkSession)
    shipped = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]):
        own = received(shipped)
        table, weights = letter_table(), own.table() if own else None
        for batch in steps(batches, "text"):
            grams, offsets, letters = n_grams(batch.column("text"), table)
            if own is None:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = own.score(grams, offsets, weights)
                names = [own.languages[k] if has else UNKNOWN for k, has in zip(p.argmax(axis=1).tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, p.max(axis=1), 0.0)
            out = with_columns(batch, lang_pred=pa.array(names, pa.string()), lang_score=pa.array(score))
            yield out if least is None else out.filter(pa.array((score >= least) & (np.array(names) != UNKNOWN)))

    form = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string, lang_score double"])
    return docs.mapInArrow(run, form)
