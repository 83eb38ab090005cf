"""Quality scores by a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards its diagonal. The sums that they
need are aggregates over all labelled rows. A score is the logistic of the difference of the classes' log densities,
that is of their Mahalanobis distances, taken with Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, codes, materialize, owners, per_row, received, ship, steps, with_columns, words

N_FEATURES = 9
#: Shares of the pooled covariance and of its diagonal in a class covariance, and the least variance, as a share of the pooled one.
POOLED, DIAGONAL, FLOOR = 0.10, 0.10, 1e-3


def distinct_per_row(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many different codes each row has."""
    if not len(code):
        return np.zeros(len(offsets) - 1, np.int64)
    pairs = np.unique(owners(offsets) * (int(code.max()) + 1) + code)
    return np.bincount(pairs // (int(code.max()) + 1), minlength=len(offsets) - 1)


def statistics(text: pa.Array) -> np.ndarray:
    """Transformed statistics of each whole text, one row each. Shares are smoothed, so that few words say little."""
    text = pc.fill_null(text, "")
    flat, offsets = words(text)
    n = np.diff(offsets).astype(float)
    code, distinct = codes(flat)
    size = pc.utf8_length(distinct).to_numpy().astype(np.int64)[code] if len(code) else code
    again = np.zeros(len(code), np.int64)
    again[1:] = code[1:] == code[:-1]
    first = offsets[:-1][n > 0]
    again[first] = 0
    count = lambda pattern: pc.count_substring_regex(text, pattern).to_numpy(zero_copy_only=False).astype(float)
    upper, letters = count(r"\p{Lu}"), count(r"\p{L}")
    lines = pc.split_pattern(text, "\n")
    line_offsets = lines.offsets.to_numpy().astype(np.int64)
    line_code, _ = codes(lines.values)
    n_lines = np.diff(line_offsets)
    x = [
        np.log1p(10 * count(r"[#*$%&|<>]") / (n + 5)),
        np.log1p(10 * count("!") / (n + 5)),
        np.log1p(10 * (upper + 0.02 * 40) / (letters + 40)),
        (per_row((size <= 3).astype(np.int64), offsets) + 0.31 * 30) / (n + 30),
        np.log((per_row(size, offsets) + 5.1 * 30) / (n + 30)),
        np.log1p(10 * per_row(again, offsets) / (n + 5)),
        np.log((distinct_per_row(code, offsets) + 8) / (n + 8)),
        (n_lines - distinct_per_row(line_code, line_offsets)) / (n_lines + 3.0),
        np.log1p(n),
    ]
    return np.stack(x, axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in steps(batches, "text"):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))})

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    means: np.ndarray  # of classes 0 and 1
    factors: np.ndarray  # inverse Cholesky factors of the shrunk covariances
    offsets: np.ndarray  # log prior - half log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [o - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def discriminant(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant | None:
    """The discriminant of two classes' counts, sums and sums of products; None unless both have rows."""
    if (counts < 1).any():
        return None
    means = sums / counts[:, None]
    scatter = squares - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / max(counts.sum() - 2, 1)
    spread = np.diag(pooled).clip(1e-9)
    pooled = pooled + np.diag(FLOOR * spread)
    factors, offsets = [], []
    for n, s in zip(counts, scatter, strict=True):
        cov = (1 - POOLED - DIAGONAL) * s / max(n - 1, 1) + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled))
        cov += np.diag(FLOOR * spread)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(n / counts.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def fit(x: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The discriminant of the rows of ``x`` (doc_id, x) by ``labels`` (doc_id, quality 0 or 1); null labels are no labels, repeated rows count as often as they occur."""
    k = N_FEATURES
    joined = x.join(labels.filter("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    at = [F.col("x")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = joined.groupBy("quality").agg(F.count("*").alias("n"), *[F.sum(c) for c in at], *[F.sum(at[i] * at[j]) for i, j in pairs]).collect()
    counts, sums, squares = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for r in rows:
        c, values = int(r[0]), list(r[2:])
        counts[c], sums[c] = r[1], values[:k]
        for (i, j), v in zip(pairs, values[k:], strict=True):
            squares[c, i, j] = squares[c, j, i] = v
    return discriminant(counts, sums, squares)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant | None, DataFrame]:
    """The model of all labelled documents, and the statistics of all documents, written once."""
    x = materialize(measured(docs), "statistics")
    return fit(x, labels), x


def scored(x: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id and score (0 to 1, the higher the likelier class 1; 0.5 without a model) of measured documents."""
    shipped = ship(x.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]):
        own = received(shipped)
        for batch in batches:
            values = batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": own.score(values) if own else np.full(len(values), 0.5)})

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Discriminant | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``least`` or more, with quality_score; all columns stay.

    Null and empty texts have the statistics of no words and are scored like others; repeated rows get equal scores;
    an empty table stays empty; a column quality_score is replaced. Without a model all rows score 0.5.
    """
    docs = docs.drop("quality_score")
    bounded_batches(docs.sparkSession)
    shipped = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]):
        own = received(shipped)
        for batch in steps(batches, "text"):
            score = own.score(statistics(batch.column("text"))) if own else np.full(batch.num_rows, 0.5)
            yield with_columns(batch, quality_score=pa.array(score)).filter(pa.array(score >= least))

    form = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["quality_score double"])
    return docs.mapInArrow(run, form)
