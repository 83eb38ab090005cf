"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Windows of benchmark items are the patterns, words are the symbols. For patterns of m words, the shift table
maps a block of two words to how far the search can move: to the block's last place in any pattern, or past it.
Where the shift is 0 the block ends some pattern; the patterns in its suffix bucket are compared word by word.
All texts of a step are searched in lockstep, cut into lanes that overlap by m - 1 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, bounded_batches, materialize, per_row, received, ship, steps, with_columns, words

#: Words of a lane.
LANE = 512
#: Characters of benchmark text that one search holds, on the driver and in each worker; a larger benchmark is searched in passes, one block of items each.
BLOCK_CHARS = 4 << 20


class Searcher:
    """Wu-Manber tables for patterns of ``m`` words, given as rows of word codes above 0."""

    def __init__(self, patterns: np.ndarray, m: int, n_codes: int):
        self.m, self.block, self.n_codes = m, min(2, m), n_codes + 1
        self.patterns = patterns
        every = np.arange(len(patterns))
        places = range(m, self.block - 1, -1)  # later places first: they give smaller shifts, and the first one found counts
        keys = [np.unique(self._keys(patterns, np.full(len(patterns), q - 1), every)) for q in places]
        shifts = np.repeat([m - q for q in places], [len(k) for k in keys])
        self.keys, first = np.unique(np.concatenate(keys), return_index=True)
        self.shifts = shifts[first]
        last = self._keys(patterns, np.full(len(patterns), m - 1), np.arange(len(patterns)))
        order = np.argsort(last, kind="stable")
        self.bucket_keys, first = np.unique(last[order], return_index=True)
        self.bucket_first, self.bucket_end, self.bucket = first, np.append(first[1:], len(order)), order

    def _keys(self, rows: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        key = rows[which, at].astype(np.int64)
        return key if self.block == 1 else rows[which, at - 1].astype(np.int64) * self.n_codes + key

    def find(self, code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence in the texts that ``offsets`` part."""
        m, n = self.m, np.diff(offsets)
        places = np.maximum(n - m + 1, 0)  # of a window's first word
        lanes = -(-places // LANE)
        of = np.repeat(np.arange(len(n)), lanes)
        k = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = offsets[of] + k * LANE + m - 1  # a window's last word
        end = np.minimum(offsets[of] + (k + 1) * LANE, offsets[of] + places[of]) + m - 1
        firsts, found = [], []
        past = m - self.block + 1
        while len(at):
            key = code[at].astype(np.int64)
            if self.block == 2:
                key = code[at - 1].astype(np.int64) * self.n_codes + key
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            shift = np.where(self.keys[slot] == key, self.shifts[slot], past)
            stop = shift == 0
            if stop.any():
                here, key = at[stop], key[stop]
                b = np.searchsorted(self.bucket_keys, key)
                many = self.bucket_end[b] - self.bucket_first[b]
                place = np.repeat(here, many)
                pattern = self.bucket[np.repeat(self.bucket_first[b] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                same = np.ones(len(place), bool)
                for q in range(m - self.block):
                    same[same] = code[place[same] - m + 1 + q] == self.patterns[pattern[same], q]
                firsts.append(place[same] - m + 1)
                found.append(pattern[same])
                shift[stop] = 1
            at = at + shift
            on = at < end
            if not on.all():
                at, end = at[on], end[on]
        if not firsts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(firsts), np.concatenate(found)


class Patterns:
    """The windows of some benchmark items, and the tables that search for them."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        flat, offsets = words(pa.array([t for _, t in items], pa.string()), ALNUM)
        enc = flat.dictionary_encode() if len(flat) else None
        self.vocabulary = enc.dictionary if enc is not None else pa.array([], pa.large_string())
        code = enc.indices.to_numpy().astype(np.int32) + 1 if enc is not None else np.zeros(0, np.int32)
        n = np.diff(offsets)
        self.searchers = []
        for m in np.unique(np.minimum(n, window))[np.unique(np.minimum(n, window)) > 0].tolist():
            of = np.flatnonzero(np.minimum(n, window) == m)
            places = n[of] - m + 1
            item = np.repeat(of, places)
            first = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) + offsets[item]
            rows = np.stack([code[first + q] for q in range(m)], axis=1)
            found, pattern = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([pattern.ravel(), item]), axis=1)
            starts = np.searchsorted(pairs[0], np.arange(len(found) + 1))
            self.searchers.append((Searcher(found, m, len(self.vocabulary)), starts, pairs[1].astype(np.int32)))
        self.names = [None if i is None else str(i) for i, _ in items]

    def scan(self, flat: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """Which words lie in an occurrence, and the items found in each text."""
        hit = np.zeros(len(flat) + 1, np.int64)
        items: dict[int, set] = {}
        if len(flat) and len(self.vocabulary):
            code = pc.fill_null(pc.add(pc.index_in(flat, self.vocabulary.cast(flat.type)), 1), 0).to_numpy(zero_copy_only=False)
            for searcher, starts, owner in self.searchers:
                first, pattern = searcher.find(code, offsets)
                np.add.at(hit, first, 1)
                np.add.at(hit, first + searcher.m, -1)
                row = np.searchsorted(offsets, first, "right") - 1
                for r, p in np.unique(np.stack([row, pattern]), axis=1).T.tolist() if len(first) else []:
                    items.setdefault(r, set()).update(self.names[i] for i in owner[starts[p] : starts[p + 1]].tolist() if self.names[i] is not None)
        return np.cumsum(hit[:-1]) > 0, items


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about ``BLOCK_CHARS`` characters: one, unless it is larger."""
    chars = benchmark.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = -(-chars // BLOCK_CHARS) or 1
    return [benchmark] if n == 1 else [benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _search(spark: SparkSession, part: DataFrame, window: int) -> Broadcast:
    """The tables of one block: at most about ``BLOCK_CHARS`` characters of items, or one longer item, pass the driver."""
    return ship(spark, Patterns([(r.item_id, r.text) for r in part.select("item_id", "text").collect()], window))


def _fresh(items: list) -> tuple[int, list[str], str]:
    names = sorted(items)
    return len(names), names, hashlib.sha256(",".join(names).encode()).hexdigest()


ADDED = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"


def _with_results(batch: pa.RecordBatch, offsets: np.ndarray, hit: np.ndarray, items: dict[int, set]) -> pa.RecordBatch:
    n_hit = per_row(hit.astype(np.int64), offsets)
    n, names, digest = zip(*(_fresh(items.get(r, ())) for r in range(batch.num_rows)), strict=True)
    return with_columns(batch, n_words=pa.array(np.diff(offsets)), n_hit=pa.array(n_hit), n_items=pa.array(n, pa.int64()), items=pa.array(names, pa.list_(pa.string())), items_sha256=pa.array(digest), contaminated=pa.array(n_hit > 0))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted item ids as strings), items_sha256 and contaminated.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all beyond ASCII, of whole texts. An item's windows are its
    ``window`` consecutive words, or all of a shorter item; a word in any occurrence of a window is hit. Null and
    wordless texts have no words, null and wordless items no windows; an empty benchmark hits nothing; an item without
    an id hits words but is not among the items. Rows are kept as they are, repeated ones too; columns of these names
    are replaced. A benchmark of one block is searched in one pass; of a larger one, each block takes a pass of its own.
    """
    docs = docs.drop(*[c.split()[0] for c in ADDED.split(", ")])
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = blocks(benchmark)
    if len(parts) > 1:
        return _in_passes(docs, parts, window)
    shipped = _search(spark, parts[0], window)

    def run(batches: Iterator[pa.RecordBatch]):
        own = received(shipped)
        for batch in steps(batches, "text"):
            flat, offsets = words(batch.column("text"), ALNUM)
            yield _with_results(batch, offsets, *own.scan(flat, offsets))

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], ADDED]))


def _in_passes(docs: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """The same over several blocks: each pass writes the runs of hit words of the rows it hits, which are joined to the rows at the end. Driver and workers hold one block at a time."""
    own = docs.columns

    def number(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield with_columns(batch, _row=pa.array(at + np.arange(batch.num_rows)))
            at += batch.num_rows

    form = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    numbered = materialize(docs.mapInArrow(number, ", ".join([*form, "_row long"])), "numbered")
    found = None
    for part in parts:
        shipped = _search(docs.sparkSession, part, window)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped):
            search = received(shipped)
            for batch in steps(batches, "text"):
                flat, offsets = words(batch.column("text"), ALNUM)
                hit, items = search.scan(flat, offsets)
                rows = np.flatnonzero(per_row(hit.astype(np.int64), offsets))
                runs = []
                for r in rows.tolist():
                    edge = np.diff(np.concatenate([[0], hit[offsets[r] : offsets[r + 1]].view(np.int8), [0]]))
                    runs.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).T.astype("<i8").tobytes())
                yield pa.RecordBatch.from_pydict({"_row": batch.column("_row").take(pa.array(rows)), "runs": pa.array(runs, pa.binary()), "found": pa.array([sorted(items.get(r, ())) for r in rows.tolist()], pa.list_(pa.string()))})

        one = materialize(numbered.select("_row", "text").mapInArrow(run, "_row long, runs binary, found array<string>"), "block-hits")
        shipped.destroy()  # its results are written
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("_row").agg(F.collect_list("runs").alias("_runs"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("_found"))  # of one text, a list a block

    def join(batches: Iterator[pa.RecordBatch]):
        for batch in steps(batches, "text"):
            flat, offsets = words(batch.column("text"), ALNUM)
            edge, items = np.zeros(len(flat) + 1, np.int64), {}
            for r, (runs, names) in enumerate(zip(batch.column("_runs").to_pylist(), batch.column("_found").to_pylist(), strict=True)):
                for x in runs or ():
                    a, b = np.frombuffer(x, "<i8").reshape(-1, 2).T + offsets[r]
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                items[r] = names or ()
            yield _with_results(batch.select(own), offsets, np.cumsum(edge[:-1]) > 0, items)

    return numbered.join(merged, "_row", "left").mapInArrow(join, ", ".join([*form, ADDED]))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS m
      FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
pattern AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(w[j:j + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS j FROM b)),
window_ AS (SELECT r, j, m, array_to_string(w[j:j + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM d, (SELECT DISTINCT m FROM pattern))),
found AS (SELECT r, j, m, item FROM window_ JOIN pattern USING (m, s)),
hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(j, j + m)) AS k FROM (SELECT DISTINCT r, j, m FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS x FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.x, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
