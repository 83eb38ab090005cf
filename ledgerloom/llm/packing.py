"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

1. Every document is encoded once; ids go to a table in the shared folder, whole stretches of
   ``capacity`` ids are sequences of their own, and the rest of each document is an item.
2. The items' length histogram (``capacity / grid`` classes, whatever the input) defines a
   linear program over patterns. Column generation solves it: a knapsack dynamic program prices
   new patterns with the duals of the restricted master until none improves.
3. The rounded patterns are assigned to documents by their rank within a class, which is a
   function of (class, rank); ranks come from counts per input partition, so nothing is sorted globally.
4. Items beyond the rounded patterns are laid end to end over the gaps that remain, and cut there;
   what is left over fills sequences of its own, the last ids in sequences of powers of two.

Defined results: a null text counts as empty and holds the end id only; repeated rows are documents of
their own; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, codes, materialize, settle, steps, words

ENCODED = "row long, part int, doc_id long, n long, ids binary, full_crcs array<long>, rest_crc long, klass int, rank long, full_rank long"
#: Words whose ids a worker keeps; beyond it starts anew.
CACHE_WORDS = 500_000
#: Words whose ids are laid end to end at once.
GATHERED = 1 << 17
#: Width of the stretches that gaps and filling documents are matched in.
STRETCH = 1 << 16
#: Sequences or partitions whose running sums one window holds: a hundred thousand such windows make a last one of as many rows.
BLOCK = 1 << 16


# The settings of a tokenizer for which words can be encoded one by one. White space is dropped and nothing is matched across it, ASCII case is folded.
WORDWISE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDWISE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def wordwise(settings: dict) -> bool:
    """Do a tokenizer's own settings (its JSON) say that a text's ids are those of its words in turn?"""
    steps_ = (settings.get("normalizer") or {}).get("normalizers") or []
    parts = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    blanks = [x for x in steps_ if x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " "]
    split = parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": WORDWISE_PATTERN} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    return [x.get("type") for x in steps_] == WORDWISE_NORMALIZERS and len(blanks) == 1 and split and not settings.get("truncation")


class WordEncoder:
    """Encodes texts by their distinct words where the tokenizer's settings allow it, else text by text.

    Where they do, a text's ids are those of its words in turn; a word's ids do not depend on ASCII case, nor on points
    and commas behind a letter. Ids have 16 bits, or 32 if the vocabulary is larger.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = wordwise(json.load(f))
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.item = array(self.code).itemsize
        self.known: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        """This Python worker's encoder: its known words serve all tasks that the worker runs."""
        import sys
        import types

        kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _ids(self, strings: list[str]) -> list[bytes]:
        new = [x for x in strings if x not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = strings
        plain = [x for x in new if x.isalpha()]
        for at in range(0, len(plain), 8192):
            self._learn_letters(plain[at : at + 8192])
        self._learn([x for x in new if x not in self.known])
        return [self.known[x] for x in strings]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.known.update(zip(part, [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))

    def _learn_letters(self, new: list[str], together: int = 64) -> None:
        """Words of letters alone are a stretch each for the tokenizer: many are encoded as one text and told apart by their places in it. A text whose stretches are not its words is left."""
        parts = [new[i : i + together] for i in range(0, len(new), together)]
        for part, x in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            place = np.array(x.word_ids)
            if len(place) and place[-1] == len(part) - 1 and (np.diff(place) <= 1).all() and place[0] == 0:
                ids, ends = array(self.code, x.ids).tobytes(), (self.item * np.searchsorted(place, np.arange(len(part) + 1))).tolist()
                self.known.update({w: ids[a:b] for w, a, b in zip(part, ends[:-1], ends[1:], strict=True)})

    def __call__(self, text: pa.Array, end_id: int) -> list[bytes]:
        """The ids of each text, its end id included."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(pc.fill_null(text, "").to_pylist(), add_special_tokens=False)
            return [array(self.code, [*x.ids, end_id]).tobytes() for x in found]
        flat, offsets = words(text)
        code, distinct = codes(flat)
        distinct = distinct.cast(pa.large_string())
        parts = pc.extract_regex(distinct, r"^(?P<stem>.*\p{L})(?P<tail>[.,]+)$")
        stem = pc.if_else(parts.is_valid(), pc.struct_field(parts, "stem"), distinct)
        tail = pc.if_else(parts.is_valid(), pc.struct_field(parts, "tail"), "")
        stem = pc.if_else(pc.match_substring(stem, "<|"), stem, pc.ascii_lower(stem))
        (stem_code, stems), (tail_code, tails) = codes(stem), codes(tail)
        stem_ids, tail_ids = self._ids(stems.to_pylist()), self._ids(tails.to_pylist())
        ids = [stem_ids[a] + tail_ids[b] for a, b in zip(stem_code.tolist(), tail_code.tolist(), strict=True)]
        ids.append(array(self.code, [end_id]).tobytes())
        return self._joined(ids, np.insert(code, offsets[1:], len(ids) - 1), offsets[1:] + np.arange(1, len(offsets)))

    def _joined(self, ids: list[bytes], code: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of texts whose words are ``code``, up to each of ``ends``: gathered from one array, ``GATHERED`` words at a time."""
        pool = np.frombuffer(b"".join(ids), f"<u{self.item}")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.item
        first = np.cumsum(size) - size
        parts, before = [], np.zeros(len(code) + 1, np.int64)
        np.cumsum(size[code], out=before[1:])
        for at in range(0, len(code), GATHERED):
            part = code[at : at + GATHERED]
            places = np.repeat(first[part] - (before[at : at + len(part)] - before[at]), size[part])
            parts.append(pool[places + np.arange(len(places))].tobytes())
        all_, cuts = b"".join(parts), (self.item * before[np.concatenate([[0], ends])]).tolist()
        return [all_[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, grid: int) -> DataFrame:
    """``docs`` with their ids, the checksums of whole stretches and of the rest, and ranks within the input partition."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, row, fulls, encoder = TaskContext.get().partitionId(), 0, 0, WordEncoder.of_worker(tokenizer_path)
        seen = np.zeros(capacity // grid + 2, np.int64)
        for batch in steps(batches, "text", 4 << 20, keep=True):
            ids = encoder(batch.column("text"), end_id)
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // encoder.item
            rest = n % capacity
            klass = -(-rest // grid)
            order = np.argsort(klass, kind="stable")
            ordered = klass[order]
            within = np.empty(len(n), np.int64)
            within[order] = np.arange(len(n)) - np.searchsorted(ordered, ordered, "left")
            rank = seen[klass] + within
            seen += np.bincount(klass, minlength=len(seen))
            full = n // capacity
            full_rank = fulls + np.cumsum(full) - full
            fulls += int(full.sum())
            crcs, rests = [], []
            for x, r in zip(ids, rest.tolist(), strict=True):
                wide = np.frombuffer(x, f"<u{encoder.item}").astype("<u4")
                crcs.append([zlib.crc32(wide[i : i + capacity]) for i in range(0, len(wide) - r, capacity)])
                rests.append(zlib.crc32(wide[len(wide) - r :]))
            yield pa.RecordBatch.from_pydict({
                "row": (np.int64(part) << 33) + row + np.arange(len(n)), "part": np.full(len(n), part, np.int32), "doc_id": batch.column("doc_id"), "n": n, "ids": pa.array(ids, pa.binary()),
                "full_crcs": pa.array(crcs, pa.list_(pa.int64())), "rest_crc": pa.array(rests, pa.int64()), "klass": klass.astype(np.int32), "rank": rank, "full_rank": full_rank,
            })
            row += len(n)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within ``capacity`` (unbounded knapsack), by dynamic programming over the capacity."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = size <= c
        if fit.any():
            gain = np.where(fit, best[np.maximum(c - size, 0)] + value, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], take[c] = gain[k], k
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(size[take[c]])
    return float(best[capacity]), counts


def cutting_stock(demand: np.ndarray, size: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns: counts of each size) and how often each is used, of the linear program's optimum.

    Revised simplex over generated columns, from the patterns of one size alone. Each basis is
    feasible, so a stop after ``rounds`` still returns patterns that meet the demand exactly.
    """
    m = len(demand)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0)
    basis = np.diag(capacity // size).astype(float)
    for _ in range(rounds):
        use = np.linalg.solve(basis, demand.astype(float))
        dual = np.linalg.solve(basis.T, np.ones(m))
        best, column = price(np.maximum(dual, 0), size, capacity)
        if best <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    return basis.astype(np.int64), np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


@dataclass
class Plan:
    """Rounded patterns. rows: (klass, lo, hi, pieces, base, slot0): ranks lo..hi-1 of klass go to sequences from base on."""

    n_sequences: int
    rows: list[tuple[int, int, int, int, int, int]]


def plan(histogram: dict[int, int], capacity: int, grid: int) -> Plan:
    """Pattern uses for a histogram of item lengths, held back so far that what is not assigned can fill the gaps."""
    top = capacity // grid
    count, tokens = np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64)
    for length, n in histogram.items():
        count[-(-length // grid)] += n
        tokens[-(-length // grid)] += n * length
    klass = np.flatnonzero(count)
    patterns, use = cutting_stock(count[klass], klass, top)
    mean = tokens[klass] / count[klass]
    times = np.zeros(len(use), np.int64)
    for held in np.linspace(0, 1, 401):
        times = np.floor(use * (1 - held) + 1e-7).astype(np.int64)
        taken = patterns @ times if len(klass) else times
        placed = float((taken * mean).sum())
        if tokens.sum() - placed >= 1.05 * (times.sum() * capacity - placed) + (capacity if times.sum() else 0):
            break
    rows, base, rank = [], 0, np.zeros(len(klass), np.int64)
    for p in np.flatnonzero(times):
        slot = 0
        for i in np.flatnonzero(patterns[:, p]):
            pieces, n = int(patterns[i, p]), int(patterns[i, p] * times[p])
            rows.append((int(klass[i]), int(rank[i]), int(rank[i]) + n, pieces, base, slot))
            rank[i] += n
            slot += pieces
        base += int(times[p])
    return Plan(base, rows)


def _running(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all smaller keys; keys are small integers, summed in blocks first: the last window holds a row for each ``BLOCK`` keys."""
    block = df.withColumn("_block", F.expr(f"{key} div {BLOCK}"))
    sums = block.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return block.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0))).join(before, "_block").withColumn(out, F.col(out) + F.col("_before")).drop("_block", "_before")


def _checksums(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("ids", "start", "length", "doc_tokens")), strict=True)
        crc = [zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // all_}")[s : s + n].astype("<u4")) for ids, s, n, all_ in rows]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if x == "ids_crc32" else batch.column(x) for x in names], names=names)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, grid: int = 16) -> tuple[DataFrame, DataFrame]:
    """(pieces, encoded): where each stretch of ids goes, and the table of ids that they index.

    docs: doc_id, text. ``pieces`` has one row per piece: doc_id, start and length in the document's ids, ids_crc32 of them
    (little-endian 32-bit), doc_tokens, sequence_id and offset there. ``encoded`` has doc_id, n and ids (little-endian, 16-bit,
    or 32-bit for a vocabulary of more than 65,536). Null texts hold the end id alone; repeated rows and rows without a
    doc_id are documents of their own, which ``doc_id`` does not tell apart; an empty table gives no piece; further
    columns, of whatever name, are ignored.
    """
    spark = docs.sparkSession
    encoded = materialize(encode(docs, tokenizer_path, end_id, capacity, grid), "ids")
    meta = encoded.drop("ids", "full_crcs").withColumn("rest", F.expr(f"n % {capacity}"))
    histogram = {r["rest"]: r["count"] for r in meta.filter("rest > 0").groupBy("rest").count().collect()}
    chosen = plan(histogram, capacity, grid)
    settle(spark)

    # ranks over all partitions, from counts of (partition, class)
    before = Window.partitionBy("klass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = meta.filter("rest > 0").groupBy("part", "klass").count()
    starts = counts.select("part", "klass", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    items = meta.filter("rest > 0").join(starts, ["part", "klass"]).withColumn("rank", F.col("rank") + F.col("first"))
    rows = spark.createDataFrame(chosen.rows, "klass int, lo long, hi long, pieces long, base long, slot0 long")  # at most a row for each class and pattern
    ranked = items.alias("i").join(F.broadcast(rows).alias("r"), F.expr("i.klass = r.klass and i.rank >= r.lo and i.rank < r.hi"), "left")
    ranked = ranked.select("row", "part", "doc_id", "n", "rest", "rest_crc", F.expr("base + (rank - lo) div pieces").alias("sequence_id"), F.expr("slot0 + (rank - lo) % pieces").alias("slot"))
    ranked = materialize(ranked, "ranked")

    of = Window.partitionBy("sequence_id")
    placed = ranked.filter("sequence_id is not null").select("*", F.coalesce(F.sum("rest").over(of.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("rest").over(of).alias("held"))
    placed = materialize(placed, "placed")
    whole = placed.select("doc_id", F.expr("n - rest").alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")

    # whole stretches: sequences of their own
    per_part = _running(meta.groupBy("part").agg(F.sum(F.expr(f"n div {capacity}")).alias("fulls")), "part", "fulls", "first")
    fulls = encoded.filter(f"n >= {capacity}").select("part", "doc_id", "n", "full_rank", F.posexplode("full_crcs").alias("j", "crc")).join(per_part.select("part", "first"), "part")
    n_fulls = meta.agg(F.coalesce(F.sum(F.expr(f"n div {capacity}")), F.lit(0)).alias("x")).first().x
    long = fulls.select("doc_id", F.expr(f"cast(j as long) * {capacity}").alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(chosen.n_sequences) + F.col("first") + F.col("full_rank") + F.col("j")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # what is not assigned, end to end, over the gaps and then over further sequences
    filler = ranked.filter("sequence_id is null").select("row", "part", "n", "rest")
    by_part = _running(filler.groupBy("part").agg(F.sum("rest").alias("sum")), "part", "sum", "first")
    inner = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    filler = filler.withColumn("at", F.coalesce(F.sum("rest").over(inner), F.lit(0))).join(by_part.select("part", "first"), "part")
    filler = filler.select("row", F.expr("n - rest").alias("begin"), F.expr("at + first").alias("lo"), F.expr("at + first + rest").alias("hi"))
    gaps = _running(placed.filter(f"slot = 0 and held < {capacity}").select("sequence_id", "held", (F.lit(capacity) - F.col("held")).alias("gap")), "sequence_id", "gap", "lo")
    gaps = gaps.select("sequence_id", F.col("held").alias("off0"), "lo", F.expr("lo + gap").alias("hi"))
    total_gap = placed.filter("slot = 0").agg(F.coalesce(F.sum(F.lit(capacity) - F.col("held")), F.lit(0)).alias("x")).first().x
    total_filler = ranked.filter("sequence_id is null").agg(F.coalesce(F.sum("rest"), F.lit(0)).alias("x")).first().x
    left, first = max(0, total_filler - total_gap), chosen.n_sequences + n_fulls
    more = spark.range(left // capacity).select((F.col("id") + first).alias("sequence_id"), F.lit(0).cast("long").alias("off0"), (F.col("id") * capacity + total_gap).alias("lo"), (F.col("id") * capacity + capacity + total_gap).alias("hi"))
    tail, at, sequence = [], total_gap + left // capacity * capacity, first + left // capacity
    for bit in reversed(range(capacity.bit_length())):
        if left % capacity >> bit & 1:
            tail.append((sequence, 0, at, at + (1 << bit)))
            at, sequence = at + (1 << bit), sequence + 1
    gaps = gaps.unionByName(more).unionByName(spark.createDataFrame(tail, "sequence_id long, off0 long, lo long, hi long"))
    stretches = F.explode(F.expr(f"sequence(lo div {STRETCH}, (hi - 1) div {STRETCH})")).alias("stretch")
    cuts = filler.select("*", stretches).alias("f").join(gaps.select("*", stretches).alias("g"), F.expr(f"f.stretch = g.stretch and f.lo < g.hi and g.lo < f.hi and greatest(f.lo, g.lo) div {STRETCH} = f.stretch"))
    cuts = cuts.select("row", F.expr("begin + greatest(f.lo, g.lo) - f.lo").alias("start"), F.expr("least(f.hi, g.hi) - greatest(f.lo, g.lo)").alias("length"), "sequence_id", F.expr("off0 + greatest(f.lo, g.lo) - g.lo").alias("offset"))
    assigned = {k: 0 for k in range(capacity // grid + 1)} | {row[0]: 0 for row in chosen.rows}
    for k, _, hi, *_ in chosen.rows:
        assigned[k] = max(assigned[k], hi)
    limit = F.element_at(F.array(*[F.lit(assigned[k]).cast("long") for k in range(capacity // grid + 1)]), F.col("klass") + 1)
    held = encoded.filter(f"n % {capacity} > 0").select("row", "doc_id", F.col("n").alias("doc_tokens"), "ids", "part", "klass", "rank").join(starts, ["part", "klass"]).filter(F.col("rank") + F.col("first") >= limit)
    cut = held.select("row", "doc_id", "doc_tokens", "ids").join(cuts, "row").select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset").mapInArrow(_checksums, PIECES)
    return whole.unionByName(long).unionByName(cut), encoded


def sequences(pieces: DataFrame, encoded: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array). ``doc_id`` must be unique here."""
    part = pieces.join(encoded.select("doc_id", "ids", "n"), "doc_id").select("sequence_id", "offset", F.expr("substring(ids, cast(start * (length(ids) div n) + 1 as int), cast(length * (length(ids) div n) as int))").alias("ids"), F.expr("cast(length(ids) div n as int)").alias("item"))
    joined = part.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "item"))).alias("x"))  # a sequence's pieces only

    def read(batches):
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(y["ids"], f"<u{y['item']}") for y in x]).astype(np.int32) for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_pydict({"sequence_id": batch.column("sequence_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return joined.mapInArrow(read, "sequence_id long, ids array<int>")
