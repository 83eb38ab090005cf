"""Self-join on the Jaccard similarity of word shingles by a grouped prefix join, as classes of linked documents.

1. Documents with equal shingle sets collapse into one representative.
2. Shingles are ordered by a fixed-size sketch of their frequency over the whole corpus, then by length: common
   passages come last. A set's prefix (its first n - ceil(t n) + 1 shingles) must meet that of any set similar enough.
3. Representatives with identical prefixes and size collapse into one group; the inverted index holds groups.
4. Each group is first compared to the least group of each index list, each member to its group's first: these
   pairs are linear in the index. Verified links form classes.
5. Pairs of groups that share an index entry and have members of different classes are filtered by size and by
   the entry's places in both prefixes, expanded to members and verified. Pairs within a class need no look.

No pair of different classes that could be similar is passed over, so classes equal those of the full join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, codes, discard, materialize, mix, owners, per_row, settle, steps, summed_arrays, words
from .components import components

#: Counters of the frequency sketch. It orders shingles, and any order gives the same links.
SKETCH = 1 << 22
#: Bits of the filter of wanted documents: so many for each, within these bounds. Beyond, more documents than wanted are read again; links stay the same.
WANTED_BITS, WANTED_LEAST, WANTED_MOST = 16, 1 << 20, 1 << 28
#: A shingle is frequent if its counter exceeds the median by so many times the lower spread, which frequent shingles do not widen.
SPREADS = 3
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def shingles(text: pa.Array, k: int, distinct: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bytes, row) of the k-word shingles of each text, by row; distinct ones by ascending hash if asked for.

    A text of fewer than k words, but not none, has one shingle: all of it.
    """
    import xxhash

    flat, offsets = words(text, LOWER)
    code, strings = codes(flat)
    known = strings.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    sizes = np.fromiter((len(w.encode()) for w in known), np.int64, len(known))
    h, size, own, n = hashes[code], sizes[code], owners(offsets), np.diff(offsets)
    odd = [np.uint64(_ODD[i % len(_ODD)] + 2 * (i // len(_ODD))) for i in range(k)]
    m = max(0, len(h) - k + 1)
    s, long = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    for i in range(k):
        s += mix(h[i : m + i] + np.uint64(i)) * odd[i]
        long += size[i : m + i]
    whole = own[:m] == own[k - 1 : m + k - 1] if m else np.zeros(0, bool)
    s, long, row = s[whole], long[whole], own[:m][whole]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        bytes_ = np.zeros(len(few), np.int64)
        for i in range(k - 1):
            has = n[few] > i
            at = offsets[few[has]] + i
            short[has] += mix(h[at] + np.uint64(i)) * odd[i]
            bytes_[has] += size[at]
        s, long, row = np.concatenate([s, mix(short + n[few].astype(np.uint64))]), np.concatenate([long, bytes_]), np.concatenate([row, few])
    s = mix(s)
    if distinct or len(few):
        order = np.argsort(s) if distinct else np.arange(len(s))
        order = order[np.argsort(row[order].astype(np.uint16) if len(n) < 1 << 16 else row[order], kind="stable")]
        s, long, row = s[order], long[order], row[order]
    if distinct and len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        s, long, row = s[new], long[new], row[new]
    return s, long, row


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """0 to 15 for each counter of the sketch: 0 for what other shingles' chance collisions explain, else the power of two of the excess."""

    def count(batches, own):
        for batch in steps(batches, "text"):
            s, _, _ = shingles(batch.column("text"), k, distinct=False)
            own[:SKETCH] += np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)

    total = summed_arrays(docs, ["text"], count, SKETCH)
    low, usual = np.quantile(total, [0.16, 0.5])
    excess = (total - usual) / (SPREADS * max(usual - low, 1.0))
    return np.where(excess < 1, 0, np.minimum(1 + np.floor(np.log2(np.maximum(excess, 1))), 15)).astype(np.uint8)


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest (d1, d2) of the set, and its prefix; none where no other set can be similar. Written."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, k))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in steps(batches, "text"):
            s, size, row = shingles(batch.column("text"), k)
            count = np.bincount(row, minlength=batch.num_rows)
            ends = np.concatenate([[0], np.cumsum(count)])
            d1, d2 = per_row(mix(s).view(np.int64), ends), per_row(mix(s ^ np.uint64(_ODD[0])).view(np.int64), ends)
            level = levels.value[(s % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64)
            key = level << np.uint64(60) | (63 - np.minimum(size, 63)).astype(np.uint64) << np.uint64(54) | s >> np.uint64(10)
            order = np.argsort(key)
            order = order[np.argsort(row[order].astype(np.uint16) if batch.num_rows < 1 << 16 else row[order], kind="stable")]
            length = count - (percent * count + 99) // 100 + 1
            length[(count * (100 - percent) < percent) | (count == 0)] = 0
            inside = np.arange(len(key)) - ends[row] < length[row]
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order][inside].view(np.int64)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": count.astype(np.int64), "d1": d1, "d2": d2, "prefix": prefix})

    out = materialize(docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>"), "prefixes")
    levels.destroy()
    return out


def _wanted(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, set) of the documents in ``ids``, read again from their texts, and of a few more: a filter sized by their number picks them before anything is shuffled. Written."""
    bits = min(WANTED_MOST, max(WANTED_LEAST, 1 << (WANTED_BITS * ids.count()).bit_length()))

    def slot(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = mix(x.astype(np.int64).view(np.uint64)) % np.uint64(bits)
        return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def count(batches, own):
        for batch in batches:
            at, bit = slot(batch.column("id").to_numpy())
            np.bitwise_or.at(own, at, bit)

    has = docs.sparkSession.sparkContext.broadcast(summed_arrays(ids, ["id"], count, bits // 8, merge=np.bitwise_or, dtype=np.uint8))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at, bit = slot(pc.fill_null(batch.column("doc_id"), 0).to_numpy())
            kept = batch.filter(pa.array(has.value[at] & bit > 0))
            for part in steps([kept], "text"):
                s, _, row = shingles(part.column("text"), k)
                offsets = pa.array(8 * np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "set": pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets.buffers()[1], pa.py_buffer(s)])})

    out = materialize(docs.mapInArrow(run, "doc_id long, set binary"), "sets")
    has.destroy()
    return out


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, as a table of edges (u, v)."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = _wanted(docs, ids, k)
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))

    def similar(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = int((q[at] == p).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # one side's set moves with the pair; the other's is only read
    both = pairs.join(x, "a").join(y, "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y")
    links = materialize(both.mapInArrow(similar, "u long, v long"), "links")
    discard(pairs, sets)
    return links


def _across(entries: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs (p, q) of subgroups (sid) that may hold similar sets and differ in comp. entries: key, pos, sid, comp, n.

    A similar pair's first common entry has enough of both sets behind it; only such entries make a pair. And only what
    is outside a key's largest class is joined with the rest: a list within one class costs nothing.
    """
    counts = entries.groupBy(key, "comp").count()
    major = counts.groupBy(key).agg(F.max_by("comp", "count").alias("major"), F.count("*").alias("n_comps")).filter("n_comps > 1").drop("n_comps")
    mixed = materialize(entries.join(major, key).select(key, "pos", "sid", "comp", "n", "major"), "mixed")
    x, y = mixed.filter("comp != major").alias("x"), mixed.alias("y")
    sizes = f"x.n * 100 >= y.n * {percent} and y.n * 100 >= x.n * {percent}"
    enough = f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent} <= least(x.n - x.pos, y.n - y.pos)"
    pairs = x.join(y, F.expr(f"x.{key} = y.{key} and x.comp != y.comp and (y.comp = y.major or x.sid < y.sid) and {sizes} and {enough}"))
    found = materialize(pairs.selectExpr("least(x.sid, y.sid) as p", "greatest(x.sid, y.sid) as q").distinct(), "across")
    discard(mixed)
    return found


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct k-word shingles of the whole
    text, or all of a shorter one. Documents link when 100 * intersection >= percent * union; component_id is the
    least doc_id reachable. Null and wordless texts have no shingle and are alone. Rows with the same doc_id are one
    document, linked by any of its texts; rows without a doc_id link only with equal sets, and where all of those have none
    their component_id is null. An empty table gives none; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = _prefixes(docs, k, percent)
    reps = own.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    reps = materialize(reps.select("*", F.xxhash64("prefix").alias("p1"), F.xxhash64("prefix", F.lit(1)).alias("p2")), "reps")
    viable = reps.filter("size(prefix) > 0 and rep is not null")
    grouped = materialize(viable.select("rep", "n", "p1", "p2").join(viable.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid")), ["n", "p1", "p2"]).select("rep", "n", "gid"), "groups")

    postings = viable.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"), F.first("prefix").alias("prefix")).select(F.posexplode("prefix").alias("pos", "tok"), "gid", "n")
    postings = materialize(postings, "postings")  # lists are counted before entries are dealt by them: a long list is one row of each task
    lists = postings.groupBy("tok").agg(F.count("*").alias("many"), F.min("gid").alias("anchor"), F.min_by("n", "gid").alias("anchor_n")).filter("many > 1")
    index = materialize(postings.join(lists, "tok").select("tok", "pos", "gid", "n", "anchor", "anchor_n"), "index")
    discard(postings)

    prefix = f"(%s - ({percent} * %s + 99) div 100 + 1)"
    rest = lambda n: f"({n} - {prefix % (n, n)})"  # noqa: E731  what is behind the prefix
    needed = lambda a, b: f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent} - greatest({rest(a)}, {rest(b)}))"  # noqa: E731  shared prefix entries of a similar pair
    fits = lambda a, b: f"{a} * 100 >= {b} * {percent} and {b} * 100 >= {a} * {percent}"
    first = index.filter("gid != anchor").filter(fits("n", "anchor_n")).groupBy("gid", "anchor", "n", "anchor_n").count().filter(f"4 * count >= {needed('n', 'anchor_n')}")
    first = first.select(F.col("gid").alias("a"), F.col("anchor").alias("b")).unionByName(grouped.filter("rep != gid").select(F.col("rep").alias("a"), F.col("gid").alias("b")))
    links = verified(docs, first, k, percent)
    known = materialize(components(links), "classes")
    settle(docs.sparkSession)

    comp = F.coalesce("component", "rep").alias("comp")
    members = grouped.join(known, grouped.rep == known.node, "left").select("rep", "gid", "n", comp)
    # the members of a group in one class are a subgroup, named by its least member
    members = materialize(members.join(members.groupBy("gid", "comp").agg(F.min("rep").alias("sid")), ["gid", "comp"]), "members")
    subgroups = members.filter("rep = sid").select("gid", "sid", "comp", "n")
    by_token, by_group = _across(index.select("tok", "pos", "gid").join(subgroups, "gid"), "tok", percent), _across(subgroups.withColumn("pos", F.lit(0)), "gid", percent)
    more = by_token.unionByName(by_group)
    p, q = members.select(F.col("sid").alias("p"), F.col("rep").alias("a")), members.select(F.col("sid").alias("q"), F.col("rep").alias("b"))
    links = links.unionByName(verified(docs, more.join(p, "p").join(q, "q"), k, percent))
    discard(index, grouped, members, by_token, by_group)
    settle(docs.sparkSession)

    # rows of one doc_id with different texts
    row_reps = own.filter("n > 0").select("doc_id", "n", "d1", "d2").join(reps.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
    split = row_reps.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u != v").drop("v")
    links = links.unionByName(row_reps.join(split, "doc_id").select("u", F.col("rep").alias("v")))
    known = components(links)
    final = reps.select("n", "d1", "d2", "rep").join(known, reps.rep == known.node, "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    some = own.filter("n > 0").select("doc_id", "n", "d1", "d2").join(final, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return some.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


#: The classes of 3-word shingles at 90 percent. Documents with equal sets stand for each other before shingles are joined.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS x FROM s GROUP BY doc_id),
reps AS (SELECT n, x, min(doc_id) AS rep FROM sets GROUP BY n, x),
r AS (SELECT rep, n, g FROM reps JOIN s ON s.doc_id = rep),
links AS (SELECT a.rep AS u, b.rep AS v FROM r a JOIN r b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS u, rep AS v FROM reps UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least_ AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(least_.c, d.doc_id) AS BIGINT) AS component_id
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN reps ON reps.n = sets.n AND reps.x = sets.x LEFT JOIN least_ ON least_.u = reps.rep
"""
