"""Quality rules on repetition, from suffix arrays over each document's words.

All documents of a step share one suffix array whose first symbol is the document, so that nothing matches across
documents. Prefix doubling sorts it, refining only what still ties; the ranks of each round give the longest common
prefix of neighbours by binary descent. A word's longest match is the larger common prefix with either neighbour: so the
occurrences of the maximal repeated substrings are found without building their intervals. Their spans are united for
the covered share, the longest gives the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, codes, owners, per_row, steps, with_columns, words

#: Words of the shortest repeat that counts.
LEAST_REPEAT = 8
#: The method's limits: share of words in repeats, in percent, and words of the longest repeat.
MOST_COVERED, MOST_LONGEST = 25, 100
#: The base rules' limits.
LEAST_WORDS, MOST_REPEATED = 20, 30


#: Words up to which ranks of all levels are kept; beyond, common prefixes are counted in text order, in memory of one array.
RANKED_WORDS = 1 << 20


def _common_prefixes(code: np.ndarray, offsets: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each suffix but the first in ``sa``, the words it shares with the one before: each follows from its left neighbour in the text, less one."""
    n = len(code)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = owners(offsets)
    before[own[np.maximum(before, 0)] != own] = -1  # the first suffix of a text
    out, ends = np.zeros(n, np.int64), offsets[1:][own]
    word, prev, end, common = memoryview(code), memoryview(before), memoryview(ends), memoryview(out)
    k = 0
    for i in range(n):
        j = prev[i]
        if j < 0:
            k = 0
            continue
        most = min(end[i] - i, end[j] - j)
        while k < most and word[i + k] == word[j + k]:
            k += 1
        common[i] = k
        k = max(k - 1, 0)
    return out[sa[1:]]


def longest_matches(code: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """For each word, how many words from it on occur elsewhere in its text too; 0 where fewer than ``least``."""
    n = len(code)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    own = owners(offsets)
    end = offsets[1:][own]
    key = own * (int(code.max()) + 1) + code
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n + 1, np.int64)  # of a suffix: the place of the first that ties with it
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    few = n <= RANKED_WORDS
    ranks, h = [rank.astype(np.int32)] if few else [], 1
    alone = new & np.append(new[1:], True)
    at = np.flatnonzero(~alone)  # places in sa that still tie
    while len(at):
        suffix = sa[at]
        next_ = suffix + h
        second = np.where(next_ < end[suffix], rank[np.minimum(next_, n)], -1)
        first = rank[suffix]
        order = np.lexsort((second, first))
        suffix, first, second = suffix[order], first[order], second[order]
        sa[at] = suffix
        fresh = np.ones(len(at), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (second[1:] < 0)
        rank[suffix] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        if few:
            ranks.append(rank.astype(np.int32))
        h *= 2
        at = at[~(fresh & np.append(fresh[1:], True))]
    if not few:
        del key, new, alone, rank
        i, j, common = sa[1:], sa[:-1], _common_prefixes(code, offsets, sa)
        common[common < least] = 0
        np.maximum.at(out, i, common)
        np.maximum.at(out, j, common)
        return out
    # neighbours that share at least the largest power of two up to ``least`` words; at the last level none do
    level = min(int(least).bit_length() - 1, len(ranks) - 1)
    pairs = np.flatnonzero(ranks[level][sa[1:]] == ranks[level][sa[:-1]])
    i, j, common = sa[pairs], sa[pairs + 1], np.zeros(len(pairs), np.int64)
    for k in reversed(range(len(ranks))):
        a, b = np.minimum(i + common, n), np.minimum(j + common, n)
        common += (ranks[k][a] == ranks[k][b]).astype(np.int64) << k
    common[common < least] = 0
    np.maximum.at(out, i, common)
    np.maximum.at(out, j, common)
    return out


def covered(longest: np.ndarray) -> np.ndarray:
    """Which words lie in an occurrence of a repeat."""
    edge = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest)
    edge[at] += 1
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(text: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = pc.split_pattern(text, "\n")
    offsets = lines.offsets.to_numpy().astype(np.int64)
    code, distinct = codes(lines.values)
    some = pc.match_substring_regex(distinct, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
    has = some[code] if len(code) else np.zeros(0, bool)
    own = owners(offsets)
    pairs = np.unique(own[has] * max(len(distinct), 1) + code[has])
    return per_row(has.astype(np.int64), offsets) - np.bincount(pairs // max(len(distinct), 1), minlength=len(text)).astype(np.int64)


def rules(docs: DataFrame, most_covered: int = MOST_COVERED, most_longest: int = MOST_LONGEST) -> DataFrame:
    """``docs`` with the base statistics, longest_repeat, base_failed and kept, from whole texts.

    Words are runs without ASCII white space. n_repeat_words counts the words in repeats of 8 words or more.
    Null, empty and wordless texts have no words: base_failed. Repeated rows get equal results, an empty table stays
    empty, and columns of the added names are replaced.
    """
    long = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
    docs = docs.drop(*long, "base_failed", "kept")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in steps(batches, "text"):
            text = pc.fill_null(batch.column("text"), "")
            flat, offsets = words(text)
            code, distinct = codes(flat)
            size = pc.utf8_length(distinct).to_numpy().astype(np.int64)[code] if len(code) else code
            longest = longest_matches(code, offsets, LEAST_REPEAT)
            n, repeated = np.diff(offsets), per_row(covered(longest).astype(np.int64), offsets)
            most = np.zeros(len(n), np.int64)
            at = np.flatnonzero(longest)
            np.maximum.at(most, np.searchsorted(offsets, at, "right") - 1, longest[at])
            failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
            kept = ~failed & (100 * repeated <= most_covered * n) & (most <= most_longest)
            symbols = pc.count_substring_regex(text, r"[#*$%&|<>]").cast(pa.int64())
            numbers = [n, per_row(size, offsets), symbols, duplicate_lines(text), repeated, most]
            yield with_columns(batch, **{k: pa.array(v, pa.int64()) if isinstance(v, np.ndarray) else v for k, v in zip(long, numbers, strict=True)}, base_failed=pa.array(failed), kept=pa.array(kept))

    form = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} long" for c in long] + ["base_failed boolean, kept boolean"])
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, form)


#: The same in DuckDB SQL over ``documents``: windows of 8 words, and of one word more than the longest repeat allowed.
SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, w, text, len(w) AS n FROM w),
p AS (SELECT doc_id, unnest(range(1, n - 6)) AS i, w, n FROM d WHERE n >= 8),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + 7], ' ') AS s, CASE WHEN i + {MOST_LONGEST} <= n THEN md5(array_to_string(w[i:i + {MOST_LONGEST}], ' ')) END AS l FROM p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k, CASE WHEN l IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, l) END AS m FROM g),
r AS (SELECT doc_id, max(m) AS m FROM c GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT j) AS x FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM c WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
a AS (SELECT doc_id, n AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.x, 0) AS n_dup_lines, coalesce(hit.x, 0) AS n_repeat_words, coalesce(r.m, 0) AS m
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * n_repeat_words <= {MOST_COVERED} * n_words AND m < 2 AS kept
FROM a
"""
