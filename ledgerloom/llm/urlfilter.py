"""URL filter: host and path rules, and a character language-model ratio where no rule decides.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each character's probability after
contexts of 0 to ``ORDER - 1`` characters: every order is interpolated with the next shorter one. Their counts are
gathered from all training URLs, without collisions or a limit on their number. A URL's score is the difference of its
log-likelihoods, over its length. The limit is calibrated on hosts that the calibrated models have not seen; the final
models then learn from all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, discard, materialize, owners, steps, summed_arrays, text_buffer, with_columns

ORDER, STRENGTH = 5, 2.0
#: Bins of the scores that the limit is chosen from, over -MOST..MOST nats a character.
BINS, MOST = 2000, 10.0
#: One host in so many calibrates the limit.
FOLDS = 5
START = 2

#: (host suffix, start of the path, verdict)
Rule = tuple[str, str, str]

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWERED), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rule(rule: str, verdict: str) -> Rule:
    """``example.com/en/7``: the host and its subdomains, paths from ``/en/7`` on."""
    host, _, path = rule.partition("/")
    return host.lower(), f"/{path}", verdict


def rule_column(rules: list[Rule], host: Column, path: Column, value: int) -> Column:
    """Of the longest rule that fits: its text (value 0) or its verdict (value 1); null if none fits."""
    out = F.lit(None).cast("string")
    for own, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a later one is asked first
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.lit((own + start, verdict)[value])).otherwise(out)
    return out


def grams_of(url: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets; for each byte the n-gram of ``ORDER`` bytes that ends at it, as a number). URLs are lower-cased, a start mark fills what precedes them."""
    raw, offsets = text_buffer(url)
    c = LOWER[raw].astype(np.int64)
    place = np.arange(len(c)) - offsets[:-1][owners(offsets)]
    out = np.zeros(len(c), np.int64)
    for k in range(ORDER):
        before = np.full(len(c), START, np.int64)
        before[k:] = np.where(place[k:] >= k, c[: len(c) - k] if k else c, START)
        out |= before << (8 * k)
    return offsets, out


@dataclass
class MarkovPair:
    """Both models: a table (gram, good, bad) of the counts of all training n-grams of ``ORDER`` bytes, and the calibrated limit."""

    counts: DataFrame
    limit: float = 0.0


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` in blocks of at most a step's bytes of URLs, numbered by _block; written once, so that numbers stay."""

    def number(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(steps(batches, "_url")):
            yield with_columns(batch, _block=pa.array(np.full(batch.num_rows, first + i)))

    return materialize(rows.mapInArrow(number, _form(rows, "_block long")), "urls")


def _form(rows: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [more])


def _grams(blocks: DataFrame, accepted: Column) -> DataFrame:
    """(_block, gram, good, bad): each block's different n-grams, and how often rows have them where ``accepted`` is true and false."""

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in steps(batches, "_url"):
            offsets, grams = grams_of(batch.column("_url"))
            own = owners(offsets)
            right, block = (batch.column(c).to_numpy(zero_copy_only=False)[own] for c in ("_right", "_block"))
            for b in np.unique(block):
                here = block == b
                found, at = np.unique(grams[here], return_inverse=True)
                good, bad = (np.bincount(at[right[here] == x], minlength=len(found)) for x in (1, 0))
                yield pa.RecordBatch.from_pydict({"_block": pa.array(np.full(len(found), b)), "gram": pa.array(found), "good": pa.array(good.astype(np.int64)), "bad": pa.array(bad.astype(np.int64))})

    right = F.coalesce(accepted.cast("int"), F.lit(-1)).alias("_right")
    return materialize(blocks.select("_block", "_url", right).mapInArrow(count, "_block long, gram long, good long, bad long"), "url_grams")


def _ratios(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, ratio): log-likelihood difference of a byte after its context, accepted less rejected, for all of ``counts`` and ``grams``.

    Shorter n-grams' counts are sums over the longer ones that end in them, contexts' over the n-grams that begin with
    them. Every key that is joined has at most 256 rows.
    """
    level = counts.select("gram", "good", "bad").unionByName(grams.select("gram").distinct().select("gram", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad")))
    level = written = materialize(level.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url_level")
    levels = [level]
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        levels.insert(0, level)
    shorter = None
    for k, level in enumerate(levels):
        context = Window.partitionBy(F.shiftright("gram", 8))
        rows = level.select("gram", "good", "bad", F.sum("good").over(context).alias("goods"), F.sum("bad").over(context).alias("bads"))
        if shorter is None:
            rows = rows.withColumns({"p": F.lit(1 / 256), "q": F.lit(1 / 256)})
        else:
            rows = rows.withColumn("_end", F.col("gram").bitwiseAND((1 << 8 * k) - 1)).join(shorter, "_end")
        p, q = (F.col(n) + STRENGTH * F.col(x) for n, x in (("good", "p"), ("bad", "q")))
        shorter = rows.select(F.col("gram").alias("_end"), (p / (F.col("goods") + STRENGTH)).alias("p"), (q / (F.col("bads") + STRENGTH)).alias("q"))
    out = materialize(shorter.select(F.col("_end").alias("gram"), (F.log("p") - F.log("q")).alias("ratio")), "url_ratios")
    discard(written)
    return out


def _scored(blocks: DataFrame, grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``blocks`` without _block and _url, with url_score: log-likelihood difference a byte; 0 for null and empty URLs. A block meets the ratios of its own n-grams."""
    ratios = grams.select("_block", "gram").join(_ratios(counts, grams), "gram")

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        url = rows.column("_url").combine_chunks()
        offsets, found = grams_of(url)
        gram, ratio = (known.column(c).to_numpy() for c in ("gram", "ratio"))
        order = np.argsort(gram)
        logs = ratio[order][np.searchsorted(gram[order], found)] if len(found) else np.zeros(0)
        total = np.bincount(owners(offsets), logs, len(offsets) - 1)  # each URL by itself, so that equal ones get equal scores
        return rows.drop_columns(["_block", "_url"]).append_column("url_score", pa.array(total / np.maximum(np.diff(offsets), 1)))

    form = _form(blocks.drop("_block", "_url"), "url_score double")
    return blocks.groupBy("_block").cogroup(ratios.groupBy("_block")).applyInArrow(score, form)


def fit(urls: DataFrame, url: str, accepted: Column) -> MarkovPair | None:
    """Models of all rows of ``urls``: those where ``accepted`` is true, and those where it is false; null rows teach nothing. None unless both kinds occur.

    Counts are exact and kept in a table that grows with the URLs; scores are counted in fixed bins. The limit comes from
    one host in ``FOLDS``, scored by models of the other hosts, so that it does not rest on URLs the models know by heart; where
    either fold lacks one kind, all URLs serve for both.
    """
    held = F.pmod(F.xxhash64(host_of(F.col(url))), F.lit(FOLDS)) == 0
    rows = urls.select(F.col(url).alias("_url"), accepted.alias("accepted"), held.alias("held")).filter("_url is not null and accepted is not null")
    blocks = _blocks(rows)
    kinds = blocks.groupBy("held", "accepted").count().collect()
    if len({r.accepted for r in kinds}) < 2:
        discard(blocks)
        return None
    parts = len(kinds) == 4
    grams = _grams(blocks, F.col("accepted"))
    total = lambda g: g.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts = materialize(total(grams), "url_counts")
    if parts:
        own, unseen = _grams(blocks.filter("not held"), F.col("accepted")), blocks.filter("held")
        known, asked = materialize(total(own), "url_known"), _grams(unseen, F.lit(None))
        scores = _scored(unseen, asked, known)
    else:
        scores = _scored(blocks, grams, counts)

    def tally(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        for batch in batches:
            score = batch.column("url_score").to_numpy(zero_copy_only=False)
            bin_ = np.clip((score + MOST) * (BINS / (2 * MOST)), 0, BINS - 1).astype(np.int64)
            rejected = (~batch.column("accepted").to_numpy(zero_copy_only=False)).astype(np.int64)
            own[: 2 * BINS] += np.bincount(rejected * BINS + bin_, minlength=2 * BINS)

    good, bad = summed_arrays(scores, ["url_score", "accepted"], tally, 2 * BINS).reshape(2, BINS)
    discard(blocks, grams, *([own, known, asked] if parts else []))
    # the limit of best balanced accuracy; of a run of equally good ones, the middle
    lost, caught = np.concatenate([[0], np.cumsum(good)]) / good.sum(), np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(caught - lost >= (caught - lost).max() - 1e-12)
    run = best[: np.argmax(np.append(np.diff(best) > 1, True)) + 1]
    return MarkovPair(counts, float(run.mean() * (2 * MOST / BINS) - MOST))


def judge(pages: DataFrame, rules: list[Rule], model: MarkovPair | None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, url_score and verdict (allow or block).

    The longest rule that fits decides; else a URL is blocked whose score is below the model's limit. Null and empty
    URLs have no character to score: nothing speaks against them, and they are allowed. Without a model, all are that no
    rule blocks. Repeated rows get equal verdicts, an empty table stays empty, columns of these names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "url_score", "verdict")
    if model:
        blocks = _blocks(pages.withColumn("_url", F.coalesce(F.col(url), F.lit(""))))
        scored = _scored(blocks, _grams(blocks, F.lit(None)), model.counts)
    else:
        scored = pages.withColumn("url_score", F.lit(0.0))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    empty = F.coalesce(F.col(url), F.lit("")) == ""
    limit = F.lit(model.limit if model else 0.0)
    own = F.when(empty | (F.col("url_score") >= limit), "allow").otherwise("block")
    out = scored.withColumns({"host": host, "path": path})
    of = lambda value: rule_column(rules, F.col("host"), F.col("path"), value)
    return out.withColumns({"rule": of(0), "verdict": F.coalesce(of(1), own)})


#: Words in host names that mark a URL as rejected for training.
SEED_WORDS = ["adult", "ads", "bet", "bets", "casino", "cheap", "cialis", "dating", "free", "gambling", "jackpot", "lottery", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx"]


def seeded(url: Column, rules: list[Rule]) -> Column:
    """Training labels: false where the host has a seed word among its parts; else true, but null where a rule blocks, which is policy and says nothing about the URL."""
    host, path = host_of(url), path_of(url)
    marked = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, SEED_WORDS)))
    return F.when(marked, F.lit(False)).when(F.coalesce(rule_column(rules, host, path, 1), F.lit("allow")) == "allow", F.lit(True))
