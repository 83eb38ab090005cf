"""Tables from positioned words: row bands, rows by position, column corridors, cells; headings and the values below them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import placing

#: Width that x is scaled to; the share of rows that may cross a corridor; its least width, in pixels and as a share.
PAGE_WIDTH, CROSSING, GAP_PIXELS, GAP_SHARE = 1000, 0.06, 6, 0.010
ROW_TOLERANCE, LINE_TOLERANCE, PITCH = 0.55, 0.6, 0.18
#: So many rules make a grid; a rotated reading is tried if so many of its words are wider than high, in this order of rotations.
RULES, WIDE_SHARE, ROTATIONS = 3, 0.60, (270, 90, 0, 180)
PAGE = ["doc_id", "page_no"]


def centres(words: DataFrame) -> DataFrame:
    return words.withColumns({"xc": (F.col("x0") + F.col("x1")) / 2, "yc": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0")})


def row_bands(words: DataFrame, rules: DataFrame) -> DataFrame:
    """``words`` with visual_row: the band between neighbouring rules that holds their centre; words outside go, empty bands are not counted. rules: keys, y_rules (array)."""
    ys = F.sort_array("y_rules")
    inside = centres(words).join(rules, PAGE).withColumn("_b", F.size(F.filter(ys, lambda y: y <= F.col("yc")))).filter((F.col("_b") > 0) & (F.col("_b") < F.size("y_rules")))
    return inside.withColumn("visual_row", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("_b")) - 1).drop("_b", "y_rules")


def rows_by_position(words: DataFrame) -> DataFrame:
    """``words`` with visual_row where there are no rules: from top to bottom, a word joins the row whose mean centre is near enough.

    The running mean is no window function: pages become arrays, many to a batch, and are folded there.
    """
    placed = centres(words)
    row = F.struct("yc", "x0", "text", *[c for c in placed.columns if c not in (*PAGE, "yc", "x0", "text")])
    pages = placed.groupBy(*PAGE).agg(F.sort_array(F.collect_list(row)).alias("_w"), F.percentile(F.when(F.col("h") > 0, F.col("h")), 0.5).alias("_h"))  # a page's words
    pages = pages.withColumn("_y", F.transform("_w", lambda w: w["yc"]))

    @F.pandas_udf("array<int>")
    def fold(ys: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for centre, h in zip(ys, height, strict=True):
            limit = 12.0 if pd.isna(h) else ROW_TOLERANCE * h
            rows, at, total, n = [], -1, 0.0, 0
            for y in centre:
                if at < 0 or abs(y - total / n) > limit:
                    at, total, n = at + 1, 0.0, 0
                total, n = total + y, n + 1
                rows.append(at)
            out.append(rows)
        return pd.Series(out)

    found = pages.withColumn("_r", fold("_y", "_h")).select(*PAGE, F.explode(F.arrays_zip("_w", "_r")).alias("_z"))
    return found.select(*PAGE, "_z._w.*", F.col("_z._r").alias("visual_row"))


def lines(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """``words`` with line: a new one where a centre is farther from the one before than a share of the upper median height."""
    heights = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("y1") - F.col("y0"))).alias("_h"))
    limit = heights.select(*keys, (LINE_TOLERANCE * F.element_at("_h", F.floor(F.size("_h") / 2).cast("int") + 1)).alias("_limit"))
    w = Window.partitionBy(*keys).orderBy("yc", "x0", "text")
    marked = centres(words).join(limit, keys).withColumn("_new", (F.col("yc") - F.lag("yc").over(w) > F.col("_limit")).cast("int"))
    return marked.withColumn("line", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_limit", "_new")


def in_body(rows: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Row centres (keys, visual_row, centre) with in_body: the pitch to a neighbour is near the median pitch of a page of five rows or more."""
    w = Window.partitionBy(*keys).orderBy("visual_row")
    p = rows.withColumn("_up", F.col("centre") - F.lag("centre").over(w)).withColumn("_down", F.lead("centre").over(w) - F.col("centre"))
    med = p.groupBy(*keys).agg(F.median("_up").alias("_m"), F.count("*").alias("_n"))
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col("_m")) <= PITCH * F.col("_m"), F.lit(False))
    return p.join(med, keys).withColumn("in_body", (F.col("_n") >= 5) & (near("_up") | near("_down"))).drop("_up", "_down", "_m", "_n")


def longest_run(flags: DataFrame, keys: list[str], order: str = "visual_row", flag: str = "in_body", bridge: int = 1, least: int = 3) -> DataFrame:
    """keys, start and end of the longest run of true flags over gaps of at most ``bridge``; the first of equals; none shorter than ``least``. Orders are consecutive integers."""
    w = Window.partitionBy(*keys).orderBy(order)
    true = flags.filter(F.col(flag)).withColumn("_new", F.coalesce((F.col(order) - F.lag(order).over(w) > bridge + 1).cast("int"), F.lit(0)))
    island = true.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy(*keys, "_i").agg(F.min(order).alias("start"), F.max(order).alias("end"))
    best = runs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.col("end") - F.col("start")), "start")))
    return best.filter("_r = 1").filter(F.col("end") - F.col("start") + 1 >= least).select(*keys, "start", "end")


def merged_runs(positions: DataFrame, keys: list[str], gap: int = 4) -> DataFrame:
    """keys and centre of each run of positions that are at most ``gap`` apart: where rules lie. positions: keys, at."""
    w = Window.partitionBy(*keys).orderBy("at")
    new = positions.withColumn("_new", F.coalesce((F.col("at") - F.lag("at").over(w) > gap).cast("int"), F.lit(0)))
    runs = new.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(((F.min("at") + F.max("at")) / 2).alias("centre")).drop("_run")


def corridors(words: DataFrame, keys: list[str], width: int = PAGE_WIDTH) -> DataFrame:
    """keys and boundaries (array): outer edges, and the middles of corridors that hardly a row crosses. words: keys, row (id of a row), x0, x1 scaled to ``width``.

    Rows of two words or more vote, all rows where there are none. A sweep: each row's words merge into spans, a span
    adds one at its start and takes it back behind its end, and a running sum over at most ``width`` places counts the
    rows at each. Nothing is made per pixel.
    """
    last = width + 1  # places 0..last; corridors at either edge of the page are margins
    of_row = Window.partitionBy(*keys, "row")
    placed = words.select(*keys, "row", "x0", "x1", F.greatest(F.floor("x0"), F.lit(0)).alias("s"), F.least(F.ceil("x1"), F.lit(last)).alias("e")).filter("e >= s")
    before = of_row.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.withColumn("_multi", F.count("*").over(of_row) >= 2).withColumn("_reach", F.max("e").over(before))
    # a word that begins inside what came before adds only what reaches beyond it
    inside = F.coalesce(F.col("s") <= F.col("_reach") + 1, F.lit(False))
    start = F.when(inside, F.col("_reach") + 1).otherwise(F.col("s"))
    spans = spans.withColumn("s", start)
    edges = spans.groupBy(*keys, "_multi").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.count_if(F.col("_reach").isNull()).alias("n"))
    chosen = edges.groupBy(*keys).agg(F.max("_multi").alias("_multi"), *[F.max_by(c, "_multi").alias(c) for c in ("lo", "hi", "n")])
    ends = F.explode(F.array(F.struct(F.col("s").alias("x"), F.lit(1).alias("_delta")), F.struct((F.col("e") + 1).alias("x"), F.lit(-1).alias("_delta"))))
    deltas = spans.filter("e >= s").select(*keys, "_multi", ends.alias("_at")).groupBy(*keys, "_multi", "_at.x").agg(F.sum("_at._delta").alias("_delta"))
    deltas = deltas.join(chosen.select(*keys, "_multi"), [*keys, "_multi"]).select(*keys, "x", "_delta").unionByName(chosen.select(*keys, F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("_delta")))
    along = Window.partitionBy(*keys).orderBy("x")
    steps = deltas.groupBy(*keys, "x").agg(F.sum("_delta").alias("_delta")).filter(F.col("x") <= last)
    steps = steps.withColumn("c", F.sum("_delta").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.coalesce(F.lead("x").over(along) - 1, F.lit(last)))
    steps = steps.join(chosen.select(*keys, "n"), keys).withColumn("_free", F.col("c") <= F.greatest(F.lit(1), F.floor(CROSSING * F.col("n"))))
    runs = steps.withColumn("_g", F.sum((~F.col("_free")).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).filter("_free")
    gaps = runs.groupBy(*keys, "_g").agg(F.min("x").alias("a"), F.max("to").alias("b"))
    inner = gaps.filter((F.col("b") - F.col("a") + 1 >= max(GAP_PIXELS, int(GAP_SHARE * width))) & (F.col("a") > 0) & (F.col("b") < last))
    middles = inner.groupBy(*keys).agg(F.sort_array(F.collect_list((F.col("a") + F.col("b")) / 2)).alias("m"))  # at most a hundred
    out = chosen.join(middles, keys, "left")
    return out.select(*keys, F.concat(F.array("lo"), F.coalesce("m", F.array().cast("array<double>")), F.array("hi")).alias("boundaries"))


def ruled(rules: Column) -> Column:
    """Do a page's rules settle its rows or columns? Three do."""
    return F.coalesce(F.size(rules) >= RULES, F.lit(False))


def column_of(x: Column, boundaries: Column) -> Column:
    """The column that holds x; the nearest one outside."""
    return F.least(F.size(boundaries) - 2, F.greatest(F.lit(0), F.size(F.filter(boundaries, lambda b: b <= x)) - 1))


def assign_cells(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, visual_row, col_no, raw (words by x, one space between) and conf (the least). words: keys, visual_row, x0, x1, text, confidence, boundaries."""
    placed = words.withColumn("col_no", column_of((F.col("x0") + F.col("x1")) / 2, F.col("boundaries")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*keys, "visual_row", "col_no").agg(text.alias("raw"), F.min("confidence").alias("conf"))


#: What ``page_rows`` gets of a chunk's rows, beside document and page.
TABLES = "row_no int, cells array<string>, confs array<double>, kind string, grid boolean, top double, bottom double, page_height double"


def page_rows(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Positioned words as the engine's page rows: doc_id, page_no, table_no, row_no, cells, confs, kind, extractor, top, bottom, page_height.

    words: doc_id, page_no, text, x0, y0, x1, y1, confidence; pages: doc_id, page_no, width, height, kind, x_rules, y_rules (both null
    or arrays). Rows lie between a page's rules, or go by position; without rules the body is the longest run of rows on a regular
    pitch, and the table that and one row above. Pages without a clear pitch keep all rows. Columns are shared by a document's
    pages: the bodies of all pages without vertical rules are scaled to one width and swept once per document. A digital page
    gives a table if it has two rows and two columns; a scanned one always.

    Words are sorted by document once and placed many pages at a time (``placing``), a document's pages by one task. Pages and
    each of their rules come as further rows, not by a join and not as nested columns that all words would carry: words that lie by document stay there.
    """
    box = ["x0", "y0", "x1", "y1", "confidence"]
    no, part = F.lit(None).cast("double"), lambda kind, x, y=None, text=None: F.struct(F.lit(kind).alias("_part"), (F.lit(None).cast("string") if text is None else text.cast("string")).alias("text"), x.cast("double").alias("x0"), (F.lit(None) if y is None else y).cast("double").alias("y0"))
    rules = lambda name, kind: F.coalesce(F.transform(name, lambda x: part(kind, x)), F.array().cast("array<struct<_part:int,text:string,x0:double,y0:double>>"))
    parts = F.concat(F.array(part(placing.ABOUT, F.col("width"), F.col("height"), F.col("kind"))), rules("x_rules", placing.X_RULE), rules("y_rules", placing.Y_RULE))
    rows = pages.select(*PAGE, F.explode(parts).alias("_z")).select(*PAGE, "_z._part", "_z.text", "_z.x0", "_z.y0", no.alias("x1"), no.alias("y1"), no.alias("confidence"))
    rows = rows.unionByName(words.select(*PAGE, F.lit(placing.WORD).alias("_part"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("double").alias(c) for c in box]))
    order = Window.partitionBy("doc_id").orderBy("page_no", "_part", "x0", "text")  # a document's words lie together; the number says where it begins
    rows = rows.dropna(subset=PAGE).withColumn("_i", F.row_number().over(order))
    settings = {"width": PAGE_WIDTH, "crossing": CROSSING, "gap": max(GAP_PIXELS, int(GAP_SHARE * PAGE_WIDTH)), "tolerance": ROW_TOLERANCE, "pitch": PITCH, "rules": RULES, "chunk": placing.CHUNK, "long": placing.LONG}

    def run(batches):
        return placing.page_tables(batches, settings)

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*PAGE).schema)
    found = rows.mapInArrow(run, f"{keys}, {TABLES}")
    extractor = F.when(F.col("kind") != "scanned", "text-columns").when(F.col("grid"), "ocr-grid").otherwise("ocr-columns")
    return found.select(*PAGE, F.lit(0).alias("table_no"), "row_no", "cells", "confs", "kind", extractor.alias("extractor"), "top", "bottom", "page_height")


def choose_rotation(rotations: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """keys and rotation of the reading with most wide words, then most confidence. rotations: words with rotation."""
    r = rotations.groupBy(*keys, "rotation").agg(F.avg((F.col("x1") - F.col("x0") > F.col("y1") - F.col("y0")).cast("double")).alias("wide"), F.avg("confidence").alias("mean"))
    return r.groupBy(*keys).agg(F.max_by("rotation", F.struct("wide", "mean", -F.col("rotation"))).alias("rotation"))


# ------------------------------------------------------------------ headings and values

# Folded headings of the facts.
NEEDLES = [
    ("libelle", "libelleducertificat"), ("libelle", "libelledu"), ("prix_unitaire", "prixunitaire"), ("date_souscription", "datedesouscription"), ("date_souscription", "datesouscription"),
    ("date_remboursement", "datederemboursement"), ("date_remboursement", "dateremboursement"), ("montant", "montant"), ("quantite", "quantite"), ("taux", "taux"),
]


def heading_candidates(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Words with line, and each joined with those just below it on the next line: keys, text, x0, y0, x1, y1, h, parts."""
    a, b = words.alias("a"), words.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    gap = F.col("b.y0") - F.col("a.y1")
    share = S.overlap(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1"))
    pairs = a.join(b, [*on, F.col("b.line") == F.col("a.line") + 1, gap >= -0.5 * F.col("a.h"), gap <= 1.4 * F.col("a.h"), share >= 0.30])
    both = pairs.select(*[F.col(f"a.{k}") for k in keys], F.concat_ws(" ", "a.text", "b.text").alias("text"), F.least("a.x0", "b.x0").alias("x0"), F.col("a.y0").alias("y0"), F.greatest("a.x1", "b.x1").alias("x1"), F.col("b.y1").alias("y1"), F.lit(2).alias("parts"))
    return words.select(*keys, "text", "x0", "y0", "x1", "y1", F.lit(1).alias("parts")).unionByName(both)


def anchors(candidates: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """keys, fact, x0, x1, bottom of the heading of each fact: the candidate that its needle covers most, the part of it that the needle takes."""
    folded = candidates.withColumn("f", S.fold(F.col("text")))
    needles = F.array(*[F.struct(F.lit(fact).alias("fact"), F.lit(n).alias("needle"), F.lit(i).alias("rank")) for i, (fact, n) in enumerate(NEEDLES)])
    hit = folded.select("*", F.explode(F.filter(needles, lambda n: F.col("f").contains(n["needle"]))).alias("n"))
    at, size = F.instr(F.col("f"), F.col("n.needle")) - 1, F.length("n.needle")
    width = F.col("x1") - F.col("x0")
    placed = hit.select(*keys, "n.fact", "parts", "y0", (size / F.length("f")).alias("coverage"), (F.col("x0") + width * at / F.length("f")).alias("x0"), (F.col("x0") + width * (at + size) / F.length("f")).alias("x1"), F.col("y1").alias("bottom"), F.col("n.rank").alias("rank"))
    best = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "fact").orderBy(F.desc("coverage"), "rank", "parts", "y0", "x0")))
    return best.filter("_r = 1").select(*keys, "fact", "x0", "x1", "bottom")


def value_below(anchor: DataFrame, words: DataFrame, height: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """keys, fact, text, confidence of the word nearest below each anchor: it starts below, not far, and overlaps enough. height: keys, height of the page."""
    a, w = anchor.join(height, keys).alias("a"), words.alias("w")
    share = S.overlap(F.col("a.x0"), F.col("a.x1"), F.col("w.x0"), F.col("w.x1"))
    near = a.join(w, [*[F.col(f"a.{k}") == F.col(f"w.{k}") for k in keys], F.col("w.y0") >= F.col("a.bottom") - 2, F.col("w.y0") - F.col("a.bottom") <= 0.10 * F.col("a.height"), share >= 0.30])
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"a.{k}") for k in keys], "a.fact").orderBy("w.y0", F.desc(share), "w.x0", "w.text"))
    return near.withColumn("_r", rank).filter("_r = 1").select(*[F.col(f"a.{k}") for k in keys], "a.fact", "w.text", "w.confidence")


#: The facts, in the order in which ``_below`` gives their words.
FACTS = list(dict.fromkeys(fact for fact, _ in NEEDLES))


def _share(a0: float, a1: float, b0: float, b1: float) -> float:
    narrow = min(a1 - a0, b1 - b0)
    return max(0.0, min(a1, b1) - max(a0, b0)) / narrow if narrow > 0 else 0.0


def _headings(x0: list, y0: list, x1: list, y1: list, folded: list) -> dict[str, tuple]:
    """``lines``, ``heading_candidates`` and ``anchors`` of one page whose words are sorted by centre: for each fact that has a heading, x0, x1 and bottom."""
    tall = [b - a for a, b in zip(y0, y1, strict=True)]
    heights = sorted(h for h in tall if h == h)
    limit = LINE_TOLERANCE * heights[len(heights) // 2] if heights else float("inf")
    by_line: list[list[int]] = []
    for i in range(len(x0)):
        if not i or (y0[i] + y1[i]) / 2 - (y0[i - 1] + y1[i - 1]) / 2 > limit:
            by_line.append([])
        by_line[-1].append(i)
    best: dict[str, tuple] = {}

    def meet(f: str, parts: int, left: float, top: float, right: float, bottom: float) -> None:
        for rank, (fact, needle) in enumerate(NEEDLES):
            at = f.find(needle)
            if at >= 0:
                width, size, whole = right - left, len(needle), len(f)
                found = (-(size / whole), rank, parts, top, left + width * at / whole, left + width * (at + size) / whole, bottom)
                if fact not in best or found < best[fact]:
                    best[fact] = found

    for i, f in enumerate(folded):
        meet(f or "", 1, x0[i], y0[i], x1[i], y1[i])
    for upper, lower in zip(by_line, by_line[1:], strict=False):
        for i in upper:
            for j in lower:
                if -0.5 * tall[i] <= y0[j] - y1[i] <= 1.4 * tall[i] and _share(x0[i], x1[i], x0[j], x1[j]) >= 0.30:
                    meet((folded[i] or "") + (folded[j] or ""), 2, min(x0[i], x0[j]), y0[i], max(x1[i], x1[j]), y1[j])
    return {fact: found[4:] for fact, found in best.items()}


def _below(x0: list, y0: list, x1: list, y1: list, text: list, folded: list, height: float) -> list[int]:
    """``value_below`` of one page: the place of each fact's word among the page's, -1 where there is none."""
    heads, out = _headings(x0, y0, x1, y1, folded), []
    for fact in FACTS:
        best = None
        if fact in heads:
            left, right, bottom = heads[fact]
            for i in range(len(x0)):
                if y0[i] >= bottom - 2 and y0[i] - bottom <= 0.10 * height and (share := _share(left, right, x0[i], x1[i])) >= 0.30:
                    rank = (y0[i], -share, x0[i], text[i] is not None, text[i] or "", i)
                    best = rank if best is None or rank < best else best
        out.append(-1 if best is None else best[-1])
    return out


def _pages_of_words(words: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each page with words: keys, _words (its words from top to bottom), title, _wide (the share of words that are wider than high) and _height. Heights come as further rows, not by a join: words that lie by document stay there."""
    box = ["x0", "y0", "x1", "y1", "confidence"]
    yc = (F.col("y0") + F.col("y1")) / 2
    word = F.struct(yc.alias("yc"), "x0", "text", "y0", "x1", "y1", "confidence")
    rows = words.select(*keys, F.col("text").cast("string").alias("text"), *[F.col(c).cast("double").alias(c) for c in box], F.lit(True).alias("_word"), F.lit(None).cast("double").alias("_height"))
    rows = rows.unionByName(pages.select(*keys, F.lit(None).cast("string").alias("text"), *[F.lit(None).cast("double").alias(c) for c in box], F.lit(False).alias("_word"), F.col("height").cast("double").alias("_height")))
    heads = F.when(F.upper("text").contains("DECLARATION"), F.struct("y0", "x0", "text"))
    wide = F.avg((F.col("x1") - F.col("x0") > F.col("y1") - F.col("y0")).cast("double"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_word"), word))).alias("_words"), F.min(heads)["text"].alias("title"), wide.alias("_wide"), F.max("_height").alias("_height"))  # a page's words


def _facts_of_pages(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """``facts`` of what ``_pages_of_words`` gives: headings and values are found in the arrays, so that words are dealt out once and no join is planned for each step."""

    @F.pandas_udf("array<int>")
    def places(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, text: pd.Series, folded: pd.Series, height: pd.Series) -> pd.Series:
        rows = zip(x0, y0, x1, y1, text, folded, height, strict=True)
        return pd.Series([_below(*[v.tolist() for v in box], list(t), list(f), h) for *box, t, f, h in rows], dtype=object)

    once = places.asNondeterministic()  # else filters on what it found run it again
    of = lambda name: F.transform("_words", lambda w: w[name])
    folded = F.transform("_words", lambda w: S.fold(w["text"]))
    found = grouped.filter((F.size("_words") > 0) & F.col("_height").isNotNull()).dropna(subset=keys)
    found = found.withColumn("_at", once(of("x0"), of("y0"), of("x1"), of("y1"), of("text"), folded, "_height"))
    word = lambda i: F.when(F.col("_at")[i] >= 0, F.get("_words", F.col("_at")[i]))
    raw = found.select(*keys, "title", *[word(i)["text"].alias(fact) for i, fact in enumerate(FACTS)], F.array_min(F.array(*[word(i)["confidence"] for i in range(len(FACTS))])).alias("confidence"))
    comma = lambda c: S.parse_amount(F.col(c), F.lit(","))
    out = raw.select(
        *keys, "title", F.coalesce(S.first_percent(F.col("taux")), S.first_percent(F.col("libelle"))).alias("taux"), S.first_int(F.col("quantite")).alias("quantite"),
        S.first_date(F.col("date_souscription")).alias("date_souscription"), S.first_date(F.col("date_remboursement")).alias("date_remboursement"),
        comma("prix_unitaire").alias("prix_unitaire"), comma("montant").alias("montant"), "libelle", "confidence",
    )
    return out.dropna(subset=["taux", "quantite", "date_souscription", "date_remboursement"])


def facts(words: DataFrame, pages: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """The facts of declaration pages that have all of rate, quantity and both dates. pages: keys, height."""
    return _facts_of_pages(_pages_of_words(words, pages, keys), keys)


def declaration_facts(words: DataFrame, pages: DataFrame) -> DataFrame:
    """The facts of each declaration page, from the first of its rotated readings that gives them. words: readings with rotation; pages: doc_id, page_no, rotation, height.

    A reading is tried only if enough of its words are wider than high.
    """
    keys = [*PAGE, "rotation"]
    found = _facts_of_pages(_pages_of_words(words, pages, keys).filter(F.col("_wide") >= WIDE_SHARE), keys)
    order = F.array_position(F.array(*map(F.lit, ROTATIONS)), F.col("rotation"))
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.when(order > 0, order).otherwise(len(ROTATIONS) + 1), "rotation"))
    return found.withColumn("_r", first).filter("_r = 1").drop("_r")
