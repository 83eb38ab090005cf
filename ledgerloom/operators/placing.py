"""Rows and cells of many pages at once: what ``geometry`` says of one page and one document, over arrays of all words of a chunk.

Rows come sorted by document, page, part, x0 and text: a page's size and kind, its rules, its words. A document's pages share their
columns, so a chunk holds whole documents; of a longer one, the placed parts wait in an anonymous file until its end.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts of a page, in order: x0, y0 and text are its width, height and kind; x0 is where a rule lies; a word.
ABOUT, X_RULE, Y_RULE, WORD = range(4)
#: Words that are placed at once, and so many from which on a document is taken in parts.
CHUNK, LONG = 100_000, 400_000
#: So many documents are swept at once at most.
DOCUMENTS = 2000
#: Pages beyond the longest so many are folded together, a word of each at a time.
LONGEST = 32


def _starts(of: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)


def _medians(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The median of each group 0..n-1; NaN where it is empty."""
    out, order = np.full(n, np.nan), np.lexsort((values, of))
    count = np.bincount(of, minlength=n)
    first, some = np.cumsum(count) - count, count > 0
    v, m = values[order], count // 2
    upper, lower = v[(first + m)[some]], v[(first + (count - 1) // 2)[some]]
    out[some] = np.where(count[some] % 2 == 1, upper, (lower + upper) / 2)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float, copy=False)


def by_place(centre: list, limit: float) -> list[int]:
    """Rows from top to bottom: a word joins the row whose mean centre is within ``limit``."""
    rows, at, total, n = [], -1, 0.0, 0
    for y in centre:
        if at < 0 or abs(y - total / n) > limit:
            at, total, n = at + 1, 0.0, 0
        total, n = total + y, n + 1
        rows.append(at)
    return rows


def _by_place(centre: np.ndarray, first: np.ndarray, size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """``by_place`` of many pages, whose words lie at first..first+size-1."""
    out = np.zeros(len(centre), np.int64)
    order = np.argsort(-size, kind="stable")
    for p in order[:LONGEST]:
        a, b = first[p], first[p] + size[p]
        out[a:b] = by_place(centre[a:b].tolist(), limit[p])
    rest = order[LONGEST:]
    at, total, n = np.full(len(rest), -1), np.zeros(len(rest)), np.ones(len(rest))
    left = size[rest]
    for k in range(int(left[0]) if len(rest) else 0):
        m = int(np.searchsorted(-left, -k, side="left"))  # pages of more than k words
        i = first[rest[:m]] + k
        y = centre[i]
        new = (np.abs(y - total[:m] / n[:m]) > limit[rest[:m]]) | (k == 0)
        at[:m] += new
        total[:m] = np.where(new, 0.0, total[:m]) + y
        n[:m] = np.where(new, 0, n[:m]) + 1
        out[i] = at[:m]
    return out


def _by_rules(centre: np.ndarray, page: np.ndarray, rules: np.ndarray, ruled_page: np.ndarray, n: int) -> np.ndarray:
    """Rows between a page's rules, -1 outside; empty bands are not counted. Words are sorted by page and centre."""
    of = np.r_[ruled_page, page]
    word = np.r_[np.zeros(len(rules), np.int64), np.ones(len(page), np.int64)]
    order = np.lexsort((word, np.r_[rules, centre], of))
    above = np.cumsum(1 - word[order])
    found = np.empty(len(of), np.int64)
    found[order] = above
    count = np.bincount(ruled_page, minlength=n)
    band = found[len(rules) :] - (np.cumsum(count) - count)[page]
    out = np.full(len(page), -1)
    inside = np.flatnonzero((band > 0) & (band < count[page]))
    if len(inside):
        p, b = page[inside], band[inside]
        top = np.r_[True, p[1:] != p[:-1]]
        seen = np.cumsum(top | np.r_[True, b[1:] != b[:-1]])
        out[inside] = seen - seen[np.flatnonzero(top)][np.cumsum(top) - 1]
    return out


def _bands(centre: np.ndarray, row: np.ndarray, page: np.ndarray, n: int, pitch_share: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of each page's longest run of rows on the median pitch; all rows where there is none. Words are sorted by page and centre."""
    count = np.zeros(n, np.int64)
    np.maximum.at(count, page, row + 1)
    first, last = np.zeros(n, np.int64), count - 1
    base = np.cumsum(count) - count
    total = int(count.sum())
    at = base[page] + row
    mean = np.bincount(at, weights=centre, minlength=total) / np.bincount(at, minlength=total)
    of = np.repeat(np.arange(n), count)
    pairs = np.flatnonzero((of[1:] == of[:-1]) & (count[of[1:]] >= 5))
    pitch, pair_of = mean[pairs + 1] - mean[pairs], of[pairs]
    mid = _medians(pitch, pair_of, n)[pair_of]
    near = pairs[np.abs(pitch - mid) <= pitch_share * mid]
    flag = np.zeros(total, bool)
    flag[near] = flag[near + 1] = True
    true = np.flatnonzero(flag)
    if len(true):
        new = np.flatnonzero(np.r_[True, (of[true[1:]] != of[true[:-1]]) | (true[1:] - true[:-1] > 2)])
        begin, end = true[new], true[np.r_[new[1:] - 1, len(true) - 1]]
        best = np.lexsort((begin, begin - end, of[begin]))
        best = best[_starts(of[begin][best])]
        best = best[end[best] - begin[best] + 1 >= 3]
        p = of[begin[best]]
        first[p], last[p] = begin[best] - base[p], end[best] - base[p]
    return first, last


class Chunk:
    """Words of whole pages with their rows. ``rows``: the table that ``geometry.page_rows`` sends, or what ``kept`` gave."""

    def __init__(self, rows: pa.Table, s: dict, at: np.ndarray | None = None):
        self.s, self.rows = s, rows.combine_chunks()
        self.batch = {c: (x.chunk(0) if (x := self.rows[c]).num_chunks else pa.array([], x.type)) for c in self.rows.column_names}
        number = self.batch["_i"].to_numpy()
        no = self.batch["page_no"].to_numpy(zero_copy_only=False)
        fresh = np.r_[True, (no[1:] != no[:-1]) | (number[1:] == 1)]
        begin = np.flatnonzero(fresh)
        part = self.batch["_part"].to_numpy()
        about = begin[part[begin] == ABOUT]  # pages that are not in ``pages`` have no row
        n = len(about)
        page = np.cumsum(fresh) - 1
        known = np.full(len(begin), -1)
        known[page[about]] = np.arange(n)
        page = known[page]
        self.at_page, self.n = about, n
        self.doc = (np.cumsum(np.r_[True, number[1:] == 1]) - 1)[about]
        self.docs = int(np.count_nonzero(number[1:] == 1)) + 1
        word = np.flatnonzero((part == WORD) & (page >= 0))
        self.word, self.page = word, page[word]
        self.x0, self.x1, self.y0, self.y1 = (_numbers(self.batch[c])[word] for c in ("x0", "x1", "y0", "y1"))
        x0 = _numbers(self.batch["x0"])
        self.width, self.height, self.kind = x0[about], self.batch["y0"].take(pa.array(about)), self.batch["text"].take(pa.array(about))
        x_rule, y_rule = (np.flatnonzero((part == k) & (page >= 0)) for k in (X_RULE, Y_RULE))
        self.x_rules, self.y_rules = ((np.bincount(page[i], minlength=n), x0[i]) for i in (x_rule, y_rule))
        self.grid = self.x_rules[0] >= s["rules"]
        self.at = self.place() if at is None else at[word]

    def place(self) -> np.ndarray:
        """For each word -1 where it is in no row, else four times its row, plus two in the table's body, plus one in the table."""
        s, n = self.s, self.n
        out, yc = np.full(len(self.word), -1), (self.y0 + self.y1) / 2
        order = np.lexsort((yc, self.page))
        order = order[~np.isnan(yc[order])]
        count, rules = self.y_rules
        ruled = count >= s["rules"]
        by_rule = ruled[self.page[order]]
        w = order[by_rule]
        of_rule = np.repeat(np.arange(n), count)
        row = _by_rules(yc[w], self.page[w], rules[ruled[of_rule]], of_rule[ruled[of_rule]], n)
        out[w] = np.where(row < 0, -1, 4 * row + 3)
        w = order[~by_rule]
        if len(w):
            p, high = self.page[w], (self.y1 - self.y0)[w]
            typical = _medians(high[high > 0], p[high > 0], n)
            limit = np.where(np.isnan(typical), 12.0, s["tolerance"] * typical)
            size = np.bincount(p, minlength=n)
            row = _by_place(yc[w], np.cumsum(size) - size, size, limit)
            a, b = _bands(yc[w], row, p, n, s["pitch"])
            out[w] = 4 * row + 2 * ((a[p] <= row) & (row <= b[p])) + ((a[p] - 1 <= row) & (row <= b[p]))
        return out

    def kept(self) -> pa.Table:
        at = np.full(self.rows.num_rows, -1)
        at[self.word] = self.at
        return self.rows.append_column("_at", pa.array(at))

    def sweep(self) -> dict[str, np.ndarray]:
        """By document, and for rows of one word (0) and more (1): how many rows begin and end to cover each place, least x0, largest x1, number of rows."""
        last, docs = self.s["width"] + 1, self.docs
        out = {"delta": np.zeros((docs, 2, last + 2), np.int32), "lo": np.full((docs, 2), np.inf), "hi": np.full((docs, 2), -np.inf), "n": np.zeros((docs, 2), np.int64)}
        i = np.flatnonzero((self.at >= 0) & (self.at % 4 >= 2) & (~self.grid & (self.width > 0))[self.page])
        p = self.page[i]
        scale = self.s["width"] / self.width[p]
        x0, x1 = self.x0[i] * scale, self.x1[i] * scale
        s, e = np.fmax(np.floor(x0), 0), np.fmin(np.ceil(x1), last)
        use = e >= s
        if not use.any():
            return out
        row = (p * (int(self.at.max()) // 4 + 1) + self.at[i] // 4)[use]
        p, x0, x1, s, e = p[use], x0[use], x1[use], s[use].astype(np.int64), e[use].astype(np.int64)
        order = np.lexsort((e, s, row))
        row, p, x0, x1, s, e = row[order], p[order], x0[order], x1[order], s[order], e[order]
        begin = _starts(row)
        size = np.diff(np.r_[begin, len(row)])
        many = np.repeat(size >= 2, size).astype(np.int64)
        step = np.repeat(np.arange(len(begin)), size) * 2 * (last + 2)
        reach = np.r_[-2, np.maximum.accumulate(e + step)[:-1]] - step + 1
        s = np.where(s <= reach, reach, s)  # a word that begins inside what came before adds only what reaches beyond it
        at = self.doc[p] * 2 + many
        new = e >= s
        flat = out["delta"].reshape(-1)
        flat += np.bincount((at * (last + 2) + s)[new], minlength=len(flat)) - np.bincount((at * (last + 2) + e + 1)[new], minlength=len(flat))
        np.fmin.at(out["lo"].reshape(-1), at, x0)
        np.fmax.at(out["hi"].reshape(-1), at, x1)
        out["n"] += np.bincount(at[begin], minlength=2 * docs).reshape(docs, 2)
        return out

    def table(self, boundaries: list[np.ndarray | None]) -> pa.RecordBatch | None:
        """The rows of tables, with the columns of their documents."""
        n_shared = np.array([0 if b is None else len(b) for b in boundaries])[self.doc]
        n_bounds = np.where(self.grid, self.x_rules[0], n_shared)
        bounds = np.full((self.n, int(n_bounds.max(initial=0))), np.inf)
        shared = np.full((len(boundaries), bounds.shape[1]), np.inf)
        for d, b in enumerate(boundaries):
            if b is not None:  # no page of this chunk has more than there is room for
                shared[d, : len(b)] = b[: bounds.shape[1]]
        free = np.flatnonzero(~self.grid)
        bounds[free] = shared[self.doc[free]]
        within = np.arange(bounds.shape[1]) < n_bounds[:, None]
        bounds[free] = np.where(within[free], bounds[free] * self.width[free, None] / self.s["width"], np.inf)
        size, rules = self.x_rules
        of = np.repeat(np.arange(self.n), size)
        order = np.lexsort((rules, of))
        ruled = self.grid[of]
        bounds[of[ruled], (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size))[ruled]] = rules[order][ruled]
        i = np.flatnonzero((self.at >= 0) & (self.at % 2 == 1) & (n_bounds > 0)[self.page])
        if not len(i):
            return None
        p, n_cols = self.page[i], n_bounds - 1
        col, xc = np.full(len(i), -1), (self.x0[i] + self.x1[i]) / 2
        for k in range(bounds.shape[1]):
            col += bounds[p, k] <= xc
        col = np.minimum(n_cols[p] - 1, np.maximum(0, col))
        row = p * (int(self.at.max()) // 4 + 1) + self.at[i] // 4
        order = np.argsort(row * (int(n_cols.max()) + 1) + col, kind="stable")
        i, p, col, row = i[order], p[order], col[order], row[order]
        cell = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])])
        text = self.batch["text"].take(pa.array(self.word[i]))
        ends = np.r_[cell, len(i)]
        if text.null_count:
            ends = np.r_[0, np.cumsum(text.is_valid().to_numpy(zero_copy_only=False))][ends]
            text = text.drop_null()
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text), " ")
        conf = np.fmin.reduceat(_numbers(self.batch["confidence"])[self.word[i]], cell)
        conf = np.where(np.isnan(conf), 1.0, conf)
        page_at = _starts(p)
        top, bottom = np.full(self.n, np.nan), np.full(self.n, np.nan)
        top[p[page_at]], bottom[p[page_at]] = np.fmin.reduceat(self.y0[i], page_at), np.fmax.reduceat(self.y1[i], page_at)
        # rows: those with a cell that is not blank, of scans and of pages with two rows and columns
        row_at = _starts(row[cell])
        said = pc.greater(pc.binary_length(pc.utf8_trim(raw, " ")), 0).to_numpy(zero_copy_only=False)
        said = np.logical_or.reduceat(said, row_at)
        of_row = p[cell[row_at]]
        scanned = pc.fill_null(pc.equal(self.kind, "scanned"), False).to_numpy(zero_copy_only=False)
        whole = scanned | ((np.bincount(of_row[said], minlength=self.n) >= 2) & (n_cols >= 2))
        keep = said & whole[of_row]
        if not keep.any():
            return None
        kept = of_row[keep]
        begin = _starts(kept)
        row_no = np.arange(len(kept)) - np.repeat(begin, np.diff(np.r_[begin, len(kept)]))
        at = np.cumsum(np.r_[0, n_cols[kept]])
        cells_of = np.diff(np.r_[row_at, len(cell)])
        use = np.repeat(keep, cells_of)
        source = np.full(int(at[-1]), -1)
        source[np.repeat(at[:-1], cells_of[keep]) + col[cell][use]] = np.flatnonzero(use)
        cells = raw.take(pa.array(source, mask=source < 0)).fill_null("")
        confs = np.where(source < 0, 1.0, conf[source])
        lists, pages, head = pa.array(at, pa.int32()), pa.array(kept), pa.array(self.at_page[kept])
        return pa.RecordBatch.from_pydict({
            "doc_id": self.batch["doc_id"].take(head), "page_no": self.batch["page_no"].take(head), "row_no": pa.array(row_no, pa.int32()),
            "cells": pa.ListArray.from_arrays(lists, cells), "confs": pa.ListArray.from_arrays(lists, pa.array(confs)), "kind": self.kind.take(pages),
            "grid": pa.array(self.grid[kept]), "top": pa.array(top[kept], from_pandas=True), "bottom": pa.array(bottom[kept], from_pandas=True), "page_height": self.height.take(pages),
        })


def columns(sweep: dict[str, np.ndarray], s: dict) -> list[np.ndarray | None]:
    """``geometry.corridors`` of each document from what its pages have swept; None where no page has."""
    last = s["width"] + 1
    n_docs = np.arange(len(sweep["n"]))
    many = (sweep["n"][:, 1] > 0).astype(np.int64)
    lo, hi, n = (sweep[k][n_docs, many] for k in ("lo", "hi", "n"))
    out: list[np.ndarray | None] = []
    for a in range(0, len(n_docs), 1000):
        d = n_docs[a : a + 1000]
        cover = np.cumsum(sweep["delta"][d, many[d], : last + 1], axis=1)
        free = np.zeros((len(d), last + 3), np.int8)
        free[:, 1:-1] = cover <= np.maximum(1, np.floor(s["crossing"] * n[d]))[:, None]
        edge = np.diff(free, axis=1)
        doc, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        inner = (end - begin + 1 >= s["gap"]) & (begin > 0) & (end < last)
        doc, middle = doc[inner], (begin[inner] + end[inner]) / 2
        cut = np.searchsorted(doc, np.arange(len(d) + 1))
        out += [np.r_[lo[k], middle[cut[j] : cut[j + 1]], hi[k]] if n[k] else None for j, k in enumerate(d)]
    return out


def _added(a: dict | None, b: dict) -> dict:
    return b if a is None else {"delta": a["delta"] + b["delta"], "lo": np.fmin(a["lo"], b["lo"]), "hi": np.fmax(a["hi"], b["hi"]), "n": a["n"] + b["n"]}


def _few(rows: pa.Table, docs: np.ndarray) -> Iterator[tuple[pa.Table, bool]]:
    for a, b in zip(cuts := [*docs[::DOCUMENTS], rows.num_rows], cuts[1:], strict=False):
        yield rows.slice(a, b - a), True


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, long: int) -> Iterator[tuple[pa.Table, bool]]:
    """(rows, do they end with a document's end): whole documents, or whole pages of one that is long."""
    have: list[pa.RecordBatch] = []
    seen, least = 0, chunk
    for b in batches:
        if b.num_rows:
            have.append(b)
            seen += b.num_rows
        if seen < least:
            continue
        rows = pa.Table.from_batches(have)
        number = rows["_i"].to_numpy()
        docs = np.flatnonzero(np.r_[True, number[1:] == 1])
        at, ends = int(docs[-1]), True
        if not at and seen >= long:
            no = rows["page_no"].to_numpy()
            at, ends = int(np.flatnonzero(np.r_[True, no[1:] != no[:-1]])[-1]), False
        if at and ends:
            yield from _few(rows.slice(0, at), docs[:-1])
        elif at:
            yield rows.slice(0, at), False
        have = rows.slice(at).to_batches()
        seen -= at
        least = max(chunk, seen * 3 // 2)  # a document or page that has not ended is not looked through at each batch
    if have:
        rows = pa.Table.from_batches(have)
        yield from _few(rows, np.flatnonzero(np.r_[True, rows["_i"].to_numpy()[1:] == 1]))


def page_tables(batches: Iterator[pa.RecordBatch], s: dict) -> Iterator[pa.RecordBatch]:
    """Rows of ``geometry.page_rows`` of a partition's words. s: its settings."""
    parts, swept, waits = None, None, None
    try:
        for rows, ends in _cut(batches, s["chunk"], s["long"]):
            while rows.num_rows:
                more = None
                if parts is not None and ends:  # the rest of the long document, then others
                    after = np.flatnonzero(rows["_i"].to_numpy() == 1)
                    after = int(after[0]) if len(after) else rows.num_rows
                    rows, more = rows.slice(0, after), rows.slice(after)
                if not rows.num_rows:
                    found = None
                else:
                    found = Chunk(rows, s)
                    sweep = found.sweep()
                if parts is None and ends:
                    if (out := found.table(columns(sweep, s))) is not None:
                        yield out
                    break
                if found is not None:
                    table = found.kept()
                    if parts is None:
                        parts = tempfile.TemporaryFile()
                        waits = pa.ipc.new_stream(parts, table.schema)
                    waits.write_table(table)
                    swept = _added(swept, sweep)
                if not ends:
                    break
                waits.close()
                yield from _released(parts, columns(swept, s), s)
                parts.close()
                parts, swept, waits = None, None, None
                rows = more
    finally:
        if parts is not None:
            parts.close()


def _released(parts, bounds: list, s: dict) -> Iterator[pa.RecordBatch]:
    parts.seek(0)
    for batch in pa.ipc.open_stream(parts):
        table = pa.Table.from_batches([batch])
        if (out := Chunk(table.drop_columns("_at"), s, table["_at"].to_numpy()).table(bounds)) is not None:
            yield out
