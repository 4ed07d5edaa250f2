"""Pages back into items: words to cells, cells to rows, rows to lines and tables.

Clustering is greedy and depends on order, so it can't be a set operation: one page is one group, worked on with numpy, and pages are spread over all tasks.
Words are taken by (y0, x0) and by word_no where those are equal, so the order in which rows arrive makes no difference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Gaps and overlaps in points or shares.
GAP_LOW, GAP_HIGH, X_OVERLAP, ROW_OVERLAP = -1.0, 6.0, 0.5, 0.35
REPAIR_GAP, TABLE_GAP = 22.0, 1.8
OPEN, CLOSE, EMPTY = "【表格】", "【/表格】", "—"
ITEM = "doc string, page int, item_no int, kind string, text string"


def _is_close(c: str) -> bool:
    return c in ".,%" or c.isdigit() or "一" <= c <= "鿿"


def glue(before: str, after: str) -> str:
    """What goes between two parts of a wrapped cell: a blank only between words of letters."""
    return " " if before and after and not _is_close(before[-1]) and not _is_close(after[0]) else ""


def has_digit(s: str) -> bool:
    return any(c.isdigit() for c in s)


class Boxes:
    """Growing boxes with text, as columns."""

    def __init__(self, most: int):
        self.x0, self.y0, self.x1, self.y1 = (np.zeros(most) for _ in range(4))
        self.text: list[str] = []

    def add(self, box, text: str) -> None:
        k = len(self.text)
        self.x0[k], self.y0[k], self.x1[k], self.y1[k] = box
        self.text.append(text)

    def grow(self, k: int, box, text: str) -> None:
        self.x0[k], self.y0[k] = min(self.x0[k], box[0]), min(self.y0[k], box[1])
        self.x1[k], self.y1[k] = max(self.x1[k], box[2]), max(self.y1[k], box[3])
        self.text[k] += glue(self.text[k], text) + text


def cells_of(words: pd.DataFrame) -> Boxes:
    """Words that continue a cell (just below it, in its column) are added to the lowest such cell."""
    out = Boxes(len(words))
    for w in words.sort_values(["y0", "x0", "word_no"], kind="stable").itertuples():
        n, box = len(out.text), (w.x0, w.y0, w.x1, w.y1)
        gap = w.y0 - out.y1[:n]
        shared = np.minimum(w.x1, out.x1[:n]) - np.maximum(w.x0, out.x0[:n])
        narrow = np.minimum(w.x1 - w.x0, out.x1[:n] - out.x0[:n])
        with np.errstate(divide="ignore", invalid="ignore"):
            fits = (gap >= GAP_LOW) & (gap <= GAP_HIGH) & (narrow > 0) & (shared / narrow >= X_OVERLAP)
        if fits.any():
            out.grow(int(np.where(fits, out.y1[:n], -np.inf).argmax()), box, w.text)
        else:
            out.add(box, w.text)
    return out


def rows_of(cells: Boxes) -> list[dict]:
    """Rows from top to bottom, cells from left to right: a cell joins the first row that has a cell beside it."""
    n = len(cells.text)
    order = np.lexsort((np.arange(n), cells.x0[:n], cells.y0[:n]))
    row = np.full(n, -1)
    count = 0
    for k in order:
        done = np.flatnonzero(row >= 0)
        shared = np.minimum(cells.y1[k], cells.y1[done]) - np.maximum(cells.y0[k], cells.y0[done])
        height = np.minimum(max(1e-6, cells.y1[k] - cells.y0[k]), np.maximum(1e-6, cells.y1[done] - cells.y0[done]))
        beside = row[done[(shared > 0) & (shared / height >= ROW_OVERLAP)]]
        row[k] = beside.min() if len(beside) else count
        count += not len(beside)
    out = []
    for r in range(count):
        mine = [k for k in order if row[k] == r]
        mine.sort(key=lambda k: cells.x0[k])
        out.append({"y0": min(cells.y0[k] for k in mine), "y1": max(cells.y1[k] for k in mine), "cells": [cells.text[k] for k in mine]})
    return sorted(out, key=lambda r: r["y0"])


def repaired(rows: list[dict]) -> list[dict]:
    """A label row, the row of its numbers, and the label's tail become one row."""
    is_label = lambda r: len(r["cells"]) == 1 and not has_digit(r["cells"][0])
    left, out = list(reversed(rows)), []
    while left:
        r = left.pop()
        if is_label(r) and left and all(map(has_digit, left[-1]["cells"])) and left[-1]["y0"] - r["y1"] < REPAIR_GAP:
            numbers = left.pop()
            label, bottom = r["cells"][0], max(r["y1"], numbers["y1"])
            if left and is_label(left[-1]) and left[-1]["y0"] - bottom < REPAIR_GAP:
                tail = left.pop()
                label, bottom = label + glue(label, tail["cells"][0]) + tail["cells"][0], max(bottom, tail["y1"])
            r = {"y0": r["y0"], "y1": bottom, "cells": [label, *numbers["cells"]]}
        out.append(r)
    return out


def blocks_of(rows: list[dict]) -> list[tuple[int, int]]:
    """Runs (from, to) of two or more rows with several cells, cut before the first gap that is much wider than the run's upper median gap."""
    out, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and len(rows[j]["cells"]) > 1:
            j += 1
        if j - i >= 2:
            gaps = np.diff([r["y0"] for r in rows[i:j]])
            usual = np.sort(gaps)[len(gaps) // 2]
            wide = np.flatnonzero(gaps > usual * TABLE_GAP) if usual > 0 else []
            j = i + int(wide[0]) + 1 if len(wide) else j
        if j - i >= 2:
            out.append((i, j))
        i = max(j, i + 1)
    return out


def items_of(rows: list[dict]) -> list[tuple[str, str]]:
    """(kind, text): tables with a marker before and after them, lines for all other rows."""
    out, tables = [], dict(blocks_of(rows))
    i = 0
    while i < len(rows):
        if i in tables:
            block = [r["cells"] for r in rows[i : tables[i]]]
            width = max(map(len, block))
            out.append(("table", OPEN))
            out += [("table", " | ".join([c.strip() or EMPTY for c in r] + [EMPTY] * (width - len(r)))) for r in block]
            out.append(("table", CLOSE))
            i = tables[i]
        else:
            cells = rows[i]["cells"]
            out.append(("line", cells[0] if len(cells) == 1 else " ".join(c for c in cells if c.strip())))
            i += 1
    return out


def page_items(words: DataFrame) -> DataFrame:
    """doc, page, item_no, kind, text from words (doc, page, word_no, x0, y0, x1, y1, text)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = items_of(repaired(rows_of(cells_of(pdf))))
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "page": pdf["page"].iloc[0], "item_no": range(len(got)), "kind": [k for k, _ in got], "text": [t for _, t in got]})

    return words.groupBy("doc", "page").applyInPandas(run, ITEM)


def recognised_items(pages: DataFrame) -> DataFrame:
    """doc, page, item_no, kind, text of pages whose text was recognised: a line each, blank ones left out."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("n", "text")).where(T.strip(F.col("text")) != "")
    return lines.select("doc", "page", F.col("n").cast("int").alias("item_no"), F.lit("line").alias("kind"), T.strip(F.col("text")).alias("text"))
