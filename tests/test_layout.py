import random

import pandas as pd

from tessera.operators import furniture as FU
from tessera.operators import layout as LY
from tessera.plans.text_queries import WORDS


def test_pages(spark):
    words = spark.createDataFrame(WORDS, "doc string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [(r.page, r.kind, r.text) for r in LY.page_items(words).orderBy("page", "item_no").collect()]
    assert got == [(1, "line", "Title"), (1, "table", LY.OPEN), (1, "table", "归属于股东 | 3,925.60"), (1, "table", "net | 12.5%"), (1, "table", LY.CLOSE), (2, "line", "label tail 1 2")]


def test_order_of_arrival_makes_no_difference():
    rng = random.Random(0)
    for _ in range(20):
        words = [("d", 1, i, rng.randrange(0, 400, 7), rng.randrange(0, 300, 5), 0.0, 0.0, rng.choice(["a", "12", "好", "x.", "tail"])) for i in range(40)]
        words = [(d, p, i, float(x), float(y), x + 30.0, y + 9.0, t) for d, p, i, x, y, _, _, t in words]
        cols = ["doc", "page", "word_no", "x0", "y0", "x1", "y1", "text"]
        seen = set()
        for _ in range(4):
            rng.shuffle(words)
            seen.add(str(LY.items_of(LY.repaired(LY.rows_of(LY.cells_of(pd.DataFrame(words, columns=cols)))))))
        assert len(seen) == 1


def test_blocks():
    rows = [{"y0": float(y), "y1": y + 5.0, "cells": ["a", "b"][:n]} for y, n in [(0, 2), (10, 2), (20, 2), (60, 2), (70, 2), (80, 1), (90, 2), (100, 1)]]
    assert LY.blocks_of(rows) == [(0, 3), (3, 5)]
    assert [k for k, _ in LY.items_of(rows)].count("line") == 3
    wide = [{"y0": 0.0, "y1": 5.0, "cells": ["a", " ", "c"]}, {"y0": 10.0, "y1": 15.0, "cells": ["d", "e"]}]
    assert [t for _, t in LY.items_of(wide)] == [LY.OPEN, "a | — | c", "d | e | —", LY.CLOSE]


def test_repair():
    r = lambda y, *c: {"y0": float(y), "y1": y + 8.0, "cells": list(c)}
    got = LY.repaired([r(0, "label"), r(20, "1", "2"), r(40, "tail"), r(100, "label"), r(140, "5"), r(150, "x", "1")])
    assert [x["cells"] for x in got] == [["label tail", "1", "2"], ["label"], ["5"], ["x", "1"]]


def test_furniture(spark):
    rows = []
    for p in range(1, 7):
        rows.append(("d", p, 1, 10.0, 20.0, 800.0, f"Annual report 20{p}", 9.0))
        rows.append(("d", p, 2, 400.0, 410.0, 800.0, "Annual report 2024", 12.0))
        rows.append(("d", p, 3, 780.0, 790.0, 800.0, f"第 {p} 页", 8.0))
    lines = spark.createDataFrame(rows, "doc string, page int, line_no int, y0 double, y1 double, height double, text string, size double")
    b = FU.banded(lines)
    f = FU.repeated(b)
    assert sorted((r.band, r.canon, r.n) for r in f.collect()) == [("top", "Annualreport#", 6)]  # a page number is no repeated line, but goes too
    left = FU.without_furniture(b, f).collect()
    assert len(left) == 6 and {r.line_no for r in left} == {2}
    assert FU.body_size(lines).first().body_size == 12.0
    rows = spark.createDataFrame([("d", 1, 0, 405.0, 500.0), ("d", 1, 1, 600.0, 610.0)], "doc string, page int, row int, y0 double, y1 double")
    assert [r.size for r in FU.attach_sizes(rows, lines).orderBy("row").collect()] == [12.0, 0.0]


def test_recognised(spark):
    p = spark.createDataFrame([("d", 1, " a \n\n b\r\nc ")], "doc string, page int, text string")
    assert [(r.text, r.kind) for r in LY.recognised_items(p).orderBy("item_no").collect()] == [("a", "line"), ("b", "line"), ("c", "line")]
