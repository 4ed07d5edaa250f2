"""MinHash near-dedup by a signature-coordinate inverted join.

1. Each document's distinct shingles give a signature of ``K`` minima. Documents with equal sets are one node from here on.
2. A node is posted under each (coordinate, value) of its signature. Values that one node alone has are dropped; the others are ordered by how many
   nodes have them. Two nodes that agree in ``LEAST`` of ``K`` coordinates share one of the ``K - LEAST + 1`` rarest of each, so only that prefix is kept
   and long lists are skipped wherever rarer ones decide.
3. Pairs from the lists are counted over the whole signature, and those with ``LEAST`` matches are confirmed on the full sets. Lists of up to ``SMALL`` nodes
   give all their pairs. From a longer list each node is paired with the list's most central one (whose values
   most nodes share); when that has given components, only nodes outside that
   one's component are compared with the rest, in cells of about ``CELL`` nodes a side; pairs with ``LEAST`` matches are confirmed in the cell, which returns
   only the links that join components. Pairs within a component can't change it, so nothing is lost, and a group of copies gives no more rows than it has members.
4. Components are found by smallest-label propagation with pointer jumping.

At similarity 0.75 a pair has fewer than LEAST = 21 of K = 48 matches with probability below 1e-6; every other step is exact.

Defined results: a null or empty text has no shingles, is its own component and stays; a text of any length is one set of shingles, read whole; documents with a null doc_id take part, and are kept only if their
component has no other; repeated rows are in one component; rows that share a doc_id are compared like any others; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.llm import texts as T
from tessera.session import cut, drop_path, scratch_dir

K, LEAST, SMALL, CELL = 48, 21, 16, 2048
PORTION = 1 << 17
_ODD = np.random.default_rng(7).integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The signatures (a row for each text) of texts whose shingles begin at ``at``; every text has some."""
    out = np.empty((len(at), K), np.uint32)
    for j in range(K):
        out[:, j] = np.minimum.reduceat((value * _ODD[j]) >> np.uint64(32), at)
    return out.view(np.int32)


def _sketch(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, texts_at in T.parts(batches, PORTION):
            value, at = S.of(data, texts_at, size)
            n = np.diff(at)
            some = np.flatnonzero(n)
            keys = np.zeros((2, len(n)), np.uint64)
            lists = pa.nulls(len(n), pa.list_(pa.int32()))
            if len(some):
                keys[0, some] = np.add.reduceat(T.mix(value), at[some])
                keys[1, some] = np.add.reduceat(T.mix(value ^ np.uint64(0xC2B2AE3D27D4EB4F)), at[some])
                where = np.concatenate([[0], np.cumsum(n > 0)]).astype(np.int32) * K
                lists = pa.ListArray.from_arrays(pa.array(where), pa.array(_minima(value, at[some]).ravel()), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(n), *(pa.array(k.view(np.int64)) for k in keys), lists], names=["doc_id", "row", "row_b", "n_shingles", "set_a", "set_b", "sig"])

    return sketch


def _full_sets(size: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, texts_at in T.parts(batches, PORTION):
            value, at = S.of(data, texts_at, size)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["node", "items"])

    return full


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of ``edges`` (a, b). Each round's tables go when the next one's are written."""
    spark = edges.sparkSession
    paths = [scratch_dir(spark) for _ in range(2)]
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), paths[0])
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), paths[1])
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        paths += [scratch_dir(spark) for _ in range(2)]
        step = cut(step, paths[2])
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = cut(step.join(jump, "comp", "left").select("node", "was", F.coalesce("further", "comp").alias("comp")), paths[3])
        labels = step.select("node", "comp")
        done = not step.where("was != comp").head(1)
        for p in paths[:3] if done else paths[1:3]:
            drop_path(spark, p)
        if done:
            return labels
        paths = [paths[0], paths[3]]


def _matches(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    sig = nodes.select("node", "sig", "n_shingles")
    two = pairs.join(sig.toDF("a", "sa", "na"), "a").join(sig.toDF("b", "sb", "nb"), "b")
    two = two.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    n = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return two.where(n >= LEAST).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    two = pairs.join(sets.toDF("a", "ia"), "a").join(sets.toDF("b", "ib"), "b")
    both = F.size(F.array_intersect("ia", "ib"))
    return two.where(100 * both >= percent * (F.size("ia") + F.size("ib") - both)).select("a", "b")


def _cells(percent: int):
    def cells(cell: pd.DataFrame) -> pd.DataFrame:
        """Links of a cell between different components, as many as join them: pairs with LEAST matches and sizes that allow it, confirmed on the full sets."""
        left = cell[cell["side"] == 0]
        right = cell[cell["side"] == 1]
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            (x, cx, nx, sx), (y, cy, ny, sy) = ((np.stack(d["sig"].to_numpy()), d["comp"].tolist(), d["node"].tolist(), d["items"].tolist()) for d in (left, right))
            size = np.array([len(v) for v in sy])
            up: dict = {}

            def top(c):
                while c in up:
                    c = up[c]
                return c

            for i in range(len(x)):
                n = len(sx[i])
                near = np.flatnonzero((100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & ((x[i] == y).sum(axis=1) >= LEAST))
                mine = top(cx[i])
                near = [j for j in near.tolist() if top(cy[j]) != mine]
                if not near:
                    continue
                own = np.sort(sx[i])
                both = np.concatenate([sy[j] for j in near])
                hit = own[np.minimum(np.searchsorted(own, both), n - 1)] == both
                some = size[near]
                both = np.add.reduceat(hit, np.cumsum(some) - some)
                for j in np.flatnonzero(100 * both >= percent * (n + some - both)).tolist():
                    other, mine = top(cy[near[j]]), top(cx[i])
                    if other != mine:
                        up[mine] = other
                        links.append((min(nx[i], ny[near[j]]), max(nx[i], ny[near[j]])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return cells


def _across(posts: DataFrame, lists: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 3's second half: links across components from long lists. Lists with the same first node are looked at together."""
    long = posts.join(lists.where(F.col("n") > SMALL), "token").select("first", "node").distinct()
    member = long.join(labels, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
    heads = member.where(F.col("node") == F.col("first")).select("first", F.col("comp").alias("main"))
    member = cut(member.join(heads, "first").withColumn("home", F.col("comp") == F.col("main")))
    sizes = member.groupBy("first").agg(F.count_if("home").alias("inside"), F.count_if(~F.col("home")).alias("outside")).where(F.col("outside") > 0)
    cells = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    member = member.join(sizes.select("first", cells("inside").alias("ni"), cells("outside").alias("no")), "first")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("ni")).otherwise(F.col("no"))).cast("int")
    member = member.withColumn("own", own)
    # cells are (row: a chunk outside, column: a chunk outside (0..no-1) or inside (no..)); a node outside stands in its row once and in its column
    row = F.transform(F.sequence(F.lit(0), F.col("no") + F.col("ni") - 1), lambda j: F.struct(F.col("own").alias("r"), j.alias("c"), F.lit(0).alias("side")))
    column = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda j: F.struct(j.alias("r"), (F.col("own") + F.when(F.col("home"), F.col("no")).otherwise(0)).alias("c"), F.lit(1).alias("side")))
    places = F.when(F.col("home"), column).otherwise(F.concat(row, column))
    spread = member.select("first", "node", "comp", F.explode(places).alias("p")).select("first", "p.r", "p.c", "p.side", "node", "comp")
    spread = spread.where((F.col("c") >= F.col("r")))  # outside against outside: each pair of chunks once
    spread = spread.join(nodes.select("node", "sig"), "node").join(sets, "node")
    return spread.groupBy("first", "r", "c").applyInPandas(_cells(percent), "a bigint, b bigint")


def _row(*names: str) -> list:
    """128 bits of hashes of a row's id and text."""
    a, b = names or ("row", "row_b")
    return [F.xxhash64("doc_id", "text").alias(a), F.xxhash64(F.lit(1), "doc_id", "text").alias(b)]


def _labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row and row_b, n_shingles, component_id, and comp, the component itself (null for a text without words)."""
    rows = docs.select("doc_id", *_row(), T.whole())
    sketch = cut(rows.mapInArrow(_sketch(size), "doc_id bigint, row bigint, row_b bigint, n_shingles bigint, set_a bigint, set_b bigint, sig array<int>"))
    keys = ["set_a", "set_b", "n_shingles"]
    some = sketch.where("n_shingles > 0")
    nodes = cut(
        some.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.min(F.struct("row", "row_b")).alias("r"), F.first("sig").alias("sig")).select("*", "r.row", "r.row_b").drop("r").withColumn("node", F.monotonically_increasing_id())
    )
    tokens = nodes.select("node", F.posexplode("sig").alias("k", "v")).select("node", (F.shiftleft(F.col("k").cast("bigint"), 32) + F.col("v").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("token"))
    freq = cut(tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"))
    ranked = tokens.join(freq, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"), F.sum("f").alias("weight"))
    # K - size(t) values are the node's alone and come first in its prefix of K - LEAST + 1
    prefix = ranked.where(F.size("t") >= LEAST).select("node", "weight", F.explode(F.slice("t", 1, F.size("t") - (LEAST - 1))).alias("x"))
    posts = cut(prefix.select("node", "weight", F.col("x.token").alias("token")))
    # the first of a list is the node whose values are shared most: among copies of one text, that is the one nearest to all others
    lists = cut(posts.groupBy("token").agg(F.max_by("node", F.struct("weight", "node")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    listed = posts.join(lists, "token")
    star = listed.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    small = listed.where((F.col("n") > 2) & (F.col("n") <= SMALL) & (F.col("node") != F.col("first"))).select("token", "node")
    rest = small.toDF("token", "a").join(small.toDF("token", "b"), "token").where("a < b").select("a", "b")
    ordered = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = _matches(ordered.union(rest).distinct(), nodes, percent)

    wanted = nodes.join(listed.select("node").distinct(), "node", "left_semi").select("node", "row", "row_b")
    found = rows.join(wanted, ["row", "row_b"]).select("node", "text").mapInArrow(_full_sets(size), "node bigint, items array<bigint>")
    sets = cut(found.dropDuplicates(["node"]))
    edges = cut(_confirmed(pairs, sets, percent))
    labels = components(edges)
    more = cut(_across(posts, lists, labels, nodes, sets, percent))
    if more.head(1):
        labels = components(edges.union(more))
    owner = nodes.select(*keys, "least", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop("node")
    least = owner.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_set = cut(owner.join(least, "comp").select(*keys, "component_id", "comp"))
    out = sketch.join(of_set, keys, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "row", "row_b", "n_shingles", "component_id", "comp")


def link(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), n_shingles, component_id, kept of every document.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of ``size``-word shingles; component_id is the smallest
    doc_id reachable.
    """
    return _labelled(docs, size, percent).select("doc_id", "row", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_a_component(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row of ``docs``, with all its columns, of each component: that of the least doc_id (nulls last), then of the least row hash, then one of equal rows.

    Texts without words are near nothing and stay.
    """
    labels = _labelled(docs, size, percent)
    rows = cut(labels.where("n_shingles > 0").groupBy("comp", "doc_id", "row", "row_b").agg(F.count("*").alias("n")))
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "row_b", "n")).alias("b"))
    wordless = labels.where("n_shingles = 0").select("row", "row_b", F.lit(False)).distinct()
    chosen = cut(best.select(F.col("b.row").alias("_nd_row"), F.col("b.row_b").alias("_nd_row_b"), (F.col("b.n") > 1).alias("_nd_many")).union(wordless))
    key = ["_nd_row", "_nd_row_b"]
    found = docs.select("*", *_row(*key))
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = found.join(chosen.where("NOT _nd_many"), key, "left_semi").select(*names)
    many = chosen.where("_nd_many")
    if many.head(1):  # equal rows meet only where there are some
        out = out.union(found.join(many, key, "left_semi").dropDuplicates(key).select(*names))
    return out
