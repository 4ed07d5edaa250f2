"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the largest permitted length, and only their lengths are packed: a piece is a row of three numbers. Pieces are dealt
by a hash into independent portions of about ``portion`` pieces, since best-fit loses next to nothing once a portion has thousands of them; within a portion they are taken
longest first. A piece goes to the open bin that it leaves least room in. If none holds it, a bin of the permitted size is opened that costs least
for each token it can still be given: sizes are optimised jointly under ``cost(size) = overhead + size + size^2 / quadratic`` (a fixed cost a sequence, a
linear one a token, and attention's). At the end each bin is downsized to the smallest permitted size that holds its contents.

Defined results: documents without tokens (null or empty texts too) have no piece and no row; a text of any length is cut into as many pieces as it takes, and measured
whole; ties go to the bin opened first and the piece of smaller (doc_id, text hash, start); repeated rows are pieces of their own; null doc_ids are packed
and returned as null; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import texts as T
from tessera.session import cut


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in T.parts(batches, 1 << 17):
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(T.n_words(data, at))], names=["doc_id", "row", "n"])


def _measured(docs: DataFrame, length: Callable[[Column], Column] | None) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), n: the tokens of each text."""
    row = F.xxhash64("doc_id", "text").alias("row")
    if length is None:
        return docs.select("doc_id", row, T.whole()).mapInArrow(_words, "doc_id bigint, row bigint, n bigint")
    return docs.select("doc_id", row, length(F.col("text")).cast("bigint").alias("n"))


class Cost:
    def __init__(self, overhead: float, quadratic: float):
        self.overhead, self.quadratic = overhead, quadratic

    def __call__(self, size: int) -> float:
        return self.overhead + size + size * size / self.quadratic


def opening(sizes: list[int], cost: Cost, piece: int, left: int) -> int:
    """The permitted size to open for ``piece``, with ``left`` tokens (its own too) still to come: least cost a token it can be given."""
    fit = [s for s in sizes if s >= piece]
    return min(fit, key=lambda s: (cost(s) / min(s, left), s))


def pack(lengths: list[int], sizes: list[int], cost: Cost) -> tuple[list[int], list[int], list[int]]:
    """For lengths, longest first: each one's bin and offset, and each bin's final size. ``sizes`` ascend."""
    room: list[tuple[int, int]] = []  # open bins as (room, bin), sorted
    opened: list[int] = []
    used: list[int] = []
    where, offset, left = [], [], sum(lengths)
    for n in lengths:
        k = bisect.bisect_left(room, (n, -1))
        if k < len(room):
            r, b = room.pop(k)
        else:
            b = len(opened)
            opened.append(opening(sizes, cost, n, left))
            used.append(0)
            r = opened[b]
        where.append(b)
        offset.append(used[b])
        used[b] += n
        left -= n
        if r > n:
            bisect.insort(room, (r - n, b))
    return where, offset, [sizes[bisect.bisect_left(sizes, u)] for u in used]


def best_fit(
    docs: DataFrame,
    sizes: tuple[int, ...] = (512, 1024, 2048, 4096),
    length: Callable[[Column], Column] | None = None,
    overhead: float = 64.0,
    quadratic: float = 16384.0,
    portion: int = 20000,
) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_size, bin_offset: where each piece of each document lies.

    ``length`` gives a text's tokens as a column; without it, tokens are words.
    """
    sizes, cost = sorted(sizes), Cost(overhead, quadratic)
    most = sizes[-1]
    sized = _measured(docs, length).where("n > 0")
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(most).cast("bigint")))
    # four numbers a piece, written so that texts are measured once
    pieces = cut(sized.select("doc_id", "row", "n", start.alias("start")).withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(most))).drop("n"))
    # a third of all rows in one source makes no difference to a hash
    portions = max(1, -(-pieces.count() // portion))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(portions)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "row", "start"], ascending=[False, True, True, True], kind="stable")
        where, offset, final = pack(pdf["length"].tolist(), sizes, cost)
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].astype("Int64"),
                "piece": pdf["start"] // most,
                "start": pdf["start"],
                "length": pdf["length"],
                "bin_id": [(int(pdf["part"].iloc[0]) << 32) + b for b in where],
                "bin_size": [final[b] for b in where],
                "bin_offset": offset,
            }
        )

    return dealt.groupBy("part").applyInPandas(run, "doc_id bigint, piece bigint, start bigint, length bigint, bin_id bigint, bin_size bigint, bin_offset bigint")
