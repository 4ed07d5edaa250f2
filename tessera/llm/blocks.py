"""Blocks of documents that stay where they are, and a packed exchange of hashes between them.

Duplicate search over every position of a corpus would shuffle a row a position. Here each task packs its documents into blocks of about
``block_bytes``, compressed, in a table bucketed by block, so that a later round finds a block's text and what it was answered on one executor: texts are
never shuffled. Block numbers are chosen such that all blocks of a task fall into one bucket: one file a task.

In a round a task sends each bucket of the hash range one row, with the packed distinct hashes of all its blocks that fall there, and gets back bits in
the same order. A hash is sent once a block however often it occurs there, so a passage that a third of all documents hold costs its bucket one entry a block. Rows of a round
are tasks times buckets, as the pieces of any shuffle are, and a row holds as much as a task's share of a bucket.

Documents are ordered by ``doc_id`` (null first); rows that share one are one document, its parts in the order of the hashes of their texts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import texts as T
from tessera.session import cut, scratch_dir

BLOCK = "block bigint, doc_ids array<bigint>, parts array<bigint>, seconds array<bigint>, sizes array<bigint>, raw bigint, body binary"
#: A task sends what it has when it holds this much.
FLUSH = 96 << 20


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of bigints (Murmur3, seed 42), by which it deals rows to buckets."""

    def turn(v: np.ndarray, r: int) -> np.ndarray:
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    h = np.full(len(x), 42, np.uint32)
    u = x.astype(np.int64).view(np.uint64)
    for k in (u.astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32)):
        k = turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def numbers(task: int, buckets: int) -> Iterator[int]:
    """Block numbers of a task: rising, no other task's, all in one bucket."""
    low = task << 32
    while True:
        some = np.arange(low, low + 64 * buckets)
        yield from some[spark_hash(some).astype(np.int64) % buckets == task % buckets].tolist()
        low += 64 * buckets


def build(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text; a null text is empty), as a bucketed table in the shared folder."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = numbers(TaskContext.get().partitionId(), buckets)
        for rows, data, at in T.parts(batches, block_bytes):
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            body = pa.compress(data.tobytes(), "zstd", asbytes=True)
            cols = [pa.array([next(names)]), *(one(rows.column(k)) for k in range(3)), one(pa.array(np.diff(at))), pa.array([len(data)]), pa.array([body], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "doc_ids", "parts", "seconds", "sizes", "raw", "body"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("part"), F.xxhash64(F.lit(1), "text").alias("second"), T.whole())
    name = f"tessera_{uuid.uuid4().hex}"
    blocks = rows.mapInArrow(pack, BLOCK).write.bucketBy(buckets, "block").option("compression", "none").option("path", scratch_dir(spark))
    blocks.saveAsTable(name)
    return spark.table(name)


def text_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("raw")).first()[0] or 0


class Block:
    """A block's bytes, offsets of its texts, and what orders its documents."""

    def __init__(self, row: dict):
        self.number = row["block"].as_py()
        self.doc_ids = row["doc_ids"].values
        self.parts, self.seconds = (row[c].values.to_numpy().view(np.uint64) for c in ("parts", "seconds"))
        if "body" in row:
            self.data = np.frombuffer(pa.decompress(row["body"].as_buffer(), row["raw"].as_py(), "zstd"), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(row["sizes"].values.to_numpy())])
        # null first, then by number
        self.ids = np.asarray(self.doc_ids.fill_null(-(1 << 63)).to_numpy(), np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        self.row = row

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal texts: each text's number among the block's distinct ones, and of each of these the first text with the least id; in the order of their hashes."""
        order, new = grouped(self.parts, self.seconds)
        lead, group = leads(new)
        least = np.minimum.reduceat(self.ids[order], lead)
        number = np.empty(len(order), np.int64)
        number[order] = group
        first = np.full(len(lead), len(order))
        fits = order[self.ids[order] == least[group]]
        np.minimum.at(first, number[fits], fits)
        return number, first, least

    def copies(self, strict: bool) -> np.ndarray:
        """Which texts equal one of a smaller document (or, unless ``strict``, of the same document but before it), by the answers of round "c"."""
        number, first, least = self.texts()
        bits = self.bits("c")
        far = np.zeros(len(first), bool) if bits is None else bits.astype(bool)
        return far[number] | (self.ids > least[number] if strict else first[number] != np.arange(len(number)))

    def bits(self, k: int | str, width: int = 1) -> np.ndarray | None:
        """What round ``k`` answered to this block's entries, in the order they were sent."""
        value = self.row[f"a{k}"]
        return unpacked(value.as_buffer(), self.row[f"n{k}"].as_py(), width) if value.is_valid else None

    def note(self, k: int) -> np.ndarray:
        """What this block noted in round ``k``."""
        value = self.row[f"note{k}"]
        return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    T.keep_memory()
    for b in batches:
        for k in range(b.num_rows):
            yield Block({n: c[k] for n, c in zip(b.schema.names, b.columns, strict=True)})


def packed(codes: np.ndarray, width: int) -> bytes:
    return b"".join(np.packbits((codes >> w) & 1).tobytes() for w in range(width))


def unpacked(data, n: int, width: int) -> np.ndarray:
    size = (n + 7) // 8
    out = np.unpackbits(np.frombuffer(data, np.uint8, size), count=n)
    for w in range(1, width):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, size, w * size), count=n) << w
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets cut the range of 64-bit hashes evenly; a larger hash has no smaller bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def shares(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes."""
    if not len(hashes):
        return iter(())
    b = bucket_of(hashes, buckets)
    lead = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return zip(b[lead].tolist(), lead.tolist(), [*lead[1:].tolist(), len(b)], strict=True)


def number_of_buckets(total: float, each: float) -> int:
    return max(64, math.ceil(total / each))


def exchange(blocks: DataFrame, send: Callable[[Block], Iterator[tuple[int, int, bytes]]], answer: Callable[[list[tuple[int, int, bytes]]], list[np.ndarray]], width: int = 1) -> DataFrame:
    """One round. ``send`` gives (bucket, number of answers, payload) of a block, in bucket order; bucket -1 is a note (its number of answers is its size) that comes back as it is.

    ``answer`` gets a bucket's (block, number of answers, payload) and returns for each that many codes of ``width`` bits. Returns block, n, a (all answers to the
    block, packed) and note, written to the shared folder.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        home, held, size = TaskContext.get().partitionId(), {}, 0
        for block in blocks_of(batches):
            for bucket, n, payload in send(block):
                held.setdefault(bucket, []).append((block.number, n, payload))
                size += len(payload)
            if size > FLUSH:
                yield from _rows(home, held)
                held, size = {}, 0
        yield from _rows(home, held)

    def reply(got: pa.Table) -> pa.Table:
        T.keep_memory()
        bucket = got["bucket"][0].as_py()
        rows = [list(zip(o.as_py(), n.as_py(), _split(p.as_buffer(), s.as_py()), strict=True)) for o, n, s, p in zip(got["owner"], got["n"], got["size"], got["payload"], strict=True)]
        if bucket < 0:
            return got.drop_columns(["size"]).rename_columns(["home", "bucket", "owner", "n", "answer"])
        codes = iter(answer([x for r in rows for x in r]))
        back = [b"".join(packed(next(codes), width) for _ in r) for r in rows]
        return pa.table({"home": got["home"], "bucket": got["bucket"], "owner": got["owner"], "n": got["n"], "answer": pa.array(back, pa.binary())})

    def by_block(got: pa.Table) -> pa.Table:
        found: dict = {}
        for bucket, owner, n, a in sorted(zip(got["bucket"].to_pylist(), got["owner"].to_pylist(), got["n"].to_pylist(), got["answer"].to_pylist(), strict=True), key=lambda r: r[0]):
            sizes = [width * ((k + 7) // 8) for k in n] if bucket >= 0 else n
            for o, k, x in zip(owner, n, _split(a, sizes), strict=True):
                codes, notes = found.setdefault(o, ([], []))
                (codes if bucket >= 0 else notes).append(unpacked(x, k, width) if bucket >= 0 else bytes(x))
        codes = {o: np.concatenate(c) if c else np.zeros(0, np.uint8) for o, (c, _) in found.items()}
        return pa.table(
            {
                "block": pa.array(list(found), pa.int64()),
                "n": pa.array([len(c) for c in codes.values()], pa.int64()),
                "a": pa.array([packed(c, width) for c in codes.values()], pa.binary()),
                "note": pa.array([b"".join(notes) for _, notes in found.values()], pa.binary()),
            }
        )

    sent = blocks.mapInArrow(emit, "home bigint, bucket int, owner array<bigint>, n array<bigint>, size array<bigint>, payload binary")
    back = sent.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("home"))).applyInArrow(reply, "home bigint, bucket int, owner array<bigint>, n array<bigint>, answer binary")
    return cut(back.groupBy("home").applyInArrow(by_block, "block bigint, n bigint, a binary, note binary"))


def copies(blocks: DataFrame, strict: bool) -> DataFrame:
    """The round that finds equal texts, told by 128 bits of hashes: a text that equals an earlier one can be left out of all later rounds, since the earlier one holds all that it holds.

    A text is sent once a block, and no text is read.
    """
    size = blocks.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    buckets = number_of_buckets(size * 20, 4e6)

    def send(block: Block) -> Iterator[tuple[int, int, bytes]]:
        _, first, least = block.texts()
        h, second = block.parts[first], block.seconds[first]
        for b, i, j in shares(h, buckets):
            yield b, j - i, h[i:j].tobytes() + second[i:j].tobytes() + least[i:j].tobytes()

    def answer(got: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        h, second, ids = (np.concatenate([np.frombuffer(p, np.uint64, n, k * 8 * n) for _, n, p in got]) for k in range(3))
        whose = np.repeat([b for b, _, _ in got], [n for _, n, _ in got])
        order, new = grouped(h, second)
        lead, group = leads(new)
        if strict:
            rank = ids
        else:
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((whose, ids))] = np.arange(len(ids))
        out = np.empty(len(ids), np.uint8)
        out[order] = np.minimum.reduceat(rank[order], lead)[group] < rank[order]
        return np.split(out, np.cumsum([n for _, n, _ in got])[:-1])

    return exchange(blocks.drop("body"), send, answer)


def _split(data, sizes: list[int]) -> Iterator[memoryview]:
    view, i = memoryview(data), 0
    for s in sizes:
        yield view[i : i + s]
        i += s


def _rows(home: int, held: dict) -> Iterator[pa.RecordBatch]:
    """A row a bucket, some megabytes at a time."""
    some: list = []
    size = 0
    for bucket in sorted(held):
        owner, n, payload = zip(*held[bucket], strict=True)
        some.append((home, bucket, owner, n, [len(p) for p in payload], b"".join(payload)))
        size += len(some[-1][-1])
        if size > 4 << 20:
            yield _batch(some)
            some, size = [], 0
    if some:
        yield _batch(some)


def _batch(rows: list) -> pa.RecordBatch:
    many = pa.list_(pa.int64())
    types = [pa.int64(), pa.int32(), many, many, many, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["home", "bucket", "owner", "n", "size", "payload"])


def with_answers(blocks: DataFrame, rounds: dict[int | str, DataFrame]) -> DataFrame:
    """Blocks with what the given rounds answered, as n, a and note with the round's name. The blocks stay in their buckets."""
    for k, r in rounds.items():
        blocks = blocks.join(r.select("block", *(F.col(c).alias(f"{c}{k}") for c in ("n", "a", "note"))).hint("shuffle_hash"), "block", "left")
    return blocks


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which entries with all keys equal are neighbours, rising in the first key's leading bits, and whether each begins a group."""
    n = len(keys[0])
    bits = np.uint64(max(n, 2).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = np.sort((keys[0] & ~low) | np.arange(n, dtype=np.uint64))
    order = (both & low).astype(np.int64)
    same = np.zeros(n, bool)
    same[1:] = (both[1:] >> bits) == (both[:-1] >> bits)
    full = same.copy()
    near = np.flatnonzero(same)
    for k in keys:
        full[near] &= k[order[near]] == k[order[near - 1]]
    if (full != same).any():  # runs whose leading bits alone agree are sorted by all keys
        run = np.cumsum(~same)
        bad = np.flatnonzero(np.isin(run, run[full != same]))
        part = order[bad]
        order[bad] = part[np.lexsort((*(k[part] for k in reversed(keys)), run[bad]))]
        near = bad[same[bad]]
        full[near] = True
        for k in keys:
            full[near] &= k[order[near]] == k[order[near - 1]]
    return order, ~full


def leads(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin, and each entry's group."""
    return np.flatnonzero(new), np.cumsum(new) - 1


def covered(start: np.ndarray, length: int) -> np.ndarray:
    """Which places lie in [s, s + length) for some place s that ``start`` marks."""
    sums = np.cumsum(start, dtype=np.int64)
    out = sums.copy()
    out[length:] -= sums[:-length] if length else 0
    return out > 0
