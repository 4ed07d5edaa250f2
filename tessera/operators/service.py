"""A corpus opened for questions: retrieval, answers, aggregation over groups, look-ups and metadata."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config as C
from tessera.functions import plugins as P
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import aggregate as A
from tessera.operators import index as I
from tessera.operators import search as S
from tessera.session import cut, scratch_dir

KEPT_QUERIES = 24


class Corpus:
    """``chunks``: doc_id (numeric row), text, embedding, company, report_year, chapter, page, chunk_id."""

    def __init__(self, chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], tokenize=T.tokens, index: I.StoredIndex | None = None):
        """``index``: the stored keyword index of ``chunks``; without one, it is built and written once, here."""
        self.spark, self.chunks, self.encode, self.tokenize = chunks.sparkSession, chunks, encode, tokenize
        self.index = I.StoredIndex.build(chunks, scratch_dir(self.spark), tokenize=tokenize) if index is None else index
        self.queries: OrderedDict[int, dict] = OrderedDict()
        self._next = 0

    def _terms(self, question: str) -> list[str]:
        return self.spark.createDataFrame([(question,)], "q string").select(self.tokenize(F.col("q")).alias("t")).first()["t"]

    def _vector(self, question: str) -> DataFrame:
        return self.spark.createDataFrame([([float(x) for x in self.encode([P.question(question)])[0]],)], "embedding array<float>")

    def scores(self, question: str) -> DataFrame:
        return self.index.scores(self._terms(question))

    def retrieve(self, question: str, k: int = C.TOP_K) -> tuple[int, DataFrame]:
        """The query's number and its neighbours: rank, ids, both scores and ranks, snippet. The last ``KEPT_QUERIES`` are remembered."""
        vec = self._vector(question)
        found = S.hybrid_search(self.chunks.select("doc_id", "embedding"), vec, self.scores(question), k)
        found = S.top_per_group(found.withColumn("_g", F.lit(0)), ["_g"], [F.desc("rrf"), F.col("doc_id")], k).drop("_g")
        rows = found.select("rank", "doc_id", "sim", "bm25", "rrf", "vrank", "brank").join(self.chunks.drop("embedding"), "doc_id").withColumn("snippet", F.substring("text", 1, C.SNIPPET))
        rows = cut(rows)  # k rows, which contexts and answers read again
        self._next += 1
        self.queries[self._next] = {"question": question, "vector": vec, "rows": rows}
        while len(self.queries) > KEPT_QUERIES:
            self.queries.popitem(last=False)
        return self._next, rows

    def query_vector(self, number: int, n: int = 8) -> DataFrame:
        """The vector of a remembered query, and its first values."""
        return self.queries[number]["vector"].select("embedding", V.preview("embedding", n).alias("preview"))

    def keyword(self, question: str, k: int = C.TOP_K) -> DataFrame:
        return S.keyword_search(self.scores(question), k).join(self.chunks.drop("embedding"), "doc_id")

    def context(self, number: int) -> DataFrame:
        """One row: the passages that fit the budget under their headings, and the ids that were used."""
        used = S.context(self.queries[number]["rows"], "rank")
        head = F.format_string("[%d] %s %d %s P%d\n", "rank", "company", "report_year", "chapter", "page")
        parts = F.sort_array(F.collect_list(F.struct("rank", F.concat(head, F.col("passage")).alias("p"), "doc_id")))
        return used.agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("context"), F.transform(parts, lambda x: x["doc_id"]).alias("used"), F.sum("used").alias("chars"))

    def answer(self, number: int, generator: Callable[[str, str], Iterator[str]] = P.quoting_generator) -> Iterator[dict]:
        """Events: what is sent, the answer's tokens, and citations of the passages that were used."""
        row = self.context(number).first()  # the budget bounds it
        yield {"type": "start", "chars": row["chars"] or 0, "passages": len(row["used"])}
        try:
            for t in generator(self.queries[number]["question"], row["context"]):
                yield {"type": "token", "text": t}
        except Exception as e:
            yield {"type": "error", "error": str(e)[:200]}
            return
        yield {"type": "citations", "ids": list(row["used"])}
        yield {"type": "done"}

    def aggregate(self, question: str, group: str = "company", k: int = C.GROUP_K, only: list[str] | None = None, extractor: Callable | None = None) -> tuple[DataFrame, DataFrame]:
        """A conclusion a group, and the reduced row. The question is encoded once."""
        rows = self.chunks if only is None else self.chunks.where(F.col(group).isin(only))
        found = S.grouped_hybrid(rows, self._vector(question), self.scores(question), group, k).select(group, "rank", "doc_id")
        mapped = A.map_groups(found.join(self.chunks.select("doc_id", "text"), "doc_id"), group, extractor or A.extractive(self._terms(question)))
        return mapped, A.reduce_groups(mapped, group)

    def chunk(self, row: int, chunk_id: str | None = None) -> DataFrame:
        """The chunk of a row with its state: ok, or stale if the row no longer holds ``chunk_id``; nothing if there is no such row."""
        fresh = F.lit(True) if chunk_id is None else F.col("chunk_id") == chunk_id
        return self.chunks.drop("embedding").where(F.col("doc_id") == row).withColumn("state", F.when(fresh, "ok").otherwise("stale"))

    def meta(self) -> DataFrame:
        """One row: sizes, and the values of the facets."""
        seen = lambda c: F.sort_array(F.collect_set(c)).alias(f"{c}s")
        return self.chunks.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), seen("company"), seen("report_year"), seen("chapter"))

    def health(self) -> dict[str, bool]:
        """What is ready: rows, the keyword index, and the encoder (tried on one text)."""
        try:
            encoder = len(self.encode([P.question("ready")])[0]) > 0
        except Exception:  # whatever a plug-in raises, it isn't ready
            encoder = False
        return {"rows": bool(self.chunks.head(1)), "keyword_index": bool(self.index.n), "encoder": encoder}
