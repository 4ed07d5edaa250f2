"""From ordered items to chunks: headings, sections, paragraphs, atoms, ranges, assembly.

Everything is windows within a document or section and one pointer chase per section. The chase works on an array of one section's ``next``
positions: sections have some hundreds of atoms, so the array is small, and sections are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import ChunkParams
from tessera.functions import text as T
from tessera.session import cut

#: What begins a new unit of text.
NEW_UNIT = r"^(第[一二三四五六七八九十]+[节章]|[一二三四五六七八九十]+[、.]|（[一二三四五六七八九十0-9]+）|\([一二三四五六七八九十0-9]+\)|\d+[、.])"
FRONT = "前置"


def flatten_documents(docs: DataFrame) -> DataFrame:
    """doc, item_idx, page, kind, text, size of nested text documents (pages of items), blank items left out."""
    pages = docs.select(F.col("pdf_id").alias("doc"), F.posexplode("pages").alias("_p", "page"))
    items = pages.select("doc", "_p", F.posexplode("page.items").alias("_i", "item")).where(T.strip(F.col("item.text")) != "")
    order = W.partitionBy("doc").orderBy("_p", "_i")
    return items.select("doc", (F.row_number().over(order) - 1).alias("item_idx"), "item.page", "item.kind", "item.text", "item.size")


def lines_as_items(docs: DataFrame, per_page: int = 10) -> DataFrame:
    """Plain texts as items: one a non-blank line, ``per_page`` lines a page."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    lines = lines.where(T.strip(F.col("text")) != "")
    order = W.partitionBy("doc").orderBy("line_no")
    return lines.select("doc", (F.row_number().over(order) - 1).alias("item_idx"), (F.floor(F.col("line_no") / per_page) + 1).cast("int").alias("page"), F.lit("line").alias("kind"), "text")


def heading_candidates(items: DataFrame, most_per_page: int = 2) -> DataFrame:
    """doc, item_idx, page, no, name: lines that look like a section's heading, on pages without too many of them (a table of contents)."""
    following = F.lead("text", 1, "").over(W.partitionBy("doc").orderBy("item_idx"))
    # nearly all lines lack these two characters, and are done with before any pattern is tried
    likely = items.withColumn("_next", following).where(F.col("text").contains("第") & F.col("text").contains("节"))
    found = T.with_heading(likely, "text", "_next").where("no IS NOT NULL")
    crowd = F.count("*").over(W.partitionBy("doc", "page"))
    return found.withColumn("_n", crowd).where(F.col("_n") <= most_per_page).select("doc", "item_idx", "page", "no", "name")


def accepted(numbers: Column, jump: int = 3) -> Column:
    """Of an ordered array of structs with a ``no``, those whose number grows by 1 to ``jump`` over the last accepted one (0 at first)."""
    kind = F.filter(numbers, lambda x: F.lit(False))
    start = F.struct(F.lit(0).alias("cur"), kind.alias("kept"))

    def step(a, x):
        ok = (x["no"] > a["cur"]) & (x["no"] <= a["cur"] + jump)
        return F.when(ok, F.struct(x["no"].cast("int").alias("cur"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)

    return F.aggregate(numbers, start, step)["kept"]


def chapters(candidates: DataFrame) -> DataFrame:
    """The accepted headings: doc, item_idx, page, no, name. An array holds one document's headings, a few dozen at most."""
    lists = candidates.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("item_idx", "page", "no", "name"))).alias("c"))
    return lists.select("doc", F.explode(accepted(F.col("c"))).alias("c")).select("doc", "c.*")


def sectioned(items: DataFrame, heads: DataFrame) -> DataFrame:
    """Items with their section (0 before the first heading), and its number and name (null for section 0)."""
    marked = items.join(heads.select("doc", "item_idx", F.col("no").alias("_no"), F.col("name").alias("_name")), ["doc", "item_idx"], "left")
    w = W.partitionBy("doc").orderBy("item_idx").rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return marked.select(*items.columns, F.count("_no").over(w).cast("int").alias("section"), last("_no").alias("chapter_no"), last("_name").alias("chapter_name"))


def orbit(df: DataFrame, group: list[str], idx: str, following: str) -> DataFrame:
    """group, idx: the positions reached from 0 by ``following`` until it is null or past the end."""
    nexts = df.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct(idx, F.col(following).alias("nx")))), lambda x: x["nx"]).alias("nx"))
    start = F.struct(F.lit(0).alias("pos"), F.array(F.lit(0)).alias("seen"))

    def step(a, _):
        to = F.get(F.col("nx"), a["pos"])
        on = to.isNotNull() & (to < F.size("nx"))
        return F.when(on, F.struct(to.cast("int").alias("pos"), F.concat(a["seen"], F.array(to.cast("int"))).alias("seen"))).otherwise(
            F.struct(F.size("nx").alias("pos"), a["seen"].alias("seen"))
        )

    return nexts.select(*group, F.explode(F.aggregate("nx", start, step)["seen"]).alias(idx))


def paragraphs(items: DataFrame, p: ChunkParams) -> DataFrame:
    """doc, section, par, kind, text, page, page_end: visual lines put back into paragraphs.

    A line joins the one before it if that doesn't end a sentence, is no table row and has fewer than ``max_paragraph`` characters by then, and if the line itself has 10
    characters and begins no new unit.
    """
    w = W.partitionBy("doc", "section").orderBy("item_idx")
    before, kind = F.lag("text").over(w), F.lag("kind").over(w)
    joins = (F.col("kind") == "line") & (kind == "line") & ~T.ends_sentence(before, p.sentence_ends) & (F.length("text") >= 10) & ~F.col("text").rlike(NEW_UNIT)
    rows = items.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # within a run, a paragraph is full once max_paragraph characters precede a line: the first such line starts the next one
    r = W.partitionBy("doc", "section", "_run").orderBy("item_idx")
    rows = rows.withColumn("_i", F.row_number().over(r) - 1).withColumn("_at", F.coalesce(F.sum(F.length("text")).over(r.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    full = F.max("_i").over(W.partitionBy("doc", "section", "_run").orderBy("_at").rangeBetween(0, p.max_paragraph - 1)) + 1
    rows = rows.withColumn("_next", full)
    starts = orbit(rows, ["doc", "section", "_run"], "_i", "_next").withColumn("_new", F.lit(1))
    rows = rows.join(starts, ["doc", "section", "_run", "_i"], "left")
    rows = rows.withColumn("par", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    parts = F.sort_array(F.collect_list(F.struct("item_idx", "text", "kind", "page")))
    out = rows.groupBy("doc", "section", "par").agg(parts.alias("x"), F.first("chapter_no").alias("chapter_no"), F.first("chapter_name").alias("chapter_name"))
    first, last = F.col("x")[0], F.element_at("x", -1)
    return out.select("doc", "section", "chapter_no", "chapter_name", "par", first["kind"].alias("kind"), F.array_join(F.transform("x", lambda a: a["text"]), "").alias("text"), first["page"].alias("page"), last["page"].alias("page_end"))


def split_long(text: Column, limit: int, ends: str = "。！？；!?;…") -> Column:
    """Pieces of at most ``limit`` characters: cut after sentences, then after commas, then anywhere; neighbours that fit are put together again."""
    marks = "".join("\\" + c if c in ".?!" else c for c in ends)
    cuts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / limit).cast("int")), lambda i: F.substring(x, i * limit + 1, F.lit(limit)))
    by_comma = lambda x: F.flatten(F.transform(F.split(x, "(?<=[，,、])"), lambda y: F.when(F.length(y) > 0, cuts(y)).otherwise(F.array().cast("array<string>"))))
    pieces = F.flatten(F.transform(F.split(text, f"(?<=[{marks}])"), lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(by_comma(x))))
    pieces = F.filter(pieces, lambda x: x != "")

    def put(a, x):
        fits = (F.size(a) > 0) & (F.length(F.try_element_at(a, F.lit(-1))) + F.length(x) <= limit)
        return F.when(fits, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(a, F.lit(-1)), x)))).otherwise(F.concat(a, F.array(x)))

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(pieces, F.array().cast("array<string>"), put))


def atoms(paras: DataFrame, p: ChunkParams) -> DataFrame:
    """doc, section, idx, text, page, page_end, start, end: pieces with offsets in their section, one newline between two."""
    pieces = paras.select("doc", "section", "chapter_no", "chapter_name", "par", "kind", "page", "page_end", F.posexplode(split_long(F.col("text"), p.hard_max)).alias("piece", "text"))
    w = W.partitionBy("doc", "section").orderBy("par", "piece")
    start = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return pieces.withColumn("idx", F.row_number().over(w) - 1).withColumn("start", start).withColumn("end", F.col("start") + F.length("text")).drop("par", "piece")


def ranges(at: DataFrame, p: ChunkParams) -> DataFrame:
    """doc, section, first, last: the atoms of each chunk (closed ranges).

    From an atom, a chunk reaches as far as ``target`` characters go, backs off to a sentence's end within ``sentence_window``, and the next one starts where at
    most ``overlap`` characters are repeated. All of that is a function of the first atom, so it is worked out for every atom by range windows, and followed from atom 0.
    """
    key = ["doc", "section"]
    by = W.partitionBy(*key)
    a = at.select(*key, "idx", "start", "end", T.ends_sentence(F.col("text"), p.sentence_ends).alias("stop"))
    back = F.last(F.when(F.col("stop"), F.col("idx")), ignorenulls=True).over(by.orderBy("end").rangeBetween(-p.sentence_window, 0))
    low = F.min("idx").over(by.orderBy("end").rangeBetween(-p.overlap, 0))
    look = a.select(*key, F.col("idx").alias("j"), back.alias("back"), low.alias("low"))
    far = F.max("idx").over(by.orderBy("start").rangeBetween(0, p.target + 1))
    size = F.count("*").over(by)
    # an atom i ends within target of start(p) exactly if atom i + 1 starts within target + 1; the last atom has no next one and is looked at by its own end
    total = F.max("end").over(by)
    reach = F.when(total - F.col("start") <= p.target, size - 1).otherwise(far - 1)
    a = at.select(*key, "idx", "start", "end").withColumn("j", F.greatest("idx", reach).cast("int")).withColumn("n", size)
    a = a.join(look, [*key, "j"])
    a = a.withColumn("last", F.when(F.col("back") >= F.col("idx"), F.col("back")).otherwise(F.col("j")))
    lows = look.select(*key, F.col("j").alias("last"), F.col("low").alias("low_of_last"))
    a = a.drop("low").join(lows, [*key, "last"])
    a = a.withColumn("next", F.when(F.col("last") < F.col("n") - 1, F.greatest(F.col("idx") + 1, F.col("low_of_last"))).cast("int"))
    chosen = orbit(a, key, "idx", "next")
    return a.join(chosen, [*key, "idx"]).select(*key, F.col("idx").alias("first"), F.col("last").cast("int").alias("last"))


def chunks(at: DataFrame, rng: DataFrame, p: ChunkParams, meta: DataFrame | None = None) -> DataFrame:
    """Assembled chunks, a row each. ``meta``: pdf_id, company, stock_code, report_year by ``doc``.

    A body shorter than ``min_tail`` outside front matter joins the chunk before it, whatever that one's chapter (so text moves as in the reference
    behaviour); what follows from the text is worked out afterwards. Fragments below ``min_keep`` go and numbers are given anew.
    """
    key = ["doc", "section"]
    inside = rng.select(*key, "first", "last", F.explode(F.sequence("first", "last")).alias("idx")).join(at, [*key, "idx"])
    body = inside.groupBy(*key, "first", "last").agg(
        F.sort_array(F.collect_list(F.struct("idx", "text", "page", "page_end"))).alias("x"), F.first("chapter_no").alias("chapter_no"), F.first("chapter_name").alias("chapter_name")
    )
    body = body.select(
        *key, "first", "chapter_no", "chapter_name", T.strip(F.array_join(F.transform("x", lambda a: a["text"]), "\n")).alias("text"), F.col("x")[0]["page"].alias("page_start"), F.element_at("x", -1)["page_end"].alias("page_end")
    ).where("text != ''")
    order = W.partitionBy("doc").orderBy("section", "first")
    front = F.col("chapter_no").isNull()
    merges = (F.length("text") < p.min_tail) & ~front & (F.row_number().over(order) > 1)
    body = body.withColumn("_new", F.when(merges, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("section", "first", "text", "page_start", "page_end", "chapter_no", "chapter_name")))
    one = body.groupBy("doc", "_g").agg(parts.alias("x"))
    head = F.col("x")[0]
    one = one.select(
        "doc", "_g", head["chapter_no"].alias("no"), head["chapter_name"].alias("name"), F.array_join(F.transform("x", lambda a: a["text"]), "\n").alias("text"), head["page_start"].alias("page_start"), F.element_at("x", -1)["page_end"].alias("page_end")
    ).where(F.length("text") >= p.min_keep)
    label = F.when(F.col("no").isNull(), F.lit(FRONT)).otherwise(F.concat(F.lit("第"), F.col("no").cast("string"), F.lit("节 "), F.col("name")))
    one = one.withColumn("chapter", label).withColumn("chapter_no", F.coalesce("no", F.lit(0)).cast("int")).withColumn("is_front", F.col("no").isNull())
    one = one.withColumn("chunk_index", F.row_number().over(W.partitionBy("doc").orderBy("_g")))
    one = one.withColumn("sec_chunk_index", F.row_number().over(W.partitionBy("doc", "chapter").orderBy("_g")))
    out = one.select(
        "doc", "chapter", "chapter_no", "is_front", F.col("page_start").alias("page"), "page_start", "page_end", "chunk_index", "sec_chunk_index",
        F.length("text").alias("char_len"), (F.col("text").contains("【表格】") | F.col("text").contains("【/表格】")).alias("has_table"),
        F.floor((F.length("text") - F.length(F.replace("text", F.lit(" | "), F.lit("")))) / 3).cast("int").alias("n_table_rows"), "text", F.sha1("text").alias("chunk_sha1"),
    )
    if meta is None:
        return out
    out = out.join(meta, "doc")
    return out.withColumn("chunk_id", F.format_string("%s#%04d", "pdf_id", "chunk_index")).withColumn("embed_text", T.embed_text(F.col("company"), F.col("report_year"), F.col("chapter"), F.col("text")))


def chunked(items: DataFrame, p: ChunkParams, meta: DataFrame | None = None) -> DataFrame:
    """Items to chunks."""
    s = cut(sectioned(items, cut(chapters(heading_candidates(items)))))
    a = cut(atoms(paragraphs(s, p), p))  # read three times below
    return chunks(a, ranges(a, p), p, meta)
