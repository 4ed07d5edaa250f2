"""Headers and footers: lines that repeat in the bands at the top and bottom of a document's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# The bands' shares of a page's height, and how often a line must repeat.
TOP, BOTTOM, SHARE, LEAST = 0.12, 0.88, 0.5, 3


def banded(lines: DataFrame) -> DataFrame:
    """Lines (doc, page, y0, y1, height, text) with their band (top, bottom or null) and canonical text."""
    band = F.when(F.col("y1") < F.col("height") * TOP, "top").when(F.col("y0") > F.col("height") * BOTTOM, "bottom")
    return lines.withColumn("band", band).withColumn("canon", T.canon(F.col("text")))


def repeated(banded_lines: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """doc, band, canon, n of lines that at least max(least, share * pages) places have."""
    pages = banded_lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    n = banded_lines.where(F.col("band").isNotNull() & F.length("canon").between(4, 100)).groupBy("doc", "band", "canon").agg(F.count("*").alias("n"))
    return n.join(pages, "doc").where(F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("pages"))).select("doc", "band", "canon", "n")


def without_furniture(banded_lines: DataFrame, furniture: DataFrame) -> DataFrame:
    """Lines less blank ones, page numbers in a band, and repeated ones of that band."""
    own = banded_lines.where((T.strip(F.col("text")) != "") & ~(F.col("band").isNotNull() & T.is_page_number(F.col("text"))))
    return own.join(furniture.select("doc", "band", "canon"), ["doc", "band", "canon"], "left_anti")


def body_size(lines: DataFrame) -> DataFrame:
    """doc, body_size: the font size (to a tenth) that most characters have; the smaller one of a tie."""
    chars = lines.groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return chars.groupBy("doc").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))


def attach_sizes(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (doc, page, row, y0, y1) with the size of the line of their page that overlaps most; the first of a tie, 0 without any."""
    line = lines.select("doc", "page", F.col("y0").alias("ly0"), F.col("y1").alias("ly1"), "line_no", F.col("size").alias("_s"))
    overlap = F.least("y1", "ly1") - F.greatest("y0", "ly0")
    best = rows.join(line, ["doc", "page"]).where(overlap > 0).groupBy("doc", "page", "row").agg(F.max_by("_s", F.struct(overlap, -F.col("line_no"))).alias("_best"))
    return rows.join(best, ["doc", "page", "row"], "left").withColumn("size", F.coalesce("_best", F.lit(0.0))).drop("_best")
