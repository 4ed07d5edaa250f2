"""Scalar text functions, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks that count for normalisation (with the ideographic space), numerals, and the sections' canonical names.
SPACES = r"(?U)[\s　]+"
NUMERALS = "一二三四五六七八九十"
CANONICAL = [
    "重要提示、目录和释义",
    "公司简介和主要财务指标",
    "管理层讨论与分析",
    "公司治理",
    "环境和社会责任",
    "环境与社会责任",
    "公司治理、环境和社会",
    "重要事项",
    "股份变动及股东情况",
    "优先股相关情况",
    "债券相关情况",
    "财务报告",
    "备查文件目录",
]
#: Three-digit code prefixes by market.
MARKETS = {
    "SH": ["600", "601", "603", "605", "688", "689"],
    "SZ": ["000", "001", "002", "003", "300", "301", "302"],
    "BJ": ["920", "430"],
}
#: Titles with any of these aren't a report's main text.
EXCLUDED_TITLE = (
    r"(?i)摘要|英文|English|Annual\s*Report|更正|补充|澄清|问询|提示|说明会|路演|半年度|季度|一季|三季|审计|鉴证|审阅|内部控制|财务报表附注"
    r"|监事会|董事会|独立董事|股东大会|业绩预告|业绩快报|社会责任|ESG|环境、社会|H股|港股"
)
ABOUT_NOTICE = r"^关于.{0,40}?(的)?(公告|通知|说明|提示性公告|更正公告|回复|问询函)$"
YEAR_LONG = r"(?<!\d)(20\d{2})[\s_]*年?[\s_]*年度报告"
YEAR_SHORT = r"(?<!\d)(20\d{2})[\s_]*年?[\s_]*年报[\s_]*(?:[（(][^）)]*[）)])?[\s_]*$"
#: Characters of readable pages.
READABLE = r"[一-鿿＀-￯　-〿A-Za-z0-9 \n\r\t.,;:%()\[\]（）【】・·—–\-+/=]"
PAGE_NUMBER = r"^\s*(\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|第\s*\d+\s*页|共\s*\d+\s*页)\s*$"
DOT_LEADER = r".{2,60}(\.{4,}|…{2,})\s*\d+"
STOPWORDS = "的 了 和 与 及 或 为 在 是 等 有 中 上 下 之 其 该 本 我们 公司 以及 其中".split()
TOKEN = r"[\p{L}\p{N}]{2,}"


#: Blanks at an end that ``strip`` takes: those of any script, and the four separators U+001C to U+001F.
_EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(t: Column) -> Column:
    """Without blanks at both ends, whatever kind of blank."""
    return F.regexp_replace(F.coalesce(t, F.lit("")), _EDGES, "")


def norm(t: Column) -> Column:
    """Without blanks and cell separators."""
    return F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)[\s　|]+", "")


def canon(t: Column) -> Column:
    """Without blanks, each run of digits as one #: what a repeated header or footer has in common."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), SPACES, ""), r"(?U)\d+", "#")


def is_dot_leader(t: Column) -> Column:
    blank = r"[\s\x1c-\x1f]"
    return F.coalesce(t, F.lit("")).rlike(rf"(?U)\A{blank}*(?!{blank}){DOT_LEADER}{blank}*\z")


def is_page_number(t: Column) -> Column:
    return F.coalesce(t, F.lit("")).rlike(PAGE_NUMBER)


def numeral(s: Column) -> Column:
    """A Chinese numeral from 1 to 99; 0 for anything else."""
    digit = lambda c, other: F.when(F.length(c) == 1, F.coalesce(F.nullif(F.instr(F.lit(NUMERALS[:9]), c), F.lit(0)), F.lit(other))).otherwise(other)
    at = F.instr(s, NUMERALS[9])
    before, after = F.substring_index(s, NUMERALS[9], 1), F.expr("1")
    after = F.substring(s, at + 1, F.length(s))
    tens = F.when(before == "", 1).otherwise(digit(before, 1))
    ones = F.when(after == "", 0).otherwise(digit(after, 0))
    return F.when(at > 0, tens * 10 + ones).otherwise(digit(s, 0)).cast("int")


def with_heading(df: DataFrame, text: str, following: str) -> DataFrame:
    """``df`` with no and name where ``text`` is a section's heading, else null; the name may stand in the line that follows.

    The steps are columns of their own, so that each pattern is tried once a row.
    """
    s, found, body, rest, tail, after = (F.col(c) for c in ("_s", "_found", "_body", "_rest", "_tail", "_after"))
    plain = s.rlike(f"^第[{NUMERALS}]+节") & (F.length(s) <= 70)
    glued = s.rlike(f"第[{NUMERALS}]+节") & (F.length(found) <= 40) & found.rlike("年度报告|股份|有限公司")
    names = [F.when(rest.startswith(c), F.lit(c)) for c in sorted(CANONICAL, key=lambda c: (-len(c), c))]
    cross_reference = tail.rlike('["“”之]') | tail.rlike(f"^[{NUMERALS}0-9]+[、.]") | tail.contains("章") | tail.startswith("规定")
    named = tail.isin(CANONICAL) | ((F.length(tail) <= 20) & ~tail.rlike("[0-9、]"))
    from_next = (F.length(after) > 0) & (F.length(after) <= 20) & ~is_dot_leader(F.col(following))
    out = (
        df.withColumn("_s", norm(F.col(text)))
        .withColumn("_found", F.regexp_extract(s, f"^(.*?)第[{NUMERALS}]+节", 1))
        .withColumn("_body", F.when(plain, s).when(glued, F.substring(s, F.length(found) + 1, F.length(s))))
        .withColumn("_number", F.regexp_extract(body, f"^第([{NUMERALS}]+)节", 1))
        .withColumn("_rest", F.regexp_extract(body, f"^第[{NUMERALS}]+节(.*)$", 1))
        .withColumn("_tail", F.coalesce(*names, rest))
        .withColumn("_after", norm(F.col(following)))
        .withColumn("no", numeral(F.col("_number")))
        .withColumn("name", F.when(tail == "", F.when(from_next, after)).when(~cross_reference & named, tail))
    )
    ok = ~is_dot_leader(F.col(text)) & (s != "") & (F.col("no") > 0) & F.col("name").isNotNull()
    return out.withColumn("no", F.when(ok, F.col("no"))).withColumn("name", F.when(F.col("no").isNotNull(), F.col("name"))).drop("_s", "_found", "_body", "_number", "_rest", "_tail", "_after")


def ends_sentence(text: Column, ends: str) -> Column:
    """Does the text, without blanks at its end, end with one of ``ends``?"""
    marks = "".join("\\" + c if c in ".?!" else c for c in ends)
    return F.regexp_replace(text, r"(?U)\s+\z", "").rlike(f"[{marks}]\\z")


def title_year(title: Column) -> Column:
    """The one year whose report a title announces, else null."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"<[^>]*>", "")
    t = F.btrim(F.regexp_replace(t, r"(?U)[\s　 ]+", " "))
    years = F.array_union(F.regexp_extract_all(t, F.lit(YEAR_LONG), F.lit(1)), F.regexp_extract_all(t, F.lit(YEAR_SHORT), F.lit(1)))
    return F.when((t != "") & ~t.rlike(EXCLUDED_TITLE) & ~t.rlike(ABOUT_NOTICE) & (F.size(years) == 1), F.get(years, F.lit(0)).cast("int"))


def market(code: Column) -> Column:
    by_prefix = [F.when(F.substring(code, 1, 3).isin(p), F.lit(m)) for m, p in MARKETS.items()]
    return F.coalesce(*by_prefix, F.when(F.substring(code, 1, 2).isin("83", "87") | F.substring(code, 1, 1).isin("4", "8"), F.lit("BJ")), F.lit("UNKNOWN"))


def stock_code(raw: Column) -> Column:
    """Six digits, or empty: quotes and a market's suffix go, short codes get zeros."""
    s = F.btrim(strip(raw), F.lit("'\""))
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\.(SH|SZ|BJ)$", ""), r"\D", "")
    return F.when(F.length(s).between(1, 6), F.lpad(s, 6, "0")).otherwise("")


def truth(raw: Column, default: bool = True) -> Column:
    s = F.lower(strip(raw))
    return F.when(s.isin("0", "false", "no", "n", "否", "停用"), False).when(s.isin("1", "true", "yes", "y", "是", "启用"), True).otherwise(default)


def file_name(raw: Column, most: int = 120) -> Column:
    """A name that any file system takes: characters that some forbid go, runs of blanks are one, and no blank or dot stands at the right end."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), r'[/\\:*?"<>|\n\r\t]', "")
    s = F.regexp_replace(strip(F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+", " ")), r"[. ]+\z", "")
    reserved = F.upper(F.substring_index(s, ".", 1)).rlike(r"\A(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])\z")
    return F.substring(F.when(reserved, F.concat(F.lit("_"), s)).otherwise(s), 1, most)


def page_quality(text: Column, min_chars: int = 80, ratio: float = 0.85, short: int = 8) -> Column:
    """empty, garbled or ok; a short text is ok if it has ``short`` characters, nearly all readable."""
    t = F.coalesce(text, F.lit(""))
    # runs of readable characters are long, so taking them out is quicker than taking out what is left
    share = lambda x: (F.length(x) - F.length(F.regexp_replace(x, READABLE + "++", ""))) / F.greatest(F.length(x), F.lit(1))
    stripped = strip(t)
    whole = (F.length(t) >= min_chars) & (share(t) >= ratio)
    # looked at only where the whole text isn't enough
    clean = (F.length(stripped) >= short) & (share(stripped) >= ratio)
    return F.when(whole, "ok").when(clean, "ok").when(F.length(t) < min_chars, "empty").otherwise("garbled")


def without_cjk_gaps(t: Column) -> Column:
    """Without the blanks that recognition puts between ideographs."""
    return F.regexp_replace(t, r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])", "")


def joined(before: Column, after: Column) -> Column:
    """What goes between two parts of a wrapped cell."""
    a, b = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    close = r"(?U)^([.,%]|\d|[一-鿿])$"
    return F.when((F.coalesce(before, F.lit("")) == "") | (F.coalesce(after, F.lit("")) == "") | a.rlike(close) | b.rlike(close), "").otherwise(" ")


def tokens(text: Column) -> Column:
    """The default tokenizer: runs of two or more letters and digits, lower-cased, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(STOPWORDS))


def announcement_date(epoch_ms: Column) -> Column:
    """The date in UTC+8."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(epoch_ms), "Asia/Shanghai"), "yyyy-MM-dd")


def pdf_id(code: Column, year: Column) -> Column:
    return F.concat_ws("_", code, year.cast("string"))


def embed_text(company: Column, year: Column, chapter: Column, body: Column) -> Column:
    """What an encoder reads: the passage under its heading."""
    return F.concat(company, F.lit(" "), year.cast("string"), F.lit("年年度报告 "), chapter, F.lit("\n"), body)


def output_name(code: Column, name: Column, year: Column, title: Column) -> Column:
    base = F.concat(code, F.lit("_"), file_name(name), F.lit("_"), year.cast("string"), F.lit("年年度报告"))
    return F.concat(base, F.when(title.rlike("修订|更新"), "_修订版").otherwise(""), F.lit(".pdf"))


def unquoted(t: Column, plus: bool = False) -> Column:
    """Percent escapes decoded as UTF-8; ``plus`` reads + as a blank, as in query strings. A text with a broken escape stays as it is."""
    s = F.coalesce(t, F.lit(""))
    return F.coalesce(F.try_url_decode(s if plus else F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def query_values(url: Column) -> Column:
    """The parameters after a url's ? and before its # as a map: names and values decoded, the last of a name, those without a value left out."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x.contains("=") & ~x.endswith("="))
    name = lambda x: unquoted(F.substring_index(x, "=", 1), plus=True)
    value = lambda x: unquoted(F.regexp_extract(x, r"(?s)=(.*)\z", 1), plus=True)
    # later pairs first, and of each name the first
    back = F.reverse(F.transform(pairs, lambda x: F.struct(name(x).alias("k"), value(x).alias("v"))))
    names = F.array_distinct(F.transform(back, lambda x: x["k"]))
    return F.map_from_entries(F.transform(names, lambda k: F.filter(back, lambda x: x["k"] == k)[0]))
