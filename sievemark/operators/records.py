"""Typed records from tables: vertical tables by header words, wide expert tables, continued tables, metadata sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exprs import compact, number, strip
from .text import looks_like_bidder

# Words of the header that name a column.
HEADERS = {
    "bidder": ("投标人", "供应商", "单位名称", "supplier_name", "bidder"),
    "expert": ("专家", "评委"),
    "factor": ("评审因素", "评分项", "评分因素"),
    "max_score": ("满分", "最高分"),
    "raw_score": ("得分", "原始分"),
    "weight": ("权重", "折算比例"),
    "weighted_score": ("折算得分", "加权得分"),
    "business_score": ("商务标部分", "商务得分", "商务分"),
    "technical_score": ("技术标部分", "技术得分", "技术分"),
    "price_score": ("价格标部分", "价格得分", "报价得分"),
    "total_score": ("总得分", "总分", "合计得分", "得分合计"),
    "rank": ("排名", "排序", "名次"),
    "bid_price": ("投标报价", "报价金额", "投标总价", "bid_price"),
    "lot": ("标段", "包号", "采购包"),
}
TEXT_COLUMNS = ("bidder", "expert", "factor", "lot")
METADATA = ("supplier_code", "supplier_name", "file_author", "created_time", "creation_tool", "upload_ip", "mac_address", "machine_code", "cost_software_lock_id")


def header_index(header: Column, words: tuple[str, ...]) -> Column:
    """0-based place of the first column that is one of the words, else of the first that contains one; null without."""
    names = F.transform(header, compact)
    exact = F.array_position(F.transform(names, lambda h: h.isin(*words)), True)
    part = F.array_position(F.transform(names, lambda h: h.rlike("|".join(words))), True)
    return F.nullif(F.when(exact > 0, exact).otherwise(part), F.lit(0)) - 1


def vertical(tables: DataFrame) -> DataFrame:
    """(doc, table_no, row, bidder, ... every column of HEADERS): rows of tables (doc, table_no, rows) that name a bidder."""
    at = tables.filter("size(rows) > 1").select("doc", "table_no", "rows", *[header_index(F.col("rows")[0], w).cast("int").alias(f"__{c}") for c, w in HEADERS.items()]).filter("__bidder IS NOT NULL")
    rows = at.select("*", F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("pos", "cells"))
    cell = lambda c: strip(F.coalesce(F.get("cells", F.col(f"__{c}")), F.lit("")))
    out = rows.select("doc", "table_no", (F.col("pos") + 2).alias("row"), *[(compact(cell(c)) if c == "bidder" else cell(c) if c in TEXT_COLUMNS else number(cell(c)).cast("int" if c == "rank" else "double")).alias(c) for c in HEADERS])
    return out.filter(looks_like_bidder("bidder") & ~F.col("bidder").isin("合计", "总计"))


def horizontal(tables: DataFrame) -> DataFrame:
    """(doc, table_no, row, bidder, expert, factor, max_score, raw_score): experts in columns, factors in rows.

    tables: doc, table_no, bidder, rows. A table whose header begins with 评委 names the experts; tables after it go on
    with the same experts and bidder until the next. The section in the first column is carried down.
    """
    first = F.transform(F.col("rows")[0], compact)
    head = first[0] == "评委"
    w = Window.partitionBy("doc").orderBy("table_no").rowsBetween(Window.unboundedPreceding, 0)
    names = F.filter(F.slice(first, 2, F.size(first)), lambda n: n.rlike("^[\\u4e00-\\u9fa5·]{2,8}$"))
    t = tables.filter("size(rows) > 0").withColumn("head", head).withColumn("experts", F.last(F.when(head, names), True).over(w)).withColumn("bidder", F.last(F.when(head, F.nullif("bidder", F.lit(""))), True).over(w))
    t = t.filter("experts IS NOT NULL AND bidder IS NOT NULL AND size(experts) > 0")
    rows = t.select("doc", "table_no", "bidder", "experts", F.posexplode(F.when(F.col("head"), F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows"))).alias("pos", "cells"))
    start = F.when(F.col("cells")[0].rlike("商务标部分|技术标部分|价格标部分"), F.regexp_replace(compact(F.col("cells")[0]), "（.*?分）", ""))
    down = Window.partitionBy("doc", "table_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.size("cells") >= F.size("experts") + 2, 1).otherwise(0)
    rows = rows.withColumn("section", F.last(start, True).over(down)).withColumn("at", at).withColumn("factor", compact(F.coalesce(F.get("cells", F.col("at")), F.lit(""))))
    rows = rows.filter("factor <> '' AND factor <> '合计'").withColumn("scores", F.slice("cells", F.col("at") + 2, F.size("experts"))).filter("size(scores) = size(experts)")
    each = rows.select("*", F.explode(F.arrays_zip("experts", "scores")).alias("s")).withColumn("raw_score", number(F.col("s.scores"))).filter("raw_score IS NOT NULL")
    full = F.regexp_extract("factor", r"[（(](\d+(?:\.\d+)?)分[）)]", 1).try_cast("double")
    return each.select("doc", "table_no", (F.col("pos") + 2).alias("row"), "bidder", F.col("s.experts").alias("expert"), F.concat_ws("/", "section", "factor").alias("factor"), full.alias("max_score"), "raw_score")


def merge_continued(tables: DataFrame) -> DataFrame:
    """(doc, table_no, page, page_end, continued, rows): tables on consecutive pages with the same header as one."""
    w = Window.partitionBy("doc").orderBy("table_no")
    header = F.transform(F.col("rows")[0], lambda c: F.lower(compact(c)))
    goes_on = F.coalesce((F.col("page") == F.lag("page").over(w) + 1) & (F.col("h") == F.lag("h").over(w)), F.lit(False))
    t = tables.withColumn("h", header).withColumn("goes_on", goes_on).withColumn("island", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("table_no", F.when(F.col("goes_on"), F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows")).alias("rows"))
    out = t.groupBy("doc", "island").agg(F.min("table_no").alias("table_no"), F.min("page").alias("page"), F.max("page").alias("page_end"), (F.count("*") > 1).alias("continued"), F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["rows"])).alias("rows"))
    return out.drop("island")


def submission_metadata(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, METADATA..., raw_line): rows of the metadata worksheet, marked in the text by its name."""
    line = strip("raw")
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select("doc", "pos", line.alias("raw_line"))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sheet", F.last(F.when(F.col("raw_line").startswith("【工作表："), F.col("raw_line")), True).over(w)).filter("sheet LIKE '【工作表：文件与网络元数据】%'")
    cells = F.transform(F.split("raw_line", r"\|"), strip)
    rows = rows.withColumn("cells", cells).filter((F.size("cells") >= len(METADATA)) & ~F.col("raw_line").startswith("supplier_code"))
    return rows.select("doc", "pos", *[F.col("cells")[i].alias(c) for i, c in enumerate(METADATA)], "raw_line")
