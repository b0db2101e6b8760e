"""Operators over document text: keyword lines, sections, chunks, extraction and classification. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..exprs import clean_text, col, compact, contains_any, count_hits, first_case, lines, money_yuan, normalize_clause, strip, unique_keep_order
from .quotes import find_quotes


def keyword_lines(text: str | Column, words: list[str] | tuple[str, ...], limit: int = 8, width: int = 240) -> Column:
    """The first ``limit`` lines with any of the words, cut to ``width``, then distinct."""
    return F.array_distinct(F.transform(F.slice(F.filter(lines(text), lambda x: contains_any(x, words)), 1, limit), lambda x: F.substring(x, 1, width)))


def missing_words(text: str | Column, words: list[str] | tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: ~F.contains(col(text), w))


def collusion_snippets(text: str | Column, limit: int = 5) -> Column:
    found = [F.regexp_extract_all(col(text), F.lit("(?i)" + p), F.lit(0)) for p in K.COLLUSION_PATTERNS]
    return F.slice(unique_keep_order(F.concat(*found)), 1, limit)


def is_heading(line: str | Column) -> Column:
    text = col(line)
    numbered = text.rlike("(?U)" + K.HEADINGS[2]) & text.rlike("[。；;]$")
    return (F.length(text) <= 80) & ~numbered & text.rlike("(?U)(?:" + "|".join(K.HEADINGS) + ")")


def heading_level(title: str | Column) -> Column:
    text = col(title)
    digits = F.regexp_extract(text, r"(?U)^(\d+(?:\.\d+)*)", 1)
    return first_case(
        [
            (text.startswith("第") & F.substring(text, 1, 8).rlike("[篇部分章]"), 1),
            (text.rlike(r"^[一二三四五六七八九十]+、"), 1),
            (digits != "", F.least(F.size(F.split(digits, r"\.")), F.lit(4))),
        ],
        2,
    )


def islands(df: DataFrame, keys: list[str], order: str, opens: Column, out: str = "island") -> DataFrame:
    """Numbers runs that begin where ``opens`` holds; rows before the first are run 0."""
    return df.withColumn(out, F.sum(opens.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def sections(docs: DataFrame, doc: str, text: str, limit: int | None = 200) -> DataFrame:
    """(doc, section_no, title, level, line_start, content): text cut at its headings, at most ``limit`` for a document.

    Without a limit all sections come.

    What stands before the first heading is 文档正文 and only comes where it has text.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select("doc", "pos", strip("raw").alias("line"))
    rows = islands(rows.withColumn("head", is_heading("line")), ["doc"], "pos", F.col("head"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head") & (F.col("line") != ""), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    out = rows.groupBy("doc", "island").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("h"), (F.min("pos") + 1).alias("line_start"), body.alias("content"))
    out = out.filter("h IS NOT NULL OR content <> ''").withColumn("title", F.coalesce("h", F.lit("文档正文")))
    out = out.withColumn("section_no", F.row_number().over(Window.partitionBy("doc").orderBy("island")))
    if limit is not None:
        out = out.filter(F.col("section_no") <= limit)
    return out.select("doc", "section_no", "title", F.when(F.col("h").isNull(), 1).otherwise(heading_level("title")).alias("level"), "line_start", "content")


def chunks(df: DataFrame, doc: str, section_no: str | Column, text: str, size: int = K.CHUNK, step: int = K.CHUNK_STEP) -> DataFrame:
    """(doc, part, chunk_id, content, source_hash): overlapping windows of each text; blank texts give none."""
    body = strip(text)
    last = F.greatest(F.lit(0), F.ceil((F.length("body") - size) / step)).cast("int")
    rows = df.select(F.col(doc).alias("doc"), col(section_no).alias("section_no"), body.alias("body")).filter("body <> ''")
    rows = rows.select("doc", "section_no", "body", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    rows = rows.withColumn("content", strip(F.substring(F.col("body"), F.col("part") * step + 1, F.lit(size)))).filter("content <> ''").withColumn("source_hash", F.sha2("content", 256))
    name = F.format_string("%s-s%s-c%s-%s", F.col("doc").cast("string"), F.col("section_no").cast("string"), (F.col("part") + 1).cast("string"), F.substring("source_hash", 1, 8))
    return rows.select("doc", (F.col("part") + 1).alias("part"), name.alias("chunk_id"), "content", "source_hash")


def neighbours(df: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """Rows where ``hit`` holds, and the rows next to them."""
    near = F.max(hit.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1))
    return df.withColumn("__near", near).filter("__near = 1").drop("__near")


def phones(text: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(text), F.lit(K.PHONE), F.lit(0))))


def emails(text: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(K.EMAIL), F.lit(0)), F.lower)))


def legal_citations(text: str | Column) -> Column:
    """Distinct (law, article), first seen first."""
    pattern = r"(?U)《([^》]{2,80})》\s*第([一二三四五六七八九十百零〇0-9]+)条"
    names, articles = (F.regexp_extract_all(col(text), F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.transform(F.arrays_zip(names.alias("a"), articles.alias("b")), lambda x: F.struct(strip(x["a"]).alias("law"), F.concat(F.lit("第"), x["b"], F.lit("条")).alias("article"))))


def meaningful_terms(text: str | Column, limit: int = 8) -> Column:
    terms = F.regexp_extract_all(col(text), F.lit("[\\u4e00-\\u9fff]{4,}"), F.lit(0))
    return F.slice(F.filter(terms, lambda t: ~t.isin(*K.STOP_TERMS)), 1, limit)


def guess_project_name(text: str | Column, fallback: str | Column = "") -> Column:
    found = [F.nullif(F.regexp_extract(col(text), rf"(?U){label}[:：]\s*([^\n\r]+)", 1), F.lit("")) for label in ("项目名称", "招标项目名称", "工程名称")]
    return F.coalesce(*[F.substring(strip(f), 1, 80) for f in found], fallback if isinstance(fallback, Column) else F.lit(fallback))


def first_match(text: str | Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that matches, stripped; null without one."""
    return F.coalesce(*[F.when(col(text).rlike("(?m)" + p), strip(F.regexp_extract(col(text), "(?m)" + p, 1))) for p in patterns])


def file_type(name: str | Column) -> Column:
    business = F.lower(col(name)).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in K.BUSINESS_SUFFIXES) + ")$")
    return first_case([(contains_any(name, words), kind) for words, kind in K.FILE_TYPES] + [(business, "业务文件")], "未知文件")


def document_subtype(name: str | Column, kind: str | Column) -> Column:
    return first_case([(contains_any(name, words), sub) for words, sub in K.SUBTYPES], F.coalesce(F.nullif(col(kind), F.lit("")), F.lit("其他资料")))


def subtype_from_content(subtype: str | Column, text: str | Column) -> Column:
    head = F.regexp_replace(F.substring(col(text), 1, 2500), r"[ \t]+", "")
    upgrade = col(subtype).isin("业务文件", "其他资料") & F.contains(head, F.lit("响应文件")) & contains_any(head, ("合作方：", "合作方:", "投标人：", "供应商："))
    return F.when(upgrade, "响应文件").otherwise(col(subtype))


def document_role(name: str | Column, kind: str | Column, subtype: str | Column) -> Column:
    text = F.lower(F.concat_ws(" ", col(name), col(kind), col(subtype)))
    return first_case([(contains_any(text, words), role) for words, role in K.ROLES], "other")


def is_placeholder(value: str | Column) -> Column:
    text = compact(value)
    return (text == "") | text.rlike(r"^[_＿—\-/.（）()\[\]【】]+(?:万元|元)?$") | text.rlike("[_＿]{2,}") | F.lower(text).isin(*K.NULL_WORDS)


def is_definition(field: str | Column, value: str | Column) -> Column:
    text = compact(value)
    words = text.startswith("指") | text.startswith("是指") | contains_any(text, ("依法进行政府采购", "受采购人委托")) | ((F.contains(text, F.lit("本项目采购人")) | F.contains(text, F.lit("本项目采购代理机构"))) & F.contains(text, F.lit("见")))
    return col(field).isin("tenderer", "procurement_agency") & words


def looks_like_bidder(value: str | Column) -> Column:
    text = compact(value)
    return (text != "") & (F.length(text) <= 80) & ~F.contains(col(value), F.lit("\n")) & ~text.rlike(r"(?U)^[（(]?\d+[）).、]") & ~contains_any(text, K.NOT_BIDDER_WORDS) & text.rlike(K.ORGANISATION_END)


def is_unfilled_template(text: str | Column) -> Column:
    return (count_hits(text, K.TEMPLATE_MARKERS) >= 2) & (F.regexp_count(col(text), F.lit(r"(?:_{2,}|＿{2,}|□|\[待填写\]|【待填写】)")) >= 3)


def is_non_operational(line: str | Column) -> Column:
    text = compact(line)
    return text.rlike(r"[【\[][】\]]") | contains_any(text, ("本项目注册资本", "项目公司注册资本", *K.REFERENCE_MARKERS)) | (F.contains(text, F.lit("资金来源")) & F.contains(text, F.lit("注册资本")))


def clause_category(line: str | Column) -> Column:
    """The risk category of a clause line of 8 to 500 characters, '' without one."""
    c = col(line)
    rules = [
        ((F.length(c) < 8) | (F.length(c) > 500), ""),
        (contains_any(c, ("注册地址", "本市设立", "本地企业")) & contains_any(c, ("必须", "不得", "得", "满")), "地域或本地条件"),
        (F.contains(c, F.lit("品牌")) & contains_any(c, ("必须", "指定", "不接受", "不得分", "得分")), "品牌限制或品牌评分"),
        (contains_any(c, ("丰富", "全面深入", "优秀", "良好", "一般", "较差")) & c.rlike(r"(?U)得\s*\d+(?:\.\d+)?\s*分"), "主观评分"),
        ((contains_any(c, ("调整", "改变")) & contains_any(c, ("中标候选人", "评标结果", "评审结果"))) | F.contains(c, F.lit("无需说明理由")), "程序权限"),
        (contains_any(c, ("注册资本", "成立满", "项目业绩")) & c.rlike(r"(?U)\d"), "资格门槛"),
    ]
    return first_case(rules, "")


def coverage_candidates(docs: DataFrame, doc: str, text: str, limit: int = 20) -> DataFrame:
    """(doc, pos, evidence, category): clause lines at risk, the first of those that read the same, ``limit`` a document."""
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select("doc", "pos", strip("raw").alias("evidence"))
    rows = rows.withColumn("category", clause_category("evidence")).filter((F.col("category") != "") & ~is_non_operational("evidence")).withColumn("key", normalize_clause("evidence"))
    firsts = rows.groupBy("doc", "key").agg(F.min(F.struct("pos", "evidence", "category")).alias("r")).select("doc", "r.*")
    return firsts.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).filter(F.col("n") <= limit).drop("n")


def uncovered(candidates: DataFrame, returned: DataFrame, evidence: str = "evidence") -> DataFrame:
    """The candidates whose evidence neither holds nor is held by any returned evidence; blank ones cover nothing.

    Either way is a search of many quotes in many texts, by the quotes' rarest words.
    """
    held = returned.select(normalize_clause(evidence).alias("text")).filter("text <> ''").distinct()
    rows = candidates.withColumn("__own", normalize_clause(evidence))
    own = rows.select(F.col("__own").alias("text")).filter("text <> ''").distinct()
    pair = lambda quotes, texts: find_quotes(quotes.select(F.col("text").alias("qid"), F.col("text").alias("quote")), texts.select(F.col("text").alias("id"), "text"))
    covered = pair(held, own).select(F.col("id").alias("__own")).unionByName(pair(own, held).select(F.col("qid").alias("__own"))).distinct()
    return rows.join(covered, "__own", "left_anti").select(*candidates.columns)


def clause_group(text: str | Column) -> Column:
    hits = [count_hits(text, words) for _, words in K.CLAUSE_GROUPS]
    best = F.greatest(*hits)
    return first_case([(contains_any(text, words), g) for words, g in K.CLAUSE_OVERRIDES] + [(best == 0, "procedure")] + [(h == best, g) for h, (g, _) in zip(hits, K.CLAUSE_GROUPS, strict=True)], "procedure")


def assessment(statement: str | Column, basis: str | Column) -> Column:
    return first_case([(contains_any(statement, K.UNCERTAIN_MARKERS), 0.55), (strip(basis) == "", 0.45)], 0.85)


def is_non_issue(statement: str | Column, a: str | Column, b: str | Column) -> Column:
    x, y = F.lower(compact(a)), F.lower(compact(b))
    return contains_any(statement, K.NO_ISSUE_MARKERS) | ((x != "") & (x == y))


def bond_is_covered(statement: str | Column, bond: str | Column, budget: str | Column) -> Column:
    """A bid bond of at most 2 % of the budget."""
    b, g = money_yuan(budget), money_yuan(bond)
    return F.contains(col(statement), F.lit("投标保证金")) & F.coalesce((b > 0) & (g <= b * 0.02 + 0.01), F.lit(False))


def seal_matches(seal: str | Column, entities: str | Column) -> Column:
    """True or false where both sides have text, else null: one contains the other after seal words and signs are gone."""
    keep = lambda c: F.regexp_replace(c, r"(?U)[^\w一-鿿]", "")
    s = keep(F.regexp_replace(col(seal), "系统测试专用章|测试专用章|合同专用章|财务专用章|公章", ""))
    names = F.transform(F.filter(col(entities), lambda e: e != ""), keep)
    return F.when((s != "") & (F.size(names) > 0), F.exists(names, lambda e: F.contains(e, s) | F.contains(s, e)))


def key_fields(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, field, value, raw_text): for each field the first pattern, in order, with a value that is no placeholder."""
    parts = [F.struct(F.lit(i).alias("n"), F.lit(f).alias("field"), strip(F.regexp_extract(text, "(?U)" + p, 1)).alias("value"), strip(F.regexp_extract(text, "(?U)" + p, 0)).alias("raw_text")) for i, (f, p) in enumerate(K.FIELD_PATTERNS)]
    rows = docs.select(F.col(doc).alias("doc"), F.explode(F.array(*parts)).alias("m")).select("doc", "m.*")
    rows = rows.withColumn("value", F.substring(F.regexp_replace(F.regexp_replace("value", r"[ \t]+", " "), "[。；;，,]+$", ""), 1, 200)).filter(~is_placeholder("value") & ~is_definition("field", "value"))
    return rows.groupBy("doc", "field").agg(F.min(F.struct("n", "value", "raw_text")).alias("r")).select("doc", "field", "r.value", "r.raw_text")


def text_records(docs: DataFrame, doc: str, subtype: str, text: str) -> DataFrame:
    """(doc, pos, kind, bidder, rank, detail): rejections or invalid-bid clauses, opinions and candidates by line."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(subtype).alias("subtype"), F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select("doc", "subtype", "pos", strip("raw").alias("line")).filter("line <> ''")
    result = F.col("subtype").isin("评标报告", "废标说明", "评审意见", "中标候选人推荐表")
    bidder = strip(F.regexp_extract("line", "(?:投标人|供应商)[：:]?\\s*([^，,；;。]+)", 1))
    reject = contains_any("line", ("废标", "否决投标", "投标无效", "响应无效"))
    reason = F.coalesce(F.nullif(strip(F.regexp_extract("line", r"(?:原因|理由)[：:]?\s*(.+)$", 1)), F.lit("")), F.col("line"))
    ranked = F.regexp_extract("line", r"第([一二三四五六七八九十\d]+)中标候选人[：:]?\s*([^，,；;。]+)", 1)
    place = F.when(ranked.rlike(r"^\d+$"), ranked.try_cast("int")).otherwise(F.nullif(F.expr(f"locate(__r, '{K.HAN_DIGITS}')"), F.lit(0)))
    rows = rows.withColumn("__r", ranked)
    none = F.lit(None)
    kinds = F.array(
        F.when(reject & result & (bidder != ""), F.struct(F.lit("rejection").alias("kind"), bidder.alias("bidder"), none.cast("int").alias("rank"), reason.alias("detail"))),
        F.when(reject & ~result, F.struct(F.lit("invalid_bid_clause").alias("kind"), F.lit("").alias("bidder"), none.cast("int").alias("rank"), F.col("line").alias("detail"))),
        F.when(contains_any("line", ("评审意见", "评标意见", "评审结论")), F.struct(F.lit("opinion").alias("kind"), F.lit("").alias("bidder"), none.cast("int").alias("rank"), strip(F.regexp_replace("line", "^[^：:]*[：:]", "")).alias("detail"))),
        F.when(ranked != "", F.struct(F.lit("candidate").alias("kind"), strip(F.regexp_extract("line", r"第([一二三四五六七八九十\d]+)中标候选人[：:]?\s*([^，,；;。]+)", 2)).alias("bidder"), place.alias("rank"), F.col("line").alias("detail"))),
    )
    return rows.select("doc", "pos", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("r")).select("doc", "pos", "r.*")


def greedy_chunks(df: DataFrame, doc: str, text: str, size: int, overlap: int) -> DataFrame:
    """(doc, chunk_no, content): lines packed up to ``size`` characters, each chunk beginning with the last ``overlap`` of the one before.

    A fold over each document's lines; it stays in the JVM.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(True).alias("empty"))

    def step(a: Column, line: Column) -> Column:
        over = ~a["empty"] & (F.length(a["now"]) + 1 + F.length(line) > size)
        tail = F.regexp_replace(F.substring(a["now"], F.greatest(F.lit(1), F.length(a["now"]) - overlap + 1), F.lit(overlap)), r"(?U)^\s+", "")
        begun = F.when(tail == "", line).otherwise(F.concat(tail, F.lit("\n"), line))
        grown = F.when(a["empty"], line).otherwise(F.concat(a["now"], F.lit("\n"), line))
        return F.struct(F.when(over, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"), F.when(over, begun).otherwise(grown).alias("now"), F.lit(False).alias("empty"))

    packed = F.aggregate(lines(text), zero, step, lambda a: F.when(a["empty"], a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return df.select(F.col(doc).alias("doc"), F.posexplode(packed).alias("pos", "content")).select("doc", (F.col("pos") + 1).alias("chunk_no"), "content")


def garbled(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit("�")) > F.greatest(F.lit(3.0), F.length(col(text)) / 200)


def digest(text: str | Column) -> Column:
    return F.md5(clean_text(text))
