"""Rule executors over the relations of one review: each gives a row (rule_id, status).

Relations: docs (seq, doc, subtype, text), names (source, value), ids (source, value, raw_text), openings (doc, bidder,
price), rankings (doc, lot, bidder), marks (target, source_text, status), rejections (doc, bidder, reason, cited,
evidence), tables (doc, table_no, row_no, cells), summaries (bidder, total). A rule without data is insufficient_data.
Documents are never put together into one text: a rule asks each of them and aggregates the answers. Rules that are
executed together ask a relation together: what they want to know of it is one aggregate.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..exprs import col, compact, strip
from ..operators.links import repeated
from ..operators.quotes import find_quotes

# Patterns, words and suffixes that results must agree on.
LOT_PATTERNS = (r"(?:包编号|包号|标包)\s*[:：]?\s*([^\n；。]+)", r"项目编号\s*[:：]?\s*([^\n；。]*?(?:号-\d+|ZBDL\d+号-\d+))", r"项目名称\s*[:：]?\s*([^\n；。]*?\d+分包)")
NARRATIVE_PATTERN = r"(?:评标情况及说明|评标情况说明|评标情况|评审情况及说明|评审情况)[：:]?\s*([^\n]{0,120})"
SALE_PATTERNS = (
    r"(?:发售|获取|领取)(?:招标|采购)?文件(?:开始)?(?:时间)?\s*[:：]?\s*([^\n；。]+)",
    r"(?:发售|获取|领取)(?:招标|采购)?文件(?:截止|结束)(?:时间)?\s*[:：]?\s*([^\n；。]+)",
    r"(?:发售|获取)(?:招标|采购)?文件(?:时间|期限)?\s*[:：]?\s*([^\n；。]*(?:至|—|~)[^\n；。]+)",
)
DATE_PATTERNS = {
    "P2-04": (r"(?:投标|响应文件(?:递交|提交))?截止时间\s*[:：]?\s*([^\n；。]+)", r"提交投标文件的截止时间\s*[:：]?\s*([^\n；。]+)"),
    "P2-05": (r"(?:招标|采购)公告(?:发布)?日期\s*[:：]?\s*([^\n；。]+)", r"公告发布时间\s*[:：]?\s*([^\n；。]+)"),
    "P2-07": (r"开标地点\s*[:：]?\s*([^\n；。]+)",),
    "P2-08": (r"开标时间\s*[:：]?\s*([^\n；。]+)",),
}
DEADLINE_SECTION = r"投标截止及开标时间、地点[\s\S]{0,80}?时间\s*[:：]\s*([^\n；。]+)"
MEETING_DATE = r"开标日期\s*[:：]?\s*([^\n；。]+)"
FULL_DATE = r"20\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}"
ANY_DATE = r"(?:20\d{2}\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2}|\d{1,2}\s*月\s*\d{1,2}\s*日)"
DATE_KEY = r"(20\d{2})\D{0,3}(\d{1,2})\D{0,3}(\d{1,2})(?:\D{0,8}(\d{1,2})\s*[:时]\s*(\d{1,2}))?"
NO_VALUES = ("", "和地点", "及地点", "地点", "时间", "详见公告", "详见采购文件")
TERM_PATTERNS = (r"((?:特许经营|服务|合同|交货|工期)(?:期限|期)?(?:为|：|:)\s*[^\n；。]{1,60})", r"(本项目特许经营期限为\s*\d+\s*年)")
TERM = r"\d+(?:\.\d+)?(?:年|个月|月|日|天)"
COMPANY = r"(?:公司|集团|企业|中心|研究院|事务所)$"
ID_KINDS = (
    ("transaction_or_lot_id", ("交易编号", "系统编号", "标段编号", "分包编号", "包编号", "(县区)", "（县区）", "ZBDL")),
    ("procurement_id", ("采购编号", "采购项目编号", "政府采购编号")),
    ("tender_id", ("招标编号", "招标项目编号")),
)
LOT_SUFFIX = r"(?:第?\d+|[一二三四五六七八九十]+)(?:分?包|标段)$"
REPORT, OPENING = "评标报告", "开标记录表"
NOT_PASSED = ("不通过", "未通过", "废标")
QUALIFIED, CONFORMING = "资格性审查", "符合性审查"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode's NFKC form, which no built-in expression gives."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v) if v is not None else None)


def project_name(value: str | Column) -> Column:
    """A project's name for comparing: NFKC, without its label, white space, a lot at the end, and closing signs."""
    text = F.regexp_replace(strip(nfkc(F.coalesce(col(value), F.lit("")))), r"^项目名称\s*[:：]?\s*", "")
    return F.regexp_replace(F.regexp_replace(compact(text), LOT_SUFFIX, ""), "[。；;，,]+$", "")


def project_id(value: str | Column) -> Column:
    return F.translate(compact(F.upper(strip(nfkc(F.coalesce(col(value), F.lit("")))))), "－—–", "---")


def project_id_kind(context: str | Column) -> Column:
    text, out = col(context), F.lit("project_id")
    for kind, words in reversed(ID_KINDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, kind).otherwise(out)
    return out


class Rule(NamedTuple):
    """What a rule asks of each relation (see ``ASKED``), by name, and its status by the answers; null where data are missing."""

    rule_id: str
    facts: dict[str, dict[str, Column]]
    status: Column


def _run(r: dict[str, DataFrame], *rules: Rule) -> DataFrame:
    """(rule_id, status) of each rule: every relation gives one row of answers for all of them."""
    facts: dict[str, dict[str, Column]] = {}
    for rule in rules:
        for relation, own in rule.facts.items():
            facts.setdefault(relation, {}).update(own)
    answers = [ASKED[relation](r).agg(*[c.alias(name) for name, c in own.items()]) for relation, own in facts.items()]
    told = reduce(DataFrame.crossJoin, answers).select(*[F.coalesce(x.status, F.lit("insufficient_data")).alias(x.rule_id) for x in rules])
    return told.select(F.inline(F.array(*[F.struct(F.lit(x.rule_id).alias("rule_id"), F.col(x.rule_id).alias("status")) for x in rules])))


def _same(least: str, most: str) -> Column:
    """Whether values are one, by their least and their greatest."""
    return F.when(F.col(least) == F.col(most), "passed").otherwise("human_review")


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def _stated(rule_id: str, patterns: tuple[str, ...], status: str) -> Rule:
    hit = f"{rule_id} hit"
    return Rule(rule_id, {"docs": {hit: _any(_matches(F.col("text"), patterns))}}, F.when(F.col(hit), status))


def stated(docs: DataFrame, rule_id: str, patterns: tuple[str, ...], status: str) -> DataFrame:
    """P1-01, P1-08 (passed) and P2-01 (human_review): some document states the value."""
    return _run({"docs": docs}, _stated(rule_id, patterns, status))


def _names(names: DataFrame) -> DataFrame:
    """(n, c): names of sources, and how many have them; equal values are normalised once. Both are null for what is no name."""
    rows = names.filter(strip("value") != "").groupBy("value").agg(F.count("*").alias("c")).select(project_name("value").alias("n"), "c")
    name = (F.col("n") != "") & (F.length("n") <= 120) & ~F.col("n").rlike(r"^\d+[.、]")
    return rows.select(*[F.when(name, F.col(c)).alias(c) for c in ("n", "c")])  # a filter would go below the grouping, and normalise each row


def _same_names() -> Rule:
    return Rule("P1-02", {"names": {"names": F.sum("c"), "least_name": F.min("n"), "most_name": F.max("n")}}, F.when(F.col("names") >= 2, _same("least_name", "most_name")))


def same_names(names: DataFrame) -> DataFrame:
    """P1-02: names of two sources or more agree."""
    return _run({"names": names}, _same_names())


def _ids(ids: DataFrame) -> DataFrame:
    """(kind, c, differ): how many ids a kind has, each once for a source, and whether they differ; equal values are normalised once."""
    rows = ids.select("value", "source", project_id_kind(F.concat_ws(" ", "raw_text", "source")).alias("kind")).distinct()
    rows = rows.select(F.nullif(project_id("value"), F.lit("")).alias("id"), "source", "kind").dropDuplicates(["id", "source"])
    return rows.groupBy("kind").agg(F.count("id").alias("c"), (F.min("id") != F.max("id")).alias("differ"))


def _same_ids() -> Rule:
    return Rule("P1-03", {"ids": {"ids": F.sum("c"), "ids_differ": F.bool_or("differ")}}, F.when(F.col("ids") >= 2, F.when(F.col("ids_differ"), "human_review").otherwise("passed")))


def same_ids(ids: DataFrame) -> DataFrame:
    """P1-03: ids of one kind agree; ids of different kinds are not held against each other."""
    return _run({"ids": ids}, _same_ids())


def _candidates(rankings: DataFrame) -> DataFrame:
    """(doc, n): how many candidates a document has."""
    return rankings.filter(compact("bidder").rlike(COMPANY)).groupBy("doc").agg(F.count_distinct("lot", compact("bidder")).alias("n"))


def _candidate_count(expected: int | None) -> Rule:
    if expected is not None:
        n = F.col("candidates")
        return Rule("P1-05", {"rankings": {"candidates": F.count_distinct("lot", "bidder")}}, F.when(n == 0, None).when(n == expected, "passed").otherwise("human_review"))
    facts = {"rankings": F.count("*"), "least_candidates": F.min("n"), "most_candidates": F.max("n")}
    return Rule("P1-05", {"candidates": facts}, F.when(F.col("rankings") >= 2, _same("least_candidates", "most_candidates")))


def candidate_count(rankings: DataFrame, expected: int | None = None) -> DataFrame:
    """P1-05: the number of candidates against a given one, or between documents."""
    return _run({"rankings": rankings}, _candidate_count(expected))


def _review_prices(rule_id: str) -> Rule:
    return Rule(rule_id, {"openings": {"prices": F.count_if((F.col("bidder") != "") & F.col("price").isNotNull())}}, F.when(F.col("prices") > 0, "human_review"))


def review_prices(openings: DataFrame, rule_id: str) -> DataFrame:
    """P1-07, P3-14, P3-18: prices are there, and a review price is another thing."""
    return _run({"openings": openings}, _review_prices(rule_id))


def _expected_marks(rule_id: str) -> Rule:
    word = {"P1-10": "日期", "P1-11": "", "P1-12": "谈判"}[rule_id]
    own, n, bad = F.contains(F.concat("target", "source_text"), F.lit(word)), F.col(f"{rule_id} n"), F.col(f"{rule_id} bad")
    facts = {"marks": {f"{rule_id} n": F.count_if(own), f"{rule_id} bad": F.count_if(own & (F.col("status") != "detected"))}, "docs": {"reports": F.count_if(F.col("subtype") == REPORT)}}
    return Rule(rule_id, facts, F.when((n > 0) & (bad == 0), "passed").when((n > 0) | (F.col("reports") > 0), "human_review"))


def expected_marks(marks: DataFrame, docs: DataFrame, rule_id: str) -> DataFrame:
    """P1-10 (dates), P1-11 (all), P1-12 (negotiation): expected marks are all detected; without any a report needs a person."""
    return _run({"marks": marks, "docs": docs}, _expected_marks(rule_id))


def _extract(text: str, pattern: str) -> Column:
    return F.when(F.col(text).rlike(pattern), strip(F.regexp_extract(F.col(text), pattern, 1)))


def _opening_meeting() -> Rule:
    time, place = DATE_PATTERNS["P2-08"][0], DATE_PATTERNS["P2-07"][0]
    said = {"place": _extract("text", place), "time": F.coalesce(_extract("text", time), F.when(F.col("subtype") == OPENING, _extract("text", MEETING_DATE)))}
    kinds = {"report": F.col("subtype") == REPORT, "record": F.col("subtype") == OPENING}
    facts = {f"{k}_{c}": F.min_by(F.when(kind, said[c]), F.when(kind, F.col("seq"))) for k, kind in kinds.items() for c in said}
    of = {name: F.nullif(project_id(name), F.lit("")) for name in facts}
    both = [of[f"report_{c}"].isNotNull() & of[f"record_{c}"].isNotNull() for c in said]
    n = both[0].cast("int") + both[1].cast("int")
    differ = reduce(lambda a, b: a | b, [F.coalesce(of[f"report_{c}"] != of[f"record_{c}"], F.lit(False)) for c in said])
    return Rule("P2-02", {"docs": facts}, F.when(n == 0, None).when(differ | (n < 2), "human_review").otherwise("passed"))


def opening_meeting(docs: DataFrame) -> DataFrame:
    """P2-02: time and place of the opening in report and record."""
    return _run({"docs": docs}, _opening_meeting())


def _bidders(r: dict[str, DataFrame]) -> DataFrame:
    """(doc, subtype) of documents that name bidders."""
    return r["openings"].filter("bidder <> ''").select("doc").distinct().join(r["docs"].select("doc", "subtype").distinct(), "doc")


def _bidder_sets() -> Rule:
    return Rule("P2-03", {"bidders": {"in_report": _any(F.col("subtype") == REPORT), "in_record": _any(F.col("subtype") == OPENING)}}, F.when(F.col("in_report") & F.col("in_record"), "human_review"))


def bidder_sets(openings: DataFrame, docs: DataFrame) -> DataFrame:
    """P2-03: bidders in report and opening record; always for a person once both are there."""
    return _run({"openings": openings, "docs": docs}, _bidder_sets())


def bidder_difference(openings: DataFrame, docs: DataFrame) -> DataFrame:
    """(bidder, only_in): bidders that only one of report and opening record has."""
    kinds = docs.filter(F.col("subtype").isin(REPORT, OPENING)).select("doc", "subtype").distinct()
    rows = openings.filter("bidder <> ''").select("doc", compact("bidder").alias("bidder")).distinct().join(kinds, "doc")
    return rows.groupBy("bidder").agg(F.min("subtype").alias("only_in"), F.max("subtype").alias("b")).filter("only_in = b").drop("b")


def _date_key(value: Column) -> Column:
    parts = [F.regexp_extract(value, DATE_KEY, i) for i in range(1, 6)]
    return F.when(value.rlike(DATE_KEY), F.concat_ws("-", *[F.lpad(F.when(x == "", "0").otherwise(F.ltrim(x, F.lit("0"))), 4 if i == 0 else 2, "0") for i, x in enumerate(parts)]))


def _dates(docs: DataFrame) -> DataFrame:
    """Of each document by rule what it states, (p, seq, value) by the first pattern that it has, and the date's key."""
    found = docs.select("doc", "seq", *[_extract("text", x).alias(f"{rule_id} {p}") for rule_id, patterns in DATE_PATTERNS.items() for p, x in enumerate(patterns)])
    first = {k: F.coalesce(*[F.when(F.col(c := f"{k} {p}").isNotNull(), F.struct(F.lit(p).alias("p"), "seq", F.col(c).alias("value"))) for p in range(len(x))]) for k, x in DATE_PATTERNS.items()}
    by = found.select("doc", *[x.alias(k) for k, x in first.items()]).groupBy("doc").agg(*[F.min(k).alias(k) for k in first])
    return by.select(*first, *[_date_key(F.col(k)["value"]).alias(f"{k} key") for k in first])


def _stated_date(rule_id: str) -> Rule:
    key = f"{rule_id} key"
    dates = {f"{rule_id} first": F.min(rule_id), f"{key}s": F.count(key), f"{key} least": F.min(key), f"{key} most": F.max(key)}
    value = F.col(f"{rule_id} first")["value"]
    valid = value.isNotNull() & ~value.isin(*NO_VALUES) & (F.lit(True) if rule_id == "P2-07" else value.rlike(ANY_DATE))
    if rule_id == "P2-07":
        return Rule(rule_id, {"dates": dates}, F.when(valid, "passed"))
    several = F.when(F.col(f"{key}s") >= 2, _same(f"{key} least", f"{key} most")).otherwise("human_review")
    if rule_id == "P2-04":  # a section of its own states time and place where the plain field has no full date
        plain = F.coalesce(value.rlike(FULL_DATE), F.lit(False))
        status = F.when(~plain & F.col("special"), "passed").when(plain & valid, several).when(valid & ~F.col("special"), several)
        return Rule(rule_id, {"dates": dates, "docs": {"special": _any(_extract("text", DEADLINE_SECTION).rlike(ANY_DATE))}}, status)
    return Rule(rule_id, {"dates": dates}, F.when(valid, several))


def stated_date(docs: DataFrame, rule_id: str) -> DataFrame:
    """P2-04, P2-05, P2-08 by date and P2-07 by place: passed where two documents agree, for a person where one states it."""
    return _run({"docs": docs}, _stated_date(rule_id))


def _with_terms(docs: DataFrame) -> DataFrame:
    """Documents with the terms that they state."""
    found = F.concat(*[F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(1)) for p in TERM_PATTERNS])
    return docs.withColumn("terms", F.filter(F.transform(found, lambda x: F.regexp_extract(compact(x), TERM, 0)), lambda t: t != ""))


def _durations() -> Rule:
    return Rule("P2-06", {"docs": {"least_term": F.min(F.array_min("terms")), "most_term": F.max(F.array_max("terms"))}}, F.when(F.col("least_term").isNotNull(), _same("least_term", "most_term")))


def durations(docs: DataFrame) -> DataFrame:
    """P2-06: the terms that documents state are one."""
    return _run({"docs": docs}, _durations())


def _table_flags(tables: DataFrame) -> DataFrame:
    """Of each table: which words it has, whether it says passed, says not passed, and names companies in its head."""
    cells = F.array_join("cells", "")
    rows = tables.withColumn("flat", compact(cells))
    heads = F.when(F.col("row_no") <= 2, F.exists(F.slice("cells", 3, 1000), lambda c: compact(c).rlike(COMPANY)))
    bad = F.lit(False)
    for w in NOT_PASSED:
        bad = bad | F.contains("flat", F.lit(w))
    has = [F.bool_or(F.contains("flat", F.lit(w))).alias(w) for w in (QUALIFIED, CONFORMING)]
    return rows.groupBy("doc", "table_no").agg(*has, F.bool_or(F.contains("flat", F.lit("通过"))).alias("ok"), F.bool_or(bad).alias("bad"), _any(heads).alias("heads"))


def _passed_counts(rule_id: str) -> Rule:
    label, keyword = ("资格审查", QUALIFIED) if rule_id == "P3-01" else ("符合性审查", CONFORMING)
    number = (rf"(?:通过|符合){label}[^\n\d]{{0,12}}(\d+)\s*家", rf"{label}(?:通过|合格)[^\n\d]{{0,12}}(\d+)\s*家")
    counted, every, shown = (f"{rule_id} {x}" for x in ("counted", "all", "shown"))
    facts = {
        "docs": {counted: _any(_matches(F.col("text"), number)), every: _any(F.col("text").rlike(rf"{label}[^\n。；]{{0,30}}(?:全部|均)(?:通过|合格)"))},
        "openings": {"bids": F.count("*")},
        "tables": {shown: _any(F.col(keyword) & F.col("ok") & F.col("heads"))},
    }
    return Rule(rule_id, facts, F.when(F.col(counted) | (F.col(every) & (F.col("bids") > 0)) | F.col(shown), "passed"))


def passed_counts(docs: DataFrame, openings: DataFrame, tables: DataFrame, rule_id: str) -> DataFrame:
    """P3-01, P3-03: the number that passed is stated, or all passed, or a table shows it."""
    return _run({"docs": docs, "openings": openings, "tables": tables}, _passed_counts(rule_id))


def _rejections(rule_id: str) -> Rule:
    label, keyword = ("资格", QUALIFIED) if rule_id == "P3-02" else ("符合性", CONFORMING)
    n, every, shown = (f"{rule_id} {x}" for x in ("n", "all", "shown"))
    facts = {
        "docs": {every: _any(F.col("text").rlike(rf"{label}(?:性)?审查[^\n。；]{{0,30}}(?:全部|均)(?:通过|合格)"))},
        "rejections": {n: F.count_if(F.contains(F.concat_ws(" ", "reason", "cited", "evidence"), F.lit(label)))},
        "tables": {shown: _any(F.col(keyword) & F.col("ok") & ~F.col("bad"))},
    }
    return Rule(rule_id, facts, F.when(F.col(n) > 0, "human_review").when(F.col(every) | F.col(shown), "passed"))


def rejections(docs: DataFrame, records: DataFrame, tables: DataFrame, rule_id: str) -> DataFrame:
    """P3-02, P3-04: records of rejection need a person; a text or a table that says all passed does not."""
    return _run({"docs": docs, "rejections": records, "tables": tables}, _rejections(rule_id))


def _score_gap() -> Rule:
    return Rule("P3-07", {"summaries": {"totals": F.count("total")}}, F.when(F.col("totals") >= 2, "human_review"))


def score_gap(summaries: DataFrame) -> DataFrame:
    """P3-07: gaps between totals are there for a person."""
    return _run({"summaries": summaries}, _score_gap())


#: What rules ask: relations as they are, or what is made of them first.
ASKED = {
    "docs": lambda r: _with_terms(r["docs"]), "dates": lambda r: _dates(r["docs"]), "names": lambda r: _names(r["names"]), "ids": lambda r: _ids(r["ids"]), "openings": lambda r: r["openings"], "bidders": _bidders,
    "rankings": lambda r: r["rankings"], "candidates": lambda r: _candidates(r["rankings"]), "marks": lambda r: r["marks"], "rejections": lambda r: r["rejections"], "tables": lambda r: _table_flags(r["tables"]), "summaries": lambda r: r["summaries"],
}


def execute(r: dict[str, DataFrame], expected_candidates: int | None = None) -> DataFrame:
    """(rule_id, status) of every rule here, over the relations of one review; input for ``rules.matrix``."""
    return _run(
        r, _stated("P1-01", LOT_PATTERNS, "passed"), _same_names(), _same_ids(), _candidate_count(expected_candidates), _stated("P1-08", (NARRATIVE_PATTERN,), "passed"), *map(_review_prices, ("P1-07", "P3-14", "P3-18")),
        *map(_expected_marks, ("P1-10", "P1-11", "P1-12")), _stated("P2-01", SALE_PATTERNS, "human_review"), _opening_meeting(), _bidder_sets(), *map(_stated_date, DATE_PATTERNS), _durations(),
        *map(_passed_counts, ("P3-01", "P3-03")), *map(_rejections, ("P3-02", "P3-04")), _score_gap(),
    )


# Checks that give findings.


def missing_inputs(docs: DataFrame) -> DataFrame:
    """CHK-02, CHK-03: (doc, issue_type, risk_level) of bids without a price and tenders without criteria.

    docs: doc, file_type, n_prices, n_criteria.
    """
    kinds = F.array_compact(F.array(
        F.when(F.contains("file_type", F.lit("投标")) & (F.col("n_prices") == 0), F.struct(F.lit("投标报价未识别").alias("t"), F.lit("中").alias("r"))),
        F.when(F.contains("file_type", F.lit("招标")) & (F.col("n_criteria") == 0), F.struct(F.lit("评分标准未识别").alias("t"), F.lit("低").alias("r"))),
    ))
    return docs.select("doc", F.explode(kinds).alias("k")).select("doc", F.col("k.t").alias("issue_type"), F.col("k.r").alias("risk_level"))


def unsupported_rejections(records: DataFrame, procurement: DataFrame, terms: Column) -> DataFrame:
    """CHK-13 with JOI-09: (doc, bidder, why) of rejections whose clause and reason no procurement text holds.

    procurement: text, a row for each document; ``terms`` are the reason's words. A blank term is in every text.
    """
    rows = records.withColumn("__t", terms).withColumn("__q", F.array_distinct(F.filter(F.array_append("__t", F.col("cited")), lambda q: q != "")))
    texts = procurement.filter("text <> ''").select(F.lit(0).alias("id"), "text")
    met = find_quotes(rows.select(F.explode("__q").alias("qid")).distinct().withColumn("quote", F.col("qid")), texts).select(F.col("qid").alias("__m")).distinct()
    held = rows.select("__q", F.explode("__q").alias("__m")).join(met, "__m", "left_semi").select("__q").distinct()
    rows = rows.join(held, "__q", "left_anti").withColumn("__n", texts.agg(F.count("*")).scalar())
    return rows.filter((F.col("__n") == 0) | ~F.exists("__t", lambda t: t == "")).select("doc", "bidder", F.when(F.col("__n") == 0, "no procurement document").otherwise("not found").alias("why"))


def unknown_citations(citations: DataFrame, laws: DataFrame) -> DataFrame:
    """CHK-14 with JOI-10: citations (law, article) that the law table does not have."""
    return citations.join(laws.select("law", "article"), ["law", "article"], "left_anti")


def parse_status(checks: DataFrame) -> DataFrame:
    """QLT-03: (doc, status): failed before warning before success."""
    worst = F.max(F.when(F.col("status") == "failed", 2).when(F.col("status") == "warning", 1).otherwise(0))
    return checks.groupBy("doc").agg(worst.alias("w")).select("doc", F.element_at(F.array(*map(F.lit, ("success", "warning", "failed"))), F.col("w") + 1).alias("status"))


# Projections and merges.


def source_label(name: str, sheet: str, page: str, row: str) -> Column:
    """PRJ-13: file, worksheet, page and row, as far as they are known."""
    return F.concat_ws(" / ", F.col(name), F.when(F.col(sheet) != "", F.concat(F.lit("工作表 "), F.col(sheet))), F.when(F.col(page) > 0, F.concat(F.lit("第"), F.col(page).cast("string"), F.lit("页"))), F.when(F.col(row) > 0, F.concat(F.lit("第"), F.col(row).cast("string"), F.lit("行"))))


def page_for_offset(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """PRJ-10: (doc, offset, page) by the running length of a document's pages (doc, page, n_chars), joined with a line end."""
    lengths = pages.filter("doc IS NOT NULL").groupBy("doc", "page").agg(F.sum(F.col("n_chars") + 1).alias("n"))
    stops = lengths.withColumn("at", F.sum("n").over(Window.partitionBy("doc").orderBy(F.asc_nulls_last("page")).rowsBetween(Window.unboundedPreceding, 0)))
    asked = offsets.filter("doc IS NOT NULL AND offset IS NOT NULL").select("doc", "offset").distinct()
    # pages and offsets in one order, from the end: an offset comes before pages that stop at it, and after all that stop later
    rows = stops.filter("at IS NOT NULL").select("doc", "at", F.lit(1).alias("kind"), "page", F.lit(None).cast(asked.schema["offset"].dataType).alias("offset"))
    rows = rows.unionByName(asked.select("doc", F.col("offset").cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(pages.schema["page"].dataType).alias("page"), "offset"))
    later = Window.partitionBy("doc").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.select("doc", "offset", "kind", F.min("page").over(later).alias("first"), F.sum("kind").over(later).alias("n"))
    return met.filter("kind = 0 AND n > 0").select("doc", "offset", F.col("first").alias("page"))


def document_text(parts: DataFrame) -> DataFrame:
    """PRJ-12: (doc, text) of a document's parts (doc, seq, content) in order, blank ones left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("seq", "content"))))
    return parts.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("text"))


def merge_fields(fields: DataFrame) -> DataFrame:
    """AGG-11: (doc, name, value, confidence, review): the surest value; different values need a person."""
    return fields.groupBy("doc", "name").agg(F.max(F.struct("confidence", "value")).alias("m"), (F.count_distinct("value") > 1).alias("review")).select("doc", "name", "m.value", "m.confidence", "review")


def merge_new(old: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """SET-08, SET-11: old rows, and of new ones the first of each key that old has not."""
    from .lifecycle import first_of

    return old.unionByName(first_of(new.join(old.select(*keys), keys, "left_anti").select(old.columns), keys, order))


def recent(tasks: DataFrame, limit: int) -> DataFrame:
    """SRT-06: the tasks changed last."""
    return tasks.orderBy(F.desc("modified"), "task").limit(limit)


def evidence_rows(records: DataFrame, cells: DataFrame) -> DataFrame:
    """JOI-16: records with the text of their source row: its cells that are not blank."""
    keys = ["doc", "sheet", "row_no"]
    texts = cells.groupBy(*keys, F.array_join(F.filter("cells", lambda c: strip(c) != ""), " | ").alias("evidence")).agg(F.count("*").alias("__n"))  # equal rows meet a record once
    return repeated(records.join(texts, keys).select(*records.columns, "evidence", "__n"), "__n")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JOI-17: ids that only one of two relations has; none where the sets are equal."""
    return a.select(key, F.lit("a").alias("side")).distinct().unionByName(b.select(key, F.lit("b").alias("side")).distinct()).groupBy(key).agg(F.min("side").alias("only_in"), F.count("*").alias("n")).filter("n = 1").drop("n")
