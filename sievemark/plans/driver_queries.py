"""Queries over the driver's tables: each binds an operator to columns, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from .. import storage
from ..exprs import clean_text, compact, issue_id, line_number, normalize_clause, normalize_compare, normalized_value, unique_keep_order
from ..operators import contracts, links, payloads, scores, segments, text
from ..operators.quotes import find_quotes
from ..sources import files, workbooks
from ..streaming import cache
from ..streaming.events import read_stream
from . import lifecycle, planner, reports, retrieval, review

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Words that stand in for the domain's in tables of other languages.
KEYWORDS = ("License", "rights reserved", "password", "TOKEN")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def score_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as score details: supplier, lot, factor and score."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bidder"), F.col("l_returnflag").alias("lot"), F.col("l_linestatus").alias("factor"), F.col("l_quantity").alias("raw_score"), F.lit(50.0).alias("max_score"))


# Sources and sinks


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def src_08_parquet_scan(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT conv_id, role, count(*) AS n, min(turn) AS first_turn FROM conversations GROUP BY 1, 2")
def snk_07_deliverables_json(spark, sf):
    nested = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("records"))
    return nested.select("conv_id", F.explode("records").alias("r")).groupBy("conv_id", F.col("r.role").alias("role")).agg(F.count("*").alias("n"), F.min("r.turn").alias("first_turn"))


# Text normalisation

CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""


@query(f"SELECT doc_id, length({CLEAN_SQL}) AS n_chars, md5({CLEAN_SQL}) AS digest FROM documents")
def prj_01_clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(clean_text("text")).cast("long").alias("n_chars"), F.md5(clean_text("text")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\s+', '', 'g')) AS digest FROM documents")
def prj_03_compact(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(compact("text")).alias("digest"))


@query(r"SELECT c_custkey, replace(replace(lower(regexp_replace(c_name || '（' || c_mktsegment || '）： 人民币1元整', '[\s，,。；;:：()（）]', '', 'g')), '人民币', ''), '元整', '元') AS value FROM customer")
def prj_06_normalize_compare_value(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", normalize_compare(F.concat("c_name", F.lit("（"), "c_mktsegment", F.lit("）： 人民币1元整"))).alias("value"))


@query(r"SELECT p_partkey, regexp_replace(p_name || '，' || p_brand || '。', '[\s，,。；;：:]', '', 'g') AS value FROM part")
def prj_07_normalize_clause(spark, sf):
    return table(spark, sf, "part").select("p_partkey", normalize_clause(F.concat(F.lit("12、 "), F.col("p_name"), F.lit("，"), F.col("p_brand"), F.lit("。"))).alias("value"))


@query(r"SELECT p_partkey, lower(regexp_replace(p_type, '\s+', '', 'g')) AS value FROM part")
def prj_08_normalized_value(spark, sf):
    return table(spark, sf, "part").select("p_partkey", normalized_value("p_type").alias("value"))


@query("SELECT doc_id, CAST(length(text) // 2 AS INTEGER) AS at, CAST(len(string_split(substr(text, 1, length(text) // 2), chr(10))) AS INTEGER) AS line FROM documents")
def prj_11_line_location(spark, sf):
    at = F.floor(F.length("text") / 2).cast("int")
    return docs(spark, sf).select("doc_id", at.alias("at"), line_number("text", at).alias("line"))


LINES_SQL = "SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"


def keyword_sql(words: tuple[str, ...], limit: int) -> str:
    test = " OR ".join(f"contains(line, '{w}')" for w in words)
    return f"""WITH l AS ({LINES_SQL}), h AS (SELECT doc_id, pos, trim(raw) AS line FROM l), m AS (
  SELECT doc_id, pos, substr(line, 1, 240) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM h WHERE line <> '' AND ({test})),
  u AS (SELECT doc_id, line, min(pos) AS pos FROM m WHERE n <= {limit} GROUP BY 1, 2)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS hits FROM u GROUP BY doc_id"""


@query(keyword_sql(KEYWORDS, 8))
def flt_01_keyword_lines(spark, sf):
    hits = text.keyword_lines("text", KEYWORDS, 8)
    return docs(spark, sf).select("doc_id", F.array_join(hits, "\n").alias("hits")).filter("hits <> ''")


@query(keyword_sql(KEYWORDS[:2], 5))
def chk_17_restrictive_clause(spark, sf):
    hits = text.keyword_lines("text", KEYWORDS[:2], 5)
    return docs(spark, sf).select("doc_id", F.array_join(hits, "\n").alias("hits")).filter("hits <> ''")


QUERIES["flt_17_restrictive_terms"], ORACLE["flt_17_restrictive_terms"] = chk_17_restrictive_clause, ORACLE["chk_17_restrictive_clause"]


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(repr(w) for w in KEYWORDS)}], lambda w: NOT contains(text, w)), ',') AS missing FROM documents")
def flt_18_missing_terms(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(text.missing_words("text", KEYWORDS), ",").alias("missing"))


QUERIES["chk_16_missing_elements"], ORACLE["chk_16_missing_elements"] = flt_18_missing_terms, ORACLE["flt_18_missing_terms"]


@query(f"WITH l AS ({LINES_SQL}) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE length(trim(raw)) <= 80 AND regexp_matches(trim(raw), '^(第.|[一二三四五六七八九十]+、|[0-9]+[、.．]|[（(][0-9]+[）)])')) AS n_headings FROM l GROUP BY doc_id")
def flt_06_is_heading(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", F.trim("raw").alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.is_heading("line")).alias("n_headings"))


@query("SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def flt_14_evidence_verbatim(spark, sf):
    """Quotes found in documents, anchored at their rarest words."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))
    return find_quotes(items, docs(spark, sf).select(F.col("doc_id").alias("id"), "text")).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"))


JOI_06_SQL = "SELECT b.item_id, min(d.doc_id) AS document_id, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1"


@query(JOI_06_SQL)
def joi_06_evidence_locator(spark, sf):
    return flt_14_evidence_verbatim(spark, sf).groupBy("item_id").agg(F.min("doc_id").alias("document_id"), F.count("*").alias("n"))


@query("SELECT doc_id, length(text) < 20 AS is_scanned, (length(text) - length(replace(text, chr(65533), ''))) > greatest(3.0, length(text) / 200.0) AS garbled FROM documents")
def flt_19_is_scanned(spark, sf):
    return docs(spark, sf).select("doc_id", (F.length("text") < 20).alias("is_scanned"), text.garbled("text").alias("garbled"))


PASSWORD = r"(?:password|token|api_key).{0,16}(?:=|:)"


@query(rf"SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '(?i){PASSWORD}'))[1:1], '|') AS snippet FROM documents WHERE regexp_matches(text, '(?i){PASSWORD}')")
def flt_16_collusion_text_signal(spark, sf):
    rows = docs(spark, sf).filter(F.col("text").rlike("(?i)" + PASSWORD))
    return rows.select("doc_id", F.array_join(F.slice(F.regexp_extract_all("text", F.lit("(?i)" + PASSWORD), F.lit(0)), 1, 1), "|").alias("snippet"))


def ano_01_collusion_text(spark, sf):
    found = text.collusion_snippets("text")
    return docs(spark, sf).select("doc_id", F.size(found).cast("long").alias("n_snippets")).filter("n_snippets > 0")


QUERIES["ano_01_collusion_text"] = ano_01_collusion_text
SNIPPETS_SQL = "flatten([" + ", ".join(f"regexp_extract_all(text, '(?i){p}')" for p in K.COLLUSION_PATTERNS) + "])"
ORACLE["ano_01_collusion_text"] = f"SELECT doc_id, CAST(least(5, len(list_distinct({SNIPPETS_SQL}))) AS BIGINT) AS n_snippets FROM documents WHERE len({SNIPPETS_SQL}) > 0"


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)))), ',') AS emails FROM documents")
def ext_14_phones_emails(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(text.emails("text"), ",").alias("emails"))


@query(r"SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?\s*元'))[1:10], '|') AS amounts FROM documents")
def ext_13_money_values(spark, sf):
    from ..exprs import money_values

    return docs(spark, sf).select("doc_id", F.array_join(money_values("text"), "|").alias("amounts"))


@query("""WITH t AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM conversations)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(turn) AS first_turn, count(*) AS n_turns, sum(length(text)) AS n_chars FROM t GROUP BY 1, 2""")
def ext_01_sections(spark, sf):
    rows = text.islands(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return rows.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


@query()
def ext_01b_document_sections(spark, sf):
    return text.sections(docs(spark, sf), "doc_id", "text", limit=None)


QUERIES["win_08_islands"], ORACLE["win_08_islands"] = ext_01_sections, ORACLE["ext_01_sections"]

CHUNK_SQL = r"""WITH b AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM documents),
p AS (SELECT doc_id, body, unnest(generate_series(0, greatest(0, CAST(ceil((length(body) - 1200) / 1080.0) AS BIGINT)))) AS part FROM b WHERE body <> ''),
c AS (SELECT doc_id, part, trim(substr(body, part * 1080 + 1, 1200), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM p)"""


@query(CHUNK_SQL + " SELECT doc_id, CAST(part + 1 AS INTEGER) AS part, doc_id || '-s1-c' || (part + 1) || '-' || substr(sha256(content), 1, 8) AS chunk_id, length(content) AS n_chars FROM c WHERE content <> ''")
def ext_06_chunks(spark, sf):
    return text.chunks(docs(spark, sf), "doc_id", F.lit(1), "text").select(F.col("doc").alias("doc_id"), "part", "chunk_id", F.length("content").cast("long").alias("n_chars"))


@query("""WITH t AS (SELECT conv_id, turn, contains(text, 'License') OR contains(text, 'the ') AS hit FROM conversations),
n AS (SELECT *, max(CAST(hit AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM t) SELECT conv_id, turn FROM n WHERE near = 1""")
def ext_09_select_chunks(spark, sf):
    hit = F.contains("text", F.lit("License")) | F.contains("text", F.lit("the "))
    return text.neighbours(table(spark, sf, "conversations"), ["conv_id"], "turn", hit).select("conv_id", "turn")


QUERIES["win_07_neighbour_expand"], ORACLE["win_07_neighbour_expand"] = ext_09_select_chunks, ORACLE["ext_09_select_chunks"]

# Joins and aggregations


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), last AS (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS r FROM supplier)
SELECT n.n_nationkey, last.s_suppkey, s.n FROM nation n JOIN last ON last.s_nationkey = n.n_nationkey AND r = 1 JOIN s ON s.l_suppkey = last.s_suppkey""")
def joi_01_scores_summaries(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    last = scores.last_by(table(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey")
    nation = table(spark, sf, "nation").select("n_nationkey")
    return nation.join(last, nation["n_nationkey"] == last["s_nationkey"]).join(counts, F.col("s_suppkey") == F.col("l_suppkey")).select("n_nationkey", "s_suppkey", "n")


SUPPLIER_RANKS = """WITH rev AS (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1), r AS (
  SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name) AS rank,
         row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC, s_name) AS recorded FROM supplier JOIN rev ON l_suppkey = s_suppkey)
SELECT s_suppkey, s_nationkey, CAST(rank AS INTEGER) AS rank, CAST(recorded AS INTEGER) AS recorded FROM r WHERE rank <> recorded"""


@query(SUPPLIER_RANKS)
def chk_07_candidate_order(spark, sf):
    revenue = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    both = table(spark, sf, "supplier").join(revenue, "s_suppkey")
    candidates = scores.expected_rank(both, ["s_nationkey"], "s_acctbal", "s_name", "rank").select("s_suppkey", "s_nationkey", "rank")
    recorded = scores.expected_rank(both, ["s_nationkey"], "revenue", "s_name", "recorded").select("s_suppkey", "s_nationkey", "recorded")
    return scores.candidate_mismatches(candidates, recorded, ["s_suppkey", "s_nationkey"], "rank", "recorded")


QUERIES["joi_02_candidates_summaries"], ORACLE["joi_02_candidates_summaries"] = chk_07_candidate_order, SUPPLIER_RANKS


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(date_trunc('day', ts) AS VARCHAR) AS day FROM events),
l AS (SELECT day, event_id, user_id, 'event_type' AS attr, event_type AS value FROM e UNION ALL SELECT day, event_id, user_id, 'k', k FROM e UNION ALL SELECT day, event_id, user_id, 'hour', CAST(hour(ts) AS VARCHAR) FROM (SELECT event_id, user_id, ts, CAST(date_trunc('day', ts) AS VARCHAR) AS day FROM events))
SELECT a.event_id AS a, b.event_id AS b, count(DISTINCT a.attr) AS n_equal FROM l a JOIN l b ON a.day = b.day AND a.attr = b.attr AND a.value = b.value AND a.event_id < b.event_id AND a.user_id <> b.user_id
GROUP BY 1, 2 HAVING count(DISTINCT a.attr) >= 3""")
def joi_03_equal_attributes(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.hour("ts").cast("string").alias("hour"), F.to_date("ts").alias("day"))
    return links.equal_attribute_pairs(e, "event_id", ["event_type", "k", "hour"], ["day"], "user_id", least=3).select("a", "b", "n_equal")


QUERIES["ano_05_metadata_overlap"], ORACLE["ano_05_metadata_overlap"] = joi_03_equal_attributes, ORACLE["joi_03_equal_attributes"]

SIMILAR_SQL = r"""WITH l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\s+', '', 'g') AS line FROM documents) WHERE length(line) >= 24),
p AS (SELECT line, min(doc_id) AS a, max(doc_id) AS b FROM l GROUP BY line HAVING count(*) = 2)"""


@query(SIMILAR_SQL + " SELECT a, b, count(*) AS n_shared, CAST(sum(length(line)) AS BIGINT) AS shared_chars, md5(array_to_string(list(line ORDER BY length(line) DESC, line)[1:5], chr(10))) AS top_lines FROM p GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(length(line)) >= 80")
def ano_07_doc_similarity(spark, sf):
    return links.similar_documents(docs(spark, sf), "doc_id", "text").withColumn("top_lines", F.md5(F.array_join("top_lines", "\n")))


for name in ("joi_04_shared_lines", "srt_04_shared_line_order", "set_06_intersect"):
    QUERIES[name], ORACLE[name] = ano_07_doc_similarity, ORACLE["ano_07_doc_similarity"]


@query(r"SELECT line, count(*) AS df FROM (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\s+', '', 'g') AS line FROM documents) WHERE length(line) >= 24) GROUP BY 1 HAVING count(*) >= 3")
def agg_04_doc_frequency(spark, sf):
    return links.long_lines(docs(spark, sf), "doc_id", "text").groupBy("line").agg(F.count("*").alias("df")).filter("df >= 3")


PROGRESSION_SQL = """WITH c AS (SELECT DISTINCT p_brand AS lot, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
t AS (SELECT x.lot, x.cents AS first_cents, y.cents AS middle_cents, 2 * y.cents - x.cents AS last_cents, y.cents - x.cents AS gap_cents,
 row_number() OVER (PARTITION BY x.lot ORDER BY x.cents DESC, y.cents) AS r FROM c x JOIN c y ON x.lot = y.lot AND y.cents > x.cents JOIN c z ON z.lot = x.lot AND z.cents = 2 * y.cents - x.cents)
SELECT lot, first_cents, middle_cents, last_cents, gap_cents FROM t WHERE r = 1"""


@query(PROGRESSION_SQL)
def ano_04_price_progression(spark, sf):
    return scores.price_progression(table(spark, sf, "part"), "p_brand", "p_retailprice")


for name in ("joi_05_arithmetic_progression", "srt_05_pick_progression"):
    QUERIES[name], ORACLE[name] = ano_04_price_progression, PROGRESSION_SQL

NET = "l_extendedprice * (1 - l_discount)"


@query(f"SELECT l_orderkey, round(sum(m), 6) AS calculated FROM (SELECT l_orderkey, l_linenumber, avg({NET}) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def agg_01_two_level_mean_sum(spark, sf):
    return scores.mean_then_sum(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", F.expr(NET)).select("l_orderkey", F.round("calculated", 6).alias("calculated"))


TOTALS_SQL = f"""WITH a AS (SELECT l_orderkey, round(sum(m), 6) AS calculated FROM (SELECT l_orderkey, l_linenumber, avg({NET}) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN calculated + 1 ELSE calculated END AS total FROM orders JOIN a ON o_orderkey = l_orderkey)
SELECT o_orderkey AS bidder, round(calculated, 6) AS calculated, round(total, 6) AS total, 'I' || substr(sha256('数据核验智能体|总分复算不一致|' || o_orderkey), 1, 12) AS issue_id FROM s JOIN a ON o_orderkey = l_orderkey WHERE abs(calculated - total) > 0.02"""


def order_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lineitem as details of orders, and summaries of which every third is one off."""
    details = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bidder"), F.col("l_linenumber").alias("factor"), F.expr(NET).alias("value"))
    own = scores.mean_then_sum(details, ["bidder"], "factor", "value").withColumn("calculated", F.round("calculated", 6))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bidder")).join(own, "bidder")
    return details, orders.select("bidder", (F.col("calculated") + F.when(F.col("bidder") % 3 == 0, 1).otherwise(0)).alias("total"))


@query(TOTALS_SQL)
def chk_05_score_total(spark, sf):
    details, summaries = order_totals(spark, sf)
    found = scores.total_mismatches(details, summaries, ["bidder"], "factor", "value", "total")
    return found.select("bidder", F.round("calculated", 6).alias("calculated"), F.round("total", 6).alias("total"), issue_id(F.lit(K.DATA), F.lit("总分复算不一致"), F.col("bidder").cast("string"), evidence=F.array().cast("array<string>")).alias("issue_id"))


QUERIES["lif_03_issue_id"], ORACLE["lif_03_issue_id"] = chk_05_score_total, TOTALS_SQL


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS expected, round(l_extendedprice * l_discount, 4) + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS weighted FROM lineitem WHERE l_partkey % 7 = 0""")
def chk_04_weighted_score(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("weighted", F.round(F.col("l_extendedprice") * F.col("l_discount"), 4) + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0))
    return scores.weighted_mismatches(rows, "l_extendedprice", "l_discount", "weighted").select("l_orderkey", "l_linenumber", F.round("expected", 4).alias("expected"), "weighted")


CONFLICT_SQL = "SELECT l_partkey, l_suppkey, count(*) AS n_values, round(min(v), 2) AS low, round(max(v), 2) AS high FROM (SELECT DISTINCT l_partkey, l_suppkey, round(l_extendedprice, 2) AS v FROM lineitem) GROUP BY 1, 2 HAVING count(*) >= 2"


@query(CONFLICT_SQL)
def chk_08_cross_price(spark, sf):
    found = scores.conflicting_values(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], "l_extendedprice", 2)
    return found.select("l_partkey", "l_suppkey", "n_values", F.col("values")[0].alias("low"), F.element_at("values", -1).alias("high"))


QUERIES["agg_02_distinct_set_size"], ORACLE["agg_02_distinct_set_size"] = chk_08_cross_price, CONFLICT_SQL


@query("SELECT o_custkey, o_orderpriority, count(*) AS n_values FROM (SELECT DISTINCT o_custkey, o_orderpriority, round(o_totalprice, 4) AS v FROM orders) GROUP BY 1, 2 HAVING count(*) >= 2")
def chk_09_cross_total(spark, sf):
    return scores.conflicting_values(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_totalprice", 4).drop("values")


SPREAD_SQL = "SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) AS spread, count(DISTINCT o_orderpriority) AS n_lots FROM orders WHERE o_orderpriority <> '' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2 AND max(o_totalprice) - min(o_totalprice) >= 400000"


@query(SPREAD_SQL)
def ano_03_cross_lot_spread(spark, sf):
    return scores.cross_lot_spread(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", 400_000).withColumn("spread", F.round("spread", 2))


QUERIES["agg_03_min_max_spread"], ORACLE["agg_03_min_max_spread"] = ano_03_cross_lot_spread, SPREAD_SQL

LOO_SQL = """WITH w AS (SELECT l_suppkey AS bidder, l_returnflag AS lot, l_linestatus AS factor, l_quantity AS raw_score, count(*) OVER g AS n, sum(l_quantity) OVER g AS s FROM lineitem WINDOW g AS (PARTITION BY l_suppkey, l_returnflag, l_linestatus))
SELECT bidder, lot, factor, raw_score, count(*) AS n_rows, round(max(abs(raw_score - (s - raw_score) / (n - 1))), 4) AS deviation FROM w WHERE n >= 3 AND abs(raw_score - (s - raw_score) / (n - 1)) >= 10 GROUP BY 1, 2, 3, 4"""


@query(LOO_SQL)
def ano_02_expert_deviation(spark, sf):
    rows = scores.leave_one_out(score_details(spark, sf), ["bidder", "lot", "factor"], "raw_score", "max_score")
    return rows.groupBy("bidder", "lot", "factor", "raw_score").agg(F.count("*").alias("n_rows"), F.round(F.max("deviation"), 4).alias("deviation"))


QUERIES["win_01_leave_one_out_mean"], ORACLE["win_01_leave_one_out_mean"] = ano_02_expert_deviation, LOO_SQL


@query("""WITH m AS (SELECT l_suppkey AS bidder, l_returnflag AS lot, l_linestatus AS factor, l_quantity AS v, avg(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus) AS m FROM lineitem)
SELECT bidder, lot, factor, count(*) AS n, round(avg(v), 4) AS mean, round(max(abs(v - m)), 4) AS max_deviation, max(abs(v - m)) > greatest(3.0, abs(avg(v)) * 0.3) AS warning FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def win_02_group_mean_deviation(spark, sf):
    rows = scores.mean_deviation(score_details(spark, sf), ["bidder", "lot", "factor"], "raw_score")
    return rows.withColumns({"mean": F.round("mean", 4), "max_deviation": F.round("max_deviation", 4)})


RANK_SQL = """WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS e, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
SELECT c_custkey, CAST(k AS INTEGER) AS rank, CAST(e AS INTEGER) AS expected_rank FROM r WHERE e <> k"""


@query(RANK_SQL)
def chk_06_rank_recheck(spark, sf):
    rows = table(spark, sf, "customer").withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    return scores.rank_mismatches(rows, ["c_nationkey"], "c_acctbal", "c_name", "rank").select("c_custkey", "rank", "expected_rank")


QUERIES["win_03_expected_rank"], ORACLE["win_03_expected_rank"] = chk_06_rank_recheck, RANK_SQL


@query("""WITH v AS (SELECT DISTINCT p_brand, p_retailprice AS v FROM part), g AS (SELECT p_brand, v, round(lead(v) OVER (PARTITION BY p_brand ORDER BY v) - v, 6) AS gap FROM v)
SELECT p_brand, count(*) AS n_values, round(min(gap), 4) AS min_gap, round(max(gap), 4) AS max_gap, max(gap) - min(gap) <= 0.01 AS regular FROM g GROUP BY 1 HAVING count(*) >= 3""")
def win_04_adjacent_gap(spark, sf):
    return scores.adjacent_gaps(table(spark, sf, "part"), "p_brand", "p_retailprice").withColumns({"min_gap": F.round("min_gap", 4), "max_gap": F.round("max_gap", 4)})


@query("SELECT * FROM (SELECT s_suppkey, round(s_acctbal - lead(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name), 2) AS gap FROM supplier) WHERE gap IS NOT NULL")
def win_05_adjacent_score_gap(spark, sf):
    return scores.ranked_gaps(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", "s_name").select("s_suppkey", "gap")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS high, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS medium, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS low, count(*) FILTER (WHERE toxic = 0) AS confirmed, count(*) FILTER (WHERE toxic = 1) AS pending, count(*) FILTER (WHERE quality = 0) AS without_evidence FROM labels")
def agg_06_risk_statistics(spark, sf):
    issues = table(spark, sf, "labels").select(
        F.when(F.col("toxic") == 1, "高").when(F.col("quality") == 0, "中").otherwise("低").alias("risk_level"), (F.col("toxic") == 1).alias("requires_human_review"), F.when(F.col("quality") == 1, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>")).alias("evidence")
    )
    return lifecycle.risk_statistics(issues)


@query("SELECT o_custkey, round(avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.55 ELSE 0.0 END), 6) AS quality_score FROM orders GROUP BY 1")
def agg_07_quality_score(spark, sf):
    weight = F.when(F.col("o_orderstatus") == "F", K.QUALITY_WEIGHTS["passed"]).when(F.col("o_orderstatus") == "O", K.QUALITY_WEIGHTS["warning"]).otherwise(K.QUALITY_WEIGHTS["failed"])
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.avg(weight), 6).alias("quality_score"))


@query("SELECT count(*) AS expected, round(coalesce(avg(CASE WHEN d.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 1.0), 4) AS recall, round(coalesce(avg(CAST(toxic AS DOUBLE)), 1.0), 4) AS review_coverage FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND length(d.text) >= 500")
def agg_09_recall_metrics(spark, sf):
    long = docs(spark, sf).filter(F.length("text") >= 500).select("doc_id").withColumn("found", F.lit(1.0))
    rows = table(spark, sf, "labels").join(long, "doc_id", "left")
    return rows.agg(F.count("*").alias("expected"), F.round(F.coalesce(F.avg(F.coalesce("found", F.lit(0.0))), F.lit(1.0)), 4).alias("recall"), F.round(F.coalesce(F.avg("toxic"), F.lit(1.0)), 4).alias("review_coverage"))


@query("SELECT conv_id, string_agg(role, '、' ORDER BY pos) AS roles FROM (SELECT conv_id, role, min(turn) AS pos FROM conversations GROUP BY 1, 2) GROUP BY 1")
def agg_10_ordered_string_agg(spark, sf):
    first = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("pos"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]), "、").alias("roles"))


TOPK_SQL = "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 5"


@query(TOPK_SQL)
def srt_01_topk_per_group(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN '高' WHEN quality = 0 THEN '中' ELSE '低' END AS risk_level, CAST(row_number() OVER (ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END, doc_id) AS INTEGER) <= 20 AS in_first FROM labels ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END, doc_id LIMIT 20")
def srt_03_risk_order(spark, sf):
    level = F.when(F.col("toxic") == 1, "高").when(F.col("quality") == 0, "中").otherwise("低")
    order = F.expr(f"locate(risk_level, '{''.join(K.RISK_ORDER)}')")
    return table(spark, sf, "labels").select("doc_id", level.alias("risk_level"), F.lit(True).alias("in_first")).orderBy(order, "doc_id").limit(20)


@query("SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS words FROM (SELECT doc_id, w, min(pos) AS pos FROM (SELECT doc_id, trim(unnest(p)) AS w, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split(split_part(text, chr(10), 1), ' ') AS p FROM documents)) WHERE w <> '' GROUP BY 1, 2) GROUP BY 1")
def set_01_unique_keep_order(spark, sf):
    words = unique_keep_order(F.split(F.element_at(F.split("text", "\n"), 1), " "))
    return docs(spark, sf).select("doc_id", F.array_join(words, " ").alias("words")).filter("words <> ''")


@query("SELECT kind, count(*) AS n FROM (SELECT 'price' AS kind FROM (" + CONFLICT_SQL + ") UNION ALL SELECT 'spread' FROM (" + SPREAD_SQL + ")) GROUP BY 1")
def set_02_union_issues(spark, sf):
    return chk_08_cross_price(spark, sf).select(F.lit("price").alias("kind")).unionByName(ano_03_cross_lot_spread(spark, sf).select(F.lit("spread").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT source_file, issue_type, evidence[1] AS quote, seq FROM (SELECT source AS source_file, lang AS issue_type, [substr(text, 1, 1)] AS evidence, doc_id AS seq, row_number() OVER (PARTITION BY source, lang, substr(text, 1, 1) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def set_03_dedupe_data(spark, sf):
    issues = docs(spark, sf).select(F.col("source").alias("source_file"), F.col("lang").alias("issue_type"), F.array(F.substring("text", 1, 1)).alias("evidence"), F.col("doc_id").alias("seq"))
    return lifecycle.dedupe_data(issues).select("source_file", "issue_type", F.col("evidence")[0].alias("quote"), "seq")


@query("SELECT c_custkey AS doc_id FROM customer WHERE CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END = ''")
def chk_01_project_name_missing(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("project_name")).filter("project_name = ''").select("doc_id")


@query("""WITH v AS (SELECT c_nationkey AS task, 'segment' AS field, lower(regexp_replace(c_mktsegment, '\\s', '', 'g')) AS value FROM customer UNION ALL SELECT c_nationkey, 'balance_sign', CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END FROM customer)
SELECT task, field, count(DISTINCT value) AS n_values FROM v WHERE value <> '' GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def chk_11_field_consistency(spark, sf):
    fields = F.array(F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("v")), F.struct(F.lit("balance_sign").alias("field"), F.when(F.col("c_acctbal") < 0, "neg").otherwise("pos").alias("v")))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("task"), F.explode(fields).alias("f")).select("task", "f.field", normalize_compare("f.v").alias("value")).filter("value <> ''")
    return rows.groupBy("task", "field").agg(F.count_distinct("value").alias("n_values")).filter("n_values > 1")


SHARED_SQL = "SELECT k AS value, count(DISTINCT user_id) AS n_holders FROM (SELECT json_extract_string(props, '$.k') AS k, user_id FROM events) WHERE k IS NOT NULL GROUP BY 1 HAVING count(DISTINCT user_id) >= 2"


@query(SHARED_SQL)
def ano_06_shared_identity(spark, sf):
    return links.shared_values(table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("value"), "user_id"), "value", "user_id")


TERM_SQL = r"""t AS (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS c, lower(text) AS l FROM documents),
terms AS (SELECT DISTINCT doc_id, term FROM (
  SELECT doc_id, substr(c, i, 2) AS term FROM (SELECT doc_id, c, unnest(generate_series(1, length(c) - 1)) AS i FROM t)
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(l, '[a-z0-9_.-]{2,}')) FROM t))"""


@query(f"WITH {TERM_SQL} SELECT term, count(*) AS df FROM terms GROUP BY 1 HAVING count(*) >= 5")
def ret_01_terms(spark, sf):
    return retrieval.document_frequency(docs(spark, sf), "text").filter("df >= 5")


def chunk_table(spark, sf):
    rows = text.chunks(docs(spark, sf), "doc_id", F.lit(1), "text")
    return rows.select("chunk_id", "content", F.lit("正文").alias("section"), F.lit(0.9).alias("confidence"), F.lit(False).alias("requires_human_review"))


SEARCH = "licensed under the apache license"
SEARCH_SQL = CHUNK_SQL + r""", k AS (SELECT doc_id || '-s1-c' || (part + 1) || '-' || substr(sha256(content), 1, 8) AS chunk_id, regexp_replace(lower(content), '\s+', '', 'g') AS body, regexp_extract_all(lower(content), '[a-z0-9_.-]{2,}') AS words FROM c WHERE content <> ''),
q AS (SELECT DISTINCT term FROM (SELECT substr(c, i, 2) AS term FROM (SELECT 'licensedundertheapachelicense' AS c, unnest(generate_series(1, 28)) AS i) UNION ALL SELECT unnest(['licensed', 'under', 'the', 'apache', 'license']))),
h AS (SELECT k.chunk_id, q.term FROM k, q WHERE (length(q.term) = 2 AND contains(k.body, q.term)) OR list_contains(k.words, q.term)),
w AS (SELECT q.term, ln(((SELECT count(*) FROM k) + 1.0) / (coalesce(df, 0) + 0.5)) + 1 AS idf FROM q LEFT JOIN (SELECT term, count(*) AS df FROM h GROUP BY 1) d ON d.term = q.term),
s AS (SELECT h.chunk_id, count(*) AS overlap, sum(idf) AS hit FROM h JOIN w USING (term) GROUP BY 1)
SELECT k.chunk_id, round(least(1.0, greatest(0.0, hit / greatest(1.0, (SELECT sum(idf) FROM w)) + CASE WHEN contains(body, 'licensedundertheapachelicense') THEN 0.25 ELSE 0 END + 0.05 * 0.9)), 4) AS score
FROM s JOIN k USING (chunk_id) WHERE overlap >= 0.3 * (SELECT count(*) FROM q) ORDER BY least(1.0, greatest(0.0, hit / greatest(1.0, (SELECT sum(idf) FROM w)) + CASE WHEN contains(body, 'licensedundertheapachelicense') THEN 0.25 ELSE 0 END + 0.05 * 0.9)) DESC, chunk_id LIMIT 8"""


@query(SEARCH_SQL)
def ret_02_search(spark, sf):
    return retrieval.search(chunk_table(spark, sf), SEARCH)


QUERIES["srt_02_topk_search"], ORACLE["srt_02_topk_search"] = ret_02_search, SEARCH_SQL


@query(SEARCH_SQL)
def snk_02_index_search(spark, sf):
    """All chunks of documents as one task of an index beside another one, and searched from there."""
    path = storage.fresh(spark, "index")
    index = retrieval.TermIndex(spark, f"evidence_{uuid.uuid4().hex[:8]}", path)
    chunks = chunk_table(spark, sf)
    index.write(chunks.withColumn("task", F.lit("all")))
    index.write(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.lit("").alias("section"), F.lit(0.5).alias("confidence"), F.lit(True).alias("requires_human_review"), F.lit("bench").alias("task")))
    found = index.search("all", SEARCH)  # reads a written table of the chunks it met, and no more the index
    index.drop()
    storage.delete(spark, path)
    return found


@query("""WITH i AS (SELECT doc_id, source, lang, substr(text, 1, 30) AS quote, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'd' END AS description, CASE WHEN doc_id % 4 = 0 THEN '高' ELSE '中' END AS risk, doc_id % 8 <> 0 AS review, row_number() OVER (PARTITION BY source, lang, substr(text, 1, 30) ORDER BY doc_id) AS n FROM documents)
SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN description = '' THEN 'blank' WHEN risk = '高' AND NOT review THEN 'unflagged' ELSE '' END AS reason, count(*) AS n FROM i GROUP BY 1""")
def lif_02_quality_review(spark, sf):
    d = docs(spark, sf)
    w = Window.partitionBy("source_file", "source_location", "quote").orderBy("seq")
    rows = d.select(F.col("source").alias("source_file"), F.col("lang").alias("source_location"), F.substring("text", 1, 30).alias("quote"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 10 == 0, "").otherwise("d").alias("description"), F.when(F.col("doc_id") % 4 == 0, "高").otherwise("中").alias("risk_level"), (F.col("doc_id") % 8 != 0).alias("requires_human_review"))
    reason = F.when(F.row_number().over(w) > 1, "duplicate").when(F.col("description") == "", "blank").when((F.col("risk_level") == "高") & ~F.col("requires_human_review"), "unflagged").otherwise("")
    return rows.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def benchmark_issues(spark, sf):
    """benchmark as findings: each quotes its own text twice; every third names a file, of which only some are known."""
    name = F.when(F.col("item_id") % 3 == 0, F.when(F.col("item_id") % 2 == 0, "web").otherwise("no such file")).otherwise("")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), name.alias("source_file"), F.lit("").alias("source_location"), F.array("text", "text").alias("evidence"))


def document_contexts(spark, sf):
    """documents as contexts: the text, and a row of metadata."""
    d = docs(spark, sf).select(F.col("source").alias("file_name"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("place"), F.lit(0).alias("ord"), F.col("lang").alias("section"), F.lit(None).cast("int").alias("page"), "text", F.concat_ws("|", "source", "lang").alias("meta"))
    parts = F.explode(F.array(F.struct(F.lit("text").alias("part"), F.col("text").alias("content")), F.struct(F.lit("metadata").alias("part"), F.col("meta").alias("content"))))
    return d.select("file_name", "document_id", "place", "ord", "section", "page", parts.alias("p")).select("file_name", "document_id", "place", "p.part", "ord", "section", "page", "p.content")


REFS_SQL = r"""i AS (SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS quote, CASE WHEN item_id % 6 = 0 THEN 'web' WHEN item_id % 3 = 0 THEN 'no such file' ELSE '' END AS named FROM benchmark),
refs AS (SELECT item_id, quote, named, doc_id, source, lang, instr(text, quote) - 1 AS position FROM i JOIN documents d ON quote <> '' AND contains(d.text, quote)
         WHERE named NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) OR named = source)"""


@query(f"WITH {REFS_SQL} SELECT item_id, doc_id, CAST(position AS BIGINT) AS position, 'text' AS source_type, source FROM refs")
def lif_01_evidence_refs(spark, sf):
    refs = lifecycle.evidence_refs(benchmark_issues(spark, sf), document_contexts(spark, sf))
    return refs.select(F.col("seq").alias("item_id"), F.col("document_id").alias("doc_id"), "position", "source_type", F.col("file_name").alias("source"))


@query(f"""WITH {REFS_SQL}, n AS (SELECT item_id, count(*) AS n_refs, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM refs GROUP BY 1)
SELECT i.item_id, coalesce(n_refs, 0) AS n_refs, CASE WHEN named = '' THEN coalesce(n.source, '') ELSE named END AS source_file, CASE WHEN n_refs > 0 THEN coalesce(n.lang, '') ELSE '' END AS source_location
FROM i LEFT JOIN n USING (item_id)""")
def lif_01_enrich_evidence(spark, sf):
    rows = lifecycle.enrich_evidence(benchmark_issues(spark, sf), document_contexts(spark, sf))
    return rows.select(F.col("seq").alias("item_id"), F.size("evidence_refs").cast("long").alias("n_refs"), "source_file", "source_location")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY source, lang, text ORDER BY doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN n > 1 THEN 'duplicate' WHEN coalesce(quality, 1) = 0 THEN 'blank' WHEN coalesce(toxic, 0) = 1 THEN 'unflagged' ELSE '' END AS reason FROM i""")
def lif_02c_review_reasons(spark, sf):
    """Every document as a finding that quotes its whole text; labels give description, risk and flag."""
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    issues = d.select(F.col("doc_id").alias("seq"), F.col("source").alias("source_file"), F.col("lang").alias("source_location"), F.lit("x").alias("issue_type"), F.when(F.col("quality") == 0, "").otherwise("d").alias("description"), F.when(F.col("toxic") == 1, "高").otherwise("中").alias("risk_level"), F.lit(False).alias("requires_human_review"), F.array("text").alias("evidence"))
    return lifecycle.review_reasons(issues, docs(spark, sf).select(F.col("source").alias("source_file"), "text")).select(F.col("seq").alias("doc_id"), "reason")


@query("SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0")
def lif_06_needs_human_review(spark, sf):
    return table(spark, sf, "labels").filter((F.col("toxic") == 1) | (F.col("quality") == 0)).select("doc_id")


# Streams (extension): the same aggregation as a batch and as a stream with a watermark


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def str_05_tumbling_windows(spark, sf):
    from ..streaming.events import tumbling

    return tumbling(table(spark, sf, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, event_id) FILTER (WHERE true) AS event_type FROM (SELECT user_id, ts, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) GROUP BY 1")
def str_01_latest_event(spark, sf):
    from ..streaming.events import latest

    return latest(table(spark, sf, "events"), "user_id").select("user_id", "ts", "event_type")


CACHE_SQL = """WITH r AS (SELECT *, event_id %% 2 AS version, event_type IN ('signup', 'purchase') AS put FROM events),
s AS (SELECT *, max_by(CASE WHEN put THEN {'ts': ts, 'payload': props} END, CASE WHEN put THEN {'ts': ts, 'id': event_id} END) OVER w AS last FROM r
      WINDOW w AS (PARTITION BY user_id, version ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, coalesce(%s, false) AS hit, CASE WHEN %s THEN last.payload END AS payload FROM s WHERE NOT put"""
ALIVE = "epoch_us(ts) - epoch_us(last.ts) < 21601000000"


def cache_requests(events: DataFrame) -> DataFrame:
    """events as requests for what is known of a user: signups and purchases put, the others get, by two versions."""
    key = cache.cache_key(F.lit("users"), F.to_json(F.struct("user_id")), (F.col("event_id") % 2).cast("string"), F.lit("1"))
    return events.select(key.alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(F.col("event_type").isin("signup", "purchase"), "put").otherwise("get").alias("op"), F.col("props").alias("payload"))


@query(CACHE_SQL % (ALIVE, ALIVE))
def str_02_versioned_cache(spark, sf):
    """All events as a stream through the cache, six hours of life."""
    path, like = f"{sf}/events.parquet", table(spark, sf, "events")
    out, state = storage.fresh(spark, "cache"), storage.fresh(spark, "cache-state")
    cache.run_available(cache_requests(read_stream(spark, path, like)), out, state, ttl_seconds=6 * 3600)
    return spark.read.schema("key string, seq long, at timestamp, hit boolean, payload string").parquet(out).select(F.col("seq").alias("event_id"), "hit", "payload")


@query(CACHE_SQL % ("last IS NOT NULL", "last IS NOT NULL"))
def str_02_cache_without_end(spark, sf):
    """The same as a batch, and entries never end."""
    return cache.cached(cache_requests(table(spark, sf, "events")), ttl_seconds=-1).select(F.col("seq").alias("event_id"), "hit", "payload")


# A whole review, cut where it waits for people

REVIEW_SQL = """WITH t AS (SELECT doc_id, coalesce(source, '') AS file, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(0), ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS raw FROM documents),
p AS (SELECT doc_id, file, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM t),
l AS (SELECT doc_id, file, u.pos, trim(u.line) AS line FROM (SELECT doc_id, file, unnest(list_transform(string_split(content, chr(10)), lambda x, i: {'pos': i, 'line': x})) AS u FROM p)),
k AS (SELECT file, substr(line, 1, 240) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l WHERE line <> '' AND (contains(line, 'License') OR contains(line, 'rights reserved'))),
a AS (SELECT DISTINCT file, list_distinct(regexp_extract_all(content, '(?i)%s')) AS found FROM p WHERE regexp_matches(content, '(?i)%s')),
x AS (
  SELECT '限制性条款' AS issue_type, '中' AS risk_level, 'confirmed_issue' AS final_status, count(*) AS n FROM (SELECT DISTINCT file, line FROM k WHERE n <= 8)
  UNION ALL SELECT '文本不可读', '低', 'confirmed_issue', count(*) FROM (SELECT DISTINCT file FROM p WHERE length(content) < 20 OR (length(content) - length(replace(content, chr(65533), ''))) > greatest(3.0, length(content) / 200.0))
  UNION ALL SELECT '敏感信息', '高', CASE WHEN len(found) > 1 THEN 'confirmed_issue' ELSE 'normal' END, count(*) FROM (SELECT file, found FROM a) GROUP BY ALL)
SELECT * FROM x WHERE n > 0""" % (PASSWORD, PASSWORD)


@query(REVIEW_SQL)
def str_03_resumed_review(spark, sf):
    """All documents reviewed until people must decide, and then gone on with: what shows more than one passage is right."""
    given = docs(spark, sf).select(F.col("doc_id").alias("document_id"), F.col("source").alias("file_name"), "text")
    root, pattern = storage.fresh(spark, "review"), "(?i)" + PASSWORD
    waiting = review.run_review(spark, root, given, KEYWORDS[:2], pattern)
    found = review.pending(waiting)
    decisions = found.select(F.hash("issue_id").alias("seq"), "issue_id", F.when(F.size("evidence") > 1, "正确").otherwise("误判").alias("decision"), F.lit("").alias("corrected_text"))
    return review.run_review(spark, root, given, KEYWORDS[:2], pattern, decisions).tables["summary"]


# The planner over sources as tasks, with words of the tables standing in for the domain's

STAND_IN = planner.Vocabulary(
    {"lot": ("License",), "negotiation_report": ("rights reserved",), "unbalanced": ("password", "TOKEN"), "recusal": ("Copyright",), "sale": ("the ",), "opening": ("und ",), "committee": ("http",), "qualification": ("que ",), "conformity": ("los ",)},
    lot_pattern=r"[0-9]{3}-[0-9]{4}", methods=("Apache", "MIT", "ion "), negotiated="ion",
)
RECORD_SQL = {"rankings": "n_chars > 20000", "summaries": "lang = 'de' AND n_chars > 4000", "details": "lang = 'fr' AND n_chars > 6000", "openings": "n_chars < 3", "report": "lang = 'es'"}


def planner_tasks(spark, sf):
    """Each source is a task, and so is one that has no documents; the system knows the method of one."""
    d = docs(spark, sf).select(F.coalesce("source", F.lit("?")).alias("task"), "text", F.lit("").alias("method"), *[F.expr(x).alias(n) for n, x in RECORD_SQL.items()])
    names = d.select("task").distinct().unionByName(table(spark, sf, "region").select(F.col("r_name").alias("task")))
    tasks = names.withColumn("method", F.when(F.col("task") == "ASIA", "negotiation").otherwise(""))
    return planner.task_facts(d, tasks, STAND_IN)


def planner_sql() -> str:
    v, has = STAND_IN, lambda words: " OR ".join(f"contains(text, '{w}')" for w in words)
    facts = {"document": "true"} | RECORD_SQL | {n: has(w) for n, w in v.markers.items()} | {"lot_number": f"regexp_matches(text, '{v.lot_pattern}')"} | {f"method {i}": has((m,)) for i, m in enumerate(v.methods)}
    bools = ", ".join(f"coalesce(bool_or({x}), false) AS f{i}" for i, x in enumerate(facts.values()))
    at = {n: f"f{i}" for i, n in enumerate(facts)} | {"negotiated": "talks"}
    method = "CASE WHEN d.task = 'ASIA' THEN 'negotiation' " + " ".join(f"WHEN {at[f'method {i}']} THEN '{m}'" for i, m in enumerate(v.methods)) + f" ELSE '{planner.UNKNOWN_METHOD}' END"
    names = lambda ns: "(" + " OR ".join(at[n] for n in ns) + ")"
    rows = " UNION ALL ".join(
        f"SELECT task, {i} AS place, '{r}' AS rule_id, '{owner}' AS owner, {names(planner.INPUTS[category])} AS executable FROM m" + (f" WHERE {names(planner.TRIGGERS[r])}" if conditional and r in planner.TRIGGERS else "")
        for i, (r, category, _, owner, _, _, conditional) in enumerate(x for x in K.RULES if x[5])
    )
    return f"""WITH t AS (SELECT coalesce(source, '?') AS task, * EXCLUDE (source) FROM documents), names AS (SELECT task FROM t UNION SELECT r_name FROM region),
d AS (SELECT names.task, {bools.replace('bool_or(true)', 'count(t.task) > 0')} FROM names LEFT JOIN t ON t.task = names.task GROUP BY names.task),
m AS (SELECT *, contains(method, '{v.negotiated}') AS talks FROM (SELECT d.*, {method} AS method FROM d)), r AS ({rows})"""


@query(planner_sql() + " SELECT * FROM r")
def flt_22_rule_plan(spark, sf):
    return planner.plan_rules(planner_tasks(spark, sf), vocabulary=STAND_IN)


@query(planner_sql() + f""", a AS (SELECT task, owner, min(place) AS p FROM r WHERE executable AND owner IN ('{K.COMPLIANCE}', '{K.DATA}', '{K.ANOMALY}') GROUP BY ALL),
l AS (SELECT task, string_agg(owner, ',' ORDER BY p) AS agents FROM a GROUP BY 1),
c AS (SELECT task, count(*) AS matched, count(*) FILTER (executable) AS executable, coalesce(string_agg(rule_id, ',' ORDER BY place) FILTER (rule_id IN {planner.PHASES['UC-07']}), '') AS uc_07 FROM r GROUP BY 1)
SELECT m.task, method, matched, executable, coalesce(agents, '') AS agents, uc_07 FROM m JOIN c USING (task) LEFT JOIN l USING (task)""")
def flt_22_plan_summary(spark, sf):
    rows = planner.plan_summary(planner_tasks(spark, sf), vocabulary=STAND_IN)
    return rows.select("task", "method", "matched", "executable", F.array_join("agents", ",").alias("agents"), F.array_join(F.col("phases")["UC-07"], ",").alias("uc_07"))


# Typed rows from answers, segments, contracts


def event_answers(spark, sf):
    """events' properties as a reader's answers; every tenth is cut off."""
    answer = F.concat(F.lit('{"fields":{"props":{"value":'), "props", F.lit(',"confidence":7}}}'))
    cut = F.when(F.col("event_id") % 10 == 0, F.substring(answer, F.lit(1), F.length(answer) - 2)).otherwise(answer)
    return table(spark, sf, "events").select("event_id", cut.alias("payload"))


@query("SELECT event_id, 'props' AS name, replace(props, ' ', '') AS value, CAST(1 AS DOUBLE) AS confidence, true AS requires_human_review FROM events WHERE event_id % 10 <> 0")
def ext_20_payload_fields(spark, sf):
    rows = payloads.fields(payloads.parsed(event_answers(spark, sf), "payload"), ["event_id"])
    return rows.select("event_id", "name", "value", "confidence", "requires_human_review")


@query("SELECT count(*) AS n, sum(event_id) AS ids FROM events WHERE event_id % 10 = 0")
def ext_20_broken_payloads(spark, sf):
    return payloads.broken_rows(event_answers(spark, sf), "payload").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT conv_id, turn, role AS title, CAST(greatest(1, least(6, turn)) AS INTEGER) AS level, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations WHERE role <> ''")
def ext_20_payload_sections(spark, sf):
    given = table(spark, sf, "conversations")
    answer = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("title"), F.col("turn").alias("level"), F.col("text").alias("content"))).alias("sections")))
    return payloads.sections(payloads.parsed(given.select("conv_id", "turn", answer.alias("payload")), "payload"), ["conv_id", "turn"]).select("conv_id", "turn", "title", "level", "content")


@query()
def ext_08_semantic_segments(spark, sf):
    """Whole documents in segments, and these in halves; tests hold them against a plain loop."""
    rows = segments.split_text(docs(spark, sf).select("doc_id", "text"), "text", floor=segments.FLOOR)
    return rows.select("doc_id", "part", "half", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


AMOUNT_SQL = """WITH d AS (SELECT i, i // 1000 AS a, i // 100 % 10 AS b, i // 10 % 10 AS c, i % 10 AS d FROM range(10000) t(i)),
g AS (SELECT i, CASE WHEN a > 0 THEN z[a + 1] || '仟' ELSE '' END || CASE WHEN b > 0 THEN z[b + 1] || '佰' ELSE '' END
  || CASE WHEN c > 0 THEN CASE WHEN b = 0 AND a > 0 THEN '零' ELSE '' END || z[c + 1] || '拾' ELSE '' END
  || CASE WHEN d > 0 THEN CASE WHEN c = 0 AND (a > 0 OR b > 0) THEN '零' ELSE '' END || z[d + 1] ELSE '' END AS t FROM d, (SELECT '零壹贰叁肆伍陆柒捌玖' AS z)),
o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
p AS (SELECT o_orderkey, cents, cents // 100 // 10000 AS hi, cents // 100 % 10000 AS lo, cents // 10 % 10 AS jiao, cents % 10 AS fen FROM o)
SELECT o_orderkey, '人民币' || CASE WHEN hi = 0 AND lo = 0 THEN '零' WHEN hi = 0 THEN l.t ELSE h.t || '万' || CASE WHEN lo > 0 AND lo < 1000 THEN '零' ELSE '' END || l.t END || '元'
  || CASE WHEN jiao = 0 AND fen = 0 THEN '整' ELSE CASE WHEN jiao > 0 THEN '零壹贰叁肆伍陆柒捌玖'[jiao + 1] || '角' ELSE '零' END || CASE WHEN fen > 0 THEN '零壹贰叁肆伍陆柒捌玖'[fen + 1] || '分' ELSE '' END END AS said, true AS same
FROM p JOIN g h ON h.i = hi JOIN g l ON l.i = lo"""


@query(AMOUNT_SQL)
def ctr_01_capital_amounts(spark, sf):
    """Every order's price in financial capitals, and whether reading them gives it back."""
    price = F.round("o_totalprice", 2).cast("decimal(20,2)")
    rows = table(spark, sf, "orders").select("o_orderkey", price.alias("price"), contracts.capital_amount(price).alias("said"))
    return rows.select("o_orderkey", "said", F.coalesce(contracts.capital_value("said") == F.col("price"), F.lit(False)).alias("same"))


@query("""WITH c AS (SELECT o_orderkey, o_orderdate AS first, max(l_shipdate) AS last, o_orderstatus, o_orderpriority, c_mktsegment, c_name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT * FROM (
  SELECT o_orderkey, 'INVALID_SERVICE_PERIOD' AS code, 'error' AS level FROM c WHERE last <= first
  UNION ALL SELECT o_orderkey, 'MISSING_PURCHASER_CREDIT_CODE', 'warning' FROM c WHERE c_mktsegment = 'MACHINERY' OR c_mktsegment IS NULL
  UNION ALL SELECT o_orderkey, 'MISSING_PURCHASER_ADDRESS', 'warning' FROM c WHERE coalesce(c_name, '') = ''
  UNION ALL SELECT o_orderkey, 'MISSING_SUPPLIER_CREDIT_CODE', 'warning' FROM c WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'MISSING_BREACH_TERMS', 'warning' FROM c WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT o_orderkey, 'LEGAL_REVIEW_REQUIRED', 'info' FROM c)""")
def ctr_01_contract_findings(spark, sf):
    """Orders as contracts that run from the order to the last shipment."""
    last = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("service_end"))
    customer = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = table(spark, sf, "orders").join(last, "o_orderkey", "left").join(customer, "o_custkey", "left")
    drafts = rows.select("o_orderkey", F.col("o_orderdate").alias("service_start"), "service_end", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("purchaser_code"), F.col("c_name").alias("purchaser_address"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("supplier_code"), F.lit("x").alias("supplier_address"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("breach_terms"))
    return contracts.contract_findings(drafts, "o_orderkey").select("o_orderkey", "code", "level")


# Deliverables as files, and the report of rules


def finding_rows(spark, sf):
    """labels and documents as rows of all four deliverables."""
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "anomaly").when(F.col("quality") == 0, "compliance").when(F.col("n_chars") > 3000, "data").otherwise("parse")
    of = {"issue_id": F.concat(F.lit("I"), "doc_id"), "risk_level": F.when(F.col("toxic") == 1, "高").otherwise("低"), "issue_type": F.concat_ws("<&>", "lang", F.lit("_x0041_")), "description": F.concat(F.lit("第一行\n"), F.col("n_chars").cast("string")), "evidence": F.array("lang", "source"), "basis": F.lit('"&'), "source_location": F.col("source"), "final_status": F.lit("passed"), "assessment": F.lit("a\r\nb"), "filename": F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), "page_count": F.col("n_chars"), "document_subtype": F.col("lang")}
    return d.select(kind.alias("kind"), *[c.alias(n) for n, c in of.items()])


@query("""WITH d AS (SELECT *, CASE WHEN toxic = 1 THEN 'anomaly' WHEN quality = 0 THEN 'compliance' WHEN n_chars > 3000 THEN 'data' ELSE 'parse' END AS kind, 'I' || doc_id AS i, CASE WHEN toxic = 1 THEN '高' ELSE '低' END AS risk,
  concat_ws('<&>', lang, '_x0041_') AS type, '第一行' || chr(10) || n_chars AS said, concat_ws(chr(10), lang, source) AS ev FROM documents JOIN labels USING (doc_id))
SELECT kind, CASE kind WHEN 'parse' THEN doc_id || '.txt|' || coalesce(lang, '') || '|' || n_chars
  WHEN 'anomaly' THEN concat_ws('|', i, risk, type, said, ev, '', '', '"&')
  ELSE concat_ws('|', i, risk, type, said, ev, '"&', coalesce(source, ''), '', CASE kind WHEN 'data' THEN 'a' || chr(13) || chr(10) || 'b' ELSE 'passed' END) END AS cells FROM d""")
def snk_06_workbooks(spark, sf):
    """Four deliverables written as spreadsheets and read back."""
    rows, root = finding_rows(spark, sf), storage.fresh(spark, "deliverables")
    back = []
    for kind in workbooks.HEADERS:
        workbooks.write_deliverable(rows.filter(F.col("kind") == kind), kind, f"{root}/{kind}", project_id="P")
        sheets = files.parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(f"{root}/{kind}"))
        body = sheets.filter((F.col("kind") == "table") & (F.col("sheet") != workbooks.COVER)).select(F.explode(F.expr("slice(rows, 2, greatest(size(rows) - 1, 0))")).alias("r"))
        back.append(body.select(F.lit(kind).alias("kind"), F.array_join("r", "|").alias("cells")))
    return reduce(DataFrame.unionByName, back)


RULE_VALUES = ", ".join(f"('{r[0]}', {str(r[5]).lower()}, {str(r[6]).lower()})" for r in K.RULES)


@query(f"""WITH s AS (SELECT source, lang, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0) AS poor, count(quality) AS known FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
r AS (SELECT coalesce(source, '?') AS task, substr(rule_id, 1, 2) AS group_code, CASE WHEN NOT active THEN 'disabled' WHEN conditional AND lang = 'de' THEN 'not_applicable' WHEN known = 0 THEN 'insufficient_data' WHEN toxic > 0 THEN 'confirmed_issue' WHEN poor > 0 THEN 'human_review' ELSE 'passed' END AS status
  FROM s, (VALUES {RULE_VALUES}) v(rule_id, active, conditional))
SELECT coalesce(task, '全部') AS task, coalesce(group_code, '合计') AS group_code, count(*) AS total, count(*) FILTER (status IN ('passed', 'confirmed_issue', 'human_review')) AS executed, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in reports.STATUSES)}
FROM r GROUP BY GROUPING SETS ((task, group_code), (task), ())""")
def snk_08_rules_report(spark, sf):
    """Rule results of each source, a set for each language, from labels: groups by status with totals."""
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    s = d.groupBy("source", "lang").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("poor"), F.count("quality").alias("known"))
    status = F.when(~F.col("active"), "disabled").when(F.col("conditional") & (F.col("lang") == "de"), "not_applicable").when(F.col("known") == 0, "insufficient_data").when(F.col("toxic") > 0, "confirmed_issue").when(F.col("poor") > 0, "human_review").otherwise("passed")
    every = F.array(*[F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[5]).alias("active"), F.lit(r[6]).alias("conditional")) for r in K.RULES])
    rows = s.select("*", F.explode(every).alias("r")).select(F.coalesce("source", F.lit("?")).alias("task"), "r.*", "lang", "known", "toxic", "poor")
    return reports.rules_summary(rows.select("task", "rule_id", status.alias("status")))
