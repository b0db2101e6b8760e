"""Semi-structured answers of a reader as typed rows: JSON text through VARIANT, clamped, blank values dropped, broken ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exprs import strip

# What stands for no value in a field, and patterns by which a quote states a rank.
NO_VALUE = ("none", "null", "无", "暂无", "未知", "未提供", "未找到", "待填写", "未填写")
BLANKS = ("____", "＿＿＿＿")
RANK_PATTERNS = (r"(?U)第[一二三四五六七八九十\d]+中标候选人", r"(?U)(?:排名|名次|排序)[：:]?[一二三四五六七八九十\d]+")
# Most characters and items that are kept.
TITLE, VALUE, RAW, PLACE, SECTIONS = 200, 500, 1000, 200, 200
CONFIDENCE = 0.7


def parsed(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``v``, the payload as VARIANT, and ``broken``: there is text, but it is no JSON object."""
    v = F.try_parse_json(payload)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    return df.withColumn("v", F.when(is_object, v)).withColumn("broken", (F.trim(F.coalesce(payload, F.lit(""))) != "") & ~is_object)


def broken_rows(df: DataFrame, payload: str) -> DataFrame:
    """The rows whose payload is no JSON object, as they came."""
    return parsed(df, payload).filter("broken").select(*df.columns)


def _text(v: Column, path: str) -> Column:
    """A value as text: strings as they are, others as JSON writes them; blank where it is missing or null."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.to_json(F.try_variant_get(v, path, "variant")), F.lit(""))


def _given(v: Column, path: str) -> Column:
    """Whether there is a value, were it null."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def _items(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """(keys, pos, key, item): the elements of an array, or the entries of an object, at ``path``."""
    rows = df.select(*keys, F.try_variant_get("v", path, "variant").alias("all")).filter(F.col("all").isNotNull())
    spark = df.sparkSession
    return rows.lateralJoin(spark.tvf.variant_explode(F.col("all").outer())).select(*keys, "pos", "key", F.col("value").alias("item"))


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def sections(df: DataFrame, keys: list[str], path: str = "$.sections") -> DataFrame:
    """(keys, pos, title, level, content, page, line_start) of a parsed frame's sections, the first 200.

    Items without a title, or whose level is given and no number, are dropped. Levels are clamped to 1 to 6.
    """
    item, level = F.col("item"), F.try_variant_get(F.col("item"), "$.level", "double").cast("int")
    rows = _items(df, path, keys).filter(F.col("key").isNull() & _is_object(item)).withColumn("title", strip(_text(item, "$.title")))
    rows = rows.filter((F.col("title") != "") & (level.isNotNull() | ~_given(item, "$.level")))
    whole = lambda p: F.try_variant_get(item, p, "int")
    out = rows.select(*keys, "pos", F.left("title", F.lit(TITLE)).alias("title"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1)))).alias("level"), strip(_text(item, "$.content")).alias("content"), whole("$.page").alias("page"), whole("$.line_start").alias("line_start"))
    # ``pos`` counts items that were dropped too; at most SECTIONS that weren't stay
    first = F.array_sort(F.collect_list(F.struct("pos", "title", "level", "content", "page", "line_start")))
    kept = out.groupBy(*keys).agg(F.slice(first, 1, SECTIONS).alias("s")).select(*keys, F.posexplode("s").alias("pos", "s"))
    return kept.select(*keys, "pos", *[f"s.{c}" for c in ("title", "level", "content", "page", "line_start")])


def fields(df: DataFrame, keys: list[str], path: str = "$.fields") -> DataFrame:
    """(keys, name, value, raw_text, source_location, confidence, requires_human_review) of a parsed frame's fields.

    Fields are an object's entries, or a list of objects with a field_name; of one name the last counts. A bare string is
    a value. Words for no value are dropped, as are fields whose confidence is no number; confidence is clamped to 0 to
    1. A field needs a person unless it says that it doesn't.
    """
    item = F.col("item")
    rows = _items(df, path, keys).withColumn("name", F.coalesce("key", F.when(_is_object(item), _text(item, "$.field_name")))).filter("name <> ''")
    bare = F.startswith(F.schema_of_variant(item), F.lit("STRING"))
    rows = rows.filter(bare | _is_object(item)).withColumn("bare", bare)
    of = lambda p: F.when(F.col("bare"), F.lit("")).otherwise(_text(item, p))
    rows = rows.withColumn("value", strip(F.when(F.col("bare"), item.cast("string")).otherwise(_text(item, "$.value"))))
    plain = F.lower(F.replace("value", F.lit(" "), F.lit("")))
    rows = rows.filter((F.col("value") != "") & ~plain.isin(*NO_VALUE) & ~F.contains(plain, F.lit(BLANKS[0])) & ~F.contains(plain, F.lit(BLANKS[1])))
    sure = F.when(F.col("bare") | ~_given(item, "$.confidence"), CONFIDENCE).otherwise(F.try_variant_get(item, "$.confidence", "double"))
    asks = F.when(F.col("bare") | ~_given(item, "$.requires_human_review"), True).otherwise(_truth(item, "$.requires_human_review"))
    rows = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).filter(sure.isNotNull())
    rows = rows.select(*keys, "pos", "name", F.left("value", F.lit(VALUE)).alias("value"), F.left(strip(of("$.raw_text")), F.lit(RAW)).alias("raw_text"), F.left(strip(of("$.source_location")), F.lit(PLACE)).alias("source_location"), "confidence", asks.alias("requires_human_review"))
    rest = ["value", "raw_text", "source_location", "confidence", "requires_human_review"]
    return rows.groupBy(*keys, "name").agg(F.max(F.struct("pos", *rest)).alias("f")).select(*keys, "name", *[f"f.{c}" for c in rest])


def _truth(v: Column, path: str) -> Column:
    """As a condition: false, 0, null, blank text and empty lists are not."""
    value = F.try_variant_get(v, path, "variant")
    text = F.to_json(value)
    return ~(F.is_variant_null(value) | text.isin("false", "0", '""', "[]", "{}") | F.coalesce(F.try_variant_get(v, path, "double") == 0, F.lit(False)) & ~F.startswith(text, F.lit('"')))


def evidence_matches(name: Column, raw_text: Column, source: Column) -> Column:
    """FLT-26: a field's quote stands in its source; a price limit needs a quote that names it."""
    limit = F.replace(raw_text, F.lit(" "), F.lit(""))
    named = (raw_text != "") & (F.contains(limit, F.lit("最高限价")) | F.contains(limit, F.lit("投标限价")) | F.contains(limit, F.lit("控制价")))
    return ((raw_text == "") | F.contains(source, raw_text)) & ((name != "price_limit") | named)


def _quoted(df: DataFrame, keys: list[str], source: str, path: str) -> DataFrame:
    """(keys, pos, item, evidence) of the objects whose evidence isn't blank and stands in the source text."""
    rows = _items(df, path, [*keys, source]).filter(F.col("key").isNull() & _is_object(F.col("item"))).withColumn("evidence", strip(_text(F.col("item"), "$.evidence")))
    return rows.filter((F.col("evidence") != "") & F.contains(source, F.col("evidence"))).drop(source)


def rejections(df: DataFrame, keys: list[str], source: str, path: str = "$.rejection_records") -> DataFrame:
    """(keys, pos, bidder, reason, cited, evidence, requires_human_review)"""
    item = F.col("item")
    review = F.coalesce(_truth(item, "$.requires_human_review"), F.lit(False))
    return _quoted(df, keys, source, path).select(*keys, "pos", *[strip(_text(item, f"$.{p}")).alias(n) for n, p in (("bidder", "bidder"), ("reason", "reason"), ("cited", "cited_clause"))], "evidence", review.alias("requires_human_review"))


def opinions(df: DataFrame, keys: list[str], source: str, path: str = "$.evaluation_opinions") -> DataFrame:
    """(keys, pos, author, opinion, evidence)"""
    item = F.col("item")
    return _quoted(df, keys, source, path).select(*keys, "pos", strip(_text(item, "$.author")).alias("author"), strip(_text(item, "$.opinion")).alias("opinion"), "evidence")


def rankings(df: DataFrame, keys: list[str], source: str, path: str = "$.candidate_rankings") -> DataFrame:
    """(keys, pos, bidder, rank, lot, evidence) where the rank is 1 or more and the quote states one."""
    item, rank = F.col("item"), F.try_variant_get(F.col("item"), "$.rank", "int")
    quote = F.replace("evidence", F.lit(" "), F.lit(""))
    stated = quote.rlike(RANK_PATTERNS[0]) | quote.rlike(RANK_PATTERNS[1])
    return _quoted(df, keys, source, path).filter((rank >= 1) & stated).select(*keys, "pos", strip(_text(item, "$.bidder")).alias("bidder"), rank.alias("rank"), strip(_text(item, "$.lot")).alias("lot"), "evidence")
