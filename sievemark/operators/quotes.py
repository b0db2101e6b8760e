"""Finding many quotes in many texts: each quote is anchored at its rarest word, met by an equi-join, and then verified.

A quote's inner words are words of every text that holds it, so the text is found by any one of them; the word that
fewest texts have is its anchor. A quote without an inner word (one or two words, or a script without spaces) is anchored
at one of its runs of a few characters instead. A text is never held against a quote that shares nothing with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exprs import col

WORD, INNER = r"(?U)\w+", r"(?U)(?<=\W)\w+(?=\W)"
#: Characters of an anchor that is no word.
GRAM = 4
#: Most quotes, and characters of them, that are broadcast to the texts at once; more are sought a block at a time.
BLOCK_QUOTES, BLOCK_CHARS = 100_000, 16_000_000
#: Most distinct words or runs of quotes whose document frequency is counted by a broadcast; beyond it they shuffle.
BROADCAST_KEYS = 500_000


def words(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0)))


def grams(text: str | Column, size: int) -> Column:
    """All distinct runs of ``size`` characters, in one pass."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _kind(quote: Column) -> Column:
    """0 for a quote with inner words, else how many characters its anchor has."""
    return F.when(F.regexp_extract(quote, INNER, 0) != "", 0).otherwise(F.least(F.length(quote), F.lit(GRAM)))


def _keys(text: str | Column, kinds: list[int]) -> Column:
    """What quotes of these kinds are anchored at, all in one array."""
    return F.array_distinct(F.concat(*[words(text) if k == 0 else grams(text, k) for k in kinds]))


def _anchored(quotes: DataFrame, texts: DataFrame, kinds: list[int]) -> DataFrame:
    """(qid, quote, key): the key of each quote that fewest texts have. A quote with a key that no text has is left out."""
    own = F.array_distinct(F.regexp_extract_all("quote", F.lit(INNER), F.lit(0)))
    for k in range(1, GRAM + 1):
        own = F.when(F.col("kind") == k, grams("quote", k)).otherwise(own)
    quotes = quotes.select("qid", "quote", "kind", F.unhex(F.sha2("quote", 256)).alias("h"))
    asked = quotes.select("h", F.explode(own).alias("key"))  # a quote meets its keys by digest: it is not repeated for each
    wanted = asked.select("key").distinct()
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    count = texts.select(F.explode(_keys("text", kinds)).alias("key")).join(wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("df"))
    rated = asked.join(count, "key", "left").groupBy("h").agg(F.min(F.struct("df", "key")).alias("best"), F.count_if(F.col("df").isNull()).alias("absent"))
    return quotes.join(rated.filter("absent = 0").select("h", F.col("best.key").alias("key")), "h").select("qid", "quote", "key")


def find_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, id, position) for every text that holds a quote, with the place of the first character, from 0.

    quotes: qid, quote; texts: id, text. Equal quotes may have any number of qids. Null and empty quotes and texts meet
    nothing; repeated rows of ``texts`` give repeated rows. Texts are scanned twice, for anchors of all kinds that the
    quotes need, without a shuffle of texts: the anchors of at most BLOCK_QUOTES quotes are broadcast at a time.
    """
    texts = texts.select("id", "text").filter("text <> ''")
    asked = quotes.select("qid", "quote").filter("quote <> ''").withColumn("kind", _kind(F.col("quote")))
    distinct = asked.groupBy("kind", "quote").agg(F.min("qid").alias("qid"))
    sizes = sorted(map(tuple, distinct.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("quote")).alias("chars")).collect()))  # a row for each kind
    if not sizes:
        of = {f.name: f.dataType.simpleString() for f in (*asked.schema, *texts.schema)}
        return quotes.sparkSession.createDataFrame([], f"qid {of['qid']}, id {of['id']}, position long")
    kinds, ns, chars = zip(*sizes, strict=True)
    held = _anchored(distinct, texts, list(kinds))
    blocks = max(-(-sum(ns) // BLOCK_QUOTES), -(-sum(chars) // BLOCK_CHARS))
    keyed = texts.select("id", "text", F.explode(_keys("text", list(kinds))).alias("key"))
    found = []
    for b in range(blocks):
        block = held if blocks == 1 else held.filter(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == b)
        met = keyed.join(F.broadcast(block), "key").filter(F.contains("text", F.col("quote")))
        found.append(met.select("quote", "id", (F.instr("text", F.col("quote")) - 1).cast("long").alias("position")))
    return reduce(DataFrame.unionByName, found).join(asked.select("qid", "quote"), "quote").select("qid", "id", "position")


def texts_holding_any(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid) of the quotes that any text holds, once each."""
    return find_quotes(quotes, texts).select("qid").distinct()
