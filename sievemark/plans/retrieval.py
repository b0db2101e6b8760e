"""Lexical evidence search: character bigrams and ASCII words, weighted by inverse document frequency.

``search`` reads chunks; ``TermIndex`` keeps a written table of terms, bucketed by term and partitioned by task, of which
a search reads the buckets of its own terms only.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..exprs import col, compact
from ..storage import written

#: Words of the index.
WORD = r"[a-z0-9_.-]{2,}"
SPACE = re.compile(r"\s+")
CHUNK = ("chunk_id", "content", "section", "confidence", "requires_human_review")
#: An index numbers its chunks; a list of a term's chunks is of one run of so many numbers, in which two bytes tell them apart.
RUN = 1 << 15
#: Terms of chunks, repeated ones too, that are grouped at once.
GROUPED = 4_000_000


def query_terms(query: str) -> list[str]:
    text = SPACE.sub("", query.lower())
    return sorted({text[i : i + 2] for i in range(len(text) - 1)} | set(re.findall(WORD, query.lower())))


def terms(text: str | Column) -> Column:
    """Distinct terms of a text: all pairs of neighbouring characters without white space, found in one pass, and words."""
    pairs = F.regexp_extract_all(compact(F.lower(col(text))), F.lit("(?s)(?=(..))"), F.lit(1))
    return F.array_union(pairs, F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0)))


def document_frequency(chunks: DataFrame, text: str) -> DataFrame:
    """(term, df) over all chunks; counts are partial before the shuffle."""
    return chunks.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def has_term(body: Column, low: Column, term: str) -> Column:
    """Whether a text has a term. body: without white space, low: with it, both lower-cased.

    A term of two characters is one of the pairs, or a word and so one too; a longer one is a whole word.
    """
    if len(term) == 2:
        return F.contains(body, F.lit(term))
    bounds = f"(?<![a-z0-9_.-]){re.escape(term)}(?![a-z0-9_.-])"
    return F.contains(low, F.lit(term)) & low.rlike(bounds)


def scored(met: DataFrame, wanted: list[str], total: int, counts: dict[int, int], limit: int) -> DataFrame:
    """The best of ``met`` (chunk_id, hits, whole, titled, confidence, requires_human_review) by score and then id.

    hits: which of the query's terms a chunk has, by their place in ``wanted``. A chunk needs a common term, and three
    tenths of a query of three terms or more.
    """
    idf = [math.log((total + 1) / (counts.get(i, 0) + 0.5)) + 1 for i in range(len(wanted))]
    weight = F.array(*map(F.lit, idf))
    hit = F.aggregate("hits", F.lit(0.0), lambda a, i: a + F.get(weight, i))
    least = F.lit(0.3 * len(wanted)) if len(wanted) >= 3 else F.lit(0.0)
    score = hit / F.greatest(F.lit(1.0), F.lit(sum(idf))) + F.when(F.col("whole"), 0.25).otherwise(0.0) + F.when(F.col("titled"), 0.12).otherwise(0.0)
    score += 0.05 * F.col("confidence") - F.when(F.col("requires_human_review"), 0.02).otherwise(0.0)
    ranked = met.filter((F.size("hits") > 0) & (F.size("hits") >= least)).select("chunk_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("s"))
    return ranked.orderBy(F.desc("s"), "chunk_id").limit(max(1, min(limit, 50))).select("chunk_id", F.round("s", 4).alias("score"))


def _flags(query: str) -> tuple[Column, Column]:
    """Whether a chunk has the whole query, and whether its section's name has."""
    whole = r"(?U)" + r"\s*".join(map(re.escape, SPACE.sub("", query.lower())))  # with any white space, which needn't be taken out first
    return F.lower("content").rlike(whole), F.lower(F.coalesce("section", F.lit(""))).rlike(whole)


def search(chunks: DataFrame, query: str, limit: int = 8, *, where: Column | None = None) -> DataFrame:
    """The best chunks for a query, by score and then id. chunks: chunk_id, content, section, confidence, requires_human_review.

    N and the document frequencies are over the chunks that ``where`` lets through. One scan asks each text for the
    query's terms and writes which it has, a few numbers a chunk; frequencies and scores come from there.
    """
    wanted = query_terms(query)
    if where is not None:
        chunks = chunks.filter(where)
    if not query.strip() or not wanted:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    rows = chunks.select(*CHUNK, F.lower("content").alias("low"), compact(F.lower("content")).alias("body"))
    hits = F.array_compact(F.array(*[F.when(has_term(F.col("body"), F.col("low"), t), i) for i, t in enumerate(wanted)]))
    whole, titled = _flags(query)
    met = written(rows.select("chunk_id", hits.alias("hits"), whole.alias("whole"), titled.alias("titled"), "confidence", "requires_human_review"), "hits")
    counts = dict(map(tuple, met.select(F.explode("hits").alias("i")).groupBy("i").count().collect()))  # a row for each term
    return scored(met, wanted, met.count(), counts, limit)


def _lists(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, run, places, task) of chunks (n, task, terms): which chunks of a run have a term."""
    table = pa.Table.from_batches(held).combine_chunks()
    n, task, each = (table[c].combine_chunks() for c in ("n", "task", "terms"))
    row, term, task = np.asarray(pc.list_parent_indices(each)), each.flatten().dictionary_encode(), task.dictionary_encode(null_encoding="encode")
    n, of_task = n.to_numpy()[row], np.asarray(task.indices)[row]
    runs, of_run = np.unique(n // RUN, return_inverse=True)
    key = (np.asarray(term.indices).astype(np.int64) * len(task.dictionary) + of_task) * len(runs) + of_run
    order = np.argsort(key, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(key))
    first = order[ends[:-1]]
    places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((n[order] % RUN).astype(np.int16)))
    out = [term.dictionary.take(term.indices.take(pa.array(first))), pa.array(runs[of_run[first]], pa.int64()), places, task.dictionary.take(pa.array(of_task[first]))]
    yield from pa.Table.from_arrays(out, ["term", "run", "places", "task"]).to_batches(10_000)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch["terms"].flatten())
        if size >= GROUPED:
            yield from _lists(held)
            held, size = [], 0
    if size:
        yield from _lists(held)


class TermIndex:
    """A written index of chunks: a table of (term, run, places, task), lists of chunks, and one of the numbered chunks themselves.

    Both are partitioned by task, and the terms are bucketed, so that writing a task again replaces that task alone and
    a search reads the files of its terms and its task.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.terms, self.chunks, self.path, self.buckets = spark, f"{name}_terms", f"{name}_chunks", path, buckets

    def _put(self, df: DataFrame, table: str, bucketed: str | None) -> None:
        if self.spark.catalog.tableExists(table):
            mode = "spark.sql.sources.partitionOverwriteMode"
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                df.select(*self.spark.table(table).columns).write.insertInto(table, overwrite=True)
            finally:
                self.spark.conf.set(mode, before)
            return
        out = df.write.partitionBy("task").format("parquet").option("path", f"{self.path}/{table}").option("compression", "zstd")
        (out.bucketBy(self.buckets, bucketed).sortBy(bucketed) if bucketed else out).saveAsTable(table)

    def write(self, chunks: DataFrame) -> None:
        """Writes the tasks that ``chunks`` (task and the columns of CHUNK, others along) has; other tasks stay as they are.

        Chunks are numbered as they are written. What a worker has read of them gives a list for each term; lists shuffle
        once, to their bucket.
        """
        mark = uuid.uuid4().hex
        self._put(chunks.select(*[c for c in chunks.columns if c != "task"], F.monotonically_increasing_id().alias("n"), F.lit(mark).alias("mark"), "task"), self.chunks, None)
        new = self.spark.table(self.chunks).filter(F.col("mark") == mark)
        posted = new.select("n", "task", terms("content").alias("terms")).mapInArrow(_posted, f"term string, run long, places array<short>, task {new.schema['task'].dataType.simpleString()}")
        # a task whose chunks have no term has a list too: an empty one, which replaces those that it had before
        none = new.select("task").distinct().select(F.lit("").alias("term"), F.lit(0).cast("long").alias("run"), F.array().cast("array<short>").alias("places"), "task")
        self._put(posted.unionByName(none).repartition(self.buckets, "term"), self.terms, "term")

    def drop(self) -> None:
        for table in (self.terms, self.chunks):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def postings(self, task: str, wanted: list[str]) -> DataFrame:
        """The rows of a task's terms: one partition, and of its buckets those that hold a term."""
        return self.spark.table(self.terms).filter((F.col("task") == task) & F.col("term").isin(*wanted))

    def search(self, task: str, query: str, limit: int = 8, *, where: Column | None = None) -> DataFrame:
        """As ``search`` over the task's chunks; their texts are asked for the whole query where they are read."""
        wanted = query_terms(query)
        chunks = self.spark.table(self.chunks).filter(F.col("task") == task)
        if where is not None:
            chunks = chunks.filter(where)
        if not query.strip() or not wanted:
            return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
        place = F.create_map(*[F.lit(x) for i, t in enumerate(wanted) for x in (t, i)])
        have = self.postings(task, wanted).select(place[F.col("term")].alias("i"), "run", F.explode("places").alias("place")).select((F.col("run") * RUN + F.col("place")).alias("n"), "i")
        hits = have.groupBy("n").agg(F.array_sort(F.collect_list("i")).alias("hits"))  # at most a query's terms
        whole, titled = _flags(query)
        asked = chunks.select("n", "chunk_id", whole.alias("whole"), titled.alias("titled"), "confidence", "requires_human_review")
        met = written(asked.join(hits, "n").drop("n"), "hits")
        counts = dict(map(tuple, met.select(F.explode("hits").alias("i")).groupBy("i").count().collect()))
        return scored(met, wanted, chunks.count(), counts, limit)
