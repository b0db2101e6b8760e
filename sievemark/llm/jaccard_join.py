"""N-gram Jaccard self-join by a token-group matrix: exact links, found without comparing all pairs of a group.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with the same set are one node from here on,
   told apart by 128 bits.
2. A fixed-size count sketch over all shingles marks the frequent ones. Shingles are ordered rare first, frequent last.
   Of two linked sets, the first common shingle in that order stands early in both: within the first
   n - ceil(t n) + 1 of the larger, and within the first n - ceil(2 t n / (1 + t)) + 1 of the smaller one. What follows
   it bounds the overlap, and so the size of a partner: a posting carries that bound as its reach.
3. Prefix shingles are grouped; each set is held against the most central set it shares a shingle with. The links
   so found partition similar documents into groups.
4. The token-group matrix holds, for each shingle and group, the sizes and reaches of the members that have it early.
   A set asks only groups whose sizes are within its own reach and that reach its size; then its overlap with the
   group's union of shingles is bounded, and only groups whose bound reaches the threshold are opened, and their
   members compared. Components are those of all links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, has_bits, map_arrow, map_batches, mix64, set_bits, small, sum_arrays

WORDS = 5
#: Positions of the count sketch: 2**22 counters, whatever the corpus. It only orders shingles; results don't depend on it.
SKETCH_BITS, SKETCH_BLOCKS = 22, 64
#: Shingles are frequent, in levels that double, from where a counter passes the mean by three of its deviations and
#: this; those of SALT_LEVEL and more are salted.
FREQUENT, SALT_LEVEL = 4, 2
#: A frequent token is dealt over the tasks by one salt for each SALT_SETS rows, and LEAST_SALTS at least.
LEAST_SALTS, SALT_SETS = 16, 500_000
#: Postings that one task prunes, about.
TASK_POSTINGS = 1_000_000
CANDIDATE_BITS = 23
#: Texts are hashed together in blocks of about this many bytes.
BLOCK_BYTES = 1 << 18
SCAN_ROWS = 1000
#: Rounds of grouping: each holds every set against another hub; they end when few of the tried pairs link.
ROUNDS, LEAST_YIELD = 3, 0.5
#: Groups of more members than SMALL_GROUP are opened by blocks, smaller ones pair by pair. A block has at most about
#: GROUP_BLOCK members, QUERY_BLOCK queries, and BLOCK_TOKENS shingles of either.
SMALL_GROUP, GROUP_BLOCK, QUERY_BLOCK, BLOCK_TOKENS = 4, 256, 2048, 1 << 20
#: Most ids that are broadcast to take rows out; beyond it the rows are shuffled.
BROADCAST_IDS = 1_000_000
#: The multipliers of byte and word polynomials, odd and so invertible modulo 2**64.
BASE, CHAIN = np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25)


class Shingler:
    """Sorted distinct shingle hashes (uint64) of texts: ``width`` words each, or all words where there are fewer.

    Words are what stands between ASCII white space, with A-Z lower-cased. Texts are hashed together from their UTF-8
    bytes: a word's hash is a difference of prefix sums of a polynomial, so no word is made a Python object.
    """

    def __init__(self, width: int = WORDS):
        self.width = width
        table = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))
        table[65:91] = table[97:123]
        self.table = table
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        base, inverse = int(BASE), pow(int(BASE), -1, 1 << 64)
        self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, np.uint64(x)))]) for x in (base, inverse))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        ends, at = offsets[1:], 0  # null texts have no bytes of their own
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, offsets[at] + BLOCK_BYTES, side="right")))
            out += self._block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
        return out

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(data)
        if n > len(self.up):
            self._powers(2 * n)
        ink = ~self.white[data]
        edge = np.zeros(n + 1, bool)  # a text ends where the next begins
        edge[offsets] = True
        begin, end = ink.copy(), ink.copy()
        begin[1:] &= ~ink[:-1] | edge[1:n]
        end[:-1] &= ~ink[1:] | edge[1:n]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        word = mix64((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        bounds = np.searchsorted(begin, offsets).tolist()
        count = max(0, len(word) - self.width + 1)
        acc = np.full(count, np.uint64(self.width))
        for j in range(self.width):
            acc = acc * CHAIN + word[j : j + count]
        acc, out = mix64(acc), []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= self.width:
                s = np.sort(acc[a : b - self.width + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                h = np.full(1, np.uint64(b - a))
                for w in word[a:b]:
                    h = h * CHAIN + w
                out.append(mix64(h))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of the set."""
    import xxhash

    both = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(np.array([both >> 64, both & (2**64 - 1)], np.uint64).view(np.int64).tolist())


def set_key(shingles: np.ndarray, shared: frozenset[int]) -> int:
    """The key of a set: its first hash, or the second where different sets have the same first one (``shared``)."""
    first, second = set_keys(shingles)
    return second if first in shared else first


def _scan(df: DataFrame) -> DataFrame:
    """(doc_id, first, second, n) per row, and per task its part of the count sketch as (block, task, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(), np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "first", "second", "n", "block", "task", "counts"]
        for batch in batches:
            keys, sizes = [], []
            for at in range(0, batch.num_rows, SCAN_ROWS):
                heads = []
                for s in shingler(batch.column(1).slice(at, SCAN_ROWS)):
                    sizes.append(len(s))
                    keys.append(set_keys(s) if len(s) else (None, None))
                    heads.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                counts += np.bincount(np.concatenate(heads), minlength=len(counts))
            none = pa.nulls(batch.num_rows)
            first, second = ([k[i] for k in keys] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        task = TaskContext.get().partitionId()
        none = pa.nulls(1).cast(pa.int64())
        for block, part in enumerate(np.split(counts, SKETCH_BLOCKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names)

    return map_arrow(df, run, "doc_id long, first long, second long, n long, block int, task int, counts binary")


def _frequent(parts: DataFrame, total: int) -> np.ndarray:
    """The level of each of the sketch's 2**SKETCH_BITS counters: 0 for shingles that are not frequent."""
    mean = total / (1 << SKETCH_BITS)
    least = 3 * mean**0.5 + FREQUENT

    def mark():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            over = [(np.frombuffer(zlib.decompress(c), "<i8") - mean) / least for c in batch.column(1).to_pylist()]
            levels = [np.where(x > 1, 1 + np.log2(np.maximum(x, 1)), 0).astype(np.uint8).tobytes() for x in over]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.binary())], names=["block", "levels"])

        return step

    size = (1 << SKETCH_BITS) // SKETCH_BLOCKS
    out = np.zeros(size * SKETCH_BLOCKS, np.uint8)
    for block, levels in map_batches(sum_arrays(parts, {"block": "int"}), mark, "block int, levels binary").collect():
        out[block * size : (block + 1) * size] = np.frombuffer(bytes(levels), np.uint8)
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def reach(n: np.ndarray | int, position: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The largest size of a set that can link with one of ``n`` whose first common shingle stands at ``position``.

    The overlap is at most n - position, and must be num / (num + den) of both sizes. A posting with a reach of n or
    more can be that of the smaller set of a link.
    """
    return (num + den) * (n - position) // num - n


def _postings(docs: DataFrame, frequent: np.ndarray, shared: frozenset[int], salts: int, num: int, den: int) -> DataFrame:
    """(token, key, n, reach, salt) of every set's prefix, once for a set and task. Frequent tokens are salted by the set."""

    def start():
        shingler, seen = Shingler(), set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            tokens, keys, sizes, hot, far = [], [], [], [], []
            for s in shingler(batch.column(1)):
                if not len(s) or (key := set_key(s, shared)) in seen:
                    continue
                seen.add(key)
                level = frequent[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[: prefix_length(len(s), num, den)]
                tokens.append(s[order])
                hot.append(level[order] >= SALT_LEVEL)
                keys.append(np.full(len(order), key, np.int64))
                sizes.append(np.full(len(order), len(s), np.int32))
                far.append(reach(len(s), np.arange(len(order)), num, den).astype(np.int32))
            if not tokens:
                return None
            key, hot = np.concatenate(keys), np.concatenate(hot)
            salt = np.where(hot, 1 + np.mod(key, salts), 0).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(key), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(far)), pa.array(salt)], names=["token", "key", "n", "reach", "salt"])

        return step

    return map_batches(docs, start, "token long, key long, n int, reach int, salt int")


POSTING = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("reach", pa.int32()), ("salt", pa.int32())])


def _shared(postings: DataFrame, parts: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(token, key, n, reach) of prefix postings that another set has too; and with a score those that can meet another.

    A posting can meet another where its reach covers the smallest set that may be the smaller one of a link by its
    token. score is the df of a set's postings for each shingle it has: a text that others were made from is above
    them. ``parts`` bounds the postings of a task.
    """

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), POSTING)
        token, key, n, far, salt = (table[c].to_numpy() for c in POSTING.names)
        order = np.lexsort((key, salt, token))
        token, key, n, far, salt = token[order], key[order], n[order], far[order], salt[order]
        if len(token):
            first = np.ones(len(token), bool)  # the same set comes once from each task that has a copy
            first[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, n, far, salt = token[first], key[first], n[first], far[first], salt[first]
            new = np.append(token[1:] != token[:-1], True)
            stay = ~(new & np.append(True, new[:-1])) | (salt > 0)  # alone in its token and no salt
            out = pa.Table.from_arrays([pa.array(c[stay]) for c in (token, key, n, far)], names=["token", "key", "n", "reach"])
            yield from out.to_batches(max_chunksize=100_000)

    pruned = scratch.save(map_arrow(postings.repartition(parts, "token", "salt"), prune, "token long, key long, n int, reach int"), "pruned")
    least = pruned.groupBy("token").agg(F.count("*").alias("df"), F.min(F.when(F.col("reach") >= F.col("n"), F.col("n"))).alias("least")).filter("df > 1")
    wide = scratch.save(pruned.join(least, "token"), "wide")
    scratch.drop(pruned)
    met = wide.filter("reach >= least")
    score = met.groupBy("key").agg((F.sum("df") / F.max("n")).alias("score"))
    return wide.select("token", "key", "n", "reach"), scratch.save(met.join(score, "key").select("token", "key", "n", "reach", "score"), "shared")


def _sets(docs: DataFrame, nodes: DataFrame, shared: frozenset[int], scratch: Scratch) -> DataFrame:
    """(key, tokens) once for each of ``nodes`` (key), found by a bitmap of fixed size and then exactly."""
    wanted = set_bits(nodes, "key", CANDIDATE_BITS)

    def start():
        shingler, seen = Shingler(), set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sets = [], []
            for s in shingler(batch.column(1)):
                if len(s) and (key := set_key(s, shared)) not in seen and has_bits(wanted, np.array([key]), CANDIDATE_BITS)[0]:
                    seen.add(key)
                    keys.append(key)
                    sets.append(s.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "tokens"])

        return step

    return scratch.save(map_batches(docs, start, "key long, tokens binary").join(small(nodes, nodes.count()), "key", "left_semi").dropDuplicates(["key"]), "sets")


def _open_groups(docs: DataFrame, twice: frozenset[int], opened: DataFrame, groups: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The links of queries (key, n) with members of the groups opened for them (other), a block of members at a time.

    groups: key, n, grp of all members. Blocks are bounded by members and by shingles, so no task holds a whole group,
    and a query's set is sent once for a block instead of once for a member.
    """
    asked = opened.groupBy(F.col("other").alias("grp")).agg(_blocks(QUERY_BLOCK).alias("qb"))
    load = asked.join(groups.groupBy("grp").agg(_blocks(GROUP_BLOCK).alias("mb")), "grp")
    part = lambda n: F.pmod(F.xxhash64(F.lit(3), "key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = groups.join(load, "grp").withColumn("m", part("mb")).select("grp", "key", "m", each("qb").alias("q"))
    queries = opened.withColumnRenamed("other", "grp").join(load, "grp").withColumn("q", part("qb")).select("grp", "key", "q", each("mb").alias("m"))
    sets = _sets(docs, scratch.save(members.select("key").union(queries.select("key")).distinct(), "nodes"), twice, scratch)

    def compare(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        tokens = [np.frombuffer(t, np.uint64) for t in held["tokens"]]
        size = np.array([len(t) for t in tokens])
        stream, owner = np.concatenate([*tokens, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(tokens)), size)
        order = np.argsort(stream, kind="stable")
        stream, owner = stream[order], owner[order]
        keys, src, dst = held["key"].to_numpy(), [], []
        for key, raw in zip(asked["key"], asked["tokens"], strict=True):
            x = np.frombuffer(raw, np.uint64)
            lo, hi = np.searchsorted(stream, x), np.searchsorted(stream, x, side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(x) else lo
            both = np.bincount(owner[at], minlength=len(tokens))
            hit = np.flatnonzero(den * both >= num * (len(x) + size - both))[:1]  # a group is one component: one link joins
            dst += keys[hit].tolist()
            src += [key] * len(hit)
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    keyed = [d.join(sets, "key").select("grp", "m", "q", "key", "tokens").toDF(*[f"{side}_{c}" for c in ("grp", "m", "q")], "key", "tokens") for side, d in (("h", members), ("a", queries))]
    keyed[1] = keyed[1].select(*[F.col(c).alias(c) for c in keyed[1].columns])
    links = scratch.save(keyed[0].groupBy("h_grp", "h_m", "h_q").cogroup(keyed[1].groupBy("a_grp", "a_m", "a_q")).applyInPandas(compare, "src long, dst long"), "links")
    scratch.drop(sets)
    return links


def _blocks(rows: int) -> Column:
    return F.ceil(F.greatest(F.count("*") / rows, F.sum("n") / BLOCK_TOKENS)).cast("int")


def _verify(docs: DataFrame, twice: frozenset[int], pairs: DataFrame, tried: int, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The links among ``pairs`` (src, dst: set keys), by comparing whole sets."""

    def compare():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                both = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(linked, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["src", "dst"])

        return step

    # A hub's set meets its pairs while they are small; then each pair goes to its other end, which has few.
    pairs = pairs.select("src", "dst")
    sets = _sets(docs, scratch.save(pairs.select(F.col("src").alias("key")).union(pairs.select("dst")).distinct(), "nodes"), twice, scratch)
    joined = small(pairs, tried).join(sets.select(F.col("key").alias("dst"), F.col("tokens").alias("b")), "dst").join(sets.select(F.col("key").alias("src"), F.col("tokens").alias("a")), "src")
    links = scratch.save(map_batches(joined.select("src", "dst", "a", "b"), compare, "src long, dst long"), "links")
    scratch.drop(sets)
    return links


def _suffix(n: Column, num: int, den: int) -> Column:
    """Tokens of a set after its prefix."""
    return F.ceil(F.lit(num) * n / F.lit(den)) - 1


def prefix(n: Column, num: int, den: int) -> Column:
    return n - _suffix(n, num, den)


def jaccard_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: sets of WORDS-word shingles linked at Jaccard num/den or more.

    component_id is the smallest id reachable by links, the row's own included. Null and empty texts, and those
    without words, have no shingles and link with nothing. Equal sets are linked; copies are not expanded into pairs.
    Repeated rows give repeated results; a null id reaches others but is never the smallest. Other columns are not
    read. An empty table gives no rows. Only components are computed, and they are those of all links: links inside a
    component that is already joined are neither counted nor returned. The sketch and the groups only choose the order
    of work. Shingles are told apart by 64-bit hashes, sets by 128 bits.
    """
    spark: SparkSession = df.sparkSession
    with Scratch(spark) as scratch:
        docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        scanned = scratch.save(_scan(docs), "scan")
        rows = scanned.filter("block is null").select("doc_id", "first", "second", "n")
        length = F.when(F.col("n") > 0, prefix(F.col("n"), num, den)).otherwise(0)
        count, total, postings = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(length), F.lit(0))).first()
        # Different sets with the same first hash: at 2**64 values a few among 10**11 sets.
        twice = rows.filter("first is not null").groupBy("first").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b")
        twice = frozenset(r["first"] for r in twice.collect())
        rows = rows.withColumn("key", F.when(F.col("first").isin(*twice), F.col("second")).otherwise(F.col("first")) if twice else F.col("first")).select("doc_id", "key", "n")
        frequent = _frequent(scanned.filter("block is not null").select("block", "task", "counts"), total)
        salts = max(LEAST_SALTS, -(-count // SALT_SETS))
        wide, shared = _shared(_postings(docs, frequent, twice, salts, num, den), max(1, -(-postings // TASK_POSTINGS)), scratch)
        edges = _links(docs, wide, shared, twice, scratch, num, den)
        own = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"))
        labels = connected_components(edges, scratch)
        own = scratch.save(own.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")), "own")
        low = own.groupBy("component").agg(F.min("low").alias("component_id"))
        found = own.join(low, "component").select("key", "component_id")
        out = rows.join(found, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.least("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        return scratch.keep(out, "components")


def _held(shared: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, key, n, reach, score, grp, size) of the tokens that more than one group has; size is the group's."""
    size = labels.groupBy("component").agg(F.count("*").alias("size"))
    labels = scratch.save(labels.join(size, "component").withColumnRenamed("node", "key"), "sizes")
    held = shared.join(small(labels, labels.count()), "key", "left").select("token", "key", "n", "reach", "score", F.coalesce("component", "key").alias("grp"), F.coalesce("size", F.lit(1)).alias("size"))
    several = held.groupBy("token").agg(F.min("grp").alias("a"), F.max("grp").alias("b"), F.max(F.col("reach") >= F.col("n")).alias("short")).filter("a <> b and short").select("token")
    return scratch.save(held.join(several, "token").select("token", "key", "n", "reach", "score", "grp", "size"), "held")


def _links(docs: DataFrame, wide: DataFrame, shared: DataFrame, twice: frozenset[int], scratch: Scratch, num: int, den: int) -> DataFrame:
    ratio = lambda a, b: (F.lit(den) * F.least(a, b) >= F.lit(num) * F.greatest(a, b))
    held, edges, labels = shared.withColumn("grp", F.col("key")).withColumn("size", F.lit(1)), None, None
    for r in range(ROUNDS):
        # Groups: each set against the hub of the tokens it has: of the largest group the most central set, in later
        # rounds that of a random quarter.
        drawn = F.lit(r == 0) | (F.pmod(F.xxhash64(F.lit(r), "key"), F.lit(4)) == 0)
        scored = held.withColumn("score", F.struct("size", drawn.alias("drawn"), "score"))
        hubs = scored.groupBy("token").agg(F.max(F.struct("score", "key", "n", "reach", "grp")).alias("hub"))
        near = held.join(hubs, "token").filter("grp <> hub.grp and hub.n <= reach and n <= hub.reach").filter(ratio(F.col("n"), F.col("hub.n")))
        best = near.groupBy("key", F.col("hub.key").alias("dst")).count().groupBy("key").agg(F.max(F.struct("count", "dst")).alias("best"))
        pairs = scratch.save(best.select(F.col("key").alias("src"), F.col("best.dst").alias("dst")), "pairs")
        tried = pairs.count()
        links = _verify(docs, twice, pairs, tried, scratch, num, den) if tried else pairs
        found = links.count()
        if found or edges is None:
            edges = links if edges is None else scratch.save(edges.union(links), "edges")
            labels = connected_components(edges, scratch)
            held = _held(shared, labels, scratch)
        if found <= LEAST_YIELD * tried:
            break

    # The token-group matrix: the members of each group that may be the smaller set of a link by this token. A set asks
    # the groups that are within its reach, and whose reach it is in.
    n, lo, hi = F.col("n"), F.greatest("lo", F.ceil(F.col("n") * num / den)), F.least("hi", "n", "reach")
    matrix = held.filter("reach >= n").groupBy("token", F.col("grp").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("far"), F.max("size").alias("other_size"))
    asks = held.select("token", "key", "n", "reach", "grp").join(matrix, "token").filter((F.col("grp") != F.col("other")) & (lo <= hi) & (F.col("far") >= n))
    asks = scratch.save(asks.groupBy("key", "n", "other").agg(F.max("other_size").alias("other_size"), F.min("lo").alias("lo")), "asks")
    # The overlap with the group's union, as far as prefixes go, and all that comes after a prefix.
    grouped = wide.join(small(labels, labels.count()).withColumnRenamed("node", "key"), "key", "left").withColumn("grp", F.coalesce("component", "key"))
    others = asks.select("other").distinct()
    union = grouped.select("token", F.col("grp").alias("other")).join(small(others, others.count()), "other", "left_semi").distinct()
    bound = asks.join(wide.select("token", "key"), "key").join(union, ["token", "other"]).groupBy("key", "n", "other", "other_size", "lo").agg(F.count("*").alias("c"))
    opened = scratch.save(bound.filter(F.lit(num + den) * (F.col("c") + _suffix(n, num, den)) >= F.lit(num) * (n + F.greatest("lo", F.ceil(n * num / den)))).select("key", "n", "other", "other_size"), "opened")
    large = opened.filter(F.col("other_size") > SMALL_GROUP).select("key", "n", "other")
    if large.limit(1).count():
        groups = labels.select(F.col("node").alias("key"), F.col("component").alias("grp")).join(large.select(F.col("other").alias("grp")).distinct(), "grp", "left_semi")
        groups = scratch.save(groups.join(wide.groupBy("key").agg(F.max("n").alias("n")), "key"), "groups")
        edges = scratch.save(edges.union(_open_groups(docs, twice, large, groups, scratch, num, den)), "edges")

    # Members of opened groups of a few that share a prefix token with the set, by the same bounds for the pair.
    probe = wide.join(opened.filter(F.col("other_size") <= SMALL_GROUP).select("key", "other"), "key").select("token", F.col("key").alias("src"), "n", "reach", F.col("other").alias("grp"))
    members = grouped.join(opened.select(F.col("other").alias("grp")).distinct(), "grp", "left_semi").select("token", "grp", F.col("key").alias("dst"), F.col("n").alias("m"), F.col("reach").alias("far"))
    pair = probe.join(members, ["token", "grp"]).filter(ratio(F.col("n"), F.col("m")) & (F.col("m") <= F.col("n")))
    pair = pair.groupBy("src", "dst", "n", "m").agg(F.count("*").alias("c"), F.max((F.col("m") <= F.col("reach")) & (F.col("n") <= F.col("far"))).alias("meets"))
    pair = scratch.save(pair.filter(F.col("meets") & (F.lit(num + den) * (F.col("c") + _suffix(n, num, den)) >= F.lit(num) * (n + F.col("m")))), "pairs")
    tried = pair.count()
    return scratch.save(edges.union(_verify(docs, twice, pair, tried, scratch, num, den)), "edges") if tried else edges


def representatives(df: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` that stay where one document of each component does: that whose id names the component.

    Rows whose id is null stay, for nothing tells them apart.
    """
    gone = components.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, df[id_col] == gone["__gone"], "left_anti")
