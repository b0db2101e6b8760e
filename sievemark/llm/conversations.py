"""Cheapest repair of conversations whose turns don't alternate as ``(s?(ua)+)?``, with the least audit string of all that cost as little.

An edit of one turn, with the insertions before it, is one macro edit: some ``I`` and then ``D``, ``K`` or ``R``. These
codes are prefix-free, so audits compare as their codes do one after the other. A layer of the search therefore needs no
audit strings: for each state it keeps a cost, the rank of its best audit among the layer's, and a pointer to its
parent; strings are read off the pointers at the end. Layers take few forms, so each step is computed once for its form.

A conversation may be cut anywhere: what a piece does from each state to each other one is a table of 16 costs and ranks,
and tables of neighbouring pieces compose like layers do. Pieces are ranges of the sorted rows, so a conversation with a
third of all rows is searched by a third of all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch

#: Fixed value: what counts as white space, \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after the system turn, after a user's, after an assistant's. A conversation may end in the first and last.
STATES = range(4)
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_NEXT = "uuau"
ROLES = {"u": "user", "a": "assistant"}
#: Runs of insertions that can be worth their cost: longer ones come back to a state that a shorter one reaches.
RUNS = range(3)
#: The codes of macro edits in ASCII order; none begins another.
CODES = sorted("I" * run + turn for run in RUNS for turn in "DKR")
_END_RUN = {0: 0, 1: 2, 2: 1, 3: 0}


def moves(initial: str, kind: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each state, the macro edits of a turn: (state after, cost, code)."""
    out = []
    for state in STATES:
        own = []
        for run in RUNS:
            before = state
            for _ in range(run):
                before = _AFTER[before, _NEXT[before]]
            late = CUT_OFF if kind == TRUNCATED else 0
            own.append((before, INSERT * run + DELETE, CODES.index("I" * run + "D")))
            if kind in (OK, TRUNCATED):
                if (before, initial) in _AFTER:
                    own.append((_AFTER[before, initial], INSERT * run + late, CODES.index("I" * run + "K")))
                own.append((_AFTER[before, _NEXT[before]], INSERT * run + REROLE + late, CODES.index("I" * run + "R")))
        out.append(tuple(own))
    return tuple(out)


class Search:
    """Steps from layer to layer. A layer has (cost above the layer's least, rank of the audit) for each state, or None."""

    def __init__(self):
        self.moves: dict[tuple[str, int], tuple] = {}
        self.known: dict[tuple, tuple] = {}

    def step(self, layer: tuple, initial: str, kind: int) -> tuple:
        """(next layer, what its least cost is above this one's, parent (state, code) of each state)."""
        initial = initial if initial in ("s", "u", "a") else ""
        key = (layer, initial, kind)
        if key not in self.known:
            if (initial, kind) not in self.moves:
                self.moves[initial, kind] = moves(initial, kind)
            found = [(cost + more, rank, code, after, state) for state, held in enumerate(layer) if held for cost, rank in [held] for after, more, code in self.moves[initial, kind][state]]
            self.known[key] = _layer(found)
        return self.known[key]

    def run(self, start: int, turns: list[tuple[str, int]]) -> tuple[list, list[tuple]]:
        """(cost, rank) of each end state, or None, and every turn's parents."""
        layer = tuple((0, 0) if s == start else None for s in STATES)
        total, parents = 0, []
        for initial, kind in turns:
            layer, more, own = self.step(layer, initial, kind)
            total += more
            parents.append(own)
        return [x and (x[0] + total, x[1]) for x in layer], parents


def _layer(found: list[tuple]) -> tuple:
    """The best of (cost, rank, code, state after, state before) for each state after; ranks follow (rank, code)."""
    best: dict[int, tuple] = {}
    for x in found:
        if x[3] not in best or x < best[x[3]]:
            best[x[3]] = x
    least = min(x[0] for x in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    layer = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in STATES)
    return layer, least, tuple((best[s][4], best[s][2]) if s in best else None for s in STATES)


def _codes(parents: list[tuple], end: int) -> bytes:
    """The codes on the way to an end state, one byte a turn."""
    out, state = bytearray(len(parents)), end
    for i in range(len(parents) - 1, -1, -1):
        state, out[i] = parents[i][state]
    return bytes(out)


def last_edit(ends: list) -> tuple[int, int, int]:
    """(cost, state, insertions) of the cheapest end, of those with one cost the one whose audit is least."""
    cost, _, state = min((x[0] + INSERT * _END_RUN[s], x[1], s) for s, x in enumerate(ends) if x)
    return cost, state, _END_RUN[state]


def compose(pieces: list[tuple[list, list]]) -> tuple[list[int], int]:
    """For each piece of a conversation, given as (costs, ranks) from state to state, the pair 4 * from + to; and the last insertions."""
    layer, parents, total = ((0, 0), None, None, None), [], 0
    for costs, ranks in pieces:
        found = [(held[0] + costs[4 * s + t], held[1], ranks[4 * s + t], t, s) for s, held in enumerate(layer) if held for t in STATES if costs[4 * s + t] is not None]
        layer, least, own = _layer(found)
        total += least
        parents.append(own)
    _, state, run = last_edit(list(layer))
    out = []
    for own in reversed(parents):
        out.append(4 * own[state][0] + state)
        state = own[state][0]
    return out[::-1], run


FAULTS = 20


def damage(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table of conversations with known faults, by the CRC-32 of ``conv_id:turn``.

    Of 20 equal parts one is dropped, one emptied, one loses its ``.!?``, one is there twice and one has role ``user``.
    Nulls count as one space; conv_id and turn stay null.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    part = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")), F.lit(FAULTS))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    out = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), part.alias("part")).filter("part <> 0")
    out = out.withColumn("text", F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("part") == 4, "user").otherwise(F.col("role")))
    twice = F.when(F.col("part") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.select("conv_id", "turn", "role", "text", F.explode(twice).alias("copy")).drop("copy")


def _slim(rows: DataFrame) -> DataFrame:
    """Distinct rows without texts: (conv, turn, role, sha, initial, kind, n). Rows alike in all are one, with their number.

    Only the first of equal role and text isn't a duplicate; a key that very many rows share is summed before it
    shuffles, and split in the join by the skew-join rule.
    """
    body = F.rtrim("text", F.lit(WHITE))
    own = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(*".!?"), OK).otherwise(TRUNCATED)
    once = rows.groupBy("conv", "turn", "role", "sha", F.substring("role", 1, 1).alias("initial"), own.alias("own")).agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = once.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min(place).alias("first"))
    joined = once.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")))
    kind = F.when(F.col("own") == BLANK, BLANK).when(place != F.col("first"), DUPLICATE).otherwise(F.col("own"))
    return joined.select("conv", "turn", "role", "sha", "initial", kind.alias("kind"), "n")


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_LEGAL = {"su", "ua", "au"}
_ORDER = ("conv", "turn", "role", "sha")


class _Piece:
    """The rows of one conversation in one range."""

    def __init__(self, conv: object):
        self.conv, self.rows, self.head, self.last = conv, [], None, None
        self.sums, self.low, self.high = dict.fromkeys(_COUNTS, 0), None, None

    def add(self, turn: int | None, initial: str, kind: int, n: int) -> None:
        pair = f"{self.last or ''}{initial}"
        self.sums["illegal"] += (self.last is not None and pair not in _LEGAL) + n - 1
        self.head, self.last = initial if self.head is None else self.head, initial
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.sums["turns"] += 1
        if kind == BLANK:
            self.sums["blank"] += n
        else:
            self.sums["duplicate"] += n - (kind != DUPLICATE)
            self.sums["truncated"] += kind == TRUNCATED
        self.rows.append((initial, kind, n))

    def row(self, search: Search, pid: int, slot: int) -> dict:
        """Its record. An open piece (``slot`` 0 or 1) has codes for each pair of states, a closed one (-1) the best alone."""
        turns = [r[:2] for r in self.rows]
        copies = DELETE * sum(n - 1 for *_, n in self.rows)  # deleting a copy right after its first is never dearer, and its audit least
        costs, ranks, codes, run = [], [], [], 0
        for start in STATES if slot >= 0 else [0]:
            ends, parents = search.run(start, turns)
            if slot < 0:
                cost, state, run = last_edit(ends)
                costs, ranks, codes = [cost + copies], [0], [_codes(parents, state)]
            else:
                costs += [x and x[0] + copies for x in ends]
                ranks += [x and x[1] for x in ends]
                codes += [x and _codes(parents, s) for s, x in enumerate(ends)]
        return {"conv": self.conv, "pid": pid, "slot": slot, "head": self.head, "last": self.last, "low": self.low, "high": self.high, "costs": costs, "ranks": ranks, "codes": codes, "run": run} | self.sums


def _pieces(slim: DataFrame) -> DataFrame:
    """A record for each conversation in each range of the sorted rows. The first and last of a range stay open: they may go on in others."""
    kind = slim.schema["conv"].dataType.simpleString()
    conv = slim.select("conv").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("conv", conv), ("pid", pa.int32()), ("slot", pa.int32()), ("head", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("low", "high", *_COUNTS)), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("codes", pa.list_(pa.binary())), ("run", pa.int32())])
    text = f"conv {kind}, pid int, slot int, head string, last string, " + ", ".join(f"{c} long" for c in ("low", "high", *_COUNTS)) + ", costs array<long>, ranks array<long>, codes array<binary>, run int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, pid = Search(), TaskContext.get().partitionId()
        now, first, out = None, True, []
        for batch in batches:
            for conv, turn, initial, kind, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row(search, pid, 0 if first else -1))
                        first = False
                    now = _Piece(conv)
                now.add(turn, initial, kind, n)
            if len(out) >= common.BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if now is not None:
            out.append(now.row(search, pid, 0 if first else 1))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ranged = slim.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv", "turn", "initial", "kind", "n")
    return common.map_arrow(ranged, run, text)


def _headers(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The pieces with the codes that the whole conversation's cheapest repair takes in each.

    Of the pieces that stay open, at most two of a range, the costs and ranks go through the driver; codes don't.
    """
    pieces = scratch.keep(_pieces(_slim(rows)), "pieces")
    chosen, chain = [], []
    for r in [*sorted(pieces.filter("slot >= 0").select("pid", "slot", "conv", "costs", "ranks").collect(), key=lambda r: r[:2]), None]:
        if chain and (r is None or r["conv"] != chain[0]["conv"]):
            pairs, run = compose([(c["costs"], c["ranks"]) for c in chain])
            chosen += [(c["pid"], c["slot"], pair, 0) for c, pair in zip(chain, pairs, strict=True)]
            chosen[-1] = (*chosen[-1][:3], run)
            chain = []
        chain.append(r)
    picked = rows.sparkSession.createDataFrame(chosen, "pid int, slot int, pair int, end int")
    own = ["conv", "pid", "head", "last", "low", "high", *_COUNTS]
    closed = pieces.filter("slot < 0").select(*own, F.col("costs")[0].alias("cost"), F.col("codes")[0].alias("codes"), "run")
    opened = pieces.join(F.broadcast(picked), ["pid", "slot"]).select(*own, (F.get("costs", "pair") + INSERT * F.col("end")).alias("cost"), F.get("codes", "pair").alias("codes"), F.col("end").alias("run"))
    return closed.unionByName(opened)


class _Replay:
    """Applies codes to the turns of one conversation as they come."""

    def __init__(self, conv: object):
        self.conv, self.codes, self.at, self.state, self.before = conv, bytearray(), 0, 0, None
        self.sums, self.low, self.high, self.last, self.cost, self.run = dict.fromkeys(_COUNTS, 0), None, None, None, 0, 0
        self.audit = bytearray()

    def header(self, r: dict) -> None:
        for c in _COUNTS:
            self.sums[c] += r[c]
        self.sums["illegal"] += self.last is not None and f"{self.last}{r['head']}" not in _LEGAL
        self.sums["turns"] -= r["low"] is not None and r["low"] == self.high
        self.last, self.low = r["last"], r["low"] if self.low is None else self.low
        self.high = self.high if r["high"] is None else r["high"]
        self.cost += r["cost"]
        self.codes += r["codes"]
        self.run = r["run"]

    def _insert(self) -> tuple[str, str]:
        role = _NEXT[self.state]
        self.state = _AFTER[self.state, role]
        self.audit += b"I"
        return ROLES[role], ""

    def turn(self, place: tuple, role: str, text: str) -> Iterator[tuple[str, str]]:
        if place == self.before:  # a row alike in all
            self.audit += b"D"
            return
        self.before = place
        code = CODES[self.codes[self.at]]
        self.at += 1
        for _ in code[:-1]:
            yield self._insert()
        self.audit += code[-1].encode()
        if code[-1] == "K":
            self.state = _AFTER[self.state, role[:1]]
            yield role, text
        elif code[-1] == "R":
            new = _NEXT[self.state]
            self.state = _AFTER[self.state, new]
            yield ROLES[new], text

    def end(self) -> Iterator[tuple[str, str]]:
        for _ in range(self.run):
            yield self._insert()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]


_HEADER = ("head", "last", "low", "high", *_COUNTS, "cost", "codes", "run")


def _replayed(df: DataFrame, also: DataFrame | None, scratch: Scratch, sink: Callable[[object], object], schema: str, arrow: list[tuple[str, pa.DataType]]) -> DataFrame:
    """All rows of a conversation in order behind its headers, through ``sink``, one conversation after the other.

    A task reads them as a stream: of a conversation it holds the codes and what the sink makes, not the texts.
    """
    text = F.coalesce("text", F.lit(" "))
    rows = df.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    heads = _headers(rows, scratch)
    some: Column = F.struct(*_HEADER)
    stream = heads.select("conv", F.lit(0).alias("tag"), "pid", some.alias("header")).unionByName(rows.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    if also is not None:
        stream = stream.unionByName(also.select(F.col("conv_id").alias("conv")).distinct().withColumn("tag", F.lit(2)), allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "tag", "pid", "turn", "role", "sha").select("conv", "tag", "header", "turn", "role", "sha", "text")
    conv = stream.select("conv").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, None
        names, target = ["conv_id", *(n for n, _ in arrow)], pa.schema([("conv_id", conv), *arrow])
        full = lambda rows: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=target)
        done: list[tuple] = []
        for batch in batches:
            for own, tag, header, turn, role, sha, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if now is None or own != now.conv:
                    if now is not None:
                        done += out.close()
                    now = _Replay(own)
                    out = sink(now)
                if tag == 0:
                    now.header(header)
                elif tag == 1:
                    done += out.take(now.turn((turn, role, sha), role, text))
                if len(done) >= common.BATCH_ROWS:
                    yield full(done)
                    done = []
        if now is not None:
            done += out.close()
        if done:
            yield full(done)

    return common.map_arrow(stream, run, f"conv_id {stream.schema['conv'].dataType.simpleString()}, {schema}")


class _Digest:
    """One row for a conversation."""

    def __init__(self, replay: _Replay):
        self.replay, self.sha, self.any = replay, hashlib.sha256(), False

    def take(self, turns: Iterator[tuple[str, str]]) -> list[tuple]:
        for role, text in turns:
            self.sha.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any = True
        return []

    def close(self) -> list[tuple]:
        self.take(self.replay.end())
        r = self.replay
        return [(r.conv, r.gaps(), *(r.sums[c] for c in _COUNTS[:4]), r.cost, r.audit.decode(), self.sha.hexdigest())]


class _Turns:
    """The repaired turns themselves."""

    def __init__(self, replay: _Replay):
        self.replay, self.at = replay, 0

    def take(self, turns: Iterator[tuple[str, str]]) -> list[tuple]:
        out = []
        for role, text in turns:
            out.append((self.replay.conv, self.at, role, text))
            self.at += 1
        return out

    def close(self) -> list[tuple]:
        return self.take(self.replay.end())


def repair(df: DataFrame, *, scratch: Scratch, also: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``df`` and ``also``.

    ``df`` has conv_id, turn, role and text; other columns aren't read. Rows of a conversation go by turn, nulls first,
    then by role and by the SHA-256 of the text.

    * Null role or text counts as one space, so as a role that can't stay, or a blank text; rows with a null conv_id are
      one conversation;
    * repeated rows are duplicates (blank ones blank) and are deleted; of equal role and text the first in order stays;
    * a conversation that only ``also`` has (a column conv_id) has zeros, an empty audit and the hash of nothing;
    * an empty table gives no rows.

    The search shuffles rows without texts, by ranges. The hash of a conversation's repaired text is one chain over all
    of it, so its texts are read in order by one task, as a stream; ``audit`` is as long as the conversation.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    arrow = [*((c, pa.int64()) for c in names), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    return _replayed(df, also, scratch, _Digest, ", ".join(f"{c} long" for c in names) + ", audit string, repaired_sha256 string", arrow)


def repaired_turns(df: DataFrame, *, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, text): every conversation after its repair, turns numbered from 0; see ``repair``."""
    arrow = [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    return _replayed(df, None, scratch, _Turns, "turn long, role string, text string", arrow)


#: ``repair`` of the damaged table ``conversations``. DuckDB has no CRC; a table for bytes is built from the polynomial. Layers
#: are steps of a recursion, which here carries the audits and repaired texts themselves.
ORACLE_SQL = r"""
WITH RECURSIVE crctable AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
parted AS (
  SELECT * EXCLUDE (h), xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT))), lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS INT) + 1])), 4294967295) % 20 AS part
  FROM keyed, crctable),
damaged AS (
  SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN part = 1 THEN '' WHEN part = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN part = 3 THEN 2 ELSE 1 END))
  FROM parted WHERE part <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn
  FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id),
faulty AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY rn) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY rn) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'ok' END AS fault
  FROM placed),
runs(state, run, mid, own) AS (
  VALUES (0, '', 0, []), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, '', 1, []), (1, 'I', 2, ['user:']), (1, 'II', 3, ['user:', 'assistant:']),
         (2, '', 2, []), (2, 'I', 3, ['assistant:']), (2, 'II', 2, ['assistant:', 'user:']), (3, '', 3, []), (3, 'I', 2, ['user:']), (3, 'II', 3, ['user:', 'assistant:'])),
edits(mid, edit, initial, after, cost, role) AS (
  VALUES (0, 'D', NULL, 0, 3, ''), (1, 'D', NULL, 1, 3, ''), (2, 'D', NULL, 2, 3, ''), (3, 'D', NULL, 3, 3, ''),
         (0, 'R', NULL, 2, 2, 'user'), (1, 'R', NULL, 2, 2, 'user'), (3, 'R', NULL, 2, 2, 'user'), (2, 'R', NULL, 3, 2, 'assistant'),
         (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL)),
moves AS (
  SELECT state, after, 2 * len(run) + cost AS cost, run || edit AS code, edit, initial, role, own FROM runs JOIN edits USING (mid)),
layers(conv, rn, state, best) AS (
  SELECT conv, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} FROM ids
  UNION ALL
  SELECT f.conv, f.rn, m.after, min({'cost': l.best.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN 1 ELSE 0 END, 'audit': l.best.audit || m.code,
                                     'lines': list_concat(list_concat(l.best.lines, m.own), CASE WHEN m.edit = 'D' THEN [] ELSE [coalesce(m.role, f.role) || ':' || f.text] END)})
  FROM layers l JOIN faulty f ON f.conv = l.conv AND f.rn = l.rn + 1
  JOIN moves m ON m.state = l.state AND (m.initial IS NULL OR m.initial = f.initial) AND (m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY f.conv, f.rn, m.after),
sizes AS (
  SELECT ids.conv, conv_id, count(rn) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN faulty USING (conv) GROUP BY ids.conv, conv_id),
ended AS (
  SELECT l.conv, min({'cost': l.best.cost + 2 * len(r.run), 'audit': l.best.audit || r.run, 'lines': list_concat(l.best.lines, r.own)}) AS best
  FROM layers l JOIN sizes ON sizes.conv = l.conv AND sizes.n = l.rn JOIN runs r ON r.state = l.state AND (r.mid = 3 OR r.mid = 0) GROUP BY l.conv)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM sizes JOIN ended USING (conv)
"""
