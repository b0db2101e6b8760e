"""Conversation repair, resampling and language-model scores against SQL and plain Python: nulls, ties, repeated rows, long texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sievemark.llm import conversations as C
from sievemark.llm import lm_scoring as L
from sievemark.llm import resampling as R
from sievemark.llm import words as W
from sievemark.llm.common import Scratch
from sievemark.llm.queries import ORACLE_SQL

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CONV = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    rel = con.sql(sql)
    got = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=repr)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted(rel.fetchall(), key=repr)
    return got


def arrow(rows, kinds):
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())})


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, sha string").repartition(3)
    return same(C.repair(C.damage(df), scratch=Scratch(spark), also=df.select("conv_id")), ORACLE_SQL["op11_conversations"], conversations=arrow(rows, CONV))


def test_repair_against_sql(spark):
    draw = random.Random(4)
    texts = [None, "", " \n", "a.", "b", "c!", "d? ", "e.", "f.\x0b", "é ", " ", "g. "]
    rows = [(draw.choice([None, *range(8)]), draw.choice([None, *range(30)]), draw.choice(["system", "user", "assistant", "user", None, "", "tool"]), draw.choice(texts)) for _ in range(300)]
    rows += [(50 + k, t, draw.choice(["system", "user", "assistant"]), draw.choice(["a.", "b.", "c", "d!"])) for k in range(40) for t in range(draw.randrange(1, 9))]
    rows += rows[:40] * 3  # repeated rows, in ties of turns
    assert len(repaired(spark, rows)) > 40
    assert repaired(spark, []) == []


def test_repair_of_one_conversation_over_all_ranges(spark):
    draw = random.Random(5)
    rows = [(1, t, draw.choice(["user", "assistant", "assistant", "system"]), f"{draw.randrange(400)}{draw.choice('.!ab')}") for t in range(700)]
    own = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        pieces = C._pieces(C._slim(C.damage(spark.createDataFrame(rows, list(CONV))).selectExpr("conv_id conv", "turn", "role", "unhex(sha2(text, 256)) sha", "text")))
        assert pieces.count() > 4
        repaired(spark, [*rows, (0, 3, "user", "x."), (2, 1, "assistant", "y.")])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repaired_turns_are_legal(spark):
    rows = [(c, t, role, f"{c} {t}.") for c, roles in enumerate(product(("system", "user", "assistant", "tool"), repeat=3)) for t, role in enumerate(roles)]
    got = defaultdict(str)
    for r in sorted(C.repaired_turns(spark.createDataFrame(rows, list(CONV)), scratch=Scratch(spark)).collect()):
        assert r["turn"] == len(got[r["conv_id"]])
        got[r["conv_id"]] += r["role"][0]
    assert all(re.fullmatch(r"(s?(ua)+)?", x) for x in got.values())


def test_layers_against_all_audits():
    """Costs and audits of the search, whole and cut in pieces, against every sequence of codes."""
    draw, search = random.Random(6), C.Search()
    for _ in range(60):
        turns = [(draw.choice("suat"), draw.choice([C.OK, C.OK, C.TRUNCATED, C.BLANK])) for _ in range(draw.randrange(1, 5))]
        best = None
        for codes in product(range(len(C.CODES)), repeat=len(turns)):
            state, cost = 0, 0
            for (initial, kind), code in zip(turns, codes, strict=True):
                step = [x for x in C.moves(initial if initial in "sua" else "", kind)[state] if x[2] == code]
                if not step:
                    break
                state, cost = step[0][0], cost + step[0][1]
            else:
                run = C._END_RUN[state]
                found = (cost + C.INSERT * run, "".join(C.CODES[c] for c in codes) + "I" * run)
                best = min(best or found, found)
        ends, parents = search.run(0, turns)
        cost, state, run = C.last_edit(ends)
        assert best == (cost, "".join(C.CODES[c] for c in C._codes(parents, state)) + "I" * run)
        pieces, chain = [turns[: len(turns) // 2], turns[len(turns) // 2 :]], []
        for piece in pieces:
            runs = [search.run(s, piece) for s in C.STATES]
            chain.append(([x and x[0] for e, _ in runs for x in e], [x and x[1] for e, _ in runs for x in e], runs))
        pairs, run = C.compose([c[:2] for c in chain])
        audit = "".join(C.CODES[c] for pair, (*_, runs) in zip(pairs, chain, strict=True) for c in C._codes(runs[pair // 4][1], pair % 4))
        assert best[1] == audit + "I" * run


def test_crc_algebra(monkeypatch):
    draw = random.Random(7)
    words = [bytes(draw.randrange(256) for _ in range(draw.choice([1, 2, 3, 40, 70000]))) for _ in range(30)]
    crc, length = np.array([zlib.crc32(w) for w in words]), np.array([len(w) for w in words])
    doc = np.array([0] * 12 + [1] * 18)
    for n, (code, inside) in enumerate(R.run_crcs(crc, length, doc, 4), 1):
        assert code.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
        assert inside.tolist() == [doc[i] == doc[i + n - 1] for i in range(len(words) - n + 1)]
    text = " ".join(f"w{draw.randrange(99)}é," for _ in range(500)).encode()
    whole = R.word_crcs(text).tolist()
    monkeypatch.setattr(W, "PIECE", 16)
    assert R.word_crcs(text).tolist() == whole and len(whole) == 500


def test_resampling_against_sql(spark, monkeypatch):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["alpha", "Beta", "x-1", "ÉT", "kilo", "z"]) for _ in range(draw.randrange(0, 60))) for _ in range(200)] + [None, "", "...", "long " * 5000]
    rows = [(draw.choice([None, *range(400)]), t) for t in texts] + [(7, "one two three four five " * 6)] * 30 + [(None, None)] * 9
    bench = [(1, "alpha beta kilo"), (2, None), (3, "z z z one two")]
    kinds = {"doc_id": pa.int64(), "text": pa.string()}
    for few, some in ((rows, bench), (rows, []), ([], bench)):
        docs = spark.createDataFrame([(*r, 1, "y") for r in few], "doc_id long, text string, n int, pid string").repartition(3)
        target = spark.createDataFrame(some, "item_id long, text string")
        monkeypatch.setattr(R, "COPIES", 7)
        args = {"documents": arrow(few, kinds), "benchmark": arrow(some, {"item_id": pa.int64(), "text": pa.string()})}
        same(R.resample(docs, target, scratch=Scratch(spark)), ORACLE_SQL["op12_resampling"], **args)


def plain_scores(texts, ids):
    """base_score and score from dictionaries of all n-grams: the same model without a filter."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A_TO_Z)), None] for t in texts]
    learn = [w for i, w in zip(ids, tokens, strict=True) if i is None or zlib.crc32(str(i).encode()) % 10]
    count = [Counter(tuple((["<s>"] * (n - 1) + w)[i : i + n]) for w in learn for i in range(len(w))) for n in (1, 2, 3)]
    total, kinds = sum(count[0].values()), len(count[0])
    floor = total + 0.1 * (kinds + 1)
    q = {c: int(L.level(c)) for k in count for c in k.values()} | {len(learn): int(L.level(len(learn)))}
    mean = L.expected()
    weight = {}
    for n in (2, 3):
        mass, again, own = Counter(), Counter(), Counter()
        for g, c in count[n - 1].items():
            own[g[:-1]] += c
        for g, c in count[n - 1].items():
            mass[int(L.level(own[g[:-1]]))] += c
            again[int(L.level(own[g[:-1]]))] += c if c > 1 else 0
        for j in mass:
            weight[n, j] = min(again[j] / (mass[j] + 1), L.MOST)
        weight[n, 1] = weight.get((n, 2), 0) / (2 - weight.get((n, 2), 0))
    out = []
    for w in tokens:
        base = score = 0.0
        for i, x in enumerate(w):
            c = count[0].get((x,), 0)
            base += math.log10((c + 0.1) / floor)
            prob = (mean[q.get(c, 0)] + 0.1) / floor
            seen = c
            for n in (2, 3):
                g = tuple((["<s>"] * (n - 1) + w)[i : i + n])
                history = len(learn) if i == 0 else count[n - 2].get(g[:-1], 0)
                seen = count[n - 1].get(g, 0) if seen and history else 0
                if history:
                    lam = weight.get((n, q[history]), 0)
                    prob = lam * min(mean[q.get(seen, 0)] / mean[q[history]], 1) + (1 - lam) * prob
            score += math.log10(prob)
        out.append((len(w), sum((x,) in count[0] for x in w), total, base, score))
    return out


@pytest.mark.parametrize("bounds", [{}, {"frequent": 12, "pack_bytes": 600}])
def test_lm_against_dictionaries(spark, monkeypatch, bounds):
    draw = random.Random(9)
    stock = [" ".join(draw.choice(["a", "b", "Dé", "the", f"w{draw.randrange(60)}"]) for _ in range(40)) for _ in range(12)]
    texts = [" ".join([draw.choice(stock)] * draw.randrange(1, 3)) + f" own{draw.randrange(9)}\tx\x1cy" for _ in range(80)] + [None, "", " \n", "new words only"]
    ids = [draw.choice([None, *range(200)]) for _ in texts]
    monkeypatch.setattr(L, "BITS", 96)  # so large that it errs on none of these
    docs = spark.createDataFrame([(i, t, 1.0, "z") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, score double, row string").repartition(3)
    scratch = Scratch(spark)
    model = L.train(docs, scratch=scratch, **bounds)
    assert (len(model.packs) > 1 and model.rare) == bool(bounds)
    got = sorted(((r["doc_id"], *tuple(r)[2:]) for r in L.score(docs, model, scratch=scratch).collect()), key=repr)
    want = sorted(((i, *x) for i, x in zip(ids, plain_scores(texts, ids), strict=True)), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_lm_filter_errs_upwards_only():
    draw = np.random.default_rng(3)
    hashes = np.unique(draw.integers(0, 2**63, 20000, dtype=np.uint64))
    counts = draw.integers(1, 40, len(hashes)) ** 2
    bits = L.segment(hashes, counts)

    class Packs:
        value = bits

    scorer = object.__new__(L._Scorer)
    scorer.size, scorer.start, scorer.pack = np.array([[len(bits) * 8]]), np.zeros((1, 1), np.int64), np.zeros((1, 1), np.int64)
    scorer.packs, scorer.slice_bits, scorer.now = [Packs()], 0, None
    got = scorer._levels(1, hashes)
    assert (got >= L.level(counts)).all() and (got > L.level(counts)).mean() < 0.05
    assert (scorer._levels(1, hashes + np.uint64(1)) > 0).mean() < 0.05


def test_lm_copies_gain_and_empty_tables(spark):
    draw = random.Random(10)
    passage = " ".join(f"p{draw.randrange(10**6)}" for _ in range(80))
    rows = [(i, passage if i % 5 == 0 else " ".join(f"p{draw.randrange(10**6)}" for _ in range(80))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark)
    scored = [r for r in L.score(docs, L.train(docs, scratch=scratch), scratch=scratch).collect() if r["held_out"]]
    gain = {r["doc_id"]: r["score"] - r["base_score"] for r in scored}
    assert min(g for i, g in gain.items() if i % 5 == 0) > 80 and max(g for i, g in gain.items() if i % 5) < 20
    empty = L.train(docs.limit(0), scratch=scratch)
    assert L.score(docs.limit(0), empty, scratch=scratch).count() == 0
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in L.score(docs.limit(5), empty, scratch=scratch).collect())
