"""Training-data operators against plain Python: small tables, nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.llm import decontamination as D
from sievemark.llm import html_extract, jaccard_join, language_id, licenses, packing, quality, sharding, toxicity
from sievemark.llm.common import Scratch, connected_components, has_bits, set_bits
from sievemark.llm.exact_dedup import exact_dedup
from sievemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, keep_id string, __row long"


def table(spark, texts, ids=None):
    """Rows with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA).repartition(3)


def sentence(draw, n, words=300):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


def near_copies(draw, groups, size):
    texts = []
    for _ in range(groups):
        base = sentence(draw, draw.randrange(5, 80), 5000).split()
        for _ in range(draw.randrange(1, size)):
            own = list(base)
            for _ in range(draw.randrange(0, 3)):
                own[draw.randrange(len(own))] = f"z{draw.randrange(10**6)}"
            texts.append(" ".join(own))
    return texts


def components(texts, ids, num=80, den=100):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for i in range(len(texts)):
        low[find(i)].append(ids[i])
    return sorted((ids[i], len(sets[i]), min(low[find(i)])) for i in range(len(texts)))


def test_jaccard_components_against_all_pairs(spark):
    draw = random.Random(4)
    texts = near_copies(draw, 25, 9) + [None, "", "  ", "One two", "one  TWO", "a b c d e", "A b c d\te", "long " * 3000, "long " * 3000]
    ids = list(range(len(texts)))
    got = jaccard_join.jaccard_components(table(spark, texts, ids))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == components(texts, ids)


def test_jaccard_large_group_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 1)
    monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "QUERY_BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    draw = random.Random(9)
    base = sentence(draw, 60, 5000).split()
    texts = []
    for _ in range(40):
        own = list(base)
        for _ in range(3):
            own[draw.randrange(len(own))] = f"z{draw.randrange(10**6)}"
        texts.append(" ".join(own))
    ids = list(range(40))
    got = jaccard_join.jaccard_components(table(spark, texts, ids))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == components(texts, ids)


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_components(table(spark, ["a"]).limit(0)).count() == 0


def test_exact_dedup_one_stays(spark):
    texts = ["a", "a", None, "", "b", "a", "b ", "c"]
    ids = [1, 5, 2, 9, 3, 5, 4, None]
    out = exact_dedup(table(spark, texts, ids), scratch=Scratch(spark)).collect()
    assert len(out) == 8
    by = defaultdict(list)
    for r in out:
        by[r["text_sha256"]].append(r)
    for sha, rows in by.items():
        known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert sum(r["kept"] for r in rows) == 1
        assert {r["group_size"] for r in rows} == {len(rows)}
        assert {r["keep_id"] for r in rows} == {max(known) if known else None}
        assert sha == hashlib.sha256((rows[0]["text"] or "").encode()).hexdigest()
    assert exact_dedup(table(spark, ["a"]).limit(0), scratch=Scratch(spark)).count() == 0


def test_exact_dedup_full_filter_keeps_results(spark):
    texts = [f"t{i % 40}" for i in range(100)]
    out = exact_dedup(table(spark, texts), scratch=Scratch(spark), bits=6)
    assert out.filter("kept").count() == 40


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    draw = random.Random(2)
    texts = [sentence(draw, n) for n in (0, 1, 5, 40, 400, 3000)] + [None, "", "Ünïcode İẞ  x\n\ny <|endoftext|> 中文😀", "A" * 300]
    packed = packing.pack_documents(table(spark, texts), tokenizer_path(), capacity=256, docs_per_part=4, with_ids=True)
    rows = packed.collect()
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    got, fill = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        got[r["doc_id"]][r["start"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in got.items()} == want
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for r in packing.sequences(packed, capacity=256).collect():
        assert len(r["tokens"]) in (256, r["n_tokens"]) and r["n_tokens"] + r["n_padding"] == len(r["tokens"])


def test_first_fit_decreasing_against_scan():
    draw = random.Random(3)
    sizes = np.array([draw.randrange(1, 101) for _ in range(300)])
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (k, 100 - room[k])
        room[k] -= sizes[i]


def test_encoder_generations():
    enc = packing.Encoder(tokenizer_path(), cache=20)
    draw = random.Random(8)
    letters = "aB cé's9 ’́ \n\tİΣ中😀<|endoftext|>!%"
    for _ in range(200):
        texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(4)]
        for t, raw in zip(texts, enc(pa.array(texts)), strict=True):
            assert raw.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_sharding_laws(spark):
    draw = random.Random(5)
    texts = [sentence(draw, draw.randrange(1, 60)) for _ in range(400)] + ["same text"] * 30 + [None, "", "é"]
    rows = sharding.shard_by_bytes(table(spark, texts), 8, scratch=Scratch(spark)).collect()
    assert len(rows) == len(texts)
    by, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        by[r["shard"]].append(r)
        groups[raw].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    target, largest = sum(r["size"] for r in rows) / 8, 30 * (len("same text") + 8)
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
        assert abs(sum(r["size"] for r in shard) - target) <= largest
    assert sharding.shard_by_bytes(table(spark, ["a"]).limit(0), 8, scratch=Scratch(spark)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div>%s<aside>More</aside><form>Name <input></form><div class="comments"><p>First!</p></div><footer>&copy; x</footer></body></html>"""
BODY = "<h1>Head &amp; tail</h1><p>One  two\n three&nbsp;four.<p>Short.</p><div class='ad'>Buy</div><ul><li>a</li><li>b</li></ul><script>x('</p>')</script>"
TEXT = "Head & tail\nOne two three four.\nShort.\na\nb"


def test_html(spark):
    assert html_extract.extract(PAGE % f"<article>{BODY}</article>") == TEXT
    assert html_extract.extract((PAGE % f"<article>{BODY}</article>")[: -len("</footer></body></html>")]) == TEXT
    long = "".join(f"<p>{'words of the story ' * 12}</p>" for _ in range(4))
    got = html_extract.extract(PAGE % f"<div id='story'>{long}</div>")
    assert got == "\n".join([("words of the story " * 12).strip()] * 4)
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (3, "u", "<p>x", 3), (None, "u", "plain", 3)], "page_id long, url string, html string, n_chars int")
    assert {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect()} == {(1, "u", "", 0), (2, None, "", 0), (3, "u", "x", 1), (None, "u", "plain", 5)}


def test_decontamination_against_scan(spark):
    draw = random.Random(6)
    items = [sentence(draw, n, 20) for n in (12, 30, 10, 3, 1)] + [None, "...", "w1 w2 w3"]
    texts = [sentence(draw, draw.randrange(0, 200), 20) + " " + (draw.choice(items) or "") + "! " + sentence(draw, 20, 20) for _ in range(60)] + [None, "", "W1,w2;w3"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want = []
    for d, t in enumerate(texts):
        w, hit, held = D.words(t), set(), set()
        for i, item in enumerate(items):
            tokens = D.words(item)
            n = min(10, len(tokens))
            for k in range(len(tokens) - n + 1 if tokens else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == tokens[k : k + n]:
                        hit.update(range(j, j + n))
                        held.add(str(i))
        want.append((d, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    docs = table(spark, texts)
    assert sorted(map(tuple, D.contamination(docs, bench).collect())) == want
    assert {r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()} == {x[0] for x in want if not x[5]}
    assert D.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    near = D.near_matches(table(spark, ["a x x b", "a x x x x b"]), [("q", "b a")], 3).collect()
    assert [(r["doc_id"], r["query"], r["position"]) for r in near] == [(0, "q", 3)]


def test_decontamination_several_passes(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"k{i} a b c d e f g h i") for i in range(5)], "item_id long, text string")
    docs = table(spark, ["x k1 a b c d e f g h i y k3 a b c d e f g h i", "none"])
    whole = sorted(map(tuple, D.contamination(docs, bench).collect()))
    real = D.passes
    monkeypatch.setattr(D, "passes", lambda b, i, t: real(b, i, t, most=10))
    assert sorted(map(tuple, D.contamination(docs, bench).collect())) == whole


def test_language_id(spark):
    words = {"xx": ["aba", "bab", "abba"], "yy": ["omo", "mom", "ommo"]}
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["xx", "yy"] * 60)] + [(900, "12 !!", "xx"), (901, None, "xx"), (902, "", None), (903, "aba bab", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify_all(docs).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    model = language_id.Mixtures(language_id.gram_counts(docs))
    mixed = spark.createDataFrame([(1, " ".join(["aba bab abba"] * 20 + ["omo mom ommo"] * 30))], "doc_id long, text string")
    shares = language_id.identify(mixed, model).first()["langs"]
    assert shares["yy"] == pytest.approx(0.6, abs=0.05) and shares["xx"] == pytest.approx(0.4, abs=0.05)
    assert {r["doc_id"] for r in language_id.keep_identified(docs, model).collect()} == set(range(120)) | {903}
    assert language_id.identify_all(docs.limit(0)).count() == 0


def test_classifiers_held_out(spark):
    draw = random.Random(1)
    bad = ["scoundrel", "blackguard", "knave"]
    texts, toxic, good = [], [], []
    for i in range(400):
        w = sentence(draw, 40).split()
        toxic.append(int(i % 4 == 0))
        good.append(int(i % 3 > 0))
        if toxic[-1]:
            w[draw.randrange(40)] = draw.choice(bad)
        t = " ".join(w)
        texts.append(t if good[-1] else t.upper().replace(" ", "!! "))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic, strict=True))], "doc_id long, quality int, toxic int")
    for out, y in ((toxicity.score(docs, toxicity.train(docs, labels)), toxic), (quality.score(docs, quality.train(docs, labels)), good)):
        rows = out.collect()
        assert len(rows) == 402 and all(0 <= r["score"] <= 1 for r in rows)
        held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
        assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.95
    none = labels.limit(0)
    assert toxicity.score(docs, toxicity.train(docs, none)).filter("predicted = 1").count() == 0
    assert quality.score(docs, quality.train(docs, none)).count() == 402


def test_licenses(spark):
    mit = "\n".join(licenses.SENTENCES[k].capitalize() + (":" if k == "mit-grant" else ".") for k in ("mit-grant", "mit-keep", "mit-as-is"))
    wrapped = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright\nnotice."
    texts = ["Story.\nReleased under the MIT License.", mit, wrapped, "All rights reserved.\nLicensed under CC BY-NC 4.0.", "nothing", None, ""]
    got = [r["licences"] for r in licenses.scan(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "", "CC-BY-NC-4.0,LicenseRef-all-rights-reserved", "", "", ""]
    assert all(any(h.decode() in s for h in licenses.HINTS) for s in licenses.SENTENCES.values() if "licen" in s or "permi" in s)


def test_licence_hints_cover_sentences():
    missing = [k for k, s in licenses.SENTENCES.items() if not any(h.decode() in s for h in licenses.HINTS)]
    assert missing == []


def test_common(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 32767, 32768, 99999, -1)], "k long")
    bits = set_bits(rows, "k", 17)
    assert has_bits(bits, np.array([0, 1, 32767, 32768, 99999, -1, 2, 50000]), 17).tolist() == [True] * 6 + [False] * 2
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "src long, dst long")
    with Scratch(spark) as scratch:
        got = {r["node"]: r["component"] for r in connected_components(edges, scratch).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


def test_shingler_slices():
    s = jaccard_join.Shingler()
    whole = s(pa.array(["a b c d e f", None, "x"]))
    part = s(pa.array(["q", "a b c d e f", None, "x"]).slice(1))
    assert all((a == b).all() for a, b in zip(whole, part, strict=True)) and [len(x) for x in whole] == [2, 0, 1]


def test_exact_dedup_with_a_full_filter_in_parts(spark):
    """A filter so small that it is full, in several parts, and one whose parts are large: the same rows."""
    from sievemark.llm import exact_dedup as E

    draw = random.Random(21)
    texts = [f"t{draw.randrange(3000)}" for _ in range(4000)] + [""] * 500 + [None] * 500
    ids = [draw.choice([None, *range(900)]) for _ in texts]
    rows = [sorted(map(str, exact_dedup(table(spark, texts, ids).select("doc_id", "text"), scratch=Scratch(spark), bits=b, parts=p).select("doc_id", "keep_id", "group_size", "text_sha256").collect())) for b, p in ((4, 1), (5, 3), (16, 4))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 5000
    assert E.filter_size(0)[0] == 1 and E.filter_size(10**6) == (1, 24, 2)
    assert E.filter_size(10**9)[:2] == (4, 32) and E.filter_size(10**10) == (8, 32, 1)
    base = table(spark, texts, ids).select(F.coalesce("text", F.lit("")).alias("sha"))
    tested = E.may_repeat(base, E.repeated_filter(base, "sha", 3, 16, 2), "sha", 3, 16, 2).collect()
    count = defaultdict(int)
    for t in texts:
        count[t or ""] += 1
    assert all(r["__maybe"] for r in tested if count[r["sha"]] > 1)
    assert sum(r["__maybe"] for r in tested if count[r["sha"]] == 1) < 0.1 * sum(n == 1 for n in count.values())


def test_packing_spreads_copies(spark):
    """A third of all rows alike in all values: no group gets many more than the others."""
    texts, ids = [""] * 6000 + [f"own {i}" for i in range(6000)], [None] * 6000 + list(range(6000))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    pieces = packing.token_pieces(docs, tokenizer_path(), capacity=64, end_id=2, parts=10)
    sizes = [r["count"] for r in pieces.groupBy("part").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 12000 and max(sizes) < 1500
    packed = packing.pack_documents(docs, tokenizer_path(), capacity=64, docs_per_part=1200).collect()
    assert len(packed) == 12000 and len({(r["sequence_id"], r["offset"]) for r in packed}) == 12000


@pytest.mark.parametrize("fault", ["hash", "cut"])
def test_encoder_falls_back_to_the_whole_tokenizer(fault, monkeypatch):
    from tokenizers import Tokenizer

    whole, texts = Tokenizer.from_file(tokenizer_path()), ["one two", "three, four!", None, "five don't 66"]
    enc = packing.Encoder(tokenizer_path())
    if fault == "hash":
        monkeypatch.setattr(packing, "mix64", lambda x: x * np.uint64(0))
        monkeypatch.setattr(enc, "_hashes", lambda data, begin, end: (np.zeros(len(begin), np.uint64), begin.astype(np.uint64)))
    else:
        enc.ends = ~enc.ends
    for _ in range(2):
        assert [x.tolist() for x in enc(pa.array(texts))] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_sharding_places_as_plain_python(spark):
    draw = random.Random(22)
    texts = [draw.choice([None, "", "same", f"t{draw.randrange(40)} " * draw.randrange(1, 30)]) for _ in range(700)]
    rows = sharding.shard_by_bytes(table(spark, texts, list(range(700))), 5, scratch=Scratch(spark)).collect()
    order = sharding.sized(table(spark, texts, list(range(700)))).orderBy("g1", "g2", "doc_id").collect()
    total, at, want, slots = sum(r["size"] for r in order), 0, {}, defaultdict(int)
    groups = defaultdict(list)
    for r in order:
        groups[r["g1"], r["g2"]].append(r)
    for g in groups.values():
        size = sum(r["size"] for r in g)
        shard = (2 * at + size) * 5 // (2 * total)
        for r in g:
            want[r["doc_id"]] = (shard, slots[shard])
            slots[shard] += 1
        at += size
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == want
    many = sharding.shard_by_bytes(table(spark, texts, list(range(700))), 5000, scratch=Scratch(spark))
    assert many.count() == 700 and max(r["slot"] for r in many.collect()) >= 0
