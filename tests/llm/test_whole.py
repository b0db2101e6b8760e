"""Training-data operators on inputs where a shortcut would lose part of the job."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from sievemark.llm import decontamination as D
from sievemark.llm import exact_dedup, html_extract, jaccard_join, language_id, licenses, packing
from sievemark.llm.common import Scratch
from sievemark.llm.queries import tokenizer_path


def words(word, n):
    return " ".join([word] * n)


def test_html_clusters_pages_with_landmarks():
    story, more, outside = words("story", 60), words("more", 70), words("outside", 60)
    links = "<ul><li><a href='/a'>Link one</a><li><a href='/b'>Link two</a></ul>"
    page = f"<body><article><h1><a href='/t'>Title</a></h1><p>{story}</p><div><a href='/x'>Buy cheap shoes</a></div><p>Short.</p><p>{more}</p>{links}</article><div>{outside}</div></body>"
    assert html_extract.extract(page) == "\n".join(["Title", story, "Short.", more, outside])
    assert html_extract.extract(f"<article><p><a href='/x'>never closed<p>{story}</article>") == f"never closed\n{story}"


def test_html_keeps_slight_regions():
    intro, main, end = words("intro", 33), words("main", 100), words("end", 33)
    page = f"<body><section><p>{intro}</p></section><section>{f'<p>{main}</p>' * 5}</section><section><p>{end}</p></section></body>"
    assert html_extract.extract(page) == "\n".join([intro, *[main] * 5, end])


def test_decontamination_passes_keep_rows_apart(spark, monkeypatch):
    items = [(i, f"k{i} a b c d e f g h i") for i in (0, 1, 2, 2)]  # item 2 is there twice
    hit = {i: text for i, text in items}
    bench = spark.createDataFrame(items, "item_id long, text string")
    ids, texts = [7, 7, None, None, 7, 8], [hit[0], "x " * 10, hit[1], "y " * 10, hit[2], f"{hit[0]} {hit[2]}"]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    held = [["0"], [], ["1"], [], ["2"], ["0", "2"]]
    want = [(d, 10 * max(1, len(h)), 10 * len(h), len(h), hashlib.sha256(",".join(h).encode()).hexdigest(), bool(h)) for d, h in zip(ids, held, strict=True)]
    assert sorted(map(tuple, D.contamination(docs, bench).collect()), key=str) == sorted(want, key=str)
    real = D.passes
    monkeypatch.setattr(D, "passes", lambda b, i, t: real(b, i, t, most=10))
    assert sorted(map(tuple, D.contamination(docs, bench).collect()), key=str) == sorted(want, key=str)


def test_language_sets_of_any_size(spark):
    letters = {"aa": "abc", "bb": "def", "cc": "ghi", "dd": "jkl", "ee": "mno"}
    rows = [(i, " ".join(f"{x[i % 3]}{x[1]}{x[0]}{x[2]}" for _ in range(30)), lang) for i, (lang, x) in enumerate(list(letters.items()) * 30)]
    model = language_id.Mixtures(language_id.gram_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    one = {lang: next(t for _, t, x in rows if x == lang) for lang in letters}
    mixed = spark.createDataFrame([(1, " ".join(one.values())), (2, " ".join(one[x] for x in ("aa", "bb", "cc", "dd", "dd"))), (3, one["ee"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(mixed, model).collect()}
    assert set(got[1]["langs"]) == set(letters) and abs(got[1]["score"] - 0.2) < 0.03
    assert set(got[2]["langs"]) == {"aa", "bb", "cc", "dd"} and abs(got[2]["score"] - 0.4) < 0.03
    assert set(got[3]["langs"]) == {"ee"}
    assert {r["doc_id"] for r in language_id.keep_identified(mixed, model).collect()} == {3}


def brute_components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(low)
        for a, x in enumerate(sets):
            for b in range(a):
                both = len(x & sets[b])
                if 100 * both >= 80 * (len(x) + len(sets[b]) - both):
                    low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return low


def family(kind, count=300, seed=3):
    """Texts around one passage: with own words at the end, or with single words of it replaced."""
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(100)]
    out = []
    for k in range(count):
        if kind == "own ends":  # 85 in 100 shingles are common to all: no two link
            out.append(" ".join(base + [f"x{k}y{i}" for i in range(17)]))
        elif kind == "links":
            out.append(" ".join(base + [f"x{k}y{i}" for i in range(draw.randrange(1, 10))]))
        else:  # the text itself is not among them; some link with few others
            own = list(base)
            for i in draw.sample(range(100), draw.randrange(1, 5)):
                own[i] = f"x{k}y{i}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("kind", ["own ends", "links", "edited"])
def test_large_families_against_brute_force(spark, kind):
    texts = family(kind)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) == {"own ends": 300, "links": 1}.get(kind, len(set(want)))


def test_sets_with_one_first_hash_stay_apart():
    first, second = (jaccard_join.Shingler()(pa.array([t]))[0] for t in ("a b c d e f", "g h i j k l"))
    clash = frozenset([jaccard_join.set_keys(first)[0]])
    assert jaccard_join.set_key(first, clash) == jaccard_join.set_keys(first)[1]
    assert jaccard_join.set_key(second, clash) == jaccard_join.set_keys(second)[0]


def test_encoder_against_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    draw = random.Random(8)
    signs = ["don't", "'tis", "it''s", "a'", "é", "×", "÷3", "İstanbul", "ÀÉÿ", "Ʒx", "x\u0301", "\u00a0", "…", "“q”", "a\tb\r\n", "\x0b", "\x1c", "<|endoftext|>", "<|", "12é3", "&&&'s", "_", "中文", "\u0250a", "😀", "B" * 300, "", "  ", "ǅ", "ª", "µ", "\x7f", "\u0085"]
    texts = ["".join(draw.choice([*signs, " ", " ", "word", "Two3", "!?"]) for _ in range(draw.randrange(0, 12))) for _ in range(600)] + [None, "", " "]
    enc = packing.Encoder(tokenizer_path(), cache=50)
    for _ in range(2):
        for t, ids in zip(texts, enc(pa.array(texts, pa.string()).slice(0)), strict=True):
            assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert [x.tolist() for x in enc(pa.array(texts, pa.string()).slice(5, 3))] == [whole.encode(t, add_special_tokens=False).ids for t in texts[5:8]]


def test_packing_wastes_little_and_is_the_same_again(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["alpha", "beta", "stone", "river"]) for _ in range(draw.randrange(1, 900))) for _ in range(400)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, two = (packing.pack_documents(docs.repartition(n), tokenizer_path(), capacity=512, docs_per_part=200) for n in (1, 5))
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, two.collect()))  # however rows are dealt, as after a lost task
    used = {}
    for r in one.collect():
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert sum(512 - n for n in used.values()) < 0.02 * 512 * len(used)
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_exact_dedup_carries_clashing_names(spark, tmp_path):
    names = ["__maybe", "__w0", "__row", "row", "id", "at", "best", "sha", "kept", "group_size"]
    rows = [(1, "a", *range(10)), (2, "a", *range(10, 20)), (3, "b", *range(10)), (None, None, *range(10)), (5, "", *range(10)), (2, "a", *range(20, 30))]
    spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    with Scratch(spark) as scratch:
        out = exact_dedup.exact_dedup(docs, scratch=scratch)
        assert set(out.columns) == set(docs.columns) | {"keep_id", "text_sha256"}
        got = {(r["doc_id"], r["row"]): (r["keep_id"], r["group_size"], r["__maybe"]) for r in out.collect()}
        assert got[(1, 3)] == (2, 3, 0) and got[(2, 13)] == (2, 3, 10) and got[(3, 3)] == (3, 1, 0) and got[(None, 3)] == (5, 2, 0)
        left = exact_dedup.drop_copies(docs, scratch=scratch)
        assert left.columns == docs.columns
        kept = [tuple(r) for r in left.collect()]
        assert sorted(r[0] for r in kept) == [2, 3, 5] and all(r in rows for r in kept)


def test_stored_index_phrases_and_proximity(spark):
    draw = random.Random(11)
    texts = [" ".join(f"w{draw.randrange(6)}" for _ in range(draw.randrange(0, 40))) for _ in range(50)] + [None, "", "...", "W1 w2"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, block string").repartition(3)
    index = D.build_index(docs, D.Scratch(spark))
    queries = [("a", "w1 w2"), ("b", "w3 w3 w4"), ("c", "w0"), ("d", "absent w1"), ("e", "")]
    got = sorted(map(tuple, D.phrase_matches(index, queries).collect()))
    want = []
    for d, t in enumerate(texts):
        w = D.words(t)
        want += [(d, q, i) for q, p in queries for n in [D.words(p)] if n for i in range(len(w) - len(n) + 1) if w[i : i + len(n)] == n]
    assert got == sorted(want)
    near = {(r["doc_id"], r["query"]) for r in D.near_matches(docs, queries, 2, index=index).collect()}
    close = {(d, q) for d, t in enumerate(texts) for w in [D.words(t)] for q, p in queries[:1] for i, x in enumerate(w) if x == b"w1" and b"w2" in w[max(0, i - 2) : i + 3]}
    assert {x for x in near if x[1] == "a"} == close
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    assert sorted(map(tuple, D.contamination(docs, bench, index=index).collect())) == sorted(map(tuple, D.contamination(docs, bench).collect()))
    assert D.build_index(docs.limit(0), D.Scratch(spark)).count() == 0


def test_drop_contaminated_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6), (1, "x", 5, 6), (None, None, None, None), (None, "A, b c!", 1, 2), (2, "", 0, 0), (1, "x", 5, 6)], "h1 long, text string, h2 int, row int")
    bench = spark.createDataFrame([("q", "a b c"), (None, None)], "item_id string, text string")
    out = D.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x", 5, 6), (None, None, None, None), (2, "", 0, 0), (1, "x", 5, 6)], key=str)


def test_licence_expressions_titles_and_versions(spark):
    cases = [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
        ("// SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND MIT", "GPL-2.0-or-later,MIT"),
        ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "Apache-2.0"),
        ("SPDX-License-Identifier: GPL-3.0\ncode", "GPL-3.0-only"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later OR Foo-1.0", "LGPL-2.1-or-later"),
        ("Code is released under the Apache 2.0 license", "Apache-2.0"),
        ("Licensed under the MIT License (MIT).", "MIT"),
        ("Released under the MIT License, see LICENSE.", "MIT"),
        ("MIT License\n\nCopyright x", "MIT"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0-only"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2", "GPL-2.0-only"),
        ("    Apache License\n  Version 2.0, January 2004", "Apache-2.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
        ("Licensed under CC BY-NC 2.5", "CC-BY-NC-2.5"),
        ("All code is provided under the terms of the GNU Lesser General Public License version 3 or later. x", "LGPL-3.0-or-later"),
        ("Our software is distributed under the ISC license, see the COPYING file for more details", "ISC"),
        ("The zone is released under the bridge. Version 3. MIT. Licensed under a licence", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs).collect()))
    assert [r[1] for r in got] == [want for _, want in cases]
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": list(range(len(cases))), "text": [t for t, _ in cases]}))
    assert sorted(duck.sql(licenses.oracle_sql()).project("doc_id, licences, n_licences, sentence_ids").fetchall()) == got


def test_licence_notices_and_families(spark):
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    cases = [
        ("// SPDX-License-Identifier: MPL-2.0\ncode", "MPL-2.0"),
        ("/* SPDX-License-Identifier: LGPL-2.1-or-later */", "LGPL-2.1-or-later"),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("This work is licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Intro. Distributed under the\nBoost Software License, Version 1.0. End.", "BSL-1.0"),
        ("This work is licensed under the GNU General Public License version 2.", "GPL-2.0-only"),
        ("Licensed under the GNU Affero General Public License v3.0 or later", "AGPL-3.0-or-later"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        (lgpl.replace("; either", ", either"), "LGPL-2.1-or-later"),
        ("The permitted parking zone is released under the bridge.", ""),
        ("MIT", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs).collect()))
    assert [r[1] for r in got] == [want for _, want in cases]
    assert all(any(h.decode() in s for h in licenses.HINTS) for s in licenses.known_sentences())
    names = [n for forms in licenses.ALL_NAMES.values() for n in forms]
    assert len(names) == len(set(names))
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": list(range(len(cases))), "text": [t for t, _ in cases]}))
    rows = duck.sql(licenses.oracle_sql()).project("doc_id, licences, n_licences, sentence_ids").fetchall()
    assert sorted(rows) == got
