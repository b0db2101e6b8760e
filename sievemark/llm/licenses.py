"""Licence recognition by sentences: normalised sentences name identifiers, ordered rules read their sequences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Public licence sentences, normalised (A-Z lower-cased, every run of other than a-z and 0-9 one space).
SENTENCES: dict[str, str] = {
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-free": "this library is free software",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "apache-title": "apache license",
    "apache-version": "version 2 0 january 2004",
    "gpl-title": "gnu general public license",
    "lgpl-title": "gnu lesser general public license",
    "agpl-title": "gnu affero general public license",
    "gnu3-version": "version 3 29 june 2007",
    "gpl2-version": "version 2 june 1991",
    "lgpl21-version": "version 2 1 february 1999",
    "agpl3-version": "version 3 19 november 2007",
    "version-3": "version 3",
    "version-2": "version 2",
    "reserved": "all rights reserved",
}
# How a notice begins and ends around a licence's name: a subject and "is" or nothing, what is done, and what
# may follow.
SUBJECTS = tuple(f"{which} {what}" for which in ("this", "the", "all", "our") for what in ("project", "software", "work", "code", "source code", "library", "package", "program", "file", "repository", "document", "module", "tool")) + ("code", "source code", "software", "it")
VERBS = ("licensed under", "released under", "distributed under", "available under", "made available under", "provided under", "published under")
FILES = ("license", "license file", "license md", "license md file", "license txt", "license txt file", "licence", "copying", "copying file")
ENDS = ("", " for details", " for more details", " for more information")
# Licences by SPDX identifier, with the names that notices give them. A plus sign is lost in normalised
# text, so short names of the GNU licences, which may end in one, are left out.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the mit license", "mit license", "an mit license", "the mit licence", "mit licence", "mit", "the mit license mit", "mit license mit", "the expat license"),
    "Apache-2.0": ("the apache license version 2 0", "apache license version 2 0", "the apache license 2 0", "apache license 2 0", "the apache 2 0 license", "apache 2 0 license", "apache 2 0", "the apache software license version 2 0", "the apache 2 license", "the apache license v2 0", "apache license v2 0"),
    "BSD-2-Clause": ("the bsd 2 clause license", "bsd 2 clause license", "bsd 2 clause", "the 2 clause bsd license", "the simplified bsd license"),
    "BSD-3-Clause": ("the bsd 3 clause license", "bsd 3 clause license", "bsd 3 clause", "the 3 clause bsd license", "the new bsd license", "the revised bsd license", "the modified bsd license"),
    "ISC": ("the isc license", "isc license", "isc"),
    "0BSD": ("the zero clause bsd license", "0bsd"),
    "MPL-2.0": ("the mozilla public license version 2 0", "the mozilla public license 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-1.0": ("the eclipse public license version 1 0", "the eclipse public license 1 0", "the eclipse public license v1 0", "epl 1 0"),
    "EPL-2.0": ("the eclipse public license version 2 0", "the eclipse public license 2 0", "the eclipse public license v2 0", "epl 2 0"),
    "Unlicense": ("the unlicense", "unlicense"),
    "Zlib": ("the zlib license", "zlib license", "zlib"),
    "BSL-1.0": ("the boost software license version 1 0", "the boost software license 1 0"),
    "CC0-1.0": ("cc0", "cc0 1 0", "cc0 1 0 universal", "the cc0 1 0 universal license"),
}
# The GNU licences: identifier, name, versions that were published.
GNU = (
    ("GPL", "general public license", ("2.0", "3.0")),
    ("LGPL", "lesser general public license", ("2.1", "3.0")),
    ("AGPL", "affero general public license", ("3.0",)),
)
# The Creative Commons licences: their parts, the words of each, and the versions that were published.
COMMONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
COMMONS_VERSIONS = {"2.0": "generic", "2.5": "generic", "3.0": "unported", "4.0": "international"}
# The rules in the order they are tried. Sentences that a rule has read are not read again.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-header",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-terms")),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-title", "apache-version")),
    ("GPL-3.0-only", ("gpl-title", "gnu3-version")),
    ("GPL-2.0-only", ("gpl-title", "gpl2-version")),
    ("LGPL-3.0-only", ("lgpl-title", "gnu3-version")),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl21-version")),
    ("AGPL-3.0-only", ("agpl-title", "agpl3-version")),
    ("GPL-3.0-only", ("gpl-title", "version-3")),
    ("GPL-2.0-only", ("gpl-title", "version-2")),
    ("CC0-1.0", ("cc0",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("Unlicense", ("unlicense-domain",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
)
# Every known sentence holds one of these, so a text without any has no known sentence.
HINTS = (b"version", b"creative commons", b"licen", b"permi", b"copyright", b"warranty", b"reserved", b"free", b"liable", b"released", b"distributed", b"available", b"provided", b"published")
#: Sentences end at these characters before white space, and at line ends; the second reading unwraps paragraphs first.
#: The colon of an SPDX tag ends none.
_END = re.compile(r"([.!?;:])[ \t\n]+")
_TAG = re.compile(r"([Ii][Dd][Ee][Nn][Tt][Ii][Ff][Ii][Ee][Rr]):[ \t]+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_OTHER = re.compile(r"[^a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gnu_names() -> dict[str, tuple[str, ...]]:
    """Names in notices of each published version of the GNU licences, that version only and or any later one."""
    out = {}
    for short, name, versions in GNU:
        for v in versions:
            forms = {v.replace(".", " "), v.removesuffix(".0").replace(".", " ")}
            only = [f"the gnu {name} version {f}" for f in sorted(forms)] + [f"the gnu {name} v{v.replace('.', ' ')}"]
            out[f"{short}-{v}-only"] = (*only, *(f"{x} only" for x in only))
            out[f"{short}-{v}-or-later"] = tuple(f"{x} or {y}" for x in only for y in ("later", "any later version", "at your option any later version"))
    return out


def gnu_terms() -> dict[str, str]:
    """The sentence of file headers under the GNU licences that names the version, by identifier."""
    out = {}
    for short, name, versions in GNU:
        for v in versions:
            said = v.removesuffix(".0").replace(".", " ")
            begin = f"you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation"
            out[f"{short}-{v}-or-later"] = f"{begin} either version {said} of the license or at your option any later version"
            out[f"{short}-{v}-only"] = f"{begin} version {said} of the license"
    return out


def commons_names() -> dict[str, tuple[str, ...]]:
    out = {}
    for part, words in COMMONS.items():
        for v, kind in COMMONS_VERSIONS.items():
            number, short = v.replace(".", " "), part.lower().replace("-", " ")
            long = [f"creative commons {x} {number}{y}" for x in sorted({words, words.replace("sharealike", "share alike").replace("noderivatives", "no derivatives").replace("noncommercial", "non commercial")}) for y in ("", f" {kind}")]
            out[f"CC-{part}-{v}"] = (f"cc {short} {number}", f"the cc {short} {number} license", *(f"{a}{x}{b}" for x in long for a in ("", "a ", "the ") for b in ("", " license")))
    return out


def titles() -> dict[str, str]:
    """Names that are a licence's title where they stand alone: those that say so, with a version where there are several."""
    return {name: licence for licence, names in (NAMES | commons_names()).items() for name in names if name.endswith((" license", " licence", " license mit", " international", " unported")) or "license version" in name}


def tags() -> dict[str, str]:
    """Normalised SPDX identifiers, the GNU ones of old too, which meant that version only."""
    out = {_OTHER.sub(" ", licence.translate(_LOWER)): licence for licence in ALL_NAMES}
    return out | {_OTHER.sub(" ", f"{short}-{v}".lower()): f"{short}-{v}-only" for short, _, versions in GNU for v in versions}


#: All names by licence, in the order in which their notices are tried.
ALL_NAMES = NAMES | commons_names() | gnu_names()
#: Sentences and rules of the GNU headers; rules of whole texts and headers stand before those of single notices.
SENTENCES |= {f"terms-{licence}": text for licence, text in gnu_terms().items() if text not in SENTENCES.values()}
RULES = (
    *RULES,
    *((licence, (free, f"terms-{licence}")) for licence in gnu_terms() if f"terms-{licence}" in SENTENCES for free in ("gpl-free", "lgpl-free")),
    *((licence, (f"notice-{licence}",)) for licence in ALL_NAMES),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)


def notice_pattern() -> str:
    """What a notice says around a licence's name, which is the only group; both for re and for RE2."""
    return f"^(?:(?:{'|'.join(SUBJECTS)}) (?:is|are) )?(?:{'|'.join(VERBS)})(?: the terms of)? (.+?)(?: see (?:the )?(?:{'|'.join(FILES)})(?:{'|'.join(ENDS[1:])})?)?$"


#: A GNU identifier with a plus, which normalising would lose, and what begins a normalised SPDX tag.
_PLUS, _SPDX = r"\b([AaLl]?[Gg][Pp][Ll]-[0-9.]*[0-9])\+", "spdx license identifier "


def known_sentences() -> dict[str, str]:
    """The sentences that are known as a whole, with their identifiers: the fixed ones and titles."""
    return {text: name for name, text in SENTENCES.items()} | {text: f"notice-{licence}" for text, licence in titles().items()}


class Reader:
    """Identifiers of normalised sentences: known ones, notices by their licence's name, and SPDX expressions by their parts."""

    def __init__(self, known: dict[str, str] | None = None):
        self.known, self.all = known_sentences() if known is None else known, known is None
        self.notice = re.compile(notice_pattern(), re.DOTALL)
        self.names = {name: licence for licence, names in ALL_NAMES.items() for name in names}
        self.tags = tags()

    def __call__(self, sentence: str) -> list[str]:
        if sentence in self.known:
            return [self.known[sentence]]
        if not self.all:
            return []
        if sentence.startswith(_SPDX):
            parts = re.split(" (?:or|and) ", sentence[len(_SPDX) :].replace(" or later", " orlater"))
            found = (self.tags.get(p.partition(" with ")[0].replace(" orlater", " or later")) for p in parts)
            return [f"notice-{x}" for x in found if x]
        if len(sentence) < 250 and (m := self.notice.match(sentence)) and (licence := self.names.get(m[1])):
            return [f"notice-{licence}"]
        return []


def identifiers(text: str, read: Reader, unwrap: bool) -> str:
    """Identifiers of a text's known sentences in order, each between bars. Other sentences are passed over."""
    text = re.sub(_PLUS, "\\1-or-later", _TAG.sub("\\1 ", text))
    if unwrap:
        text = "\x1d".join(p.replace("\n", " ") for p in _PARAGRAPH.split(text))
    parts = _END.sub("\\1\x1d", text).replace("\n", "\x1d").split("\x1d")
    return "".join(f"|{x}|" for p in parts for x in read(_OTHER.sub(" ", p.translate(_LOWER)).strip(" ")))


def apply_rules(sequence: str, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> set[str]:
    """Licences whose rule's identifiers stand one after the other, rules in order; what one has read is taken out."""
    found = set()
    for licence, ids in rules:
        pattern = "".join(f"|{x}|" for x in ids)
        if pattern in sequence:
            found.add(licence)
            sequence = sequence.replace(pattern, "")
    return found


def scan(df: DataFrame, *, sentences: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licences, n_licences, sentence_ids) per row, in one scan without a shuffle.

    Each text is read twice, line by line and with its paragraphs unwrapped; licences (sorted, comma-joined) are those
    of either reading, sentence_ids those of the first. Null and empty texts, and texts without a licence, give ''.
    Repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    known = {text: name for name, text in sentences.items()} if sentences is not None else None
    hints = HINTS if sentences is None else (b"",)

    def start():
        read = Reader(known)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            licences, counts, ids = [], [], []
            for text in batch.column(1).to_pylist():
                low = text.encode("utf-8", "surrogatepass").lower() if text else b""
                lines = wrapped = ""
                if low and any(h in low for h in hints):
                    lines, wrapped = identifiers(text, read, False), identifiers(text, read, True)
                found = apply_rules(lines) | apply_rules(wrapped) if lines or wrapped else set()
                licences.append(",".join(sorted(found)))
                counts.append(len(found))
                ids.append(lines)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(licences, pa.string()), pa.array(counts, pa.int64()), pa.array(ids, pa.string())], names=["doc_id", "licences", "n_licences", "sentence_ids"])

        return step

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), start, "doc_id long, licences string, n_licences long, sentence_ids string")


def oracle_sql() -> str:
    """The same in DuckDB's SQL over table documents."""
    values = ", ".join(f"('{name}', '{text}')" for text, name in known_sentences().items())
    names = ", ".join(f"('{licence}', '{name}')" for licence, forms in ALL_NAMES.items() for name in forms)
    marks = ", ".join(f"('{licence}', '{tag}')" for tag, licence in tags().items())
    steps, last = [], "seq"
    for i, (_, ids) in enumerate(RULES):
        pattern = "".join(f"|{x}|" for x in ids)
        steps.append(f"s{i} AS (SELECT *, contains(q{i}, '{pattern}') AS r{i}, replace(q{i}, '{pattern}', '') AS q{i + 1} FROM {last})")
        last = f"s{i}"
    hits = ", ".join(f"CASE WHEN r{i} THEN '{licence}' END" for i, (licence, _) in enumerate(RULES))
    return rf"""
WITH a(licence, name) AS (VALUES {names}),
g1(licence, tag) AS (VALUES {marks}),
k(id, sentence) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([Ii][Dd][Ee][Nn][Tt][Ii][Ff][Ii][Ee][Rr]):[ \t]+', '\1 ', 'g'), '{_PLUS}', '\1-or-later', 'g') AS text FROM documents),
t AS (
  SELECT doc_id, 'lines' AS kind, text FROM d
  UNION ALL
  SELECT doc_id, 'wrapped', array_to_string(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: replace(x, chr(10), ' ')), chr(29)) FROM d),
p AS (
  SELECT doc_id, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, kind, string_split(replace(regexp_replace(text, '([.!?;:])[ \t\n]+', '\1' || chr(29), 'g'), chr(10), chr(29)), chr(29)) AS parts FROM t)),
n AS (
  SELECT doc_id, kind, pos, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ') AS sentence FROM p),
s AS (
  SELECT doc_id, kind, pos, unnest(own) AS own, generate_subscripts(own, 1) AS sub
  FROM (SELECT doc_id, kind, pos, string_split(regexp_replace(replace(substr(sentence, {len(_SPDX) + 1}), ' or later', ' orlater'), ' (or|and) ', chr(30), 'g'), chr(30)) AS own FROM n WHERE starts_with(sentence, '{_SPDX}'))),
m AS (
  SELECT doc_id, kind, pos, 0 AS sub, k.id FROM n JOIN k USING (sentence)
  UNION ALL SELECT doc_id, kind, pos, 0, 'notice-' || licence FROM (SELECT *, regexp_extract(sentence, '{notice_pattern()}', 1) AS name FROM n WHERE length(sentence) < 250 AND sentence NOT IN (SELECT sentence FROM k) AND NOT starts_with(sentence, '{_SPDX}')) JOIN a USING (name)
  UNION ALL SELECT doc_id, kind, pos, sub, 'notice-' || licence FROM s JOIN g1 ON tag = replace(regexp_replace(own, ' with .*$', ''), ' orlater', ' or later')),
seq AS (
  SELECT t.doc_id, t.kind, coalesce(string_agg('|' || m.id || '|', '' ORDER BY m.pos, m.sub), '') AS ids, coalesce(string_agg('|' || m.id || '|', '' ORDER BY m.pos, m.sub), '') AS q0
  FROM (SELECT doc_id, kind FROM t) t LEFT JOIN m ON t.doc_id = m.doc_id AND t.kind = m.kind GROUP BY 1, 2),
{", ".join(steps)},
f AS (SELECT doc_id, kind, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM {last}),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(found)))) AS found, max(ids) FILTER (WHERE kind = 'lines') AS sentence_ids FROM f GROUP BY doc_id)
SELECT doc_id, array_to_string(found, ',') AS licences, CAST(len(found) AS BIGINT) AS n_licences, sentence_ids FROM g
"""
