"""Files as DataFrames: text in several encodings, word and spreadsheet packages, JSON side records; errors become rows."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, page int, sheet string, start_row int, text string, rows array<array<string>>, error string"
# Encodings in the order tried, and the namespaces of the two package formats.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def decode(raw: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def text_records(raw: bytes) -> Iterator[dict]:
    yield {"kind": "text", "page": 1, "text": decode(raw)}


def docx_records(raw: bytes) -> Iterator[dict]:
    """Paragraphs as one text, titles and tables as records of their own."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
    lines = []
    for e in body if body is not None else ():
        if e.tag == f"{WORD}p":
            style = e.find(f"{WORD}pPr/{WORD}pStyle")
            lines.append(said(e))
            if style is not None and (style.get(f"{WORD}val") or "").lower().startswith("heading") and lines[-1].strip():
                yield {"kind": "title", "page": 1, "text": lines[-1].strip()}
        elif e.tag == f"{WORD}tbl":
            rows = [[said(c).strip() for c in r.iter(f"{WORD}tc")] for r in e.iter(f"{WORD}tr")]
            yield {"kind": "table", "page": 1, "rows": [r for r in rows if any(r)]}
            lines += [" | ".join(r) for r in rows if any(r)]
    yield {"kind": "text", "page": 1, "text": "\n".join(lines)}


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def xlsx_records(raw: bytes) -> Iterator[dict]:
    """Each sheet as a table from row 1, without blank rows and trailing blanks; the text names the sheet first."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        said = lambda e: re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in e.iter(f"{SHEET}t")))
        shared = [said(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            target = targets[sheet.get(RELATION)]
            rows = []
            for r in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{SHEET}row"):
                cells: list[str] = []
                for c in r.iter(f"{SHEET}c"):
                    value = c.find(f"{SHEET}v")
                    text = said(c) if c.get("t") == "inlineStr" else "" if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text or ""
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = text.strip()
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    rows.append(cells)
            name = sheet.get("name")
            yield {"kind": "table", "sheet": name, "start_row": 1, "rows": rows}
            yield {"kind": "text", "sheet": name, "text": "\n".join([f"【工作表：{name}】", *(" | ".join(r) for r in rows)])}


READERS: dict[str, Callable[[bytes], Iterator[dict]]] = {**dict.fromkeys(("txt", "md", "csv", "json"), text_records), "docx": docx_records, "xlsx": xlsx_records}


def parse(files: DataFrame) -> DataFrame:
    """Records of binary files (path, content) by suffix. Missing content, unknown suffixes and broken files give an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = {"kind": None, "page": None, "sheet": "", "start_row": None, "text": "", "rows": None, "error": ""}
        for batch in batches:
            out = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                suffix = path.rpartition(".")[2].lower()
                try:
                    if not raw:
                        raise ValueError("empty file")
                    if suffix not in READERS:
                        raise ValueError(f"no reader for {suffix}")
                    out += [blank | {"path": path} | r for r in READERS[suffix](bytes(raw))]
                except Exception as e:  # a file's fault is a row, not the job's end
                    out.append(blank | {"path": path, "kind": "error", "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(object)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.format("binaryFile").load(path))


def external_record(a: Column, b: Column) -> Column:
    """Two JSON maps as one: lists are joined, other values of ``b`` replace those of ``a`` unless blank."""

    @F.pandas_udf("string")
    def merge(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str | None, q: str | None) -> str:
            left, right = json.loads(p or "{}"), json.loads(q or "{}")
            for k, v in right.items():
                if isinstance(v, list) and isinstance(left.get(k), list):
                    left[k] = left[k] + v
                elif v not in (None, ""):
                    left[k] = v
            return json.dumps(left, ensure_ascii=False, sort_keys=True)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return merge(a, b)
