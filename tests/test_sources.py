"""Readers and record extraction on small files and tables."""

import io
import zipfile

from pyspark.sql import functions as F

from sievemark.operators import records
from sievemark.sources.files import external_record, parse


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_parse(spark):
    docx = package(**{"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>标题</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    xlsx = package(
        **{
            "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="评分" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>投标人</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.5</v></c></row><row/></sheetData></worksheet>',
        }
    )
    files = spark.createDataFrame([("a.txt", bytearray("预算".encode("gb18030"))), ("b.docx", docx), ("c.xlsx", xlsx), ("d.doc", bytearray(b"x")), ("e.txt", bytearray())], "path string, content binary")
    got = {}
    for r in parse(files).collect():
        got.setdefault((r["path"], r["kind"]), r)
    assert got["a.txt", "text"]["text"] == "预算"
    assert got["b.docx", "title"]["text"] == "标题" and got["b.docx", "table"]["rows"] == [["a"]]
    assert got["c.xlsx", "table"]["rows"] == [["投标人", "", "3.5"]] and got["c.xlsx", "text"]["text"] == "【工作表：评分】\n投标人 |  | 3.5"
    assert "no reader" in got["d.doc", "error"]["error"] and "empty" in got["e.txt", "error"]["error"]


def test_external_record(spark):
    row = spark.createDataFrame([('{"a": [1], "b": "x"}', '{"a": [2], "b": "", "c": 1}')], "p string, q string").select(external_record(F.col("p"), F.col("q")).alias("m")).first()
    assert row["m"] == '{"a": [1, 2], "b": "x", "c": 1}'


TABLES = "doc string, table_no int, page int, bidder string, rows array<array<string>>"


def test_vertical(spark):
    rows = [["投标人", "总得分", "得分", "排名", "投标报价（元）"], ["甲公司", "91.5", "5", "1", "980,000"], ["合计", "", "", "", ""], ["乙公司", "88", "4", "2", ""]]
    got = records.vertical(spark.createDataFrame([("d", 1, 1, "", rows)], TABLES)).orderBy("row").collect()
    assert [(r["bidder"], r["total_score"], r["raw_score"], r["rank"], r["bid_price"], r["row"]) for r in got] == [("甲公司", 91.5, 5.0, 1, 980000.0, 2), ("乙公司", 88.0, 4.0, 2, None, 4)]


def test_horizontal_goes_on(spark):
    a = [["评委", "张三", "李四"], ["商务标部分（20分）", "业绩（10分）", "8", "9"], ["", "信誉", "5", "x"]]
    b = [["方案", "7", "6"]]
    got = records.horizontal(spark.createDataFrame([("d", 1, 1, "甲公司", a), ("d", 2, 2, "", b)], TABLES)).collect()
    assert {(r["bidder"], r["expert"], r["factor"], r["max_score"], r["raw_score"]) for r in got} == {("甲公司", "张三", "商务标部分/业绩（10分）", 10.0, 8.0), ("甲公司", "李四", "商务标部分/业绩（10分）", 10.0, 9.0), ("甲公司", "张三", "商务标部分/信誉", None, 5.0), ("甲公司", "张三", "方案", None, 7.0), ("甲公司", "李四", "方案", None, 6.0)}


def test_merge_continued(spark):
    t = [("d", 1, 1, "", [["A", "B"], ["1", "2"]]), ("d", 2, 2, "", [["a ", "B"], ["3", "4"]]), ("d", 3, 4, "", [["A", "B"], ["5", "6"]])]
    got = records.merge_continued(spark.createDataFrame(t, TABLES)).orderBy("table_no").collect()
    assert [(r["page"], r["page_end"], r["continued"], r["rows"]) for r in got] == [(1, 2, True, [["A", "B"], ["1", "2"], ["3", "4"]]), (4, 4, False, [["A", "B"], ["5", "6"]])]


def test_submission_metadata(spark):
    body = "【工作表：投标记录】\nx | y | 1\n【工作表：文件与网络元数据】\nsupplier_code | n\nA | 甲 | u | t | W | 1.1.1.1 | m | c | L\nshort | row\n【工作表：其他】\nB | 乙 | u | t | W | 1.1.1.1 | m | c | L"
    got = records.submission_metadata(spark.createDataFrame([("d", body)], "doc string, text string"), "doc", "text").collect()
    assert [(r["supplier_code"], r["upload_ip"], r["cost_software_lock_id"]) for r in got] == [("A", "1.1.1.1", "L")]
