"""Findings as spreadsheet files: a data source that writes a workbook for each partition, all of them or none.

A task streams its rows into a file of its own in a temporary folder; files get their places when all tasks are done, and
are deleted when one fails. The packages are plain zip and XML, as ``files.xlsx_records`` reads them.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "workbook"
#: Rows of a sheet, its header too; what is more goes on in another sheet.
SHEET_ROWS = 1_000_000
# Titles and columns of the deliverables, and the sheet that describes one.
COVER = "成果说明"
TITLES = {"parse": "结构化解析数据包", "compliance": "合规问题清单", "data": "数据核验结果", "anomaly": "异常评分预警及围串标线索报告"}
SHEETS = {"parse": "文档解析总览", "compliance": "合规问题清单", "data": "数据核验结果", "anomaly": "异常预警线索"}
HEADERS = {
    "parse": ("文件名称", "文档类型", "页数", "解析状态", "OCR", "章节数", "表格数", "项目名称", "采购人/招标人", "代理机构"),
    "compliance": ("问题编号", "风险等级", "问题类型", "问题描述", "原文证据", "依据条款", "原文出处", "整改建议", "最终状态"),
    "data": ("问题编号", "风险等级", "问题类型", "问题描述", "复算或比对证据", "核验依据", "原文出处", "处理建议", "排序/一致性结论"),
    "anomaly": ("线索编号", "风险等级", "异常类型", "线索描述", "证据链", "证据来源", "涉及主体", "分析依据", "处置建议"),
}
COLUMNS = {
    "parse": ("filename", "document_subtype", "page_count", "parse_status", "ocr_applied", "n_sections", "n_tables", "project_name", "tenderer", "agency"),
    "compliance": ("issue_id", "risk_level", "issue_type", "description", "evidence", "basis", "source_location", "suggestion", "final_status"),
    "data": ("issue_id", "risk_level", "issue_type", "description", "evidence", "basis", "source_location", "suggestion", "assessment"),
    "anomaly": ("issue_id", "risk_level", "issue_type", "description", "evidence", "evidence_refs", "related_entities", "basis", "suggestion"),
}
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def cell_text(value: object) -> str:
    """A cell's text as XML; signs that XML can't hold are written by number, as spreadsheets do."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", "" if value is None else str(value))
    return escape(_BAD.sub(lambda m: f"_x{ord(m[0]):04X}_", text)).replace("\r", "_x000D_")


def row_xml(values: list | tuple) -> str:
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{cell_text(v)}</t></is></c>' for v in values) + "</row>"


def write_workbook(out: object, rows: Iterator[tuple], header: tuple, sheet: str, cover: list[tuple], sheet_rows: int = SHEET_ROWS) -> int:
    """Streams rows into a workbook with its cover last; returns their number."""
    names, count = [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        more = next(rows, None)
        while more is not None or not names:
            names.append(sheet if not names else f"{sheet} {len(names) + 1}")
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                f.write(f"{_HEAD}<worksheet {_MAIN}><sheetData>{row_xml(header)}".encode())
                left = sheet_rows - 1
                while more is not None and left:
                    f.write(row_xml(more).encode())
                    count, left, more = count + 1, left - 1, next(rows, None)
                f.write(b"</sheetData></worksheet>")
        names.append(COVER)
        z.writestr(f"xl/worksheets/sheet{len(names)}.xml", f"{_HEAD}<worksheet {_MAIN}><sheetData>{''.join(map(row_xml, [*cover, ('成果记录数', count)]))}</sheetData></worksheet>")
        order = [len(names), *range(1, len(names))]  # the cover is shown first
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_MAIN} xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(names[i - 1])}" sheetId="{i}" r:id="r{i}"/>' for i in order) + "</sheets></workbook>")
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in order) + "</Relationships>")
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/></Types>')
    return count


def file_system(path: str) -> tuple[object, str]:
    """The file system of a path and the path in it, in tasks as on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class WorkbookWriter(DataSourceWriter):
    """Tasks write below ``_temporary``; what is there under another name was never committed."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        self.kind, self.rows = options["kind"], int(options.get("sheetrows", SHEET_ROWS))
        self.cover = [(TITLES[self.kind],), *((name, options.get(key, "")) for name, key in (("项目编号", "project_id"), ("项目名称", "project_name"), ("任务编号", "task_id")))]

    def write(self, iterator: Iterator[Row]) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)

        def all_rows() -> Iterator[tuple]:
            yield tuple(first)
            yield from map(tuple, iterator)

        fs, base = file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.xlsx"  # a task that runs again has another name; only one of them is committed
        fs.create_dir(f"{base}/_temporary/{self.job}", recursive=True)
        with fs.open_output_stream(f"{base}/_temporary/{self.job}/{name}") as out:
            n = write_workbook(out, all_rows(), HEADERS[self.kind], SHEETS[self.kind], self.cover, self.rows)
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.path)
        from pyarrow.fs import FileSelector

        fs.create_dir(base, recursive=True)
        old = [f.path for f in fs.get_file_info(FileSelector(base)) if f.base_name.endswith(".xlsx")] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{base}/_temporary/{self.job}/{m.name}", f"{base}/{m.name}")
        for f in old:
            fs.delete_file(f)
        self._clear(fs, base)
        with fs.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs: object, base: str) -> None:
        from pyarrow.fs import FileType

        top = f"{base}/_temporary"
        if fs.get_file_info(f"{top}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{top}/{self.job}")
        if fs.get_file_info(top).type == FileType.Directory and not fs.get_file_info(_selector(top)):
            fs.delete_dir(top)


def _selector(path: str) -> object:
    from pyarrow.fs import FileSelector

    return FileSelector(path)


class WorkbookSource(DataSource):
    """``df.write.format("workbook").option("kind", ...).mode("append" or "overwrite").save(path)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        if self.options.get("kind") not in HEADERS:
            raise ValueError(f"kind must be one of {', '.join(HEADERS)}")
        if len(schema) != len(HEADERS[self.options["kind"]]):
            raise ValueError(f"{self.options['kind']} has {len(HEADERS[self.options['kind']])} columns")
        return WorkbookWriter(dict(self.options), overwrite)


def _cell(df: DataFrame, name: str) -> Column:
    """A column as a cell: arrays a line each, maps and structs as JSON, nulls blank."""
    kind = df.schema[name].dataType.simpleString()
    if kind.startswith("array<string"):
        return F.array_join(name, "\n")
    return F.coalesce((F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")), F.lit(""))


def write_deliverable(rows: DataFrame, kind: str, path: str, *, mode: str = "overwrite", **info: str) -> None:
    """Writes rows with the columns of COLUMNS[kind] as workbooks, one for each partition that has rows.

    Missing columns are blank. Without any row there is one workbook that says so. ``info``: project_id, project_name, task_id.
    """
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(WorkbookSource)
    cells = rows.select(*[(_cell(rows, c) if c in rows.columns else F.lit("")).alias(c) for c in COLUMNS[kind]])
    if not rows.limit(1).count():
        none = "本次未形成异常线索" if kind == "anomaly" else "未形成可交付明细" if kind == "parse" else "本次未形成问题"
        cells = spark.createDataFrame([tuple(none if i == 2 else "—" if i < 2 else "" for i in range(len(COLUMNS[kind])))], ", ".join(f"{c} string" for c in COLUMNS[kind]))
    cells.write.format(FORMAT).mode(mode).options(kind=kind, **info).save(path)
