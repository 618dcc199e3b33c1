"""Sinks of the export: CSV and workbooks, a part per task, so that no table passes through one."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sheet, its header included (a limit of the format).
SHEET_ROWS = 1_048_576
# The parts of a workbook with one sheet.
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_ROOT = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="exposure" sheetId="1" r:id="rId1"/></sheets></workbook>'
_LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header in every part; quotes are doubled, and null is empty."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def _cell(value) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(header: list[str], rows: Iterator[tuple]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _ROOT), ("xl/workbook.xml", _BOOK), ("xl/_rels/workbook.xml.rels", _LINKS)):
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for row in (header, *rows):
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(rows: DataFrame, per_book: int = SHEET_ROWS - 1) -> DataFrame:
    """``rows, content``: workbooks with a header each, of a partition's rows in their order, ``per_book`` at most; none for an empty table."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for frame in frames:
            held += frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
            while len(held) >= per_book:
                yield pd.DataFrame({"rows": [per_book], "content": [workbook(names, iter(held[:per_book]))]})
                held = held[per_book:]
        if held:
            yield pd.DataFrame({"rows": [len(held)], "content": [workbook(names, iter(held))]})

    flat = rows.select(*[F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() in ("date", "timestamp", "decimal", "array", "map", "struct") else F.col(f"`{f.name}`") for f in rows.schema])
    return flat.mapInPandas(run, "rows long, content binary")
