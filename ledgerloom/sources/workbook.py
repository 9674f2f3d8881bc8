"""A spreadsheet (OOXML) sink written with the standard library, and its reader for round trips."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TemplateSettings

# Header labels of a template made here, and labels of kinds.
HEADERS = {"source_file": "来源文件", "invoice_date": "发票日期", "total_incl_tax": "带税总金额", "currency": "币种", "subtotal": "税前小计", "tax": "税额", "tip": "小费/服务费", "invoice_type": "类型", "doc_kind": "单据种类", "confidence": "置信度", "notes": "备注"}
KINDS = {"invoice": "发票", "card_slip": "刷卡小票"}
#: Rows of a sheet at most, by the format.
MOST_ROWS = 1_048_576
REVIEW_COLUMNS = ["source_file", "invoice_date", "total_incl_tax", "currency", "subtotal", "tax", "tip", "doc_kind", "invoice_type", "confidence", "notes"]
# The header of the review sheet's crops, their greatest width and least row height.
CROP_HEADER, CROP_WIDTH, CROP_HEIGHT = "原图（对着改）", 300, 60

_FILLS = {"red": 2, "yellow": 3}


def _column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _cell(ref: str, value: object, style: int = 0) -> str:
    s = f' s="{style}"' if style else ""
    if value is None:
        return f'<c r="{ref}"{s}/>'
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return f'<c r="{ref}"{s}><v>{value}</v></c>'
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _row(n: int, cells: list[tuple[str, object, int]], height: float | None = None) -> str:
    tall = f' ht="{height:g}" customHeight="1"' if height else ""
    return f'<row r="{n}"{tall}>{"".join(_cell(f"{c}{n}", v, s) for c, v, s in sorted(cells, key=lambda x: _column_number(x[0])))}</row>'


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _related(links: list[tuple[str, str, str]]) -> str:
    return f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for i, kind, target in links) + "</Relationships>"


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(extension, width, height) of a PNG or JPEG; None of anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _book(sheet: str, rows: Iterable[str], images: list[tuple[int, int, bytes]] | None = None) -> bytes:
    """A workbook of one sheet of written rows, with images at (column, row), both from 0."""
    body = "".join(rows)
    placed = [(c, r, data, *size) for c, r, data in images or [] if (size := image_size(data))]
    fill = '<fill><patternFill patternType="{}">{}</patternFill></fill>'
    colours = "".join(fill.format("solid", f'<fgColor rgb="FF{c}"/>') for c in ("FFCDD2", "FFF9C4"))
    types = "application/vnd.openxmlformats-officedocument"
    extra = '<Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/>' + f'<Override PartName="/xl/drawings/drawing1.xml" ContentType="{types}.drawing+xml"/>' if placed else ""
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{extra}<Override PartName="/xl/workbook.xml" ContentType="{types}.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{types}.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": _related([("rId1", "officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _related([("rId1", "worksheet", "worksheets/sheet1.xml"), ("rId2", "styles", "styles.xml")]),
        "xl/styles.xml": f'<styleSheet xmlns="{_SHEET}"><fonts count="2"><font/><font><b/></font></fonts><fills count="4">{fill.format("none", "")}{fill.format("gray125", "")}{colours}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" applyFont="1"/><xf fillId="2" applyFill="1"/><xf fillId="3" applyFill="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheetData>{body}</sheetData>{"<drawing r:id=" + chr(34) + "rId1" + chr(34) + "/>" if placed else ""}</worksheet>',
    }
    if placed:
        drawing = "http://schemas.openxmlformats.org/drawingml/2006"
        anchors = []
        for n, (column, row, _, _, width, height) in enumerate(placed, 1):
            share = min(1.0, CROP_WIDTH / max(width, 1))
            x, y = int(width * share * 9525), int(height * share * 9525)  # pixels to the format's units
            anchors.append(
                f'<xdr:oneCellAnchor><xdr:from><xdr:col>{column}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:ext cx="{x}" cy="{y}"/><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{n}" name="crop{n}"/><xdr:cNvPicPr/></xdr:nvPicPr>'
                f'<xdr:blipFill><a:blip r:embed="rId{n}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill><xdr:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{x}" cy="{y}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic><xdr:clientData/></xdr:oneCellAnchor>'
            )
        parts["xl/drawings/drawing1.xml"] = f'<xdr:wsDr xmlns:xdr="{drawing}/spreadsheetDrawing" xmlns:a="{drawing}/main" xmlns:r="{_OFFICE}">{"".join(anchors)}</xdr:wsDr>'
        parts["xl/worksheets/_rels/sheet1.xml.rels"] = _related([("rId1", "drawing", "../drawings/drawing1.xml")])
        parts["xl/drawings/_rels/drawing1.xml.rels"] = _related([(f"rId{n}", "image", f"../media/crop{n}.{p[3]}") for n, p in enumerate(placed, 1)])
        parts |= {f"xl/media/crop{n}.{p[3]}": p[2] for n, p in enumerate(placed, 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(name, part if isinstance(part, bytes) else '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + part)
    return out.getvalue()


def _bounded(n: int, first: int) -> int:
    if n >= MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS - first} records for one sheet: use template_books")
    return n


def _fields(columns: Iterable[str], template: TemplateSettings) -> list[str]:
    return [f for f in template.columns if f in columns]


def _cells(record: dict, template: TemplateSettings) -> list[tuple[str, object, int]]:
    """The mapped cells of a record; a null leaves its cell untouched."""
    shown = {f: KINDS.get(v, v) if f == "doc_kind" else v for f, v in record.items()}
    return [(c, shown[f], 0) for f, letters in template.columns.items() if shown.get(f) is not None for c in letters]


def _default_header(template: TemplateSettings) -> tuple[int, list[tuple[str, object, int]]]:
    return template.header_row, [(letters[0], HEADERS.get(f, f), 1) for f, letters in template.columns.items()]


def filled(source: bytes, cells: Iterable[tuple[int, list[tuple[str, object, int]]]], sheet: str | None = None) -> bytes:
    """An existing workbook with cells set; all else in it stays.  A sheet that isn't there means the first."""
    from xml.etree import ElementTree as E

    E.register_namespace("", _SHEET)
    E.register_namespace("r", _OFFICE)
    old = zipfile.ZipFile(io.BytesIO(source))
    links = {r.get("Id"): r.get("Target") for r in E.fromstring(old.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), links[s.get(f"{{{_OFFICE}}}id")]) for s in E.fromstring(old.read("xl/workbook.xml")).iter(f"{{{_SHEET}}}sheet")]
    target = dict(sheets).get(sheet, sheets[0][1])
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    root = E.fromstring(old.read(path))
    data = root.find(f"{{{_SHEET}}}sheetData")
    rows = {int(r.get("r")): r for r in data}
    for n, values in cells:
        row = rows.get(n)
        if row is None:
            row = rows[n] = E.SubElement(data, f"{{{_SHEET}}}row", r=str(n))
        held = {c.get("r"): c for c in row}
        for letters, value, style in values:
            ref = f"{letters}{n}"
            before = held.get(ref)
            new = E.fromstring(_cell(ref, value, style).replace("<c ", f'<c xmlns="{_SHEET}" ', 1))
            if before is not None:
                if before.get("s"):
                    new.set("s", before.get("s"))  # the template's format stays
                row.remove(before)
            held[ref] = new
            row.append(new)
        row[:] = sorted(row, key=lambda c: _column_number(re.match("[A-Z]+", c.get("r")).group()))
    data[:] = sorted(data, key=lambda r: int(r.get("r")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in old.namelist():
            z.writestr(name, E.tostring(root, encoding="utf-8", xml_declaration=True) if name == path else old.read(name))
    return out.getvalue()


def template_book(records: DataFrame, template: TemplateSettings = TemplateSettings(), source: bytes | None = None) -> bytes:
    """The import sheet as one file: mapped fields from start_row on; a null leaves its cell, not its row, empty.

    ``source``: a template to fill, which keeps all else that is in it; without one a
    sheet with default headers is made.  One file is for people: rows come through the
    driver one partition at a time, in the order given, and are no more than a sheet
    can hold.  ``template_books`` makes as many as are needed, in tasks.
    """
    fields = _fields(records.columns, template)
    rows = ((_bounded(n, template.start_row), _cells(r.asDict(), template)) for n, r in enumerate(records.select(*fields).toLocalIterator(), template.start_row))
    if source is not None:
        return filled(source, rows, template.sheet)

    def every() -> Iterable[str]:
        yield _row(*_default_header(template))
        for n, cells in rows:
            yield _row(n, cells)

    return _book(template.sheet or "Sheet1", every())


def template_books(records: DataFrame, keys: list[str], order: list[str], template: TemplateSettings = TemplateSettings(), source: bytes | None = None, most: int = 50_000) -> DataFrame:
    """(keys, book, n, content): workbooks of at most ``most`` records of one batch each, made in tasks, by ``order``."""
    fields = _fields(records.columns, template)
    placed = records.withColumn("book_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("book", F.floor(F.col("book_row") / most).cast("int"))
    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)

    def make(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("book_row")
        found = [{f: None if v is None or v != v else v for f, v in zip(fields, values, strict=True)} for values in batch[fields].itertuples(index=False)]
        numbered = [(n, _cells(r, template)) for n, r in enumerate(found, template.start_row)]
        content = filled(source, numbered, template.sheet) if source is not None else _book(template.sheet or "Sheet1", [_row(*_default_header(template)), *(_row(n, c) for n, c in numbered)])
        head = batch[[*keys, "book"]].head(1).reset_index(drop=True)
        return head.assign(n=len(batch), content=content)

    needed = placed.select(*dict.fromkeys([*keys, "book", "book_row", *fields]))
    return needed.groupBy(*keys, "book").applyInPandas(make, f"{kinds}, book int, n int, content binary")


def _review_sheet(records: Iterable[dict]) -> bytes:
    letters = [chr(65 + i) for i in range(len(REVIEW_COLUMNS) + 1)]
    images: list[tuple[int, int, bytes]] = []
    written = [_row(1, [(c, h, 1) for c, h in zip(letters, [*[HEADERS[f] for f in REVIEW_COLUMNS], CROP_HEADER], strict=True)])]
    for n, r in enumerate(records, 2):
        notes = r["notes"] if r["notes"] is not None else []
        values = [KINDS.get(r[f], "") if f == "doc_kind" else "; ".join(notes) if f == "notes" else r[f] for f in REVIEW_COLUMNS]
        height = None
        if r.get("crop") and (size := image_size(bytes(r["crop"]))):
            images.append((len(REVIEW_COLUMNS), n - 1, bytes(r["crop"])))
            height = max(CROP_HEIGHT, size[2] * min(1.0, CROP_WIDTH / max(size[1], 1)) * 0.75)
        written.append(_row(_bounded(n, 1), [(c, v, _FILLS.get(r["colour"], 0)) for c, v in zip(letters, values, strict=False)], height))
    return _book("复核", written, images)


def review_book(records: DataFrame) -> bytes:
    """The review sheet of a few records as one file: eleven fields and the crop, red and yellow rows by the ``colour`` column.

    A ``crop`` column holds PNG or JPEG bytes; null or others leave the place empty.
    Rows come through the driver; ``review_books`` makes as many sheets as are needed, in tasks.
    """
    shown = records.select(*REVIEW_COLUMNS, "colour", *(["crop"] if "crop" in records.columns else []))
    return _review_sheet(r.asDict() for r in shown.toLocalIterator())


def review_books(records: DataFrame, keys: list[str], order: list[str], most: int = 500) -> DataFrame:
    """(keys, book, n, content): review sheets of at most ``most`` records of one batch each, made in tasks, by ``order``."""
    fields = [*REVIEW_COLUMNS, "colour", *(["crop"] if "crop" in records.columns else [])]
    placed = records.withColumn("book_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("book", F.floor(F.col("book_row") / most).cast("int"))
    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)

    def make(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("book_row")
        plain = lambda v: v if isinstance(v, (bytes, bytearray)) or hasattr(v, "__len__") else None if v is None or v != v else v
        content = _review_sheet({f: plain(v) for f, v in zip(fields, values, strict=True)} for values in batch[fields].itertuples(index=False, name=None))
        return batch[[*keys, "book"]].head(1).reset_index(drop=True).assign(n=len(batch), content=content)

    needed = placed.select(*dict.fromkeys([*keys, "book", "book_row", *fields]))
    return needed.groupBy(*keys, "book").applyInPandas(make, f"{kinds}, book int, n int, content binary")


def read_book(data: bytes) -> dict[str, str]:
    """Cell values by reference of a book written here."""
    xml = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    found = re.findall(r'<c r="([A-Z]+\d+)"[^>]*?>(?:<v>(.*?)</v>|<is><t[^>]*>(.*?)</t></is>)</c>', xml)
    return {ref: v or t for ref, v, t in found}
