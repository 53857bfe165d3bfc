"""Files to text and tables: one row of ``binaryFile`` to one document.

Parsers are looked up by a file's extension. Each is a function of one file's bytes; Spark
deals the files, so nothing but one file is in memory beside a batch. Office files are zip
archives of XML, which the standard library reads.
"""

from __future__ import annotations

import datetime
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = "struct<sheet:string,headers:array<string>,rows:array<array<string>>,row_count:int>"
PARSED = f"path string, filename string, format string, content string, char_count int, tables array<{TABLE}>, meta map<string,string>, error string"


@dataclass
class Parsed:
    content: str
    tables: list[dict] = field(default_factory=list)
    meta: dict[str, object] = field(default_factory=dict)


_PARSERS: dict[str, Callable[[bytes], Parsed]] = {}


def parser(*extensions: str):
    def keep(f: Callable[[bytes], Parsed]) -> Callable[[bytes], Parsed]:
        _PARSERS.update(dict.fromkeys(extensions, f))
        return f

    return keep


def extension(filename: str) -> str:
    """The last suffix, lower-cased; empty if there is none."""
    name = filename.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def parser_for(filename: str) -> Callable[[bytes], Parsed]:
    try:
        return _PARSERS[extension(filename)]
    except KeyError:
        raise ValueError(f"no parser for {filename!r}; there are {', '.join(sorted(_PARSERS))}") from None


def parse_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, filename, format, content, char_count, tables, meta, error) of every file.

    A file without a parser, or that its parser can't read, gives a row whose ``error`` says why
    and whose content is null. Null bytes are an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                name, out, error = (where or "").rsplit("/", 1)[-1], None, None
                try:
                    out = parser_for(name)(data or b"")
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    error = str(e) or type(e).__name__
                meta = [(k, str(v)) for k, v in out.meta.items()] if out else []
                row = {"path": where, "filename": name, "format": extension(name), "content": out and out.content, "char_count": len(out.content) if out else None, "tables": out.tables if out else [], "meta": meta, "error": error}
                yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    return files.select(path, content).mapInArrow(run, PARSED)


_TEXT = pa.string()
_SCHEMA = pa.schema([
    ("path", _TEXT), ("filename", _TEXT), ("format", _TEXT), ("content", _TEXT), ("char_count", pa.int32()),
    ("tables", pa.list_(pa.struct([("sheet", _TEXT), ("headers", pa.list_(_TEXT)), ("rows", pa.list_(pa.list_(_TEXT))), ("row_count", pa.int32())]))),
    ("meta", pa.map_(_TEXT, _TEXT)), ("error", _TEXT),
])


# ---------------------------------------------------------------- text

def decoded(data: bytes) -> str:
    """UTF-8, else GBK, else UTF-8 with replacements."""
    for encoding in ("utf-8", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


@parser("txt", "md", "markdown")
def text(data: bytes) -> Parsed:
    return Parsed(decoded(data))


@parser("json")
def json_text(data: bytes) -> Parsed:
    """Objects and arrays as a markdown list; anything else as it stands."""
    raw = decoded(data)
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return Parsed(raw)
    return Parsed("\n".join(_outline(value, 0)) if isinstance(value, dict | list) else raw)


def _outline(value: dict | list, level: int) -> Iterator[str]:
    """Lines of a nested list; an empty one is an empty line."""
    keyed = isinstance(value, dict)
    if not value:
        yield ""
    for label, item in value.items() if keyed else enumerate(value, 1):
        pad = "  " * level
        if isinstance(item, dict | list):
            yield f"{pad}- **{label}**:" if keyed else f"{pad}{label}."
            yield from _outline(item, level + 1)
        else:
            yield f"{pad}- **{label}**: {item}" if keyed else f"{pad}- {item}"


# ---------------------------------------------------------------- office files

def _table(rows: list[list[str]], title: str = "") -> tuple[str, dict]:
    """A table as markdown and as data; the first row is the header."""
    line = lambda cells: f"| {' | '.join(cells)} |"
    body = [line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])]
    heading = [f"## {title}\n"] if title else []
    return "\n".join(heading + body), {"sheet": title or None, "headers": rows[0], "rows": rows[1:], "row_count": len(rows) - 1}


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _attribute(element: ElementTree.Element | None, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rsplit("}", 1)[-1] == name), None) if element is not None else None


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


#: Numbers of the built-in formats that show dates and times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _date_styles(styles: ElementTree.Element | None) -> set[int]:
    """Cell styles that show dates."""
    if styles is None:
        return set()
    shown = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter() if _local(x) == "numFmt"}
    own = {i for i, code in shown.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower()))}
    cells = next((x for x in styles if _local(x) == "cellXfs"), [])
    return {i for i, x in enumerate(cells) if int(x.get("numFmtId") or 0) in _DATE_FORMATS | own}


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> object:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in cell.iter() if _local(x) == "t")
    raw = next((x.text for x in cell if _local(x) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind in ("str", "e"):
        return raw
    number = float(raw) if re.search("[.eE]", raw) else int(raw)
    if int(cell.get("s") or 0) in dates:
        return datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(number * 86400))
    return number


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> Iterator[tuple[str, list[list[object]]]]:
    """(name, rows of values) of an .xlsx file's sheets, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        book = _part(archive, "xl/workbook.xml")
        links = _part(archive, "xl/_rels/workbook.xml.rels")
        if book is None or links is None:
            raise ValueError("not a workbook")
        target = {x.get("Id"): posixpath.normpath(posixpath.join("/xl", x.get("Target"))).lstrip("/") for x in links}
        strings = _part(archive, "xl/sharedStrings.xml")
        shared = ["".join(x.text or "" for x in item.iter() if _local(x) == "t") for item in strings] if strings is not None else []
        dates = _date_styles(_part(archive, "xl/styles.xml"))
        for sheet in (x for x in book.iter() if _local(x) == "sheet"):
            page, rows = _part(archive, target[_attribute(sheet, "id")]), []
            for row in (x for x in page.iter() if _local(x) == "row") if page is not None else ():
                cells: list[object] = []
                for cell in row:
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(_value(cell, shared, dates))
                rows.append(cells)
            yield sheet.get("name"), rows


@parser("xlsx")
def workbook(data: bytes) -> Parsed:
    """Each sheet as a table under its name: empty rows go, the first row is the header, and
    rows are as wide as it is without empty cells at its end."""
    parts, tables, n_sheets, n_rows = [], [], 0, 0
    for name, rows in sheets(data):
        n_sheets += 1
        filled = [["" if c is None else str(c) for c in row] for row in rows if any(c is not None for c in row)]
        n_rows += len(filled)
        width = max((i for i, c in enumerate(filled[0], 1) if c), default=0) if filled else 0
        if width:
            body, table = _table([(row + [""] * width)[:width] for row in filled], name)
            parts.append(body)
            tables.append(table)
    return Parsed("\n\n".join(parts), tables, {"sheet_count": n_sheets, "table_count": len(tables), "total_rows": n_rows})


def _said(paragraph: ElementTree.Element) -> str:
    signs = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((x.text or "") if _local(x) == "t" else signs.get(_local(x), "") for x in paragraph.iter()).strip()


def _cells(row: ElementTree.Element, above: list[str]) -> list[str]:
    """Texts of a row's cells; one that spans columns or goes on from above is repeated."""
    out: list[str] = []
    for cell in (x for x in row if _local(x) == "tc"):
        marks = {_local(x): x for x in cell.iter() if _local(x) in ("gridSpan", "vMerge")}
        said = "<br>".join(filter(None, (_said(p) for p in cell if _local(p) == "p"))).replace("\n", "<br>")
        if "vMerge" in marks and _attribute(marks["vMerge"], "val") in (None, "continue") and len(out) < len(above):
            said = above[len(out)]
        out += [said] * int(_attribute(marks.get("gridSpan"), "val") or 1)
    return out


@parser("docx")
def word_document(data: bytes) -> Parsed:
    """Paragraphs and tables in order: headings by their level, list items with a dash."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        document, styles = _part(archive, "word/document.xml"), _part(archive, "word/styles.xml")
    body = next((x for x in document if _local(x) == "body"), None) if document is not None else None
    if body is None:
        raise ValueError("not a document")
    names = {_attribute(s, "styleId"): _attribute(next((x for x in s if _local(x) == "name"), None), "val") or "" for s in (styles if styles is not None else ()) if _local(s) == "style"}
    parts, tables, paragraphs = [], [], 0
    for element in body:
        if _local(element) == "p":
            paragraphs += 1
            style = next((_attribute(x, "val") for x in element.iter() if _local(x) == "pStyle"), None) or ""
            name, said = names.get(style, style).lower(), _said(element)
            level = re.fullmatch(r"heading\s*(\d*)", name)
            if said and name.startswith("heading"):
                said = "#" * min(max(int(level[1]) if level and level[1] else 1, 1), 6) + " " + said
            elif said and name.startswith("list"):
                said = f"- {said}"
            if said:
                parts.append(said)
        elif _local(element) == "tbl":
            rows: list[list[str]] = []
            for row in (x for x in element if _local(x) == "tr"):
                rows.append(_cells(row, rows[-1] if rows else []))
            width = max(map(len, rows), default=0)
            if width:
                content, table = _table([row + [""] * (width - len(row)) for row in rows])
                parts.append(content)
                tables.append(table)
    return Parsed("\n\n".join(parts), tables, {"paragraph_count": paragraphs, "table_count": len(tables)})


#: Names of field types in templates.
FIELD_TYPES = {
    "string": ("string", "text", "str", "文本"),
    "number": ("number", "int", "float", "数字", "整数", "小数"),
    "date": ("date", "datetime", "日期", "时间"),
    "boolean": ("boolean", "bool", "布尔", "是否"),
}


def template_fields(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, position, name, type, required, sheet) of the fields that workbooks name as templates:
    the first row names fields, the second may give their types. A name counts once a file."""
    kinds = {word: kind for kind, words in FIELD_TYPES.items() for word in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                found: dict[str, tuple[str, str]] = {}
                for sheet, rows in sheets(data):
                    hints = rows[1] if len(rows) > 1 else []
                    for name, hint in zip(rows[0] if rows else [], hints + [None] * len(rows[0] if rows else []), strict=False):
                        name = str(name).strip() if name else ""
                        if name:
                            found.setdefault(name, (kinds.get(str(hint).lower().strip(), "string"), sheet))
                yield pa.RecordBatch.from_pydict({"path": [where] * len(found), "position": pa.array(range(len(found)), pa.int32()), "name": list(found), "type": [t for t, _ in found.values()], "required": pa.array([False] * len(found)), "sheet": [s for _, s in found.values()]}, schema=_FIELDS)

    return files.select(path, content).mapInArrow(run, "path string, position int, name string, type string, required boolean, sheet string")


_FIELDS = pa.schema([("path", _TEXT), ("position", pa.int32()), ("name", _TEXT), ("type", _TEXT), ("required", pa.bool_()), ("sheet", _TEXT)])


def results_table(results: DataFrame, fields: list[str]) -> DataFrame:
    """Extraction results (filename, success, error, fields as a map) as one column a field, in the
    order and with the headings that the service's spreadsheets have."""
    value = lambda f: F.when(F.col("success"), F.element_at("fields", F.lit(f))).alias(f)
    return results.select(F.col("filename").alias("文件名"), *(value(f) for f in fields), F.when(F.col("success"), "成功").otherwise("失败").alias("状态"), F.when(~F.col("success"), F.col("error")).alias("错误信息"))


def workbook_bytes(pages: dict[str, list[list[object]]]) -> bytes:
    """An .xlsx file of sheets by name, each a list of rows; None is an empty cell."""
    from xml.sax.saxutils import escape, quoteattr

    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    packaged = "http://schemas.openxmlformats.org/package/2006"

    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    def cell(value: object, at: str) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        write = lambda name, body: archive.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + body)
        numbers = range(1, len(pages) + 1)
        kinds = f"{packaged}/content-types"
        sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        write("[Content_Types].xml", f'<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_type}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet_type}.worksheet+xml"/>' for i in numbers) + "</Types>")
        write("_rels/.rels", f'<Relationships xmlns="{packaged}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        write("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="s{i}"/>' for i, name in zip(numbers, pages, strict=True)) + "</sheets></workbook>")
        write("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{packaged}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        for i, rows in zip(numbers, pages.values(), strict=True):
            body = "".join(f'<row r="{r}">' + "".join(cell(v, f"{letters(c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            write(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def results_workbooks(table: DataFrame, by: str, sheet: str) -> DataFrame:
    """(path, content): a workbook for each value of ``by``, of the other columns under their names.

    A group's rows make one file, so it is gathered: groups must be of a file's size."""
    names = [c for c in table.columns if c != by]

    def make(rows: pa.Table) -> pa.Table:
        body = [[r[c] for c in names] for r in rows.to_pylist()]
        return pa.table({"path": [f"{rows.column(by)[0].as_py()}.xlsx"], "content": pa.array([workbook_bytes({sheet: [names, *body]})], pa.binary())})

    return table.groupBy(by).applyInArrow(make, "path string, content binary")
